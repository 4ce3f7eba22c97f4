"""What operators need of the session: a shared folder for what outlives one job."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def own_root(master: str) -> str:
    """A temporary folder of this machine, which only a local session's executors can read."""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='meshlake-')}"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set in a local session, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark, "_meshlake_root", None) or own_root(spark.sparkContext.master)
        spark._meshlake_root = root
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables of one run in the shared folder: they cut lineage, survive lost executors, and go with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema: StructType) -> DataFrame:
        """Tables written before, whose names may hold a pattern. Joins don't broadcast them of themselves: files of whole numbers are so much smaller
        than their rows that Spark would send tables without a bound through the driver. F.broadcast still does."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").hint("merge")

    def drop(self, name: str = "") -> None:
        self._forget(f"{self.root}/{name}".rstrip("/"))

    def _forget(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
            return
