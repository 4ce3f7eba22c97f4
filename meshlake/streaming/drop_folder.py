"""An extension: models that are dropped into a folder are processed as they come, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(path, modificationTime, sha256) of new files, contents seen within a day left out."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.amf").option("maxFilesPerTrigger", files).load(folder)
    hashed = raw.select("path", "modificationTime", F.sha2("content", 256).alias("sha256"))
    return hashed.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["sha256"])


def process(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls handle(new files, batch) for all there is, then stops; handle must bear being called again with a batch."""
    return arrivals(spark, folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
