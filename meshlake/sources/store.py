"""Results as Parquet by content and parameters, with a check of what is read; JSON libraries and assignments."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.operators.materials import digest
from meshlake.schemas import ASSIGNMENT, MATERIAL

VERSION = 1
log = logging.getLogger("store")


def location(root: str, name: str, model_id: str, **parameters) -> str:
    """Where a result for a model and these parameters is; other parameters or another engine version, another place."""
    key = hashlib.sha256(json.dumps({"v": VERSION, **parameters}, sort_keys=True).encode()).hexdigest()[:16]
    clean = "".join(c for c in model_id if c.isalnum() or c in "_-")
    if not clean:
        raise ValueError("a model needs an id")
    return f"{root.rstrip('/')}/{name}/model={clean}/parameters={key}"


def save(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """Writes the table and its fingerprint; Spark's commit makes each visible as a whole or not at all."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/rows")
    back = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    digest(back).write.mode("overwrite").json(f"{path}/digest")
    return back


def load(spark: SparkSession, path: str, schema=None, check: bool = True) -> DataFrame:
    """Reads it back; raises ValueError where the rows aren't those of the fingerprint."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(f"{path}/rows")
    if check:
        want = spark.read.schema("n long, digest string").json(f"{path}/digest").first()
        if want is None or tuple(digest(df).first()) != tuple(want):
            raise ValueError(f"{path}: the rows aren't what was saved")
    return df


def model_key(model: DataFrame) -> str:
    """What stands for a model's content: equal for the same rows in any order of rows and columns, another one if any value changes."""
    found = digest(model).first()
    return hashlib.sha256(f"{found.n} {found.digest} {sorted(model.dtypes)}".encode()).hexdigest()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a result stands there whole: its fingerprint is written last."""
    try:
        return not spark.read.schema("n long, digest string").json(f"{path}/digest").isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def kept(model: DataFrame, root: str, results: Sequence[str], build: Callable[[], dict[str, DataFrame]], by: list[str] | None = None, **parameters) -> dict[str, DataFrame]:
    """The named results for a model's content and these parameters: read and verified if they stand under root, else built, all that are missing by one
    call of build(), and written. What doesn't match its fingerprint is built again. A lookup reads the model once and plans nothing else."""
    spark, key = model.sparkSession, model_key(model)
    paths = {name: location(root, name, key, **parameters) for name in results}
    found: dict[str, DataFrame] = {}
    for name, path in paths.items():
        if complete(spark, path):
            try:
                found[name] = load(spark, path)
            except ValueError:
                log.warning("%s doesn't match its fingerprint and is built again", path)
    if missing := [name for name in results if name not in found]:
        made = build()
        for name in missing:
            found[name] = save(made[name], paths[name], by)
    return {name: found[name] for name in results}


PAIR = ["obj1", "obj2"]


def save_pairs(pairs: DataFrame, path: str) -> None:
    """A table of rows about object pairs, partitioned by obj1 and obj2: replaces the pairs that are in pairs and leaves all others. Rows are dealt by pair, and those of a large
    pair to several files."""
    rows = pairs.hint("rebalance", *PAIR)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*PAIR).parquet(path)


def load_pairs(spark: SparkSession, path: str, only: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """All pairs, or some: then Spark opens their partitions alone."""
    found = spark.read.parquet(path)
    if only is None:
        return found
    wanted = F.lit(False)
    for a, b in only:
        wanted |= (F.col("obj1") == a) & (F.col("obj2") == b)
    return found.where(wanted)


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(MATERIAL).json(path)


def write_materials(df: DataFrame, path: str) -> None:
    df.select(*MATERIAL.fieldNames()).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_assignments(spark: SparkSession, path: str, old_path: str | None = None) -> DataFrame:
    """A row for each object of the assignment documents; the old path counts where the new one can't be read."""
    try:
        documents = spark.read.option("multiLine", True).schema(ASSIGNMENT).json(path)
    except Exception:
        if old_path is None:
            raise
        documents = spark.read.option("multiLine", True).schema(ASSIGNMENT).json(old_path)
    rows = documents.select("model_hash_id", "processing_obj_id", F.explode("objects").alias("object_id", "o"))
    return rows.select("model_hash_id", "processing_obj_id", F.col("object_id").try_cast("long").alias("object_id"), "o.*").where("object_id IS NOT NULL")


def write_assignments(df: DataFrame, path: str, model_id: str) -> None:
    """One document with all objects of a model (a handful: they are what a person assigns)."""
    body = F.struct("material_type", "material_name", "restricted_materials", "include", "exclude")
    objects = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("object_id").cast("string"), body))))
    df.agg(F.lit(1).alias("schema_version"), F.lit(model_id).alias("model_hash_id"), F.count("*").cast("int").alias("object_count"), objects.alias("objects")).write.mode("overwrite").json(path)
