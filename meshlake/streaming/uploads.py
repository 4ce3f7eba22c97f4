"""Uploads as a stream: every content is taken once, however often and under whatever names it comes, and across restarts.

A record (upload_id, name, format, n_bytes, content_hash, status, reason, first_id) is written for each upload into a table partitioned by batch
and status:

* `new`: the first upload of its content, in this and all earlier batches (within a batch the smallest id, shorter ids first, then the smallest name);
* `known`: the same content came before; first_id says which upload it was;
* `rejected`: no content, or a format that isn't read, with the reason: the queue of what a person has to look at. A rejected content isn't known.

State is the table itself, keyed by content: a batch looks up its own hashes in the new records of earlier batches. A batch
that is run again (after a crash between its output and its checkpoint) sees only earlier batches and replaces its own partitions, so it gives
the same rows. Repeated rows are uploads of their own: of those alike in id and name, one is new. Null ids come after all others; names may be null.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RECORD = "upload_id string, name string, format string, n_bytes long, content_hash string, status string, reason string, first_id string, batch long"
log = logging.getLogger("uploads")


def file_name(path: Column) -> Column:
    """What stands after the last slash of a path or address without query and fragment; characters that are neither letters, digits, '_', '-' nor '.' become '_'."""
    plain = F.regexp_replace(path, r"[?#].*$", "")
    return F.regexp_replace(F.regexp_extract(plain, r"([^/\\]*)/*$", 1), r"[^\p{L}\p{N}_.-]", "_")


def file_format(name: Column) -> Column:
    """The extension in lower case, '' without one."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def described(uploads: DataFrame, upload_id: str, path: str, content: str, formats: Sequence[str] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(upload_id, name, format, n_bytes, content_hash, reason): what can be said of each upload by itself. content: text or bytes."""
    body, name = F.col(f"`{content}`").cast("binary"), file_name(F.col(f"`{path}`").cast("string"))
    rows = uploads.select(F.col(f"`{upload_id}`").cast("string").alias("upload_id"), name.alias("name"), F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("content_hash"))
    rows = rows.withColumn("format", F.coalesce(file_format(F.col("name")), F.lit("")))
    reason = F.when(F.col("content_hash").isNull(), "no content").when(F.col("n_bytes") == 0, "empty")
    if formats is not None:
        reason = reason.when(~F.col("format").isin([f.lower() for f in formats]), F.concat(F.lit("format: "), F.col("format")))
    if most_bytes is not None:
        reason = reason.when(F.col("n_bytes") > most_bytes, "too large")
    return rows.withColumn("reason", reason)


def recorded(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """Records of a batch of described uploads. earlier: (content_hash, first_id) of contents known before. A content that comes very often is reduced to
    its first upload within each task before anything is shuffled; the uploads themselves only meet the list of first ones."""
    good = rows.where("reason IS NULL")
    order = F.struct(F.col("upload_id").isNull().alias("none"), F.length("upload_id").alias("digits"), F.col("upload_id").alias("id"), F.col("name").isNull().alias("unnamed"), F.col("name").alias("name"))
    firsts = good.groupBy("content_hash").agg(F.min(order).alias("f"))
    known = earlier.select("content_hash", F.col("first_id").alias("known_id"), F.lit(True).alias("known")).dropDuplicates(["content_hash"])
    placed = firsts.join(known, "content_hash", "left").select("content_hash", F.col("f.id").alias("batch_id"), F.col("f.name").alias("batch_name"), "known_id", F.coalesce("known", F.lit(False)).alias("known"))
    met = rows.join(placed, "content_hash", "left")
    first = F.col("upload_id").eqNullSafe(F.col("batch_id")) & F.col("name").eqNullSafe(F.col("batch_name"))
    told = met.withColumn("_candidate", F.coalesce(F.col("reason").isNull() & ~F.col("known") & first, F.lit(False)))
    rest = told.where("NOT _candidate").withColumn("_turn", F.lit(0))
    alike = told.where("_candidate").groupBy(*told.columns).agg(F.count("*").alias("_copies"))  # summed in each task first
    told = rest.unionByName(alike.select(*told.columns, F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_turn")))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_turn") == 1, "new").otherwise("known")
    first_id = F.when(F.col("reason").isNull(), F.when(F.col("known"), F.col("known_id")).otherwise(F.col("batch_id")))
    return told.select("upload_id", "name", "format", "n_bytes", "content_hash", status.alias("status"), "reason", first_id.alias("first_id"))


def records(spark: SparkSession, table: str) -> DataFrame:
    """The table as it stands; no rows if nothing has been written."""
    try:
        return spark.read.schema(RECORD).parquet(table)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD)


def take(batch: DataFrame, batch_id: int, table: str) -> None:
    """Records a batch of described uploads."""
    spark = batch.sparkSession
    earlier = records(spark, table).where((F.col("batch") < batch_id) & (F.col("status") == "new"))
    rows = recorded(batch, earlier).withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "status").parquet(table)
    counts = {r.status: r["count"] for r in records(spark, table).where(F.col("batch") == batch_id).groupBy("status").count().collect()}
    log.info("batch %d: %d new, %d known, %d rejected, into %s", batch_id, *(counts.get(s, 0) for s in ("new", "known", "rejected")), table)


def stream(uploads: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Takes what the streaming table of described uploads has that the checkpoint doesn't know yet, then ends."""
    return uploads.writeStream.foreachBatch(lambda batch, k: take(batch, k, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder(spark: SparkSession, path: str, formats: Sequence[str] = ("amf",), files: int = 1000) -> DataFrame:
    """Files dropped into a folder, as a stream of described uploads; a file's path is its id. Spark gives no row for a file without bytes."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files).load(path)
    return described(found, "path", "path", "content", formats)
