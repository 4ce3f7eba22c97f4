"""Incremental job: registers uploads by content, each content once, as files are added to a table of them.

    python -m jobs.upload_registry --uploads TABLE --output TABLE --checkpoint FOLDER [--config FILE]

The table (Parquet; doc_id, source, text or the columns that the config names, others are left alone) is read as a stream of files: a run takes the files that the checkpoint hasn't
seen, all of them, and ends. Each upload becomes a row of the output, partitioned by batch and status (`new`, `known`, `rejected`),
as meshlake.streaming.uploads describes. Running again without new files adds nothing; after a crash, the batch that was
not finished is done again and replaces what it had written.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from jobs.common import command, settings
from meshlake.streaming import uploads

log = logging.getLogger("upload_registry")


@dataclass(frozen=True)
class Settings:
    id_column: str = "doc_id"
    path_column: str = "source"
    content_column: str = "text"
    files_per_batch: int = 1000
    #: Formats that are accepted, with commas between; all, if empty.
    formats: str = ""
    most_bytes: int = 1 << 30

    def __post_init__(self) -> None:
        if self.files_per_batch < 1 or self.most_bytes < 0:
            raise ValueError("files_per_batch must be positive, most_bytes not negative")


def run(spark: SparkSession, source: str, output: str, checkpoint: str, chosen: Settings = Settings()) -> None:
    schema = T.StructType([T.StructField(chosen.id_column, T.LongType()), T.StructField(chosen.path_column, T.StringType()), T.StructField(chosen.content_column, T.StringType())])
    plain = source.rstrip("/")
    pattern = f"{plain[:-1]}[{plain[-1]}]"  # matches just this path; unlike a path, a pattern may also name a table that is one file
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", chosen.files_per_batch).parquet(pattern)
    formats = [f.strip() for f in chosen.formats.split(",") if f.strip()] or None
    log.info("reads what is new in %s by %s", source, checkpoint)
    query = uploads.stream(uploads.described(files, chosen.id_column, chosen.path_column, chosen.content_column, formats, chosen.most_bytes), output, checkpoint)
    query.awaitTermination()
    taken = [p["numInputRows"] for p in query.recentProgress]
    log.info("read %d uploads; %s has %d rows", sum(taken), output, uploads.records(spark, output).count())


def main() -> None:
    command(
        "upload_registry", {"uploads": "the table of uploads (Parquet)", "output": "the table of records", "checkpoint": "the stream's checkpoint"},
        lambda p: None, lambda spark, a: run(spark, a.uploads, a.output, a.checkpoint, settings(Settings, a.config, "upload_registry")),
    )


if __name__ == "__main__":
    main()
