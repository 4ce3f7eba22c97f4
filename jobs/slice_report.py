"""Batch job: slices the mesh of a part table and reports each layer of each object.

    python -m jobs.slice_report --parts TABLE --output FOLDER [--config FILE] [--bands 0 3]

Writes two tables under the output folder, each partitioned by band (so many layers of one height):

* `segments` (layer, object_id, tri_id, z, x1, y1, x2, y2, band): where each plane cuts each triangle.
* `report` (layer, object_id, z, n_segments, cut_length, area, open_ends, band): the cut's length, the area that its segments enclose (in
  the segments' sense; an object that isn't closed encloses none), and in how many points the segments that begin aren't as many as those that end: 0 for a
  watertight object.

All bands are replaced by a full run; with --bands, only these are computed and replaced, and the others stay. The report is made
from the segments as written. A run that was broken off is repaired by running it again; the same input gives the same rows.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, counted, settings
from meshlake.operators import slicing
from meshlake.sources.fixtures import GRID

log = logging.getLogger("slice_report")


@dataclass(frozen=True)
class Settings:
    #: Between two planes, in the mesh's units.
    layer_height: float = 7.0
    layers_per_band: int = 2
    #: Ends of segments count as one point if they agree to so many decimals.
    decimals: int = 6

    def __post_init__(self) -> None:
        if not self.layer_height > 0 or self.layers_per_band < 1 or self.decimals < 0:
            raise ValueError("layer_height and layers_per_band must be positive, decimals not negative")


def report(segments: DataFrame, decimals: int) -> DataFrame:
    """A row for each layer and object that a plane cuts."""
    key = ["band", "layer", "object_id"]
    exact = lambda c: F.sum(c.cast("decimal(30,9)")).cast("double")  # noqa: E731  the order of the rows mustn't show in the last digits
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    turn = F.col("x2") * F.col("y1") - F.col("x1") * F.col("y2")  # the outward side is on the right of a segment
    sums = segments.groupBy(*key).agg(F.min("z").alias("z"), F.count("*").alias("n_segments"), exact(length).alias("cut_length"), exact(turn / 2).alias("area"))
    ends = F.explode(F.array(*(F.struct(F.lit(way).alias("way"), F.round(f"x{k}", decimals).alias("x"), F.round(f"y{k}", decimals).alias("y")) for k, way in ((1, 1), (2, -1)))))
    loose = segments.select(*key, ends.alias("e")).groupBy(*key, "e.x", "e.y").agg(F.sum("e.way").alias("surplus")).where("surplus <> 0")
    loose = loose.groupBy(*key).agg(F.count("*").alias("open_ends"))
    return sums.join(loose, key, "left").na.fill(0, ["open_ends"])


def _write(df: DataFrame, path: str, some: bool) -> None:
    """Replaces the whole table, or those of its bands that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if some else "static").partitionBy("band").parquet(path)


def run(spark: SparkSession, parts: str, output: str, chosen: Settings = Settings(), bands: Sequence[int] | None = None) -> None:
    mesh = spark.sql(GRID, part=spark.read.parquet(parts))
    cut = slicing.segments(mesh, chosen.layer_height)
    cut = cut.withColumn("band", F.floor(F.col("layer") / chosen.layers_per_band).cast("int"))
    if bands is not None:
        cut = cut.where(F.col("band").isin(list(bands)))
    cut, seen = counted(cut)
    log.info("reads %s, planes every %s, bands: %s", parts, chosen.layer_height, "all" if bands is None else list(bands))
    _write(cut, f"{output}/segments", bands is not None)
    log.info("wrote %d segments to %s/segments", seen.get["rows"], output)
    written = spark.read.schema(cut.schema).parquet(f"{output}/segments")
    if bands is not None:
        written = written.where(F.col("band").isin(list(bands)))
    rows, told = counted(report(written, chosen.decimals), cuts="n_segments", loose="open_ends")
    _write(rows, f"{output}/report", bands is not None)
    log.info("wrote %d rows about %d segments, %d open ends, to %s/report", told.get["rows"], told.get["cuts"], told.get["loose"], output)


def main() -> None:
    command(
        "slice_report", {"parts": "the part table (Parquet)", "output": "a folder for the tables"},
        lambda p: p.add_argument("--bands", type=int, nargs="+", help="only these bands, from 0"),
        lambda spark, a: run(spark, a.parts, a.output, settings(Settings, a.config, "slice_report"), a.bands),
    )


if __name__ == "__main__":
    main()
