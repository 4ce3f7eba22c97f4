"""Stored results: the table of object pairs, with some pairs replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import spatial_join
from meshlake.queries.mesh import duck, shell
from meshlake.session import Scratch
from meshlake.sources import store
from meshlake.sources.fixtures import SHELL

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def s10_pair_store(spark, sf):
    """All pairs of triangles with overlapping boxes, stored by object pair; then those of every third first object are written again, with a new version; then all are read back."""
    scratch = Scratch(spark, "pair-store")
    path = f"{scratch.root}/store"
    pairs = scratch.write(spatial_join.triangle_pairs(shell(spark, sf)), "pairs")
    store.save_pairs(pairs.withColumn("version", F.lit(1)), path)
    store.save_pairs(pairs.where("obj1 % 3 = 0").withColumn("version", F.lit(2)), path)
    found = store.load_pairs(spark, path)
    return found.groupBy(F.col("obj1").cast("long").alias("obj1"), F.col("obj2").cast("long").alias("obj2"), "version").agg(F.count("*").alias("n"), F.sum("tri1").alias("of_first"), F.sum("tri2").alias("of_second"))


QUERIES["s10_pair_store"] = s10_pair_store
ORACLES["s10_pair_store"] = duck(f"""
WITH c AS (SELECT object_id, tri_id, least(ax, bx, cx) AS west, greatest(ax, bx, cx) AS east, least(ay, by, cy) AS south, greatest(ay, by, cy) AS north, least(az, bz, cz) AS low, greatest(az, bz, cz) AS high FROM ({SHELL}))
SELECT a.object_id AS obj1, b.object_id AS obj2, CASE WHEN a.object_id % 3 = 0 THEN 2 ELSE 1 END AS version, count(*) AS n, sum(a.tri_id)::BIGINT AS of_first, sum(b.tri_id)::BIGINT AS of_second
FROM c a JOIN c b ON a.object_id < b.object_id AND a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north AND a.low <= b.high AND b.low <= a.high GROUP BY ALL""")
