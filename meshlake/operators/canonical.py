"""From raw triangles to canonical meshes: grid, distinct vertices and triangles, stable order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions.layers import over
from meshlake.schemas import POINTS, require_columns
from meshlake.session import Scratch

#: Orders of vertices that callers can ask for.
ORDERS = {"zyx": ["z", "y", "x"], "xyz": ["x", "y", "z"], "yxz": ["y", "x", "z"]}


def quantize(triangles: DataFrame) -> DataFrame:
    """FLOAT corners as whole grid units."""
    require_columns(triangles, *POINTS)
    return triangles.select(*(c for c in triangles.columns if c not in POINTS), *(F.expr(G.quantized(p)).alias(p) for p in POINTS))


def corners(triangles: DataFrame) -> DataFrame:
    """(object_id, tri_id, corner, x, y, z): a row for each corner."""
    parts = F.array(*(F.struct(F.lit(k).alias("corner"), *(F.col(f"{p}{c}").alias(c) for c in "xyz")) for k, p in enumerate("abc")))
    return triangles.select("object_id", "tri_id", F.explode(parts).alias("v")).select("object_id", "tri_id", "v.*")


def ranked(distinct: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 in the given order, in the whole table or within groups of by. The table is ordered by ranges, and
    each range adds the sizes of those before it (of its groups in those before it): no task gets all rows or a whole large
    group. The ranges are written, as sampling their bounds again could give others."""
    by = by or []
    ordered = Scratch(distinct.sparkSession, "ranked").write(distinct.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ordered.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range")  # a group has a row for each range that it reaches
    before = sizes.select("_range", *(F.col(c).alias(f"_{c}") for c in by), (F.sum("_n").over(earlier) - F.col("_n")).alias("_before")).withColumnRenamed("_range", "_r")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = ordered.join(before if by else F.broadcast(before), same)
    inside = Window.partitionBy("_range", *by).orderBy(*order)
    return joined.withColumn(name, (F.row_number().over(inside) - 1 + F.col("_before")).cast("long")).drop("_range", "_r", "_before", *(f"_{c}" for c in by))


def vertices(triangles: DataFrame, order: str = "zyx") -> DataFrame:
    """(vid, x, y, z): distinct corners of all objects, numbered in order."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {sorted(ORDERS)}")
    return ranked(corners(triangles).select("x", "y", "z").distinct(), ORDERS[order], "vid")


def indexed(triangles: DataFrame, vertex: DataFrame) -> DataFrame:
    """(object_id, tri_id, v0 <= v1 <= v2): triangles by vertex ids."""
    ids = corners(triangles).join(vertex, ["x", "y", "z"]).groupBy("object_id", "tri_id").agg(F.array_sort(F.collect_list("vid")).alias("v"))
    return ids.select("object_id", "tri_id", *(F.col("v")[k].alias(f"v{k}") for k in range(3)))


def by_points(triangles: DataFrame) -> DataFrame:
    """(object_id, tri_id, v0, v1, v2): triangles by their corners themselves, for what only compares vertices: nothing is numbered or joined."""
    return triangles.select("object_id", "tri_id", *(F.struct(*(F.col(f"{p}{c}").alias(c) for c in "xyz")).alias(f"v{k}") for k, p in enumerate("abc")))


def unique_triangles(indexed_triangles: DataFrame) -> DataFrame:
    """(gtri, v0, v1, v2): triangles without regard to their sense, each once, in order."""
    return ranked(indexed_triangles.select("v0", "v1", "v2").distinct(), ["v0", "v1", "v2"], "gtri")


def object_triangles(indexed_triangles: DataFrame, unique: DataFrame) -> DataFrame:
    """(object_id, local_id, gtri): each object's references, duplicates kept, numbered by global id."""
    joined = indexed_triangles.join(unique, ["v0", "v1", "v2"]).select("object_id", "gtri", "tri_id")
    return ranked(joined, ["gtri", "tri_id"], "local_id", ["object_id"]).select("object_id", "local_id", "gtri")


def measured(triangles: DataFrame) -> DataFrame:
    """With normal, edges, area, box and the three grades; the tolerance follows each object's box."""
    whole = over(triangles, [*G.metrics(), *G.normal(), G.box()])
    spans = whole.groupBy("object_id").agg(*(F.expr(f"max(mx{c}) - min(mn{c})").alias(f"span{c}") for c in "xyz"))
    joined = whole.join(spans, "object_id")
    return over(joined, [{"diagonal": G.norm(tuple(f"CAST(span{c} AS DOUBLE)" for c in "xyz"))}, *G.grades("diagonal")])


def object_boxes(triangles: DataFrame) -> DataFrame:
    boxed = over(triangles, [G.box()])
    return boxed.groupBy("object_id").agg(*(F.expr(f"{f}({m}{c})").alias(f"{m}{c}") for m, f in (("mn", "min"), ("mx", "max")) for c in "xyz"))
