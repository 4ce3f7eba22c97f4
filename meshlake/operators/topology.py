"""Neighbourhood of triangles within objects: shared edges, shared vertices, induced graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(indexed: DataFrame) -> DataFrame:
    """(object_id, tri_id, lo, hi): the distinct undirected edges of each triangle."""
    pairs = F.array(*(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    return indexed.select("object_id", "tri_id", F.explode(F.array_distinct(pairs)).alias("e")).select("object_id", "tri_id", "e.lo", "e.hi")


def neighbours(indexed: DataFrame, mode: str = "manifold") -> DataFrame:
    """(object_id, tri_id, neighbour). manifold: across edges of exactly two triangles; all: across edges of two or more."""
    if mode not in ("manifold", "all"):
        raise ValueError("mode must be manifold or all")
    e = edges(indexed)
    if mode == "manifold":
        both = e.groupBy("object_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("tri_id").alias("a"), F.max("tri_id").alias("b")).where("n = 2")
        ways = F.explode(F.array(F.struct(F.col("a").alias("tri_id"), F.col("b").alias("neighbour")), F.struct(F.col("b").alias("tri_id"), F.col("a").alias("neighbour")))).alias("w")
        return both.select("object_id", ways).select("object_id", "w.*").distinct()
    other = e.select("object_id", "lo", "hi", F.col("tri_id").alias("neighbour"))
    return e.join(other, ["object_id", "lo", "hi"]).where("tri_id <> neighbour").select("object_id", "tri_id", "neighbour").distinct()


def edge_table(indexed: DataFrame) -> DataFrame:
    """(object_id, tri_id, lo, hi, neighbour): neighbour is -1 where the edge hasn't exactly one other triangle."""
    e = edges(indexed)
    ends = e.groupBy("object_id", "lo", "hi").agg(F.count("*").alias("n"), F.min("tri_id").alias("a"), F.max("tri_id").alias("b"))
    other = F.when(F.col("n") == 2, F.when(F.col("tri_id") == F.col("a"), F.col("b")).otherwise(F.col("a"))).otherwise(F.lit(-1))
    return e.join(ends, ["object_id", "lo", "hi"]).select("object_id", "tri_id", "lo", "hi", other.cast("long").alias("neighbour"))


def vertex_triangles(indexed: DataFrame) -> DataFrame:
    """(object_id, vid, tri_ids)."""
    long = indexed.select("object_id", "tri_id", F.explode(F.array_distinct(F.array("v0", "v1", "v2"))).alias("vid"))
    return long.groupBy("object_id", "vid").agg(F.array_sort(F.collect_list("tri_id")).alias("tri_ids"))


def vertex_only(indexed: DataFrame) -> DataFrame:
    """(object_id, tri_id, neighbour) of triangles that share a vertex but aren't neighbours across an edge."""
    long = indexed.select("object_id", "tri_id", F.explode(F.array_distinct(F.array("v0", "v1", "v2"))).alias("vid"))
    other = long.select("object_id", "vid", F.col("tri_id").alias("neighbour"))
    touching = long.join(other, ["object_id", "vid"]).where("tri_id <> neighbour").select("object_id", "tri_id", "neighbour").distinct()
    return touching.join(neighbours(indexed), ["object_id", "tri_id", "neighbour"], "left_anti")


def selected(triangles: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Triangles named by include (all, if None) and not by exclude. An id that there isn't raises at once."""
    out = triangles
    for ids, how in ((include, "left_semi"), (exclude, "left_anti")):
        if ids is not None:
            named = ids.select("object_id", "tri_id")
            unknown = named.join(triangles, ["object_id", "tri_id"], "left_anti").first()
            if unknown is not None:
                raise ValueError(f"object {unknown.object_id} has no triangle {unknown.tri_id}")
            out = out.join(named, ["object_id", "tri_id"], how)
    return out


def induced(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (object_id, tri_id, neighbour) whose ends are both nodes (object_id, tri_id)."""
    ends = nodes.select("object_id", F.col("tri_id").alias("neighbour"))
    return graph.join(nodes.select("object_id", "tri_id"), ["object_id", "tri_id"], "left_semi").join(ends, ["object_id", "neighbour"], "left_semi").select("object_id", "tri_id", "neighbour")


def isolates(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without an edge among the nodes."""
    return nodes.select("object_id", "tri_id").join(induced(graph, nodes), ["object_id", "tri_id"], "left_anti")
