"""Graph algorithms as rounds of joins; each round is written to the shared folder, which cuts the lineage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.operators.canonical import ranked
from meshlake.operators.chains import whole_groups
from meshlake.session import Scratch


def components(edges: DataFrame, nodes: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(id, component) of the ends of edges (a, b), and of nodes (id), each by itself if no edge has it. component is the
    smallest id reachable. Large-star and small-star rounds: the number grows with the logarithm of a path's length, and a
    hub's edges are dealt out by the other end."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "0")
    mark = None
    for k in range(1, rounds + 1):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        now = scratch.write(large.join(least, "u").select(ends.alias("e")).select("e.*").where("u <> v").distinct(), str(k))
    else:
        raise RuntimeError("components didn't settle")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def multi_source_bfs(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, depth, owner, parent): breadth-first from sources (id) over undirected edges (a, b). Ties go to the smallest
    owner, then the smallest parent. Sources without edges are reached, too; edges from a node to itself lead nowhere.

    A round reads and writes its frontier alone: a neighbour of a node at depth k is at depth k - 1, k or k + 1, so only the
    last two frontiers have to be left out, however many nodes were reached before."""
    scratch = Scratch(edges.sparkSession, "bfs")
    ways = scratch.write(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "ways")
    first = sources.select("id").where("id IS NOT NULL").distinct()
    frontier = scratch.write(first.select("id", F.lit(0).cast("long").alias("depth"), F.col("id").alias("owner"), F.lit(None).cast("long").alias("parent")), "reached/0")
    near = frontier.select(F.col("id").alias("b"))
    for k in range(1, rounds + 1):
        step = frontier.select(F.col("id").alias("a"), "owner").join(ways, "a").join(near, "b", "left_anti")
        best = step.groupBy("b").agg(F.min(F.struct("owner", "a")).alias("w")).select(F.col("b").alias("id"), F.lit(k).cast("long").alias("depth"), F.col("w.owner").alias("owner"), F.col("w.a").alias("parent"))
        after = scratch.write(best, f"reached/{k}")
        if after.isEmpty():
            return scratch.read("reached/*", after.schema)
        near = after.select(F.col("id").alias("b")).union(frontier.select("id"))
        frontier = after
    raise RuntimeError("the search didn't end")


def meetings(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(a, b) edges whose ends belong to different owners."""
    owner = reached.select("id", "owner")
    joined = edges.join(owner.toDF("a", "oa"), "a").join(owner.toDF("b", "ob"), "b")
    return joined.where("oa <> ob").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def searched(component: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """component, id, depth, place of the nodes of whole components, whose edges a-b come once each; an edge from a node to itself only names it."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    of = np.empty(len(ids), np.int64)
    of[at[: len(a)]], of[at[len(a) :]] = component, component
    here, there = at, np.concatenate((at[len(a) :], at[: len(a)]))
    ways = here != there
    here, there = here[ways], there[ways]
    there = there[np.argsort(here, kind="stable")]
    degree = np.bincount(here, minlength=len(ids))
    first = np.cumsum(degree) - degree
    start = (degree == 1) | ((ids == of) & ~np.isin(of, of[degree == 1]))
    depth, frontier, k = np.where(start, 0, -1), np.flatnonzero(start), 0
    while len(frontier):
        n = degree[frontier]
        near = there[np.repeat(first[frontier] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        frontier, k = np.unique(near[depth[near] < 0]), k + 1
        depth[frontier] = k
    order = np.lexsort((ids, depth, of))
    of, ids, depth = of[order], ids[order], depth[order]
    return of, ids, depth, np.arange(len(of)) - np.searchsorted(of, of)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (_g, component, a, b) by _g: the nodes of components with depth and place; edges of components of more than HELD as they are."""
    for table, whole in whole_groups(batches):
        if not table.num_rows:
            continue
        component, a, b = (table[c].to_numpy() for c in ("component", "a", "b"))
        found = [*searched(component, a, b), None] if whole else [component, a, None, None, b]
        n = len(found[0])
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()) for v in found], ["component", "id", "depth", "place", "other"])


def repair_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component, depth, place): the order in which the nodes of each component come up for repair. The search starts at
    ends of degree one, or at the smallest node of a component without such; outer nodes come before inner ones, and smaller
    ids before larger ones. Components are dealt to the tasks, and those of at most HELD edges are searched there; larger ones are searched
    in rounds, and their places counted by ranges, so that no task holds a component without that bound."""
    scratch = Scratch(edges.sparkSession, "repair")
    part = scratch.write(components(edges, nodes), "components")
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    smallest = part.where("id = component").select("component", F.col("id").alias("a"), F.col("id").alias("b"))  # which may have no edge
    links = once.join(part.withColumnRenamed("id", "a"), "a").select("component", "a", "b").union(smallest)
    dealt = links.withColumn("_g", F.xxhash64("component")).repartition("_g").sortWithinPartitions("_g")
    done = scratch.write(dealt.mapInArrow(_searched, "component long, id long, depth long, place long, other long"), "near")
    found, rest = done.where("depth IS NOT NULL").select("id", "component", "depth", "place"), done.where("depth IS NULL")
    if rest.isEmpty():
        return found
    return found.union(_in_rounds(rest.select(F.col("id").alias("a"), F.col("other").alias("b")), part.join(rest.select("component").distinct(), "component", "left_semi"), scratch))


def _in_rounds(edges: DataFrame, part: DataFrame, scratch: Scratch) -> DataFrame:
    """repair_order's rows for the components in part (id, component), by rounds of joins."""
    degree = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().groupBy("a").agg(F.count("*").alias("degree"))
    with_degree = part.join(degree.withColumnRenamed("a", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ends = scratch.write(with_degree.where("degree = 1").select("id", "component"), "ends")
    without = part.join(ends.select("component").distinct(), "component", "left_anti").groupBy("component").agg(F.min("id").alias("id"))
    reached = multi_source_bfs(edges, ends.select("id").union(without.select("id")))
    return ranked(part.join(reached.select("id", "depth"), "id"), ["depth", "id"], "place", ["component"]).select("id", "component", "depth", "place")
