"""Directed edges chained into closed rings by pointer doubling: no task holds a ring, a slice or an object without a bound.

Groups that hold their rings whole (a slice of an object, a region) are dealt to the tasks, and those of at most HELD edges are chained there, in numpy over Arrow
batches of as many groups as HELD edges make. Larger ones, and edges without a group, are chained as rows:

Every edge is given the edge that follows it. In round k an edge knows the edge 2^k steps on, and the least edge among the next 2^k and how far
on that is; joining the table with itself doubles both. Edges whose way ends are dropped, and with them, in turn, all edges that lead to them. When a round changes
neither the number of edges nor the sum of the least ones, each edge knows the least edge of its ring (the root) and the way to it.
The number of rounds grows with the logarithm of the longest ring; each is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.session import Scratch

ROUNDS = 50
#: Edges that a task chains at once.
HELD = 1 << 17


def by_rank(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x1, y1, next) of arcs (keys, id, x1, y1, x2, y2): at each point, the n-th arc that comes in goes on with the n-th that goes out, by ids."""
    place = lambda k: F.row_number().over(Window.partitionBy(*keys, f"x{k}", f"y{k}").orderBy("id")).alias("n")
    come = arcs.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"), "id", "x1", "y1", place(2))
    go = arcs.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("id").alias("next"), place(1))
    return come.join(go, [*keys, "x", "y", "n"]).select(*keys, "id", "x1", "y1", "next")


def by_wedge(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x1, y1, next) where arcs bound a region on their left: an arc that comes in goes on with the first one clockwise from where it came, so
    that the part of the region between them touches both; rings that meet in a point stay apart."""
    ray = lambda way, at, to: F.struct(F.lit(way).alias("way"), F.col(f"x{at}").alias("x"), F.col(f"y{at}").alias("y"), F.col(f"x{to}").alias("x1"), F.col(f"y{to}").alias("y1"), F.atan2(F.col(f"y{to}") - F.col(f"y{at}"), F.col(f"x{to}") - F.col(f"x{at}")).alias("angle"))
    rays = arcs.select(*keys, "id", F.explode(F.array(ray("out", 1, 2), ray("in", 2, 1))).alias("r")).select(*keys, "id", "r.*")
    point = Window.partitionBy(*keys, "x", "y")
    around, last = point.orderBy("angle", "id"), point.orderBy(F.desc("angle"), F.desc("id"))
    before = F.coalesce(F.lag(F.struct("id", "way")).over(around), F.first(F.struct("id", "way")).over(last))
    return rays.withColumn("p", before).where("way = 'in' AND p.way = 'out'").select(*keys, "id", "x1", "y1", F.col("p.id").alias("next"))


def both_ways(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, x1, y1, next) for segments without a sense, each as two arcs: 2 * id there and 2 * id + 1 back. At each point the segments' ends are paired
    by ids. Each ring comes twice, once each way; the one whose root is even has its least segment in its own sense."""
    end = lambda k: F.struct(F.lit(k).alias("end"), *(F.col(f"{c}{k}").alias(c) for c in "xy"), *(F.col(f"{c}{3 - k}").alias(f"{c}1") for c in "xy"))
    ends = segments.select(*keys, "id", F.explode(F.array(end(1), end(2))).alias("e")).select(*keys, "id", "e.*")
    ends = ends.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "x", "y").orderBy("id", "end")) - 1)
    come = ends.select(*keys, "x", "y", "n", "x1", "y1", (2 * F.col("id") + (F.col("end") == 1).cast("long")).alias("id"))
    go = ends.select(*keys, "x", "y", F.col("n").bitwiseXOR(F.lit(1)).alias("n"), (2 * F.col("id") + (F.col("end") == 2).cast("long")).alias("next"))
    return come.join(go, [*keys, "x", "y", "n"]).select(*keys, "id", "x1", "y1", "next")


def closed(ids: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows, root, place, length of the edges that lie on rings, which these edges hold whole."""
    order = np.argsort(ids)
    n, sorted_ids = len(ids), ids[order]
    to = np.searchsorted(sorted_ids, following[order])
    to = np.where(sorted_ids[np.minimum(to, n - 1)] == following[order], to, n)
    to, root, far, step = np.append(to, n), np.append(np.arange(n), -1), np.zeros(n + 1, np.int64), 1
    while True:
        ahead = root[to]
        if (ahead >= root).all():
            break
        far = np.where(root <= ahead, far, far[to] + step)
        root, to, step = np.minimum(root, ahead), to[to], 2 * step
    on = np.flatnonzero(root[:n] >= 0)
    length = np.bincount(root[on], minlength=n)[root[on]]
    return order[on], sorted_ids[root[on]], (length - far[on]) % length, length


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows in the order of _g as tables of whole groups, HELD rows at most, and with False those of groups of more than HELD, a part at a time."""
    held, size, passed = [], 0, None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if passed is not None:
            end = int(np.searchsorted(rows["_g"].to_numpy(), passed, "right"))
            yield rows.slice(0, end), False
            rows = rows.slice(end)
            if rows.num_rows:
                passed = None
        held.append(rows)
        size += rows.num_rows
        if size <= HELD:
            continue
        whole = pa.concat_tables(held)
        groups = whole["_g"].to_numpy()
        last = int(np.searchsorted(groups, groups[-1]))
        yield whole.slice(0, last), True
        held, size = [whole.slice(last)], len(groups) - last
        if size > HELD:
            passed = groups[-1]
            yield held[0], False
            held, size = [], 0
    if held:
        yield pa.concat_tables(held), True


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges (.., _g, id, next) by _g: those on rings with root, place and length; edges of groups of more than HELD as they are."""
    for table, whole in whole_groups(batches):
        found = [pa.nulls(table.num_rows, pa.int64())] * 3
        if whole and table.num_rows:
            rows, *found = closed(table["id"].to_numpy(), table["next"].to_numpy())
            table = table.take(pa.array(rows))
        for name, values in zip(("root", "place", "length"), found, strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        yield from table.drop_columns(["_g"]).combine_chunks().to_batches()


def grouped_rings(links: DataFrame, by: Sequence[str], name: str = "rings") -> DataFrame:
    """(links' columns but next, root, place, length) of the edges on rings, as rings() gives them, for links whose rings lie within groups of by."""
    scratch = Scratch(links.sparkSession, name)
    dealt = links.withColumn("_g", F.xxhash64(*by)).repartition("_g").sortWithinPartitions("_g")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema.fields)
    done = scratch.write(dealt.mapInArrow(_near, f"{fields}, root long, place long, length long"), "near")
    found, rest = done.where("root IS NOT NULL").drop("next"), done.where("root IS NULL").drop("root", "place", "length")
    if rest.isEmpty():
        return found
    return found.unionByName(rest.drop("next").join(rings(rest.select("id", "next"), name), "id"))


def rings(links: DataFrame, name: str = "rings") -> DataFrame:
    """(id, root, place, length) of the edges that (id, next) leads around in rings: place counts from the root, the ring's least id. An id has at most one next and is the
    next of at most one."""
    scratch = Scratch(links.sparkSession, name)
    now = scratch.write(links.select("id", "next", F.col("id").alias("root"), F.lit(0).cast("long").alias("far")), "0")
    mark = None
    for k in range(ROUNDS):
        seen = now.agg(F.count("*"), F.sum(F.col("root").cast("decimal(38,0)"))).first()
        if seen == mark:
            length = now.groupBy("root").agg(F.count("*").alias("length"))
            return now.join(length, "root").select("id", "root", ((F.col("length") - F.col("far")) % F.col("length")).alias("place"), "length")
        mark = seen
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("next2"), F.col("root").alias("root2"), F.col("far").alias("far2"))
        nearer = F.col("root") <= F.col("root2")
        now = scratch.write(now.join(ahead, "next").select("id", F.col("next2").alias("next"), F.least("root", "root2").alias("root"), F.when(nearer, F.col("far")).otherwise(F.col("far2") + (1 << k)).alias("far")), str(k + 1))
        if k:
            scratch.drop(str(k - 1))
    raise RuntimeError("the rings didn't close")
