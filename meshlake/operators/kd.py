"""A box join whose cells follow the data: a k-d tree of median splits, fitted to a bounded sample of box centres.

The tree is the driver's: at most LEAVES leaves, from at most SAMPLE centres. Each inner node halves its centres at the median of the axis along which they
spread most, so a tall stack, a thin sheet and a dense spot all get as many leaves as they have boxes. Boxes go down the tree level by level
(a broadcast join with at most 2 * LEAVES nodes) into each leaf that they reach; both sides meet by leaf, and a pair counts only in the leaf that holds the corner where
the overlap begins, so nothing is found twice. The sample decides about balance alone, never about results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as G

SAMPLE, LEAVES, LEAF_ROWS = 20_000, 4096, 2_000
_NODE = "node int, axis int, at double, low int, high int"
_INF = float("inf")


@dataclass(frozen=True)
class Tree:
    """nodes: (node, axis, at, low, high) of inner ones; leaves: (node, from and to along each axis), to excluded."""

    axes: str
    nodes: list[tuple[int, int, float, int, int]]
    leaves: list[tuple]
    depth: int


def grown(centres: np.ndarray, axes: str, most: int) -> Tree:
    """A tree of at most so many leaves over centres (a row each), splitting the fullest leaf first; centres that are all in one place aren't split."""
    bounds = tuple((-_INF, _INF) for _ in axes)
    open_, nodes, leaves, made = [(centres, bounds, 0, 0)], [], [], 1
    while open_:
        open_.sort(key=lambda x: len(x[0]))
        rows, box, node, depth = open_.pop()
        split = None
        if len(rows) > 1 and len(open_) + len(leaves) + 2 <= most:
            for axis in np.argsort(-(rows.max(0) - rows.min(0)), kind="stable"):
                at = float(np.median(rows[:, axis]))
                at = at if (rows[:, axis] < at).any() else float(np.nextafter(at, _INF))  # many on the median itself
                if 0 < (below := int((rows[:, axis] < at).sum())) < len(rows):
                    split = int(axis), at, below
                    break
        if split is None:
            leaves.append((node, *(e for b in box for e in b), depth))
            continue
        axis, at, _ = split
        nodes.append((node, axis, at, made, made + 1))
        for k, side in enumerate((rows[rows[:, axis] < at], rows[rows[:, axis] >= at])):
            own = tuple(((b[0], at) if k == 0 else (at, b[1])) if i == axis else b for i, b in enumerate(box))
            open_.append((side, own, made + k, depth + 1))
        made += 2
    return Tree(axes, nodes, [x[:-1] for x in leaves], max(x[-1] for x in leaves))


def fitted(boxes: DataFrame, axes: str = "xyz", leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, most: int = LEAVES) -> Tree:
    """For boxes with columns mnx..mxz."""
    centres = boxes.select(*(((F.col(f"mn{c}") + F.col(f"mx{c}")) / 2).cast("double").alias(c) for c in axes))
    total = centres.count()
    hashed = F.xxhash64(*axes)
    kept = centres if total <= sample else centres.where(hashed < F.lit(int(-(1 << 63) + (1 << 65) * sample // total)))
    rows = kept.orderBy(hashed, *axes).limit(sample).toPandas().to_numpy(float).reshape(-1, len(axes))
    return grown(rows, axes, int(min(most, max(1, -(-total // leaf_rows)))))


def _pick(axis: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*(F.col(n).cast("double") for n in names)), axis + 1)


def _down(left: Column, low: Column, right: Column, high: Column) -> Column:
    """One row for each side that a box reaches."""
    return F.explode(F.filter(F.array(F.when(left, low), F.when(right, high)), lambda n: n.isNotNull()))


def assigned(boxes: DataFrame, tree: Tree) -> DataFrame:
    """Each box once for each leaf that it reaches, in the column leaf."""
    if not tree.nodes:
        return boxes.withColumn("leaf", F.lit(0))
    _, axis, at, low, high = tree.nodes[0]  # the root
    now = boxes.withColumn("leaf", _down(F.col(f"mn{tree.axes[axis]}") < at, F.lit(low), F.col(f"mx{tree.axes[axis]}") >= at, F.lit(high)))
    nodes = F.broadcast(boxes.sparkSession.createDataFrame(tree.nodes, _NODE).withColumnsRenamed({c: f"_{c}" for c in ("node", "axis", "at", "low", "high")}))  # at most LEAVES rows
    for _ in range(tree.depth - 1):
        met = now.join(nodes, F.col("leaf") == F.col("_node"), "left")
        down = [_pick(F.col("_axis"), [f"{m}{c}" for c in tree.axes]) for m in ("mn", "mx")]
        inner = F.col("_node").isNotNull()
        now = met.select(*boxes.columns, _down(~inner | (down[0] < F.col("_at")), F.coalesce("_low", "leaf"), inner & (down[1] >= F.col("_at")), F.col("_high")).alias("leaf"))
    return now


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], tree: Tree | None = None, condition: str | None = None) -> DataFrame:
    """Pairs of rows of left and right that agree in keys, meet the condition (SQL over l_ and r_ columns) and whose boxes overlap, closed. Columns of left get the
    prefix l_, those of right r_; keys stay."""
    tree = tree or fitted(left)
    sides = [assigned(df, tree).select(*keys, "leaf", *(F.col(c).alias(f"{p}{c}") for c in df.columns if c not in keys)) for p, df in (("l_", left), ("r_", right))]
    ends = [f"_{e}{c}" for c in tree.axes for e in ("from", "to")]
    leaves = F.broadcast(left.sparkSession.createDataFrame(tree.leaves, "leaf int, " + ", ".join(f"{e} double" for e in ends)))  # at most LEAVES rows
    begins = " AND ".join(f"greatest(l_mn{c}, r_mn{c}) >= _from{c} AND greatest(l_mn{c}, r_mn{c}) < _to{c}" for c in tree.axes)
    met = sides[0].join(sides[1], [*keys, "leaf"]).where(F.expr(G.boxes_overlap("l_", "r_")))
    if condition is not None:
        met = met.where(condition)
    return met.join(leaves, "leaf").where(begins).drop("leaf", *ends)
