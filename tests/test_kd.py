"""The k-d join against all pairs, on planes, in stacks, in one place."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.operators import kd

BOXES = "id long, kind int, mnx double, mxx double, mny double, mxy double, mnz double, mxz double"


def table(spark, rows):
    return spark.createDataFrame([(k, k % 2, *map(float, r)) for k, r in enumerate(rows)], BOXES)


def brute(rows, same_kind=False):
    meet = lambda a, b: all(a[2 * i] <= b[2 * i + 1] and b[2 * i] <= a[2 * i + 1] for i in range(3))
    return sorted((i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i < j and meet(a, b) and (not same_kind or i % 2 == j % 2))


def found(df, keys=(), tree=None):
    return sorted((r.l_id, r.r_id) for r in kd.overlapping(df, df, list(keys), tree, "l_id < r_id").collect())


@pytest.mark.parametrize("seed", range(2))
def test_pairs_are_those_of_all_against_all(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):  # whole numbers: many edges lie on the splitting planes; a few boxes are huge
        x, y, z, n = r.randint(0, 30), r.randint(0, 30), r.randint(0, 3), r.choice([0, 1, 2, 2, 40])
        rows.append((x, x + n, y, y + r.randint(0, 2), z, z + r.randint(0, 1)))
    df = table(spark, rows)
    for leaf_rows in (1000, 20, 1):
        tree = kd.fitted(df, leaf_rows=leaf_rows)
        assert found(df, (), tree) == brute(rows), len(tree.leaves)
    assert found(df, ["kind"], kd.fitted(df, leaf_rows=20)) == brute(rows, True)
    assert found(df, (), kd.fitted(df.limit(0))) == brute(rows)  # a tree that knows nothing of the boxes: slow, not wrong


def test_a_tall_stack_is_split_by_height(spark):
    rows = [(0, 1, 0, 1, k, k + 0.5) for k in range(400)]
    df = table(spark, rows)
    tree = kd.fitted(df, leaf_rows=25)
    sizes = [r["count"] for r in kd.assigned(df, tree).groupBy("leaf").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 27 and {axis for _, axis, *_ in tree.nodes} == {2}
    assert found(df, (), tree) == []


def test_trees():
    one = kd.grown(np.zeros((50, 3)), "xyz", 64)
    assert one.nodes == [] and one.leaves == [(0, *(-np.inf, np.inf) * 3)] and one.depth == 0
    assert len(kd.grown(np.zeros((0, 3)), "xyz", 64).leaves) == 1
    mostly = kd.grown(np.array([[0.0, 0, 0]] * 90 + [[1.0, 0, 0]] * 10), "xyz", 8)  # the median itself is the commonest place
    assert len(mostly.leaves) == 2
    tree = kd.grown(np.random.default_rng(1).normal(size=(500, 3)), "xyz", 100)
    points = np.random.default_rng(2).normal(size=(200, 3))
    inside = [[all(leaf[1 + 2 * i] <= p[i] < leaf[2 + 2 * i] for i in range(3)) for leaf in tree.leaves] for p in points]
    assert len(tree.leaves) == 100 and all(sum(row) == 1 for row in inside)  # the leaves are a partition of space


def test_plan_has_no_nested_loops(spark):
    df = table(spark, [(0, 1, 0, 1, k, k + 2) for k in range(50)])
    plan = kd.overlapping(df, df, [], kd.fitted(df, leaf_rows=10), "l_id < r_id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "InPandas" not in plan
    assert kd.overlapping(df, df.limit(0), []).count() == 0 and kd.assigned(df.where(F.lit(False)), kd.fitted(df)).count() == 0
