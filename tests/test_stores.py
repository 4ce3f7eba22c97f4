"""Stored results: looked up by content, rebuilt when anything changes, verified; pairs replaced one by one, and read alone."""

from __future__ import annotations

import glob
from dataclasses import replace

import pytest
from test_mesh import cube, mesh

from meshlake.config import DEFAULT
from meshlake.plans import patches as plan
from meshlake.sources import store


def rows(df):
    return sorted(map(str, df.collect()))


def test_patches_are_built_once_for_a_content(spark, tmp_path, monkeypatch):
    built = []
    own = plan.patches
    monkeypatch.setattr(plan, "patches", lambda *a: built.append(a) or own(*a))
    two = cube(0) + cube(1, 10_000)
    root = str(tmp_path)
    first = plan.kept_patches(mesh(spark, two), root, ["links", "components"])
    assert rows(first["links"]) == rows(own(mesh(spark, two))["links"]) and len(built) == 1
    again = plan.kept_patches(mesh(spark, two[::-1]).repartition(3), root, ["links", "components"])  # the same rows in another order
    assert len(built) == 1 and {k: rows(v) for k, v in again.items()} == {k: rows(v) for k, v in first.items()}
    plan.kept_patches(mesh(spark, two), root, ["links", "objects"])  # one of them is new
    assert len(built) == 2
    plan.kept_patches(mesh(spark, cube(0) + cube(1, 10_001)), root, ["links"])  # another triangle
    plan.kept_patches(mesh(spark, two), root, ["links"], replace(DEFAULT, normal_angle=20.0))  # other parameters
    assert len(built) == 4


def test_results_that_do_not_match_are_built_again(spark, tmp_path):
    model, calls = spark.range(3).toDF("a"), []
    build = lambda: calls.append(1) or {"r": spark.range(5).toDF("b")}
    get = lambda **p: rows(store.kept(model, str(tmp_path), ["r"], build, **p)["r"])
    want = get(x=1)
    assert get(x=1) == want and len(calls) == 1
    path = store.location(str(tmp_path), "r", store.model_key(model), x=1)
    spark.range(4).toDF("b").write.mode("overwrite").parquet(f"{path}/rows")  # someone else's rows
    with pytest.raises(ValueError):
        store.load(spark, path)
    assert get(x=1) == want and len(calls) == 2
    assert get(x=2) == want and len(calls) == 3
    assert store.model_key(model) != store.model_key(spark.range(4).toDF("a")) != store.model_key(spark.range(4).toDF("b"))
    assert not store.complete(spark, f"{tmp_path}/nothing")


def test_pairs_are_replaced_alone_and_read_alone(spark, tmp_path):
    path = f"{tmp_path}/pairs"
    made = spark.createDataFrame([(a, b, t, 10 * t) for a in range(4) for b in range(a + 1, 4) for t in range(5)], "obj1 long, obj2 long, tri1 long, tri2 long")
    store.save_pairs(made, path)
    before = set(glob.glob(f"{path}/*/*/*.parquet"))
    assert rows(store.load_pairs(spark, path).selectExpr(*(f"CAST({c} AS BIGINT) AS {c}" for c in made.columns))) == rows(made)
    store.save_pairs(made.where("obj1 = 1 AND obj2 = 3").selectExpr("obj1", "obj2", "tri1 + 100 AS tri1", "tri2"), path)
    after = set(glob.glob(f"{path}/*/*/*.parquet"))
    assert {f.split("/")[-3:-1][0] + f.split("/")[-2] for f in before ^ after} == {"obj1=1obj2=3"}
    one = store.load_pairs(spark, path, [(1, 3)])
    assert sorted(r.tri1 for r in one.collect()) == [100, 101, 102, 103, 104]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan
    assert store.load_pairs(spark, path, []).count() == 0


def test_scratch_is_never_local_to_a_machine_on_a_cluster():
    from meshlake.session import own_root

    assert own_root("local[4]").startswith("file://")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        own_root("spark://host:7077")
