"""Every mesh query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SF, compared

from meshlake import registry

ORACLES = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.endswith("_whole")))  # those are the same as NAME
def test_query_matches_its_sql(spark, duck, name):
    compared(spark, duck, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.small_cases()))
def test_small_case_matches_its_sql(spark, duck, name):
    compared(spark, duck, *registry.small_cases()[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_graph_queries_see_every_meeting(spark, duck):
    from meshlake.sources import fixtures

    orders: dict[int, set[int]] = {}
    for order, nation in duck.execute("SELECT l_orderkey, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey").fetchall():
        orders.setdefault(order, set()).add(nation)
    want = {(a, b) for nations in orders.values() for a in nations for b in nations if a < b}
    assert {tuple(r) for r in fixtures.built(spark, SF, fixtures.MEETINGS).collect()} == want
    both = want | {(b, a) for a, b in want}
    roles = dict(duck.execute("SELECT n_nationkey, n_regionkey % 3 FROM nation").fetchall())
    found = QUERIES["j19_opposite_roles_whole"](spark, SF).collect()
    assert {(r.object_id, r.neighbour) for r in found} == {(a, b) for a, b in both if roles[a] != roles[b]}
    meetings = {tuple(r) for r in QUERIES["g4_meetings"](spark, SF).collect()}
    assert {(a, b) for a, b in want if a % 5 == b % 5 == 0} <= meetings <= want


def test_components_are_those_of_the_whole_mesh(spark):
    from meshlake.operators import topology
    from meshlake.queries import mesh

    links = [(r.tri_id, r.neighbour) for r in topology.neighbours(mesh.indexed(spark, SF)).collect()]
    root = {r.tri_id: r.tri_id for r in mesh.indexed(spark, SF).collect()}
    alone = set(root) - {x for link in links for x in link}
    while True:
        before = dict(root)
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert dict(QUERIES["g3_components_with_isolates_whole"](spark, SF).collect()) == root
    linked = {k: v for k, v in root.items() if k not in alone}
    assert dict(QUERIES["g2_components_whole"](spark, SF).collect()) == linked
    assert {r.id: r.component for r in QUERIES["g5_repair_order"](spark, SF).collect()} == linked


def test_library_queries_see_all_parts(spark):
    sf = "/root/testdata/sf0.01"  # more parts than the small library has
    part = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    names, fresh = {f"M{k}" for k in part}, {f"M{k}_new" for k, size in part.items() if size % 5 == 0}
    got = lambda name: {r["name"] for r in QUERIES[name](spark, sf).select("name").collect()}
    assert len(names) > 400 and fresh
    assert got("n10_property_records_whole") == got("n19_unpivot_properties_whole") == names
    assert got("f15_new_names_whole") == fresh and got("j17_upsert_library_whole") == names | fresh
    assert got("n11_remove_material_whole") == {x.removesuffix("_new") for x in fresh}
    assert QUERIES["n26_material_identity_whole"](spark, sf).first().n == len(part)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
