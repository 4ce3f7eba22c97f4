"""What keeps the mesh queries in bounds on larger tables: plans, and numpy kernels against the expressions that they replace."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions.layers import over
from meshlake.operators import contact, spatial_join
from meshlake.session import Scratch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def triangles(spark, n: int = 300):
    dice = random.Random(1)
    rows = [(k % 5, k, *(dice.randrange(0, 900) for _ in range(9))) for k in range(n)]
    rows += [(7, 1000, *[5, 5, 5] * 3), (8, 1001, 0, 0, 0, 100, 0, 0, 200, 0, 0)]  # a point and a line
    return spark.createDataFrame(rows, "object_id long, tri_id long, " + ", ".join(f"{p}{c} long" for p in "abc" for c in "xyz"))


def test_written_tables_are_not_broadcast(spark):
    a, b = (Scratch(spark, "small").write(spark.range(10).withColumn("v", F.col("id") * 2), n) for n in "ab")
    assert "Broadcast" not in plan(a.join(b.groupBy("id").agg(F.max("v")), "id"))
    assert "Broadcast" in plan(a.join(F.broadcast(b), "id"))


def test_fixture_joins_are_not_broadcast(spark):
    from meshlake.sources.fixtures import SHELL, built

    assert "Broadcast" not in plan(built(spark, "/root/testdata/sf0.001", SHELL))


def test_gates_shuffle_nothing(spark):
    t = triangles(spark)
    whole = contact.measured(t)
    pairs = spatial_join.triangle_pairs(whole, kept=contact.KEPT)
    angled = Scratch(spark, "angled").write(contact.angle_gate(pairs), "pairs")
    assert "Exchange" not in plan(contact.gates(angled)) and "Exchange" not in plan(contact.gap_gate(angled))
    one = {tuple(r) for r in contact.gates(angled).collect()}
    assert one and one == {tuple(r) for r in contact.overlap_gate(contact.gap_gate(angled)).collect()}


def test_least_distances_are_those_of_the_expressions(spark):
    t = triangles(spark, 60)
    sides = [t.select(F.col("object_id").alias(f"obj{k}"), F.col("tri_id").alias(f"tri{k}"), *(F.col(f"{p}{c}").alias(f"t{k}_{p}{c}") for p in "abc" for c in "xyz")) for k in "12"]
    pairs = sides[0].crossJoin(sides[1]).where("tri1 < tri2")
    named = lambda **points: [F.col(f"{of}{c}").cast("double").alias(f"{n}{c}") for n, of in points.items() for c in "xyz"]
    corner = [over(pairs.select(*contact.PAIR, *named(p=f"t{k}_{p}", a=f"t{o}_a", b=f"t{o}_b", c=f"t{o}_c")), G.point_triangle()) for k, o in (("1", "2"), ("2", "1")) for p in "abc"]
    edge = [over(pairs.select(*contact.PAIR, *named(a=f"t1_{u}", b=f"t1_{v}", c=f"t2_{x}", d=f"t2_{y}")), G.segment_segment()) for u, v in ("ab", "bc", "ca") for x, y in ("ab", "bc", "ca")]
    for chosen, flags in ((corner, {"edges": False}), (edge, {"corners": False})):
        rows = chosen[0].select(*contact.PAIR, "distance")
        for more in chosen[1:]:
            rows = rows.union(more.select(*contact.PAIR, "distance"))
        want = {tuple(r)[:4]: r.d for r in rows.groupBy(*contact.PAIR).agg(F.min("distance").alias("d")).collect()}
        got = {tuple(r)[:4]: r.gap for r in contact.least_distances(pairs, **flags).collect()}
        assert got == want


def test_neighbours_by_points_are_those_by_numbers(spark):
    from meshlake.operators import canonical, topology
    from meshlake.sources.fixtures import SHELL, built

    t = Scratch(spark, "shell").write(built(spark, "/root/testdata/sf0.001", SHELL), "triangles").union(triangles(spark, 20))
    found = topology.neighbours(canonical.by_points(t))
    assert plan(found).count("Join") == 0
    rows = {tuple(r) for r in found.collect()}
    assert rows and rows == {tuple(r) for r in topology.neighbours(canonical.indexed(t, canonical.vertices(t))).collect()}


def test_mixed_pairs_come_once_without_a_shuffle_of_pairs(spark):
    t = triangles(spark, 150)
    mixed = spatial_join.triangle_pairs(t, "mixed")
    assert "HashAggregate" not in plan(mixed)
    rows = [tuple(r) for r in mixed.collect()]
    combined, turned = G.mixed_box(G.rotation_to((1, 1, 100)))
    boxes = over(t, [combined, turned]).select("object_id", "tri_id", *spatial_join.BOX)
    a, b = (boxes.select(*(F.col(c).alias(f"{s}_{c}") for c in boxes.columns)) for s in "lr")
    other = a.crossJoin(b).where(f"l_object_id < r_object_id AND {G.boxes_overlap('l_', 'r_')}").select("l_object_id", "r_object_id", "l_tri_id", "r_tri_id")
    assert len(rows) == len(set(rows))
    assert set(rows) == {tuple(r) for r in spatial_join.triangle_pairs(t).union(other).collect()}


def mixed_boxes(t):
    return over(t, G.mixed_box(G.rotation_to((1, 1, 100)))).select("object_id", "tri_id", *spatial_join.BOX)


def test_mixed_pairs_compare_hardly_more_than_overlap(spark, monkeypatch):
    """Mixed boxes grow with the distance from the origin. Of all pairs of rows that meet in a cell, a good part are results."""
    rows = [(k // 200, k, *(v for dx, dy in ((0, 0), (100, 0), (100, 100)) for v in (100 * (k % 40) + dx, 1_000_000 + 1000 * (k // 40) + dy, (k * 37 + dx + 13 * dy) % 47))) for k in range(4000)]
    t = spark.createDataFrame(rows, "object_id long, tri_id long, " + ", ".join(f"{p}{c} long" for p in "abc" for c in "xyz"))
    joined, compared = type(t).join, []

    def counted(left, right, on=None, how=None):
        if isinstance(on, list) and "cellx" in on:
            sizes = (side.groupBy(*on).agg(F.count("*").alias(n)) for side, n in ((left, "a"), (right, "b")))
            compared.append(joined(*sizes, on).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0)
        return joined(left, right, on, how)

    monkeypatch.setattr(type(t), "join", counted)
    pairs = spatial_join.triangle_pairs(t, "mixed").count()
    a, b = (mixed_boxes(t).select(*(F.col(c).alias(f"{s}_{c}") for c in ("object_id", "tri_id", *spatial_join.BOX))) for s in "lr")
    assert pairs >= a.crossJoin(b).where(f"l_object_id < r_object_id AND {G.boxes_overlap('l_', 'r_')}").count() > 100_000
    assert sum(compared) < 5 * pairs


def test_boxes_meet_once_by_where_they_begin(spark):
    """Equal places, points, nulls, kept columns and boxes of very different lengths, on both sides of the origin, against all pairs."""
    dice = random.Random(5)
    rows = []
    for k in range(600):
        corner = [dice.randrange(-40, 40) for _ in range(3)]
        size = [dice.choice((0, 1, 7, 30)) * (1 if dice.random() < 0.98 else 200) for _ in range(3)]
        rows.append((k % 7, k, *map(float, corner), *(float(c + e) for c, e in zip(corner, size, strict=True)), f"kept {k}"))
    rows += [(8, 1000, None, 0.0, 0.0, 1.0, 1.0, 1.0, "null"), (None, 1001, *[0.0] * 6, "null"), *((k, 1002 + k, *[0.0] * 6, "the same") for k in range(9))]
    boxes = spark.createDataFrame(rows, "object_id long, tri_id long, mnx double, mny double, mnz double, mxx double, mxy double, mxz double, kept string")
    found = [{r.l_tri_id: r.l_kept, r.r_tri_id: r.r_kept} for r in spatial_join.beginning(boxes).collect()]
    known = [r for r in rows if None not in r]
    meet = lambda p, q: p[0] != q[0] and all(p[i] <= q[i + 3] and q[i] <= p[i + 3] for i in (2, 3, 4))
    want = [{p[1]: p[-1], q[1]: q[-1]} for i, p in enumerate(known) for q in known[:i] if meet(p, q)]
    assert sorted(sorted(x.items()) for x in found) == sorted(sorted(x.items()) for x in want) and len(want) > 1000
    assert spatial_join.beginning(boxes.limit(0)).count() == 0


def test_mixed_pairs_keep_columns_of_their_own_side(spark):
    t = triangles(spark, 100).withColumn("mark", F.concat_ws("/", "object_id", "tri_id"))
    rows = {cells: sorted(map(tuple, spatial_join.triangle_pairs(t, "mixed", cells=cells, kept=["mark"]).collect())) for cells in ("grid", "kd")}
    assert rows["grid"] == rows["kd"] and all(r[0] < r[1] and r[4:] == (f"{r[0]}/{r[2]}", f"{r[1]}/{r[3]}") for r in rows["grid"])


def test_cover_of_one_half_is_on_the_sql_s_side(spark, tmp_path):
    """Two parts of a larger table whose triangles cover one half of each other: rounding alone decides, and it's that of the SQL."""
    import duckdb

    from meshlake.queries import patches as P

    sizes = {77596: 17, 77597: 23, 77636: 19, 77637: 19, 77676: 47, 77677: 47}
    spark.createDataFrame(list(sizes.items()), "p_partkey long, p_size int").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    strict = sorted(db.execute(P.ORACLES["f8_strict_threshold"]).fetchall())
    assert (388, 100387, 2, 155193) in [r[:4] for r in strict]
    assert sorted(tuple(r) for r in P.QUERIES["f8_strict_threshold"](spark, str(tmp_path)).collect()) == strict


def test_tables_of_models_are_not_broadcast(spark, tmp_path):
    from meshlake.queries import mesh
    from meshlake.sources import amf

    t = triangles(spark, 40)
    t.transform(amf.object_xml).select(F.concat(F.lit("<amf>"), "value", F.lit("</amf>"))).repartition(1).write.text(f"file://{tmp_path}/model.amf")
    found = amf.read_mesh(spark, f"file://{tmp_path}/model.amf")
    assert "Broadcast" not in plan(amf.corners(found))
    rows = mesh.QUERIES["s2_amf_scan"](spark, "/root/testdata/sf0.01")
    assert "Broadcast" not in plan(rows) and sorted(r.object_id for r in rows.collect()) == list(range(10))


def test_components_are_searched_in_tasks_or_in_rounds(spark, monkeypatch):
    import pyarrow as pa

    from meshlake.operators import chains, graph

    dice = random.Random(3)
    pairs = [(dice.randrange(150), dice.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(k, 300 + (k - 299) % 7) for k in range(300, 307)] + [(5, 5), (400, 400), (201, 200)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    nodes = edges.select(F.col("a").alias("id")).union(edges.select("b")).union(spark.createDataFrame([(999,)], "id long")).distinct()
    part = Scratch(spark, "part").write(graph.components(edges, nodes), "part")
    want = {tuple(r) for r in graph._in_rounds(edges, part, Scratch(spark, "rounds")).collect()}
    monkeypatch.setattr(graph, "multi_source_bfs", lambda *_: 1 / 0)  # no component here is too large for a task
    assert {tuple(r) for r in graph.repair_order(edges, nodes).collect()} == want and len(want) == nodes.count()
    monkeypatch.setattr(chains, "HELD", 20)
    of = dict(part.collect())
    rows = sorted((of[a], a, b) for a, b in {(min(p), max(p)) for p in pairs if p[0] != p[1]} | {(k, k) for k, c in of.items() if k == c})
    table = pa.table({"_g": [r[0] for r in rows], **{n: [r[i] for r in rows] for i, n in enumerate(("component", "a", "b"))}})
    made = [r for b in graph._searched(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    large = {c for c in of.values() if sum(r[0] == c for r in rows) > 20}
    assert large and sorted((r["component"], r["id"], r["other"]) for r in made if r["depth"] is None) == [r for r in rows if r[0] in large]
    assert {(r["id"], r["component"], r["depth"], r["place"]) for r in made if r["depth"] is not None} == {r for r in want if r[1] not in large}
