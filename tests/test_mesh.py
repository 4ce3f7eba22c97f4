"""Closed-form cases, invariances and plans of the mesh operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions import materials as M
from meshlake.functions import polygons as P
from meshlake.functions.layers import over
from meshlake.operators import canonical, contact, graph, materials, slicing, spatial_join, topology
from meshlake.plans.patches import patches
from meshlake.schemas import POINTS, TRIANGLES, require_columns
from meshlake.sources import amf, store
from meshlake.streaming import drop_folder

CUBE = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 7), (0, 4, 7)]


def cube(obj: int, dx: int = 0, size: int = 10_000) -> list[tuple]:
    v = [(x * size + dx, y * size, z * size) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    return [(obj, t, *v[i], *v[j], *v[k]) for t, (i, j, k) in enumerate(CUBE)]


def mesh(spark, rows):
    return spark.createDataFrame(rows, TRIANGLES)


def test_cube(spark):
    t = mesh(spark, cube(0))
    vertex = canonical.vertices(t)
    indexed = canonical.indexed(t, vertex)
    assert vertex.count() == 8
    assert topology.edges(indexed).select("lo", "hi").distinct().count() == 18
    assert {r["count"] for r in topology.neighbours(indexed).groupBy("tri_id").count().collect()} == {3}
    near = topology.neighbours(indexed).select(F.col("tri_id").alias("a"), F.col("neighbour").alias("b"))
    assert {r.component for r in graph.components(near).collect()} == {0}
    assert over(t, G.metrics()).agg(F.sum("area")).first()[0] == pytest.approx(6e8)


def test_two_cubes_touch(spark):
    t = mesh(spark, cube(0) + cube(1, 10_000))
    vertex = canonical.vertices(t)
    assert vertex.count() == 12
    pairs = contact.contacts(t).where("area_pass").collect()
    facing = [p for p in pairs if p.cover_max > 0.99]
    assert {(p.angle, p.gap) for p in facing} == {(0.0, 0.0)}
    found = patches(t)
    assert {(r.a, r.b) for r in found["objects"].collect()} == {(0, 1), (1, 0)}


def test_shifted_squares_overlap_by_a_quarter(spark):
    def square(obj, d):
        a, b, c, e = (d, d, 0), (10_000 + d, d, 0), (10_000 + d, 10_000 + d, 0), (d, 10_000 + d, 0)
        return [(obj, 0, *a, *b, *c), (obj, 1, *a, *c, *e)]

    total = contact.contacts(mesh(spark, square(0, 0) + square(1, 5_000))).agg(F.sum("intersection_area")).first()[0]
    assert total == pytest.approx(2.5e7, rel=1e-9)


def test_far_and_degenerate_triangles_make_no_contact(spark):
    flat = [(0, 0, 0, 0, 0, 100, 0, 0, 0, 100, 0), (1, 0, 0, 0, 60, 100, 0, 60, 0, 100, 60), (2, 0, 0, 0, 0, 50, 0, 0, 100, 0, 0)]
    assert contact.contacts(mesh(spark, flat), mode="expanded").count() == 0
    assert contact.contacts(mesh(spark, [])).count() == 0


def test_quality_grades(spark):
    sliver = (0, 0, 0, 0, 0, 10_000, 0, 0, 5_000, 1, 0)
    even = (0, 1, 0, 0, 0, 10_000, 0, 0, 5_000, 8_660, 0)
    got = {r.tri_id: r.shape_grade for r in canonical.measured(mesh(spark, [sliver, even])).collect()}
    assert got == {0: 4, 1: 0}


@pytest.mark.parametrize("v", [(1, 1, 1), (0, 0, 1), (0, 0, -2), (1, 1, 100)])
def test_rotation(v):
    z = np.array(G.rotation_to(v)) @ [0, 0, 1]
    assert np.allclose(z, np.array(v) / np.linalg.norm(v))


def test_rotation_needs_a_direction():
    with pytest.raises(ValueError):
        G.rotation_to((0, 0, 0))


def nearest(p, tri):
    """Distance of a point to a triangle by dense barycentric search, refined."""
    a, b, c = tri
    best = math.inf
    for u in np.linspace(0, 1, 201):
        v = np.linspace(0, 1 - u, 201)
        q = a + u * (b - a) + v[:, None] * (c - a)
        best = min(best, np.sqrt(((q - p) ** 2).sum(1)).min())
    return best


def test_point_triangle_distance(spark):
    r = np.random.default_rng(4)
    rows = [tuple(map(float, r.normal(0, 3, 12))) for _ in range(25)]
    df = spark.createDataFrame(rows, [f"{n}{c}" for n in "pabc" for c in "xyz"])
    got = [x.distance for x in over(df, G.point_triangle()).select("distance").collect()]
    want = [nearest(np.array(x[:3]), np.array(x[3:]).reshape(3, 3)) for x in rows]
    assert np.allclose(got, want, atol=0.05)


def test_segment_distance_is_symmetric(spark):
    r = np.random.default_rng(5)
    rows = [tuple(map(float, r.normal(0, 3, 12))) for _ in range(50)]
    names = [f"{n}{c}" for n in "abcd" for c in "xyz"]
    one = [x.distance for x in over(spark.createDataFrame(rows, names), G.segment_segment()).collect()]
    other = [x.distance for x in over(spark.createDataFrame([x[6:] + x[:6] for x in rows], names), G.segment_segment()).collect()]
    assert np.allclose(one, other)
    ends = [min(np.linalg.norm(np.array(x[i : i + 3]) - x[j : j + 3]) for i in (0, 3) for j in (6, 9)) for x in rows]
    assert all(a <= b + 1e-9 for a, b in zip(one, ends, strict=True))


def test_quantize_equals_numpy(spark):
    v = np.random.default_rng(6).uniform(-200, 200, 900).astype(np.float32)
    rows = [(0, i, *map(float, v[9 * i : 9 * i + 9])) for i in range(100)]
    schema = "object_id long, tri_id long, " + ", ".join(f"{p} float" for p in POINTS)
    got = np.array([[r[p] for p in POINTS] for r in canonical.quantize(spark.createDataFrame(rows, schema)).orderBy("tri_id").collect()]).ravel()
    assert (got == (np.round(v, 4) * np.float32(10**4)).astype(np.int64)).all()


def test_join_has_no_nested_loops_and_finds_wide_boxes(spark):
    t = mesh(spark, cube(0) + cube(1, 9_000, 50) + cube(2, 0, 3_000_000))
    pairs = spatial_join.triangle_pairs(t)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString()
    boxes = over(t, [G.box()]).collect()
    want = {(a.object_id, b.object_id, a.tri_id, b.tri_id) for a in boxes for b in boxes if a.object_id < b.object_id and all(a[f"mn{c}"] <= b[f"mx{c}"] and b[f"mn{c}"] <= a[f"mx{c}"] for c in "xyz")}
    got = [tuple(r) for r in pairs.select("obj1", "obj2", "tri1", "tri2").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_relabelled_rows_give_the_same_patches(spark):
    rows = cube(0) + cube(1, 10_000)
    a = {tuple(r) for r in patches(mesh(spark, rows))["components"].collect()}
    b = {tuple(r) for r in patches(mesh(spark, rows[::-1]).repartition(5))["components"].collect()}
    assert a == b


def test_cube_slice_is_a_square(spark):
    t = mesh(spark, cube(0))
    s = slicing.segments(t, 2_500.0)
    assert {r.layer for r in s.collect()} == {0, 1, 2, 3}
    made = slicing.normalized(slicing.loops(s, scale=1), scale=1).collect()
    assert len(made) == 4 and {r.signed_area for r in made} == {1e8}
    assert all(r.pts[0] == min(r.pts) for r in made)


def test_chaining(spark):
    edges = [(0, 0, 40.0, 0.0, 40.0, 30.0), (0, 0, 0.0, 30.0, 0.0, 0.0), (0, 0, 0.0, 0.0, 40.0, 0.0), (0, 0, 40.0, 30.0, 0.0, 30.0), (0, 1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(edges, "layer long, object_id long, x1 double, y1 double, x2 double, y2 double")
    (loop,) = slicing.loops(df).collect()
    assert len(loop.pts) == 4 and loop.object_id == 0
    turned = df.select("layer", "object_id", F.when(F.col("x1") == 40, F.col("x2")).otherwise(F.col("x1")).alias("x1"), F.when(F.col("x1") == 40, F.col("y2")).otherwise(F.col("y1")).alias("y1"), F.when(F.col("x1") == 40, F.col("x1")).otherwise(F.col("x2")).alias("x2"), F.when(F.col("x1") == 40, F.col("y1")).otherwise(F.col("y2")).alias("y2"))
    assert slicing.loops(turned, directed=False).count() == 1


@pytest.mark.parametrize(("how", "a", "b", "areas"), [("union", (0, 0, 40, 30), (20, 10, 60, 40), [2000]), ("difference", (0, 0, 60, 40), (20, -10, 40, 50), [800, 800]), ("intersection", (0, 0, 40, 30), (20, 10, 60, 40), [400])])
def test_regions(how, a, b, areas):
    rect = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    area = lambda r: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(r, r[1:] + r[:1], strict=True)) / 2
    assert sorted(map(area, slicing.combined([rect(*a)], [rect(*b)], how))) == pytest.approx(areas)


def test_offset(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (20, 0), (20, 40), (0, 40))]
    df = spark.createDataFrame([(1, ring)], "key int, ring array<struct<x: double, y: double>>")
    assert slicing.offset_rings(df, 2.0).first().area == pytest.approx(1056)
    assert len(slicing.offset([(p["x"], p["y"]) for p in ring], 2.0)) == 4


def test_polygons_of_few_points(spark):
    df = spark.createDataFrame([(1, []), (2, [{"x": 1.0, "y": 2.0}])], "k int, q array<struct<x: double, y: double>>")
    rows = df.select("k", P.signed_area(F.col("q")).alias("a"), P.cleaned(F.col("q")).alias("c"), P.aligned(F.col("q")).alias("s")).orderBy("k").collect()
    assert [r.a for r in rows] == [0.0, 0.0] and [len(r.c) for r in rows] == [0, 1]


def test_bfs_and_repair(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 9), (9, 7)], "a long, b long")
    reached = {r.id: (r.depth, r.owner) for r in graph.multi_source_bfs(e, spark.createDataFrame([(1,), (4,)], "id long")).collect()}
    assert reached == {1: (0, 1), 2: (1, 1), 3: (1, 4), 4: (0, 4)}
    order = {r.id: r.place for r in graph.repair_order(e, spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 7, 8, 9)], "id long")).collect()}
    assert order[1] < order[2] and order[4] < order[3] and order[7] == 0


def test_search_reads_frontiers_alone(spark):
    """A comb: a long path with teeth, two sources, a loop at a node, a source without edges and one that is NULL; held against a queue."""
    from collections import deque

    links = [(k, k + 1) for k in range(25)] + [(k, 100 + k) for k in range(0, 25, 3)] + [(100, 103), (5, 5), (25, 0), (7, 19)]
    ways: dict[int, set[int]] = {}
    for a, b in links:
        ways.setdefault(a, set()).add(b)
        ways.setdefault(b, set()).add(a)
    depth, queue = {4: 0, 17: 0, 900: 0}, deque((4, 17, 900))
    while queue:
        a = queue.popleft()
        for b in ways.get(a, ()):
            if b not in depth:
                depth[b] = depth[a] + 1
                queue.append(b)
    owner = {s: s for s in (4, 17, 900)}
    parent: dict[int, int | None] = dict.fromkeys(owner)
    for n in sorted(set(depth) - set(owner), key=depth.get):
        owner[n], parent[n] = min((owner[m], m) for m in ways[n] if depth[m] == depth[n] - 1)
    found = graph.multi_source_bfs(spark.createDataFrame(links, "a long, b long"), spark.createDataFrame([(4,), (17,), (17,), (900,), (None,)], "id long")).collect()
    assert len(found) == len(depth) and {r.id: (r.depth, r.owner, r.parent) for r in found} == {n: (depth[n], owner[n], parent[n]) for n in depth}


def test_places_of_one_group_come_from_many_ranges(spark):
    n = 3000
    group = F.when(F.col("id") % 10 < 9, 1).when(F.col("id") % 20 == 9, 2)
    df = spark.range(n).select(group.alias("g"), ((F.col("id") * 7919) % n).alias("v"))
    want, sizes = {}, {}
    for g, v in sorted((r.g or 0, r.v) for r in df.collect()):
        want[g, v] = sizes.get(g, 0)
        sizes[g] = sizes.get(g, 0) + 1
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # or rows as few as these go to one range
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        assert df.repartitionByRange("g", "v").where("g = 1").select(F.spark_partition_id()).distinct().count() > 1
        got = {(r.g or 0, r.v): r.place for r in canonical.ranked(df, ["v"], "place", ["g"]).collect()}
    finally:
        spark.conf.set(setting, before)
    assert got == want


def test_amf(spark, tmp_path):
    body = "".join(f"<vertex><coordinates><x>{x}</x><y>{y}</y><z>0</z></coordinates></vertex>" for x, y in ((0, 0), (1, 0), (0, 1)))
    good = f'<object id="5"><mesh><vertices><vertex/>{body}</vertices><volume><color><r>1</r><g>0</g><b>0</b></color><triangle><v1>0</v1><v2>1</v2><v3>2</v3></triangle></volume></mesh></object>'
    bare = f'<object id="6"><mesh><vertices>{body}</vertices><volume><triangle><v1>0</v1><v2>2</v2><v3>1</v3></triangle></volume></mesh></object>'
    path = tmp_path / "m.amf"
    path.write_text(f"<amf>{good}{bare}</amf>")
    found = amf.read_mesh(spark, str(path))
    assert {(r.mesh_id, r.color.r) for r in found["meshes"].collect()} == {(0, 1.0), (1, 0.5)}
    assert found["vertices"].count() == 6 and found["triangles"].count() == 2
    assert amf.corners(found).count() == 2
    import hashlib

    assert amf.content_hashes(spark, str(path)).first().sha256 == hashlib.sha256(path.read_bytes()).hexdigest()
    with pytest.raises(FileNotFoundError):
        amf.read_mesh(spark, str(tmp_path / "no.amf"))
    (tmp_path / "m.stl").write_text("")
    with pytest.raises(ValueError):
        amf.read_mesh(spark, str(tmp_path / "m.stl"))


def test_amf_rejections(spark, tmp_path):
    """Broken objects and files become rows with a reason; all tables number the objects that are left alike; models go by content."""
    import hashlib

    def one(k: int, x: str = "0") -> str:
        return f'<object id="{k}"><mesh><vertices><vertex><coordinates><x>{x}</x><y>{k}</y><z>0</z></coordinates></vertex></vertices><volume><triangle><v1>0</v1><v2>0</v2><v3>0</v3></triangle></volume></mesh></object>'

    texts = {"a": f"<amf>{one(1)}{one(2, 'left')}{one(3)}</amf>\n<!-- end -->\n", "cut": f"<amf>{one(4)}<object>", "blank": "\n", "none": "<amf><metadata/></amf>", "prefixed": f"<amf:amf>{one(6)}</amf:amf>"}
    texts["copy of a"] = texts["a"]
    for name, text in texts.items():
        (tmp_path / f"{name}.amf").write_text(text)
    files = amf.scanned_files(spark, f"{tmp_path}/*.amf")
    objects = amf.raw_objects(spark, f"{tmp_path}/*.amf", files)
    base = lambda r: r.path.split("/")[-1].replace("%20", " ").removesuffix(".amf")
    sha = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}
    assert {base(r): (r.model_id, r.reason) for r in files.collect()} == {n: (sha[n], {"cut": "cut off", "blank": "cut off", "copy of a": "repeated"}.get(n)) for n in texts}
    assert sorted((base(r), r.reason, "left" in (r.record or "")) for r in amf.rejected(files, objects).collect()) == [("a", "broken object", True), ("blank", "cut off", False), ("cut", "cut off", False), ("none", "no object", False)]
    found = amf.tables(objects)
    assert sorted((base(r), r.mesh_id) for r in found["meshes"].collect()) == [("a", 0), ("a", 1), ("prefixed", 0)]
    assert sorted((r.model_id == sha["a"], r.mesh_id, r.y) for r in found["vertices"].collect()) == [(False, 0, 6.0), (True, 0, 1.0), (True, 1, 3.0)]
    assert sorted((r.model_id == sha["a"], r.mesh_id) for r in found["triangles"].collect()) == [(False, 0), (True, 0), (True, 1)]


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.amf", "b.amf", "c.txt"):
        (tmp_path / "in" / name).write_text("<amf/>")
    seen: list[str] = []
    q = drop_folder.process(spark, str(tmp_path / "in"), str(tmp_path / "checkpoint"), lambda df, _: seen.extend(r.path for r in df.collect()))
    q.awaitTermination(60)
    assert len(seen) == 1  # two files, one content


def test_store_checks_what_it_reads(spark, tmp_path):
    path = store.location(str(tmp_path), "t", "m/1", x=1)
    assert path != store.location(str(tmp_path), "t", "m/1", x=2)
    store.save(spark.range(5).toDF("a"), path)
    assert store.load(spark, path).count() == 5
    spark.range(6).toDF("a").write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        store.load(spark, path)


def test_materials_round_trip(spark, tmp_path):
    rows = [("1", "PLA", None, 1.0, 2.0, {"PLA": 1.0}, 1.24, None, 0.3)]
    from meshlake.schemas import MATERIAL

    store.write_materials(spark.createDataFrame(rows, MATERIAL), str(tmp_path / "m"))
    assert [tuple(r) for r in store.read_materials(spark, str(tmp_path / "m")).collect()] == rows
    a = spark.createDataFrame([(3, "source", "PLA", ["ABS"], [1], [2])], "object_id long, material_type string, material_name string, restricted_materials array<string>, include array<int>, exclude array<int>")
    store.write_assignments(a, str(tmp_path / "a"), "model")
    assert store.read_assignments(spark, str(tmp_path / "none"), str(tmp_path / "a")).first().material_name == "PLA"


def test_compositions(spark):
    df = spark.createDataFrame([("PLA:0.2, ABS:0.8",), ("PLA:x",), ("",), ("PLA",), (None,)], "t string")
    c = M.parsed(F.col("t"))
    rows = df.select(c.alias("c"), M.formatted(c).alias("f"), M.display_name(c).alias("d"), M.display_name(c, F.lit("x")).alias("s"), M.valid(c).alias("v"), M.strict_label(F.col("t")).alias("l")).collect()
    assert [r.c for r in rows] == [{"PLA": 0.2, "ABS": 0.8}, None, None, {"PLA": 1.0}, None]
    assert (rows[0].f, rows[0].d, rows[0].s, rows[0].v, rows[1].l) == ("ABS:0.8,PLA:0.2", "ABS:800_PLA:200", "ABS:800_PLA:200_x", True, "PLA:x")
    with pytest.raises(Exception, match="shares"):
        df.select(M.checked(F.create_map(F.lit("PLA"), F.lit(0.5)))).collect()


def test_differs_and_digest(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, None), (1.0, None), (1.0, 1.1)], "a double, b double")
    assert [r[0] for r in df.select(materials.differs(F.col("a"), F.col("b"))).collect()] == [False, False, True, True]
    assert materials.digest(df).first() == materials.digest(df.select("b", "a").orderBy("b")).first()
    assert materials.digest(df.limit(0)).first().n == 0


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="z"):
        require_columns(spark.range(1), "id", "z")


def test_workspace(spark, tmp_path):
    from meshlake.sources import workspace

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m.amf").write_text("<amf/>")
    with pytest.raises(ValueError):
        workspace.entry(spark, "m.amf")
    spark.conf.set(workspace.SETTING, str(tmp_path))
    assert workspace.entry(spark, "m.amf", "a").endswith("/a/m.amf")
    for name, error in (("../x", ValueError), ("/etc", ValueError), ("none", FileNotFoundError)):
        with pytest.raises(error):
            workspace.entry(spark, name)
    spark.conf.unset(workspace.SETTING)


def test_selected_refuses_unknown_triangles(spark):
    from meshlake.operators import topology

    keys = "object_id long, tri_id long"
    triangles = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], keys)
    known, unknown = spark.createDataFrame([(1, 1)], keys), spark.createDataFrame([(2, 1)], keys)
    assert {tuple(r) for r in topology.selected(triangles, None, known).collect()} == {(1, 0), (2, 0)}
    for include, exclude in ((unknown, None), (None, unknown)):
        with pytest.raises(ValueError, match="object 2 has no triangle 1"):
            topology.selected(triangles, include, exclude)
