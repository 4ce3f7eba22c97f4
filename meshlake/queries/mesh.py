"""Canonical form, metrics, topology, graphs and spatial joins over meshes derived from `part` and `embeddings`."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions.layers import over, over_sql
from meshlake.operators import canonical as C
from meshlake.operators import graph, spatial_join, topology
from meshlake.session import Scratch
from meshlake.queries import by_hand
from meshlake.sources import amf, store
from meshlake.sources.fixtures import EDGES, GRID, MEETINGS, SHELL, SOUP_FIELDS, SOUP_SPARK, SOUP_SQL, built, plain, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = duck(sql)
        return f

    return add


def duck(sql: str) -> str:
    """Double literals as any engine writes them, and the column that is a keyword elsewhere in quotes."""
    sql = re.sub(r'(?<![\w"])by\b(?!")', '"by"', sql)
    return re.sub(r"(\d+(?:\.\d+)?(?:e-?\d+)?)D\b", lambda m: m[1] if "e" in m[1] else f"{m[1]}e0", plain(sql))


def rounded(columns: list[str], digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in columns]


def r_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def grid(spark, sf):
    """Written once, as the operators read it several times."""
    return Scratch(spark, "grid").write(built(spark, sf, GRID), "triangles")


def shell(spark, sf):
    return Scratch(spark, "shell").write(built(spark, sf, SHELL), "triangles")


def soup(spark, sf):
    return built(spark, sf, SOUP_SPARK)


def indexed(spark, sf):
    t = grid(spark, sf)
    return C.indexed(t, C.vertices(t))


def _q(c: str) -> str:
    scaled = f"CAST({c} * CAST(10000 AS FLOAT) AS FLOAT)"
    return f"CAST(trunc(CAST(CAST(CAST(round_even(CAST({scaled} AS DOUBLE), 0) AS FLOAT) / CAST(10000 AS FLOAT) AS FLOAT) * CAST(10000 AS FLOAT) AS FLOAT)) AS BIGINT) AS {c}"


QUANTIZED = f"SELECT object_id, tri_id, {', '.join(map(_q, SOUP_FIELDS))} FROM ({SOUP_SQL})"
CORNERS = "SELECT object_id, tri_id, unnest([ax, bx, cx]) AS x, unnest([ay, by, cy]) AS y, unnest([az, bz, cz]) AS z FROM ({t})"
VERTICES = f"SELECT row_number() OVER (ORDER BY z, y, x) - 1 AS vid, x, y, z FROM (SELECT DISTINCT x, y, z FROM ({CORNERS}))"
INDEXED = f"SELECT object_id, tri_id, v[1] AS v0, v[2] AS v1, v[3] AS v2 FROM (SELECT object_id, tri_id, list_sort(list(vid)) AS v FROM ({CORNERS}) JOIN ({VERTICES}) USING (x, y, z) GROUP BY object_id, tri_id)"
GV, GI = VERTICES.format(t=GRID), INDEXED.format(t=GRID)
UNIQUE = f"SELECT row_number() OVER (ORDER BY v0, v1, v2) - 1 AS gtri, v0, v1, v2 FROM (SELECT DISTINCT v0, v1, v2 FROM ({GI}))"
EDGE = f"SELECT DISTINCT object_id, tri_id, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT object_id, tri_id, unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b FROM ({GI}))"
MANIFOLD = f"SELECT a.object_id, a.tri_id, b.tri_id AS neighbour FROM ({EDGE}) a JOIN ({EDGE}) b USING (object_id, lo, hi) JOIN (SELECT object_id, lo, hi FROM ({EDGE}) GROUP BY ALL HAVING count(*) = 2) USING (object_id, lo, hi) WHERE a.tri_id <> b.tri_id"


@query("p1_quantize", QUANTIZED)
def _(spark, sf):
    return C.quantize(soup(spark, sf))


@query("a9_distinct_vertices", GV)
def _(spark, sf):
    return C.vertices(grid(spark, sf))


@query("o1_vertex_order", f"SELECT row_number() OVER (ORDER BY x, y, z) - 1 AS vid, x, y, z FROM (SELECT DISTINCT x, y, z FROM ({CORNERS.format(t=QUANTIZED)}))")
def _(spark, sf):
    return C.vertices(C.quantize(soup(spark, sf)), "xyz")


@query("p34_indexed_triangles", GI)
def _(spark, sf):
    return indexed(spark, sf)


@query("a10_unique_triangles", UNIQUE)
def _(spark, sf):
    return C.unique_triangles(indexed(spark, sf))


@query("o3_object_triangles", f"SELECT object_id, row_number() OVER (PARTITION BY object_id ORDER BY gtri, tri_id) - 1 AS local_id, gtri FROM ({GI}) JOIN ({UNIQUE}) USING (v0, v1, v2)")
def _(spark, sf):
    i = indexed(spark, sf)
    return C.object_triangles(i, C.unique_triangles(i))


@query("p5_unit_normals", f"SELECT object_id, tri_id, {r_sql(['nx', 'ny', 'nz'])} FROM ({by_hand.normals(QUANTIZED, '0.1')})")
def _(spark, sf):
    return over(C.quantize(soup(spark, sf)), G.normal()).select("object_id", "tri_id", *rounded(["nx", "ny", "nz"]))


@query("p6_fine_normals", f"SELECT object_id, tri_id, {r_sql(['nx', 'ny', 'nz'])} FROM ({by_hand.normals(SOUP_SQL, '1e-12')})")
def _(spark, sf):
    return over(soup(spark, sf), G.normal(least=1e-12)).select("object_id", "tri_id", *rounded(["nx", "ny", "nz"]))


METRICS = ["min_edge", "max_edge", "perimeter", "area"]


@query("p7_edges_area", f"SELECT object_id, tri_id, {r_sql(METRICS, 4)} FROM ({by_hand.metrics(GRID)})")
def _(spark, sf):
    return over(grid(spark, sf), G.metrics()).select("object_id", "tri_id", *rounded(METRICS, 4))


def measured_sql(t: str) -> str:
    """A statement: the triangles of t with all measures."""
    return by_hand.measured(t)


GRADES = ["shape_grade", "error_grade", "area_grade"]


@query("p8_quality_grades", f"SELECT object_id, tri_id, shape_grade, error_grade, area_grade, {by_hand.BAND} AS band FROM ({by_hand.graded(QUANTIZED)})")
def _(spark, sf):
    return C.measured(C.quantize(soup(spark, sf))).select("object_id", "tri_id", *GRADES, F.expr(G.band(GRADES)).alias("band"))


@query("f9_bands", f"SELECT object_id, {by_hand.BAND} AS band, count(*) AS n FROM ({by_hand.graded(QUANTIZED)}) GROUP BY ALL")
def _(spark, sf):
    m = C.measured(C.quantize(soup(spark, sf)))
    return m.groupBy("object_id", F.expr(G.band(GRADES)).alias("band")).agg(F.count("*").alias("n"))


@query("p11_classify", by_hand.CLASSIFIED)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(G.grade("l_quantity", (5, 20, 30, 45))).alias("upper_grade"), F.expr(G.grade("l_quantity", (45, 30, 20, 5), False)).alias("lower_grade"))


BOXES = by_hand.boxes(SHELL)
OBJECT_BOX = f"SELECT object_id, {', '.join(f'{f}({m}{c}) AS {m}{c}' for m, f in (('mn', 'min'), ('mx', 'max')) for c in 'xyz')} FROM ({BOXES}) GROUP BY object_id"


@query("p12_triangle_boxes", by_hand.boxes(SHELL))
def _(spark, sf):
    return over(shell(spark, sf), [G.box()]).select("object_id", "tri_id", *spatial_join.BOX)


BOX_ALGEBRA = [{f"extent{c}": f"CAST(mx{c} - mn{c} AS DOUBLE)" for c in "xyz"} | {f"centre{c}": f"(mn{c} + mx{c}) / 2.0D" for c in "xyz"}, {"diag": G.norm(G.point("extent")), "surface": "2.0D * (extentx * extenty + extenty * extentz + extentz * extentx)", "volume": "extentx * extenty * extentz"}]
ALGEBRA_OUT = ["object_id", *spatial_join.BOX, *(f"centre{c}" for c in "xyz"), "surface", "volume"]


@query("a6_object_boxes", f"SELECT {', '.join(ALGEBRA_OUT)}, round(diag, 6) AS diag FROM ({over_sql(OBJECT_BOX, BOX_ALGEBRA)})")
def _(spark, sf):
    return over(C.object_boxes(shell(spark, sf)), BOX_ALGEBRA).select(*ALGEBRA_OUT, F.round("diag", 6).alias("diag"))


@query("p13_box_corners", f"SELECT object_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS corner, unnest([{', '.join(f'm{"x" if k & 1 else "n"}x' for k in range(8))}]) AS x, unnest([{', '.join(f'm{"x" if k & 2 else "n"}y' for k in range(8))}]) AS y, unnest([{', '.join(f'm{"x" if k & 4 else "n"}z' for k in range(8))}]) AS z FROM ({OBJECT_BOX})")
def _(spark, sf):
    parts = F.array(*(F.struct(F.lit(k).alias("corner"), *(F.col(f"m{'x' if k >> i & 1 else 'n'}{c}").alias(c) for i, c in enumerate("xyz"))) for k in range(8)))
    return C.object_boxes(shell(spark, sf)).select("object_id", F.explode(parts).alias("p")).select("object_id", "p.*")


def overlap_on(a: str, b: str) -> str:
    return " AND ".join(f"{a}.mn{c} <= {b}.mx{c} AND {b}.mn{c} <= {a}.mx{c}" for c in "xyz")


@query("j1_object_pairs", f"SELECT a.object_id AS obj1, b.object_id AS obj2 FROM ({OBJECT_BOX}) a JOIN ({OBJECT_BOX}) b ON a.object_id < b.object_id AND {overlap_on('a', 'b')}")
def _(spark, sf):
    return spatial_join.object_pairs(C.object_boxes(shell(spark, sf)))


CANDIDATES = f"SELECT a.object_id AS obj1, b.object_id AS obj2, a.tri_id AS tri1, b.tri_id AS tri2 FROM ({BOXES}) a JOIN ({BOXES}) b ON a.object_id < b.object_id AND {overlap_on('a', 'b')}"
_combined, _turned = G.mixed_box(G.rotation_to((1, 1, 100)))
MIXED_BOXES = over_sql(SHELL, [_combined, _turned])


@query("j2_triangle_pairs", CANDIDATES)
def _(spark, sf):
    return spatial_join.triangle_pairs(shell(spark, sf))


_CORNER_BOXES = f"SELECT object_id, tri_id, least(ax, bx, cx) AS west, greatest(ax, bx, cx) AS east, least(ay, by, cy) AS south, greatest(ay, by, cy) AS north, least(az, bz, cz) AS low, greatest(az, bz, cz) AS high FROM ({SHELL})"


@query("j2_pairs_by_median_splits", f"WITH c AS ({_CORNER_BOXES}) SELECT a.object_id AS obj1, b.object_id AS obj2, a.tri_id AS tri1, b.tri_id AS tri2 FROM c a JOIN c b ON a.object_id < b.object_id AND a.west <= b.east AND b.west <= a.east AND a.south <= b.north AND b.south <= a.north AND a.low <= b.high AND b.low <= a.high")
def _(spark, sf):
    return spatial_join.triangle_pairs(shell(spark, sf), cells="kd")


@query("j3_mixed_pairs", f"{CANDIDATES} UNION SELECT a.object_id, b.object_id, a.tri_id, b.tri_id FROM ({MIXED_BOXES}) a JOIN ({MIXED_BOXES}) b ON a.object_id < b.object_id AND {overlap_on('a', 'b')}")
def _(spark, sf):
    return spatial_join.triangle_pairs(shell(spark, sf), "mixed")


GROWN = f"SELECT object_id, tri_id, {', '.join(f'm{m}{c} {s} 0.5 * min_edge AS m{m}{c}' for m, s in (('n', '-'), ('x', '+')) for c in 'xyz')} FROM ({over_sql(SHELL, [*G.metrics(), G.box()])})"


@query("p13_expanded_pairs", f"SELECT a.object_id AS obj1, b.object_id AS obj2, a.tri_id AS tri1, b.tri_id AS tri2 FROM ({GROWN}) a JOIN ({GROWN}) b ON a.object_id < b.object_id AND {overlap_on('a', 'b')}")
def _(spark, sf):
    return spatial_join.triangle_pairs(shell(spark, sf), "expanded", 0.5)


@query("j5_edge_neighbours", MANIFOLD)
def _(spark, sf):
    return topology.neighbours(indexed(spark, sf))


@query("j5_edge_table", f"SELECT e.object_id, e.tri_id, e.lo, e.hi, coalesce(m.neighbour, -1) AS neighbour FROM ({EDGE}) e LEFT JOIN (SELECT a.object_id, a.tri_id, lo, hi, b.tri_id AS neighbour FROM ({EDGE}) a JOIN ({EDGE}) b USING (object_id, lo, hi) WHERE a.tri_id <> b.tri_id AND (object_id, lo, hi) IN (SELECT (object_id, lo, hi) FROM ({EDGE}) GROUP BY object_id, lo, hi HAVING count(*) = 2)) m USING (object_id, tri_id, lo, hi)")
def _(spark, sf):
    return topology.edge_table(indexed(spark, sf))


TOUCHING = f"SELECT DISTINCT a.object_id, a.tri_id, b.tri_id AS neighbour FROM (SELECT object_id, tri_id, unnest([v0, v1, v2]) AS v FROM ({GI})) a JOIN (SELECT object_id, tri_id, unnest([v0, v1, v2]) AS v FROM ({GI})) b USING (object_id, v) WHERE a.tri_id <> b.tri_id"


@query("j6_vertex_only_neighbours", f"{TOUCHING} EXCEPT {MANIFOLD}")
def _(spark, sf):
    return topology.vertex_only(indexed(spark, sf))


@query("j7_all_edge_neighbours", f"SELECT DISTINCT a.object_id, a.tri_id, b.tri_id AS neighbour FROM ({EDGE}) a JOIN ({EDGE}) b USING (object_id, lo, hi) WHERE a.tri_id <> b.tri_id")
def _(spark, sf):
    return topology.neighbours(indexed(spark, sf), "all")


@query("j8_triangles_at", f"SELECT object_id, tri_id, neighbour FROM ({MANIFOLD})")
def _(spark, sf):
    return topology.neighbours(indexed(spark, sf)).select("object_id", "tri_id", "neighbour")


@query("a7_vertex_triangles", f"SELECT object_id, vid, list_sort(list(DISTINCT tri_id)) AS tri_ids FROM (SELECT object_id, tri_id, unnest([v0, v1, v2]) AS vid FROM ({GI})) GROUP BY object_id, vid")
def _(spark, sf):
    return topology.vertex_triangles(indexed(spark, sf))


IN, OUT = "tri_id % 7 < 5", "tri_id % 11 = 0"
CHOSEN = f"SELECT object_id, tri_id FROM ({GI}) WHERE {IN} AND NOT ({OUT})"
INDUCED = f"SELECT m.* FROM ({MANIFOLD}) m JOIN ({CHOSEN}) USING (object_id, tri_id) JOIN ({CHOSEN}) c ON c.object_id = m.object_id AND c.tri_id = m.neighbour"


def chosen(spark, sf):
    i = indexed(spark, sf)
    return i, topology.selected(i, i.where(IN), i.where(OUT))


@query("f6_include_exclude", CHOSEN)
def _(spark, sf):
    return chosen(spark, sf)[1].select("object_id", "tri_id")


@query("g1_induced_graph", INDUCED)
def _(spark, sf):
    i, c = chosen(spark, sf)
    return topology.induced(topology.neighbours(i), c)


@query("g1_isolates", f"SELECT object_id, tri_id FROM ({CHOSEN}) EXCEPT SELECT object_id, tri_id FROM ({INDUCED})")
def _(spark, sf):
    i, c = chosen(spark, sf)
    return topology.isolates(topology.neighbours(i), c)


SPARSE = f"SELECT tri_id AS a, neighbour AS b FROM ({MANIFOLD}) WHERE tri_id < neighbour AND (tri_id * 7 + neighbour) % 5 < 3"
REACH = "reach(x, y) AS (SELECT id, id FROM nodes UNION SELECT reach.x, ways.b FROM reach JOIN ways ON reach.y = ways.a WHERE ways.b < 100000000)"
WAYS = "ways AS (SELECT a, b FROM sparse UNION SELECT b, a FROM sparse)"


#: All neighbours; SPARSE leaves links out, so that components are small.
ADJACENT = f"SELECT tri_id AS a, neighbour AS b FROM ({MANIFOLD}) WHERE tri_id < neighbour"


def adjacent(spark, sf):
    n = topology.neighbours(C.by_points(grid(spark, sf))).where("tri_id < neighbour")
    return Scratch(spark, "adjacent").write(n.select(F.col("tri_id").alias("a"), F.col("neighbour").alias("b")), "edges")


def sparse(spark, sf):
    n = topology.neighbours(C.by_points(grid(spark, sf))).where("tri_id < neighbour AND (tri_id * 7 + neighbour) % 5 < 3")
    return Scratch(spark, "sparse").write(n.select(F.col("tri_id").alias("a"), F.col("neighbour").alias("b")), "edges")


def labels_sql(nodes: str) -> str:
    return f"WITH RECURSIVE sparse AS ({SPARSE}), {WAYS}, nodes AS ({nodes}), {REACH} SELECT x AS id, min(y) AS component FROM reach GROUP BY x"


@query("g2_components", labels_sql("SELECT DISTINCT a AS id FROM ways"))
def _(spark, sf, edges=sparse):
    return graph.components(edges(spark, sf))


@query("g3_components_with_isolates", labels_sql(f"SELECT tri_id AS id FROM ({GI})"))
def _(spark, sf, edges=sparse):
    return graph.components(edges(spark, sf), indexed(spark, sf).select(F.col("tri_id").alias("id")))


for _name in ("g2_components", "g3_components_with_isolates"):
    query(f"{_name}_whole", ORACLES[_name].replace(duck(SPARSE), duck(ADJACENT)))(partial(QUERIES[_name], edges=adjacent))


DEPTHS = """, walk(id, depth, owner) AS (
  SELECT id, 0, id FROM sources UNION SELECT ways.b, walk.depth + 1, walk.owner FROM walk JOIN ways ON walk.id = ways.a WHERE walk.depth < 40)
SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY id"""


@query("g4_breadth_first", f"WITH RECURSIVE e AS ({plain(EDGES)}), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), sources AS (SELECT DISTINCT a AS id FROM ways WHERE a % 5 = 0)" + DEPTHS)
def _(spark, sf, edges=EDGES):
    e = built(spark, sf, edges)
    ends = e.select(F.col("a").alias("id")).union(e.select("b")).where("id % 5 = 0")
    return graph.multi_source_bfs(e, ends).select("id", "depth")


query("g4_breadth_first_whole", ORACLES["g4_breadth_first"].replace(plain(EDGES), plain(MEETINGS)))(partial(QUERIES["g4_breadth_first"], edges=MEETINGS))


#: The nearest source that is smallest owns a node.
_OWNED = DEPTHS[: DEPTHS.index("\nSELECT")] + ", owned AS (SELECT id, owner FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, owner) AS n FROM walk) WHERE n = 1)"


@query("g4_meetings", f"WITH RECURSIVE e AS ({plain(MEETINGS)}), ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), sources AS (SELECT DISTINCT a AS id FROM ways WHERE a % 5 = 0){_OWNED} SELECT a, b FROM e JOIN owned x ON x.id = a JOIN owned y ON y.id = b WHERE x.owner <> y.owner")
def _(spark, sf):
    e = built(spark, sf, MEETINGS)
    ends = e.select(F.col("a").alias("id")).union(e.select("b")).where("id % 5 = 0")
    return graph.meetings(e, graph.multi_source_bfs(e, ends))


@query("g5_repair_order", f"""WITH RECURSIVE sparse AS ({ADJACENT}), {WAYS}, nodes AS (SELECT DISTINCT a AS id FROM ways), {REACH},
label AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x),
ends AS (SELECT id, component FROM label JOIN (SELECT a AS id FROM ways GROUP BY a HAVING count(*) = 1) USING (id)),
sources AS (SELECT id FROM ends UNION SELECT min(id) FROM label WHERE component NOT IN (SELECT component FROM ends) GROUP BY component),
walk(id, depth) AS (SELECT id, 0 FROM sources UNION SELECT ways.b, walk.depth + 1 FROM walk JOIN ways ON walk.id = ways.a WHERE walk.depth < 300)
SELECT id, component, CAST(depth AS BIGINT) AS depth, row_number() OVER (PARTITION BY component ORDER BY depth, id) - 1 AS place FROM label JOIN (SELECT id, min(depth) AS depth FROM walk GROUP BY id) USING (id)""")
def _(spark, sf):
    e = adjacent(spark, sf)
    return graph.repair_order(e, e.select(F.col("a").alias("id")).union(e.select("b")).distinct())


_M = G.rotation_to((1, 2, 3))


def _turn(row: list[float]) -> str:
    return " + ".join(f"({v!r}D) * CAST({c} AS DOUBLE)" for v, c in zip(row, ("ax", "ay", "az"), strict=True))


@query("p28_rotated_points", by_hand.turned(SOUP_SQL))
def _(spark, sf):
    return soup(spark, sf).select("object_id", "tri_id", *(F.expr(f"round({_turn(r)}, 5)").alias(f"r{c}") for r, c in zip(_M, "xyz", strict=True)))


PLANAR = "SELECT k, x, y, 100 * (k % 7) AS ax, 100 * (k % 5) AS ay, 100 * (k % 7) + 60 AS bx, 100 * (k % 5) + k % 13 AS by, 100 * (k % 7) + k % 17 AS cx, 100 * (k % 5) + 80 AS cy, 640 - x AS ox, 480 - y AS oy FROM (SELECT c_custkey AS k, (c_custkey * 37) % 700 AS x, (c_custkey * 53) % 500 AS y FROM {customer})"
_p, _a, _b, _c, _o = (tuple(f"{p}{c}" for c in "xy") for p in ("", "a", "b", "c", "o"))
PREDICATES = f"SELECT k, {G.location(_p, _a, _b, _c)} AS place, {G.orient(_a, _b, _p)} AS turn, {G.strictly_cross(_a, _b, _p, _o)} OR {G.strictly_cross(_b, _c, _p, _o)} OR {G.strictly_cross(_c, _a, _p, _o)} AS crosses FROM ({PLANAR})"


@query("p24_planar_predicates", by_hand.planar(PLANAR))
def _(spark, sf):
    return built(spark, sf, PREDICATES)


@query("j9_plane_stabbing", f"SELECT object_id, tri_id FROM ({over_sql(GRID, [G.box()])}) WHERE mnz <= 25.5 AND mxz >= 25.5")
def _(spark, sf):
    from meshlake.operators.slicing import at_plane

    return at_plane(grid(spark, sf), 25.5).select("object_id", "tri_id")


@query("s2_amf_scan", f"SELECT object_id, count(*) AS n, sum(ax + bx + cx) AS sx, sum(ay + by + cy) AS sy, sum(az + bz + cz) AS sz FROM ({GRID}) GROUP BY object_id")
def _(spark, sf):
    """Writes the mesh as AMF, sixteen objects a file, as a file is listed through the driver, and reads it back; the ids are those in the file."""
    s = Scratch(spark, "amf")
    objects = amf.object_xml(grid(spark, sf)).groupBy(F.expr("object_id div 16").alias("file")).agg(F.array_join(F.collect_list("value"), "").alias("value"))
    objects.select("file", F.concat(F.lit("<amf>"), "value", F.lit("</amf>")).alias("value")).write.partitionBy("file").text(f"{s.root}/model.amf")
    objects = amf.raw_objects(spark, f"{s.root}/model.amf")
    found = amf.tables(objects)
    t = found["triangles"].select("model_id", "mesh_id", "tid", F.explode(F.array("v1", "v2", "v3")).alias("vid")).join(found["vertices"], ["model_id", "mesh_id", "vid"])
    ids = amf.numbered_ids(objects)
    return t.join(ids, ["model_id", "mesh_id"]).groupBy(F.col("xml_id").cast("long").alias("object_id")).agg(F.count_distinct("tid").alias("n"), *(F.sum(F.col(c).cast("double")).cast("long").alias(f"s{c}") for c in "xyz"))


@query("s2_amf_rejections", f"SELECT object_id, CASE object_id % 4 WHEN 1 THEN 'broken object' WHEN 2 THEN 'cut off' WHEN 3 THEN 'no object' ELSE 'read' END AS status, CASE WHEN object_id % 4 = 0 THEN count(*) ELSE 0 END AS n FROM ({GRID}) GROUP BY object_id")
def _(spark, sf):
    """The mesh as AMF again, but of four objects one has a corner that isn't a number, one's file is cut off and one's file has no object: what was read, and what was rejected."""
    s = Scratch(spark, "amf-rejections")
    k = F.col("object_id") % 4
    body = F.when(k == 1, F.regexp_replace("value", "<x>", "<x>at ")).when(k == 3, "").otherwise(F.col("value"))
    parts = amf.object_xml(grid(spark, sf)).select("object_id", F.concat(F.lit("<amf>"), F.when(k == 3, F.format_string("<metadata>%d</metadata>", "object_id")).otherwise(""), body, F.when(k == 2, "").otherwise("</amf>")).alias("value"))
    parts.write.partitionBy("object_id").text(f"{s.root}/model.amf")
    files = s.write(amf.scanned_files(spark, f"{s.root}/model.amf"), "files")
    objects = amf.raw_objects(spark, f"{s.root}/model.amf", files)
    found = amf.tables(objects)
    sizes = found["triangles"].groupBy("model_id", "mesh_id").agg(F.count("*").alias("n"))
    read = found["meshes"].join(sizes, ["model_id", "mesh_id"]).select("path", F.lit("read").alias("status"), "n")
    both = read.union(amf.rejected(files, objects).select("path", "reason", F.lit(0).cast("long")))
    return both.select(F.regexp_extract("path", r"object_id=(\d+)", 1).cast("long").alias("object_id"), "status", "n")


@query("s9_save_and_load", GRID)
def _(spark, sf):
    s = Scratch(spark, "model")
    path = store.location(s.root, "grid", "model-1", accuracy=4)
    store.save(grid(spark, sf), path, ["object_id"])
    return store.load(spark, path, grid(spark, sf).schema)


@query("a8_counts", f"SELECT object_id, count(*) AS n_triangles FROM ({GRID}) GROUP BY object_id")
def _(spark, sf):
    return grid(spark, sf).groupBy("object_id").agg(F.count("*").alias("n_triangles"))


@query("a14_fingerprint", "SELECT count(*) AS n, true AS same FROM customer")
def _(spark, sf):
    from meshlake.operators.materials import digest

    c = table(spark, sf, "customer")
    other = digest(c.select(*reversed(c.columns)).repartition(3, "c_name")).select(F.col("digest").alias("other"))
    return digest(c).crossJoin(F.broadcast(other)).select("n", (F.col("digest") == F.col("other")).alias("same"))
