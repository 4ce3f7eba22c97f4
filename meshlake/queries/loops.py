"""Slices, loops and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions import polygons as P
from meshlake.functions.layers import over_sql
from meshlake.operators import regions as region_operators
from meshlake.operators import slicing
from meshlake.queries import sheet
from meshlake.queries.mesh import duck, grid
from meshlake.sources.fixtures import GRID, LOOPS_POINTS, built, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HEIGHT = 7.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = duck(sql)
        return f

    return add


def loops(spark, sf):
    p = built(spark, sf, LOOPS_POINTS)
    listed = p.groupBy("loop_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))
    return listed.select("loop_id", F.transform("p", lambda q: F.struct(q.x.alias("x"), q.y.alias("y"))).alias("pts"))


_NEXT = "coalesce(lead({c}) OVER w, first_value({c}) OVER w)"
_PREV = "coalesce(lag({c}) OVER w, last_value({c}) OVER (PARTITION BY loop_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
_TURNS = f"SELECT *, x * {_NEXT.format(c='y')} - y * {_NEXT.format(c='x')} AS turn FROM ({LOOPS_POINTS}) WINDOW w AS (PARTITION BY loop_id ORDER BY pos)"
_AREAS = f"SELECT loop_id, sum(turn) / 2 AS area FROM ({_TURNS}) GROUP BY loop_id"


@query("p30_signed_area", _AREAS)
def _(spark, sf):
    return loops(spark, sf).select("loop_id", P.signed_area(F.col("pts")).alias("area"))


@query("p31_orientation", f"SELECT loop_id, list(x ORDER BY CASE WHEN area > 0 THEN pos ELSE -pos END) AS xs, list(y ORDER BY CASE WHEN area > 0 THEN pos ELSE -pos END) AS ys FROM ({LOOPS_POINTS}) JOIN ({_AREAS}) USING (loop_id) GROUP BY loop_id")
def _(spark, sf):
    turned = loops(spark, sf).select("loop_id", P.oriented(F.col("pts")).alias("q"))
    return turned.select("loop_id", F.transform("q", lambda p: p.x).alias("xs"), F.transform("q", lambda p: p.y).alias("ys"))


@query("p32_start_point", f"SELECT loop_id, list(x ORDER BY (pos - start + n) % n) AS xs, list(y ORDER BY (pos - start + n) % n) AS ys FROM (SELECT *, count(*) OVER (PARTITION BY loop_id) AS n, first_value(pos) OVER (PARTITION BY loop_id ORDER BY x, y, pos) - first_pos AS start0, first_value(pos) OVER (PARTITION BY loop_id ORDER BY x, y, pos) AS start FROM (SELECT *, min(pos) OVER (PARTITION BY loop_id) AS first_pos FROM ({LOOPS_POINTS}))) GROUP BY loop_id HAVING count(*) = 6")
def _(spark, sf):
    turned = loops(spark, sf).where(F.size("pts") == 6).select("loop_id", P.aligned(F.col("pts")).alias("q"))
    return turned.select("loop_id", F.transform("q", lambda p: p.x).alias("xs"), F.transform("q", lambda p: p.y).alias("ys"))


_W = "WINDOW w AS (PARTITION BY loop_id ORDER BY pos)"
_FAR = f"SELECT loop_id, pos, x, y FROM (SELECT *, sqrt(pow({_NEXT.format(c='x')} - x, 2) + pow({_NEXT.format(c='y')} - y, 2)) AS step, count(*) OVER (PARTITION BY loop_id) AS n FROM ({LOOPS_POINTS}) {_W}) WHERE n < 3 OR step >= 250"
_BENT = f"SELECT loop_id, pos, x, y FROM (SELECT *, abs((x - {_PREV.format(c='x')}) * ({_NEXT.format(c='y')} - y) - (y - {_PREV.format(c='y')}) * ({_NEXT.format(c='x')} - x)) AS turn, count(*) OVER (PARTITION BY loop_id) AS n FROM ({_FAR}) {_W}) WHERE n < 3 OR turn > 30000"


@query("p33_clean_loops", f"SELECT loop_id, count(*) AS n, list(x ORDER BY pos) AS xs FROM ({_BENT}) GROUP BY loop_id")
def _(spark, sf):
    c = loops(spark, sf).select("loop_id", P.cleaned(F.col("pts"), 250.0, 30000.0).alias("q")).where(F.size("q") > 0)
    return c.select("loop_id", F.size("q").cast("long").alias("n"), F.transform("q", lambda p: p.x).alias("xs"))


@query("f10_large_loops", f"SELECT loop_id FROM ({_AREAS}) WHERE abs(area) >= 150000")
def _(spark, sf):
    return loops(spark, sf).where(F.abs(P.signed_area(F.col("pts"))) >= 150000).select("loop_id")


@query("p2_planar_grid", "SELECT c_custkey AS k, CAST(round_even(c_acctbal / 7.0e0 * 10000, 0) AS BIGINT) AS g, round(CAST(round_even(c_acctbal / 7.0e0 * 10000, 0) AS BIGINT) * 1e-4, 4) AS back FROM customer")
def _(spark, sf):
    g = F.rint(F.col("c_acctbal") / 7.0 * 10000).cast("long")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), g.alias("g"), F.round(g * F.lit(1e-4), 4).alias("back"))


@query("p4_snap", "SELECT c_custkey AS k, round(round_even(c_acctbal / 0.25, 0) * 0.25, 2) AS snapped FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.round(F.rint(F.col("c_acctbal") / 0.25) * 0.25, 2).alias("snapped"))


@query("p37_hole_or_outer", f"SELECT loop_id, CASE WHEN area > 0 THEN 'outer' ELSE 'hole' END AS kind FROM ({_AREAS})")
def _(spark, sf):
    return loops(spark, sf).select("loop_id", F.when(P.signed_area(F.col("pts")) > 0, "outer").otherwise("hole").alias("kind"))


_BOXED = over_sql(GRID, [G.box()])
_BOTTOM = f"(SELECT min(mnz) FROM ({_BOXED}))"
_REACHED = f"SELECT *, z0 + layer * {HEIGHT} AS z FROM (SELECT *, unnest(generate_series(CAST(ceil((mnz - z0) / {HEIGHT}) AS BIGINT), CAST(floor((mxz - z0) / {HEIGHT}) AS BIGINT))) AS layer FROM (SELECT *, {_BOTTOM} + {HEIGHT} / 2 AS z0 FROM ({_BOXED})))"


def _edge(p: str, q: str, rising: bool) -> str:
    test = f"{p}z {'<' if rising else '>='} z AND {q}z {'>=' if rising else '<'} z"
    return f"SELECT layer, object_id, tri_id, z, {p}x + (z - {p}z) / ({q}z - {p}z) * ({q}x - {p}x) AS x, {p}y + (z - {p}z) / ({q}z - {p}z) * ({q}y - {p}y) AS y FROM reached WHERE {test}"


_ENDS = [" UNION ALL ".join(_edge(p, q, rising) for p, q in ("ab", "bc", "ca")) for rising in (True, False)]
SEGMENTS = f"WITH reached AS MATERIALIZED ({_REACHED}) SELECT layer, object_id, tri_id, round(r.x, 5) AS x1, round(r.y, 5) AS y1, round(f.x, 5) AS x2, round(f.y, 5) AS y2 FROM ({_ENDS[0]}) r JOIN ({_ENDS[1]}) f USING (layer, object_id, tri_id)"


@query("p36_plane_segments", SEGMENTS)
def _(spark, sf):
    s = slicing.segments(grid(spark, sf), HEIGHT)
    return s.select("layer", "object_id", "tri_id", *(F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("c7_layers", f"WITH reached AS MATERIALIZED ({_REACHED}) SELECT layer, round(z, 6) AS z, count(DISTINCT object_id) AS n_objects FROM reached GROUP BY ALL")
def _(spark, sf):
    from meshlake.functions.layers import over
    from meshlake.operators.spatial_join import layers_of

    boxed = over(grid(spark, sf), [G.box()])
    z0 = float(boxed.agg(F.min("mnz")).first()[0]) + HEIGHT / 2
    return layers_of(boxed, z0, HEIGHT).groupBy(F.col("layer").cast("long").alias("layer"), F.round("z", 6).alias("z")).agg(F.count_distinct("object_id").alias("n_objects"))


@query("f11_solid_segments", SEGMENTS.replace("SELECT layer, object_id, tri_id, round", "SELECT layer, count(*) AS n FROM (SELECT layer, object_id, tri_id, round") + ") WHERE x1 <> x2 OR y1 <> y2 GROUP BY layer")
def _(spark, sf):
    s = slicing.segments(grid(spark, sf), HEIGHT)
    s = s.select("layer", *(F.round(c, 5).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return s.where("x1 <> x2 OR y1 <> y2").groupBy("layer").agg(F.count("*").alias("n"))


def _listed(found):
    """Points as two arrays, for the comparison with SQL."""
    return found.select(*(c for c in found.columns if c != "pts"), *(F.col(f"pts.{c}").alias(f"{c}s") for c in "xy"))


@query("g7_chained_loops", sheet.DIRECTED)
def _(spark, sf):
    return _listed(slicing.loops(slicing.segments(grid(spark, sf), HEIGHT)))


@query("g8_undirected_loops", sheet.UNDIRECTED)
def _(spark, sf):
    return _listed(slicing.loops(slicing.segments(grid(spark, sf), HEIGHT), directed=False))


@query("c6_normalized_loops", sheet.NORMALIZED)
def _(spark, sf):
    return _listed(slicing.normalized(slicing.loops(slicing.segments(grid(spark, sf), HEIGHT))))


_SIZES = "SELECT p_partkey AS k, 40.0D + p_partkey % 30 AS w, 30.0D + p_partkey % 20 AS h, 5.0D + p_partkey % 25 AS dx, 3.0D + p_partkey % 17 AS dy FROM {part}"
_MEET = "(w - dx) * (h - dy)"


def _rect(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"array(array({', '.join(f'named_struct({chr(39)}x{chr(39)}, {x}, {chr(39)}y{chr(39)}, {y})' for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))}))"


def regions(spark, sf):
    return built(spark, sf, _SIZES).select("k", F.expr(_rect("0D", "0D", "w", "h")).alias("subject"), F.expr(_rect("dx", "dy", "w + dx", "h + dy")).alias("clip"))


for _how, _sql in (("union", f"2 * w * h - {_MEET}"), ("difference", f"w * h - {_MEET}"), ("intersection", _MEET)):

    @query(f"c{('union', 'difference', 'intersection').index(_how) + 1}_{_how}", f"SELECT k, round({_sql}, 3) AS area, 1 AS n_rings FROM ({_SIZES})")
    def _(spark, sf, how=_how):
        out = region_operators.combined(regions(spark, sf), how, "k")
        return out.select("k", F.round("area", 3).alias("area"), F.size("rings").alias("n_rings"))


@query("c4_offset", f"SELECT k, round((w + 4) * (h + 4), 3) AS area FROM ({_SIZES})")
def _(spark, sf):
    return slicing.offset_rings(regions(spark, sf).select("k", F.col("subject")[0].alias("ring")), 2.0, "k").select("k", F.round("area", 3).alias("area"))


@query("p22_convex_clip", f"SELECT k, round({_MEET}, 3) AS area FROM ({_SIZES})")
def _(spark, sf):
    r = regions(spark, sf).select("k", F.col("subject")[0].alias("a"), F.col("clip")[0].alias("b"))
    return r.withColumn("q", P.clipped(F.col("a"), F.col("b"), 4)).select("k", F.round(P.signed_area(F.col("q")), 3).alias("area"))


@query("c5_outer_and_holes", f"SELECT k, count(*) FILTER (area > 0) AS outers, count(*) FILTER (area < 0) AS holes FROM (SELECT loop_id // 4 AS k, area FROM ({_AREAS})) GROUP BY k")
def _(spark, sf):
    a = loops(spark, sf).select(F.floor(F.col("loop_id") / 4).alias("k"), P.signed_area(F.col("pts")).alias("area"))
    return a.groupBy("k").agg(F.count_if(F.col("area") > 0).alias("outers"), F.count_if(F.col("area") < 0).alias("holes"))
