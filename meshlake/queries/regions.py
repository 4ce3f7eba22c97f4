"""Boolean operations on polygon regions: any polygons, checked by an area formula that knows no sweep; splits, holes and touching edges, checked by closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshlake.operators import regions as R
from meshlake.sources.fixtures import built

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SCALE = 1_000_000_000
#: Twelve customers make two star-shaped hexagons, the second moved: distances from the middle along six directions come from the keys.
_CORNERS = """SELECT CAST(floor(c_custkey / 12) AS BIGINT) AS k, CAST(floor((c_custkey % 12) / 6) AS BIGINT) AS side, c_custkey % 6 AS pos, 2 + (c_custkey * 7919) % 9 AS far, (c_custkey - c_custkey % 12) % 23 AS dx, (c_custkey - c_custkey % 12) % 17 AS dy FROM {customer}"""
_POINTS = f"""SELECT k, side, pos,
 1000 + far * (CASE pos WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN -2 WHEN 4 THEN -1 ELSE 1 END) + side * (dx - 11) AS x,
 1000 + far * (CASE pos WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 4 THEN -2 ELSE -2 END) + side * (dy - 8) AS y
FROM ({_CORNERS})"""
#: The area below a region's upper edges less that below its lower ones; for two regions, each edge of one with each of the other, below both.
_AREAS = f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY k, side) AS n FROM ({_POINTS.replace("{customer}", "customer")})),
e AS (
    SELECT a.k, a.side, least(a.x, b.x)::DOUBLE AS l, greatest(a.x, b.x)::DOUBLE AS r, CASE WHEN a.x > b.x THEN 1 ELSE -1 END AS s, (b.y - a.y)::DOUBLE / (b.x - a.x) AS m, a.y - a.x * (b.y - a.y)::DOUBLE / (b.x - a.x) AS c
    FROM p a JOIN p b ON a.k = b.k AND a.side = b.side AND b.pos = (a.pos + 1) % 6 WHERE a.n = 6 AND a.x <> b.x),
own AS (SELECT k, side, sum(s * (r - l) * (m * (l + r) / 2 + c)) AS area FROM e GROUP BY ALL),
met AS (
    SELECT a.k, a.s * b.s AS s, greatest(a.l, b.l) AS l, least(a.r, b.r) AS r, a.m AS m, a.c AS c, a.m - b.m AS dm, a.c - b.c AS dc, b.m AS m2, b.c AS c2
    FROM e a JOIN e b ON a.k = b.k AND a.side = 0 AND b.side = 1 AND least(a.r, b.r) > greatest(a.l, b.l)),
cut AS (SELECT *, CASE WHEN (dm * l + dc) * (dm * r + dc) < 0 THEN -dc / dm ELSE l END AS mid FROM met),
shares AS (
    SELECT k, sum(s * ((mid - l) * least(m * (l + mid) / 2 + c, m2 * (l + mid) / 2 + c2) + (r - mid) * least(m * (mid + r) / 2 + c, m2 * (mid + r) / 2 + c2))) AS area FROM cut GROUP BY k),
found AS (SELECT a.k, a.area AS a, b.area AS b, coalesce(s.area, 0) AS s FROM own a JOIN own b ON a.k = b.k AND a.side = 0 AND b.side = 1 LEFT JOIN shares s ON s.k = a.k)
"""


def _hexagons(spark, sf):
    p = built(spark, sf, _POINTS)
    rings = p.groupBy("k", "side").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("q")).where("size(q) = 6")
    regions = rings.select("k", "side", F.array(F.transform("q", lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))).alias("r"))
    return regions.where("side = 0").select("k", F.col("r").alias("subject")).join(regions.where("side = 1").select("k", F.col("r").alias("clip")), "k")


for _n, (_how, _sql) in enumerate((("union", "a + b - s"), ("difference", "a - s"), ("intersection", "s")), 1):

    def _polygons(spark, sf, how=_how):
        return R.combined(_hexagons(spark, sf), how, "k", scale=SCALE).select("k", F.round("area", 2).alias("area"))

    QUERIES[f"c{_n}_{_how}_polygons"] = _polygons
    ORACLES[f"c{_n}_{_how}_polygons"] = f"{_AREAS} SELECT k, round(abs({_sql}), 2) AS area FROM found"

#: A rectangle w x h and, by p_partkey % 6: a bar across it, a square inside, a neighbour that shares an edge, one that touches a corner, itself, a frame inside.
_SIZES = "SELECT p_partkey AS k, p_partkey % 6 AS kind, 8 * (5 + p_partkey % 11) AS w, 8 * (4 + p_partkey % 7) AS h FROM {part}"


def _ring(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"array({', '.join(f'named_struct({chr(39)}x{chr(39)}, CAST({x} AS DOUBLE), {chr(39)}y{chr(39)}, CAST({y} AS DOUBLE))' for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)))})"


_CLIPS = [[("w / 4", "-5", "w / 2", "h + 5")], [("w / 4", "h / 4", "w / 2", "h / 2")], [("w", "0", "w + 10", "h")], [("w", "h", "w + 5", "h + 5")], [("0", "0", "w", "h")], [("w / 4", "h / 4", "3 * w / 4", "3 * h / 4"), ("3 * w / 8", "3 * h / 8", "5 * w / 8", "5 * h / 8")]]
#: Area, length, rings and holes of each kind, for each operation.
_FORMS = {
    "union": [("w * h + 2.5 * w", "2 * (w + h) + 20", 1, 0), ("w * h", "2 * (w + h)", 1, 0), ("(w + 10) * h", "2 * (w + 10 + h)", 1, 0), ("w * h + 25", "2 * (w + h) + 20", 2, 0), ("w * h", "2 * (w + h)", 1, 0), ("w * h", "2 * (w + h)", 1, 0)],
    "difference": [("0.75 * w * h", "1.5 * w + 4 * h", 2, 0), ("0.9375 * w * h", "2.5 * (w + h)", 2, 1), ("w * h", "2 * (w + h)", 1, 0), ("w * h", "2 * (w + h)", 1, 0), ("0", "0", 0, 0), ("0.8125 * w * h", "3.5 * (w + h)", 3, 1)],
    "intersection": [("0.25 * w * h", "0.5 * w + 2 * h", 1, 0), ("0.0625 * w * h", "0.5 * (w + h)", 1, 0), ("0", "0", 0, 0), ("0", "0", 0, 0), ("w * h", "2 * (w + h)", 1, 0), ("0.1875 * w * h", "1.5 * (w + h)", 2, 1)],
}


def c_split_nest_touch(spark, sf):
    sizes = built(spark, sf, _SIZES)
    clip = "CASE kind " + " ".join(f"WHEN {n} THEN array({', '.join(_ring(*r) for r in rings)})" for n, rings in enumerate(_CLIPS)) + " END"
    both = sizes.select("k", F.expr(f"array({_ring('0', '0', 'w', 'h')})").alias("subject"), F.expr(clip).alias("clip"))
    table = R.swept(R.edges(both, "k", "subject", 0).unionByName(R.edges(both, "k", "clip", 1)))
    found = None
    for how in _FORMS:
        bounds = R.boundary(table, how)
        counts = R.rings(bounds).groupBy("key").agg(F.count("*").alias("rings"), F.count_if(F.col("area") < 0).alias("holes"))
        rows = both.select("k").join(R.measured(bounds).join(counts, "key").withColumnRenamed("key", "k"), "k", "left").na.fill(0)
        rows = rows.select(F.lit(how).alias("how"), "k", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"), "rings", "holes")
        found = rows if found is None else found.unionByName(rows)
    return found


QUERIES["c1_c3_split_nest_touch"] = c_split_nest_touch
ORACLES["c1_c3_split_nest_touch"] = " UNION ALL ".join(
    f"SELECT '{how}' AS how, k, round(({area})::DOUBLE, 4) AS area, round(({length})::DOUBLE, 4) AS length, {rings} AS rings, {holes} AS holes FROM ({_SIZES.replace('{part}', 'part')}) WHERE kind = {kind}"
    for how, forms in _FORMS.items() for kind, (area, length, rings, holes) in enumerate(forms)
)
