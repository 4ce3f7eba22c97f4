"""Union, difference, intersection of polygon regions as a plane sweep in DataFrames: any number of regions at once, each of any number of rings, which may split, nest, touch, share
edges and cross themselves.

1. Corners are put on a grid. Edges of a region and its partner whose boxes overlap (an equi-join of grid cells) are cut where they cross or touch, and at each other's
   ends where they lie on one line. Pieces with the same ends are one piece with the sum of its windings; now pieces meet at their ends only.
2. The sweep runs along y + SHEAR * x, so no piece lies along the sweep line. Neighbouring values of all ends are a band, numbered by
   ranges over all regions; each piece enters every band that it reaches. Within a band pieces don't cross, and running sums over their order give the
   winding number of both regions on either side of each.
3. Pieces with the result on one side only are its boundary, directed with the result on the left. Area and length are sums over it; rings come from
   chains.by_wedge, so that holes run clockwise and rings that meet in a point stay apart.

Nothing is held by region but the chaining of boundaries of at most chains.HELD pieces: the windows are by point, edge or band, and a region's bands are spread over all tasks. Cut points are rounded to the grid, which moves an edge by
less than a unit. Null and empty regions hold nothing; rings of fewer than three points, or without area, neither add nor take away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.functions import polygons as P
from meshlake.operators import chains
from meshlake.operators.canonical import ranked
from meshlake.operators.spatial_join import overlapping
from meshlake.session import Scratch

SCALE = 1_000_000
#: Irrational, so that no edge of the grid lies along the sweep line.
SHEAR = 0.6180339887498949e-3
HOW = {"union": lambda a, b: a | b, "difference": lambda a, b: a & ~b, "intersection": lambda a, b: a & b, "xor": lambda a, b: a != b}
FILLS = {"evenodd": lambda w: w % 2 != 0, "nonzero": lambda w: w != 0}


def edges(regions: DataFrame, key: str, rings: str, side: int, scale: float = SCALE) -> DataFrame:
    """(key, side, x1, y1, x2, y2): the edges of arrays of rings of (x, y), on the grid."""
    ring = regions.select(F.col(f"`{key}`").alias("key"), F.explode(f"`{rings}`").alias("r")).where("size(r) >= 3")
    points = ring.select("key", F.transform("r", lambda p: F.struct(F.rint(p.x * scale).cast("long").alias("x"), F.rint(p.y * scale).cast("long").alias("y"))).alias("q"))
    pairs = points.select("key", F.explode(F.transform("q", lambda p, i: F.struct(p.x.alias("x1"), p.y.alias("y1"), P.at(F.col("q"), i + 1).x.alias("x2"), P.at(F.col("q"), i + 1).y.alias("y2")))).alias("e"))
    return pairs.select("key", F.lit(side).alias("side"), "e.*").where("x1 <> x2 OR y1 <> y2")


def _cross(ax: str, ay: str, bx: str, by: str) -> str:
    return f"(CAST({ax} AS DOUBLE) * ({by}) - CAST({ay} AS DOUBLE) * ({bx}))"


def _cuts(numbered: DataFrame) -> DataFrame:
    """(e, x, y): where edges of the same key cross, touch or end on each other."""
    boxed = numbered.select("*", *(F.expr(f"{f}({c}1, {c}2)").alias(f"{m}{c}") for m, f in (("mn", "least"), ("mx", "greatest")) for c in "xy"))
    flat = {f"{m}z": F.lit(0) for m in ("mn", "mx")}
    boxed = boxed.withColumns(flat)
    met = overlapping(boxed, boxed, ["key"]).where("l_e < r_e")
    d, e, f = ("l_x2 - l_x1", "l_y2 - l_y1"), ("r_x2 - r_x1", "r_y2 - r_y1"), ("r_x1 - l_x1", "r_y1 - l_y1")
    met = met.withColumn("det", F.expr(_cross(*(f"({x})" for x in (*d, *e))))).withColumn("off", F.expr(_cross(*(f"({x})" for x in (*f, *d)))))
    at = met.where("det <> 0").withColumn("t", F.expr(f"{_cross(*(f'({x})' for x in (*f, *e)))} / det")).withColumn("u", F.expr("off / det")).where("t BETWEEN -1e-12 AND 1 + 1e-12 AND u BETWEEN -1e-12 AND 1 + 1e-12")
    at = at.select(F.explode(F.array("l_e", "r_e")).alias("e"), F.expr("CAST(rint(l_x1 + t * (l_x2 - l_x1)) AS BIGINT)").alias("x"), F.expr("CAST(rint(l_y1 + t * (l_y2 - l_y1)) AS BIGINT)").alias("y"))
    along = met.where("det = 0 AND off = 0")
    ends = lambda own, other: [F.struct(F.col(f"{own}_e").alias("e"), F.col(f"{other}_x{k}").alias("x"), F.col(f"{other}_y{k}").alias("y"), *(F.col(f"{own}_{m}{c}").alias(f"{m}{c}") for m in ("mn", "mx") for c in "xy")) for k in (1, 2)]
    lying = along.select(F.explode(F.array(*ends("l", "r"), *ends("r", "l"))).alias("p")).select("p.*").where("x BETWEEN mnx AND mxx AND y BETWEEN mny AND mxy").select("e", "x", "y")
    return at.unionByName(lying)


def pieces(edge_table: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, x1, y1, x2, y2, a, b): pieces from their lower to their upper end, with the windings of side 0 and 1: +1 for an edge that came down."""
    numbered = scratch.write(edge_table.withColumn("e", F.monotonically_increasing_id()), "edges")
    own = numbered.select("e", F.explode(F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))).alias("p")).select("e", "p.*")
    points = own.unionByName(_cuts(numbered)).join(numbered, "e")
    far = F.expr("CAST(x - x1 AS DOUBLE) * (x2 - x1) + CAST(y - y1 AS DOUBLE) * (y2 - y1)")
    along = Window.partitionBy("e").orderBy(far, "x", "y")
    cut = points.select("key", "side", "x", "y", F.lead("x").over(along).alias("nx"), F.lead("y").over(along).alias("ny")).where("x <> nx OR y <> ny")  # a point found twice is its own neighbour
    down = F.expr(f"y + {SHEAR} * x > ny + {SHEAR} * nx")
    turned = cut.select("key", "side", F.when(down, 1).otherwise(-1).alias("w"), *(F.when(down, F.col(p)).otherwise(F.col(q)).alias(n) for n, p, q in (("x1", "nx", "x"), ("y1", "ny", "y"), ("x2", "x", "nx"), ("y2", "y", "ny"))))
    winding = lambda side: F.sum(F.when(F.col("side") == side, F.col("w")).otherwise(0)).alias("ab"[side])
    return turned.groupBy("key", "x1", "y1", "x2", "y2").agg(winding(0), winding(1)).where("a <> 0 OR b <> 0")


def swept(edge_table: DataFrame) -> DataFrame:
    """(key, x1, y1, x2, y2, left_a, left_b, right_a, right_b): the pieces of edges (key, side, x1, y1, x2, y2) from their lower to their upper end, with the winding numbers
    of side 0 (a) and 1 (b) on both sides. Written to the shared folder: all operations on these regions can read it."""
    scratch = Scratch(edge_table.sparkSession, "regions")
    cut = scratch.write(pieces(edge_table, scratch), "pieces")
    height = lambda k: F.expr(f"y{k} + {SHEAR} * x{k}")
    ends = cut.select("key", F.explode(F.array(height(1), height(2))).alias("t")).distinct()
    numbered = scratch.write(ranked(ends, ["key", "t"], "n"), "ends")
    low, high = (numbered.select("key", F.col("t").alias(f"t{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    placed = cut.withColumn("t1", height(1)).join(low, ["key", "t1"]).drop("t1").withColumn("t2", height(2)).join(high, ["key", "t2"]).drop("t2")
    entered = placed.select("key", "x1", "y1", "x2", "y2", "a", "b", F.posexplode(F.expr("sequence(n1, n2 - 1)")).alias("step", "band"))
    band = Window.partitionBy("band")  # its pieces all reach from the last of their lower ends to the first of their upper ones, and nothing meets between
    reached = entered.withColumn("first", F.col("step") == 0).drop("step").withColumn("t1", height(1)).withColumn("t2", height(2)).withColumn("from", F.max("t1").over(band)).withColumn("to", F.min("t2").over(band))
    at = F.expr("x1 + ((from + to) / 2 - t1) / (t2 - t1) * (x2 - x1)")
    across = Window.partitionBy("band").orderBy("at", "x1", "x2")
    summed = reached.withColumn("at", at).withColumn("right_a", F.sum("a").over(across)).withColumn("right_b", F.sum("b").over(across)).where("first")
    return scratch.write(summed.selectExpr("key", "x1", "y1", "x2", "y2", "right_a - a AS left_a", "right_b - b AS left_b", "right_a", "right_b"), "swept")


def boundary(sweep: DataFrame, how: str, fill: str = "evenodd") -> DataFrame:
    """(key, x1, y1, x2, y2): the boundary of the result on the grid, the result on the left. fill: a point is in a region if its edges wind around it an odd number of
    times (evenodd), or at all (nonzero)."""
    if how not in HOW or fill not in FILLS:
        raise ValueError(f"how must be one of {sorted(HOW)}, fill one of {sorted(FILLS)}")
    inside, both = FILLS[fill], HOW[how]
    sides = [both(inside(F.col(f"{s}_a")), inside(F.col(f"{s}_b"))).alias(s) for s in ("left", "right")]
    kept = sweep.select("key", "x1", "y1", "x2", "y2", *sides).where("left <> right")
    return kept.select("key", *(F.when(F.col("left"), F.col(f"{c}{k}")).otherwise(F.col(f"{c}{3 - k}")).alias(f"{c}{k}") for k in (1, 2) for c in "xy"))


def measured(bounds: DataFrame, scale: float = SCALE) -> DataFrame:
    """(key, area, length) of results that aren't empty."""
    turn = F.expr("CAST(x1 AS DECIMAL(19,0)) * y2 - CAST(y1 AS DECIMAL(19,0)) * x2")
    length = F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("decimal(30,6)"))
    return bounds.groupBy("key").agg((F.sum(turn).cast("double") / (2 * scale * scale)).alias("area"), (length.cast("double") / scale).alias("length"))


def _straightened(points: Column) -> Column:
    """Without points that lie within a unit of the grid of the line of their neighbours."""

    def bent(q: Column) -> Column:
        def keep(p: Column, i: Column) -> Column:
            a, b = P.at(q, i - 1), P.at(q, i + 1)
            turn = F.abs((p.x - a.x).cast("double") * (b.y - p.y) - (p.y - a.y).cast("double") * (b.x - p.x))
            return turn > F.hypot(b.x - a.x, b.y - a.y)

        return F.filter(q, keep)

    return P.bound(points, bent)


def rings(bounds: DataFrame, scale: float = SCALE) -> DataFrame:
    """(key, ring, pts, area): the boundary's rings, outer ones counterclockwise, holes clockwise; ring counts them from 0 within a key."""
    arcs = ranked(bounds, ["key", "x1", "y1", "x2", "y2"], "id")
    listed = chains.grouped_rings(chains.by_wedge(arcs, ["key"]), ["key"], "region-chains").groupBy("key", "root").agg(F.array_sort(F.collect_list(F.struct("place", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("q"))
    plain = listed.select("key", "root", _straightened(F.transform("q", lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))).alias("q")).where("size(q) >= 3")
    back = F.transform("q", lambda p: F.struct((p.x / scale).alias("x"), (p.y / scale).alias("y")))
    shown = plain.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("root")) - 1).alias("ring"), back.alias("pts"))
    return shown.withColumn("area", P.signed_area(F.col("pts")))


def combined(pairs: DataFrame, how: str, key: str = "key", subject: str = "subject", clip: str = "clip", scale: float = SCALE, fill: str = "evenodd") -> DataFrame:
    """(key, rings, area) of each row's two regions (arrays of rings); keys are unique. An empty result has no rings and area 0."""
    both = edges(pairs, key, subject, 0, scale).unionByName(edges(pairs, key, clip, 1, scale))
    made = rings(boundary(swept(both), how, fill), scale).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ring", "pts", "area"))).alias("r"))
    found = made.select(F.col("key").alias(key), F.transform("r", lambda r: r.pts).alias("rings"), P.total(F.transform("r", lambda r: r.area)).alias("area"))
    none = F.array().cast("array<array<struct<x: double, y: double>>>")
    return pairs.select(key).join(found, key, "left").select(key, F.coalesce("rings", none).alias("rings"), F.coalesce("area", F.lit(0.0)).alias("area"))
