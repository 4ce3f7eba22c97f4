"""Slices of a mesh: planes, segments, loops. Regions are in regions.py; combined() here is the plain form of their boolean operations for two small regions."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.config import DEFAULT
from meshlake.functions import geometry as G
from meshlake.functions import polygons as P
from meshlake.functions.layers import over
from meshlake.operators import chains
from meshlake.operators.canonical import ranked
from meshlake.operators.spatial_join import layers_of
from meshlake.session import Scratch


def at_plane(triangles: DataFrame, z: float) -> DataFrame:
    """Triangles whose height range holds z, both ends included."""
    return over(triangles, [G.box()]).where((F.col("mnz") <= z) & (F.col("mxz") >= z))


def segments(triangles: DataFrame, height: float, z0: float | None = None) -> DataFrame:
    """(layer, object_id, tri_id, z, x1, y1, x2, y2): where the planes z0 + (layer + 0.5) * height cut the triangles. A corner at
    or above the plane is above. The triangle's outward side is on the right of the segment; triangles in the plane give
    none. Each triangle is taken once for each plane that it reaches; there is no join."""
    boxed = over(triangles, [G.box()])
    if z0 is None:
        z0 = float(boxed.agg(F.coalesce(F.min("mnz"), F.lit(0))).first()[0])
    cut = layers_of(boxed, z0 + height / 2, height)
    up = {f"{p}up": f"CASE WHEN {p}z >= z THEN 1 ELSE 0 END" for p in "abc"}
    crossing = {}
    for p, q in ("ab", "bc", "ca"):
        for c in "xy":
            crossing[f"{p}{q}{c}"] = f"{p}{c} + (z - {p}z) / nullif(CAST({q}z - {p}z AS DOUBLE), 0.0D) * ({q}{c} - {p}{c})"
    found = over(cut, [up, crossing]).where("aup + bup + cup BETWEEN 1 AND 2")
    # with one corner p above (or below) alone, its two edges are cut; from falling to rising edge
    falls = [f"{p}up = 1 AND {q}up = 0" for p, q in ("ab", "bc", "ca")]
    rises = [f"{p}up = 0 AND {q}up = 1" for p, q in ("ab", "bc", "ca")]
    pick = lambda tests, c: "CASE " + " ".join(f"WHEN {t} THEN {e}{c}" for t, e in zip(tests, ("ab", "bc", "ca"), strict=True)) + " END"
    return found.select(F.col("layer").cast("long").alias("layer"), "object_id", "tri_id", "z", *(F.expr(pick(rises if k == 1 else falls, c)).alias(f"{c}{k}") for k in (1, 2) for c in "xy"))


def _chained(segment_table: DataFrame, directed: bool, scale: int) -> DataFrame:
    """(layer, object_id, root, place, x, y): the points of loops that count."""
    keys = ["layer", "object_id"]
    on_grid = segment_table.select(*(F.col(k).cast("long").alias(k) for k in keys), *(F.rint(F.col(c) * scale).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))
    scratch = Scratch(segment_table.sparkSession, "loops")
    solid = scratch.write(on_grid.where("x1 <> x2 OR y1 <> y2"), "solid")  # finding the ranges' bounds would compute it once more
    numbered = scratch.write(ranked(solid, [*keys, "x1", "y1", "x2", "y2"], "id"), "segments")
    links = chains.by_rank(numbered, keys) if directed else chains.both_ways(numbered, keys)
    found = chains.grouped_rings(links, keys, "loops").where("length >= 3")
    if not directed:
        found = found.where("root % 2 = 0")
    return found.select(*keys, "root", "place", F.col("x1").alias("x"), F.col("y1").alias("y"))


def _loop_id() -> Column:
    return (F.row_number().over(Window.partitionBy("layer", "object_id").orderBy("root")) - 1).cast("long").alias("loop_id")


def loop_points(segment_table: DataFrame, directed: bool = True, scale: int = 10_000) -> DataFrame:
    """(layer, object_id, loop_id, place, x, y): the points of closed loops of segments on the integer grid, for each layer and object. Where several segments
    come to a point, the n-th in their order goes on with the n-th that leaves; without a sense, the ends at a point are paired in order. A loop begins
    with its least segment, and loops are numbered by these. What doesn't close, and loops of fewer than three segments, go. Chaining is by
    pointer doubling: no task holds a slice or a loop of more segments than chains.HELD."""
    points = _chained(segment_table, directed, scale)
    first = points.where("place = 0").select("layer", "object_id", "root", _loop_id())
    return points.join(first, ["layer", "object_id", "root"]).select("layer", "object_id", "loop_id", "place", "x", "y")


def loops(segment_table: DataFrame, directed: bool = True, scale: int = 10_000) -> DataFrame:
    """(layer, object_id, loop_id, pts): loop_points() with a loop's points as an array, which one row holds."""
    listed = _chained(segment_table, directed, scale).groupBy("layer", "object_id", "root").agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    return listed.select("layer", "object_id", _loop_id(), F.transform("p", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("pts"))


def normalized(loop_table: DataFrame, counterclockwise: bool = True, scale: int = 10_000) -> DataFrame:
    """Loops cleaned, large enough, in one sense, from their least point; coordinates as before the grid."""
    clean = loop_table.withColumn("pts", P.cleaned(F.col("pts")))
    large = clean.withColumn("area", P.signed_area(F.col("pts"))).where((F.size("pts") >= 3) & (F.abs("area") >= DEFAULT.min_loop_area))
    turned = large.withColumn("pts", P.aligned(P.oriented(F.col("pts"), counterclockwise))).withColumn("signed_area", P.signed_area(F.col("pts")) / float(scale * scale))
    back = F.transform("pts", lambda p: F.struct((p.x / scale).alias("x"), (p.y / scale).alias("y")))
    return turned.select("layer", "object_id", "loop_id", back.alias("pts"), "signed_area")


Point = tuple[float, float]


def _crossings(p: Point, q: Point, edges: list[tuple[Point, Point]]) -> list[float]:
    out = [0.0, 1.0]
    dx, dy = q[0] - p[0], q[1] - p[1]
    for a, b in edges:
        ex, ey = b[0] - a[0], b[1] - a[1]
        det = dx * ey - dy * ex
        fx, fy = a[0] - p[0], a[1] - p[1]
        if abs(det) > 1e-12:
            t, u = (fx * ey - fy * ex) / det, (fx * dy - fy * dx) / det
            if -1e-12 <= u <= 1 + 1e-12 and 1e-12 < t < 1 - 1e-12:
                out.append(t)
        elif abs(fx * dy - fy * dx) < 1e-9:
            length = dx * dx + dy * dy
            out += [t for x, y in (a, b) if 1e-12 < (t := ((x - p[0]) * dx + (y - p[1]) * dy) / length) < 1 - 1e-12]
    return sorted(set(out))


def _inside(x: float, y: float, rings: list[list[Point]]) -> bool:
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def combined(subject: list[list[Point]], clip: list[list[Point]], how: str, scale: float = 1e6) -> list[list[Point]]:
    """Union, difference or intersection of two regions: their edges, cut at all crossings, of which those stay that have the
    result on one side only; chained into rings with the result on the left."""
    rings = [[tuple(p) for p in r] for r in subject], [[tuple(p) for p in r] for r in clip]
    sides = [[(p, q) for r in side for p, q in zip(r, r[1:] + r[:1], strict=True)] for side in rings]
    test = {"union": lambda a, b: a or b, "difference": lambda a, b: a and not b, "intersection": lambda a, b: a and b}[how]
    eps = 1e-7 * max([1.0, *(abs(c) for side in rings for r in side for p in r for c in p)])
    kept: dict[Point, list[Point]] = defaultdict(list)
    snap = lambda x, y: (round(x * scale) / scale, round(y * scale) / scale)
    seen = set()
    for own, other in (sides, sides[::-1]):
        for p, q in own:
            ts = _crossings(p, q, other)
            for s, t in zip(ts, ts[1:], strict=False):
                a, b = (snap(p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])) for k in (s, t))
                if a == b:
                    continue
                mx, my = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2
                length = ((b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2) ** 0.5
                nx, ny = -(b[1] - a[1]) / length * eps, (b[0] - a[0]) / length * eps
                left, right = (test(*(_inside(mx + k * nx, my + k * ny, r) for r in rings)) for k in (1, -1))
                if left != right:
                    e = (a, b) if left else (b, a)
                    if e not in seen:
                        seen.add(e)
                        kept[e[0]].append(e[1])
    out = []
    for start in sorted(kept):
        while kept[start]:
            ring, here = [start], kept[start].pop()
            while here != start and kept[here]:
                ring.append(here)
                here = kept[here].pop()
            if here == start:
                out.append([p for k, p in enumerate(ring) if abs((p[0] - ring[k - 1][0]) * (ring[(k + 1) % len(ring)][1] - p[1]) - (p[1] - ring[k - 1][1]) * (ring[(k + 1) % len(ring)][0] - p[0])) > 1e-12])
    return out


def offset(ring: list[Point], distance: float) -> list[Point]:
    """A counterclockwise ring with each edge moved outwards, corners mitred."""
    out = []
    for k, p in enumerate(ring):
        a, b = ring[k - 1], ring[(k + 1) % len(ring)]
        lines = []
        for u, v in ((a, p), (p, b)):
            dx, dy = v[0] - u[0], v[1] - u[1]
            length = (dx * dx + dy * dy) ** 0.5
            lines.append((dy / length, -dx / length))
        (nx, ny), (mx, my) = lines
        s = 1 + nx * mx + ny * my
        out.append((p[0] + distance * (nx + mx) / s, p[1] + distance * (ny + my) / s))
    return out


def offset_rings(rows: DataFrame, distance: float, key: str = "key", ring: str = "ring") -> DataFrame:
    """(key, ring, area): convex or mildly concave rings moved outwards by distance, with higher-order functions."""
    q = F.col(ring)

    def moved(pts):
        def corner(p, i):
            a, b = P.at(pts, i - 1), P.at(pts, i + 1)
            unit = lambda u, v: (F.sqrt(F.pow(v.x - u.x, 2) + F.pow(v.y - u.y, 2)), v.x - u.x, v.y - u.y)
            (l1, dx, dy), (l2, ex, ey) = unit(a, p), unit(p, b)
            nx, ny, mx, my = dy / l1, -dx / l1, ey / l2, -ex / l2
            s = 1 + nx * mx + ny * my
            return F.struct((p.x + distance * (nx + mx) / s).alias("x"), (p.y + distance * (ny + my) / s).alias("y"))

        return F.transform(pts, corner)

    return rows.select(key, P.bound(P.oriented(q), moved).alias("moved")).select(key, F.col("moved").alias("ring"), P.signed_area(F.col("moved")).alias("area"))
