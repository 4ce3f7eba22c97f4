"""Distances and overlaps of pairs of triangles over Arrow batches, in numpy: the formulas of geometry.py and polygons.py, step by step, for all rows of a batch at once. As
expressions they make methods that are too long for the JVM to compile, and run interpreted. Points are tuples of arrays; as in Spark, NaN is greater than all numbers."""

from __future__ import annotations

import numpy as np

Array = np.ndarray
Point = tuple[Array, ...]
CORNERS = "abc"
EDGES = (("a", "b"), ("b", "c"), ("c", "a"))


def _minus(a: Point, b: Point) -> Point:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def _dot(a: Point, b: Point) -> Array:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Point, b: Point) -> Point:
    return tuple(a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1)))


def _clamped(v: Array) -> Array:
    return np.fmax(0.0, np.fmin(1.0, v))


def _squared(parts: Point) -> Array:
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def point_triangle(p: Point, t: dict[str, Point]) -> Array:
    """Squared distance of points to triangles."""
    sides = {u + v: _minus(t[v], t[u]) for u, v in EDGES}
    away = {u: _minus(p, t[u]) for u in CORNERS}
    near = None
    for u, v in EDGES:
        d = sides[u + v]
        dd = _dot(d, d)
        k = np.where(dd > 0, _clamped(_dot(away[u], d) / dd), 0.0)
        far = _squared(tuple(a - k * b for a, b in zip(away[u], d, strict=True)))
        near = far if near is None else np.fmin(near, far)
    q = _cross(sides["ab"], _minus(t["c"], t["a"]))
    qq, height = _dot(q, q), _dot(away["a"], q)
    inside = qq > 0
    for u, v in EDGES:
        inside &= _dot(_cross(sides[u + v], away[u]), q) >= 0
    return np.where(inside, height * height / qq, near)


def segment_segment(a: Point, b: Point, c: Point, d: Point) -> Array:
    """Squared distance of the segments a-b and c-d."""
    u, v, r = _minus(b, a), _minus(d, c), _minus(a, c)
    uu, vv, uv, ur, vr = _dot(u, u), _dot(v, v), _dot(u, v), _dot(u, r), _dot(v, r)
    share = lambda over, under: np.where(under > 1e-10, _clamped(over / under), 0.0)
    s0 = share(uv * vr - ur * vv, uu * vv - uv * uv)
    t0 = np.where(vv > 1e-10, (uv * s0 + vr) / vv, 0.0)
    s1 = np.where(t0 < 0, share(-ur, uu), np.where(t0 > 1, share(uv - ur, uu), s0))
    t1 = _clamped(t0)
    return _squared(tuple(x + s1 * y - t1 * z for x, y, z in zip(r, u, v, strict=True)))


def least_distance(one: dict[str, Point], two: dict[str, Point], corners: bool = True, edges: bool = True) -> Array:
    """The least of the distances of six corners to the other triangle, of nine pairs of edges, or of both."""
    near = np.full(len(one["a"][0]), np.nan)
    with np.errstate(all="ignore"):
        if corners:
            for own, other in ((one, two), (two, one)):
                for p in CORNERS:
                    near = np.fmin(near, point_triangle(own[p], other))
        if edges:
            for u, v in EDGES:
                for x, y in EDGES:
                    near = np.fmin(near, segment_segment(one[u], one[v], two[x], two[y]))
        return np.sqrt(near)


def flattened(one: dict[str, Point], two: dict[str, Point], n1: Point, n2: Point) -> tuple[list, list]:
    """Both triangles as lists of (u, v), turned so that the mean of their normals points up."""
    side = np.where(_dot(n1, n2) < 0, -1.0, 1.0)
    mean = tuple((one["a"][k] + one["b"][k] + one["c"][k] + two["a"][k] + two["b"][k] + two["c"][k]) / 6.0 for k in range(3))
    axis = tuple(x + side * y for x, y in zip(n1, n2, strict=True))
    long = np.sqrt(_dot(axis, axis))
    mx, my, mz = (w / long for w in axis)
    down = mz < -1.0 + 1e-12
    tip = np.where(down, 0.0, 1.0 / (1.0 + mz))

    def turned(p: Point) -> tuple[Array, Array]:
        x, y, z = _minus(p, mean)
        return np.where(tip == 0.0, x, (1.0 - mx * mx * tip) * x - mx * my * tip * y - mx * z), np.where(tip == 0.0, -y, (1.0 - my * my * tip) * y - mx * my * tip * x - my * z)

    return [turned(one[p]) for p in CORNERS], [turned(two[p]) for p in CORNERS]


def _doubled(t: list[tuple[Array, Array]]) -> Array:
    """Twice the signed area of triangles."""
    (au, av), (bu, bv), (cu, cv) = t
    return (bu - au) * (cv - av) - (bv - av) * (cu - au)


def _counterclockwise(t: list[tuple[Array, Array]], doubled: Array) -> list[tuple[Array, Array]]:
    kept = doubled >= 0
    return [t[0], *(tuple(np.where(kept, x, y) for x, y in zip(t[i], t[3 - i], strict=True)) for i in (1, 2))]


def _shared(one: list[tuple[Array, Array]], two: list[tuple[Array, Array]]) -> Array:
    """Area that counterclockwise triangles share: the corners of each within the other and the crossings of their sides, around the mean of these points. Every
    step is that of the queries' SQL, in its order: covers are compared with thresholds, and one of exactly a half has to come out on the SQL's side of 0.5."""
    sides = [[(t[i], t[(i + 1) % 3]) for i in range(3)] for t in (one, two)]
    points = []
    for t, other in ((one, sides[1]), (two, sides[0])):
        for cx, cy in t:
            within = np.ones(len(cx), bool)
            for (x, y), (qx, qy) in other:
                within &= (qx - x) * (cy - y) - (qy - y) * (cx - x) >= -1e-7
            points.append((within, cx, cy))
    for (ax, ay), (aqx, aqy) in sides[0]:
        for (bx, by), (bqx, bqy) in sides[1]:
            det = (aqx - ax) * (bqy - by) - (aqy - ay) * (bqx - bx)
            t = ((bx - ax) * (bqy - by) - (by - ay) * (bqx - bx)) / det
            u = ((bx - ax) * (aqy - ay) - (by - ay) * (aqx - ax)) / det
            points.append(((np.abs(det) > 1e-6) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), ax + t * (aqx - ax), ay + t * (aqy - ay)))
    there, xs, ys = (np.stack(v) for v in zip(*points, strict=True))
    size = there.sum(0)
    xs, ys = (np.where(there, v, 0.0) for v in (xs, ys))
    xs, ys = (v - np.add.accumulate(v)[-1] / size for v in (xs, ys))
    angle = np.where(there, np.arctan2(ys, xs), np.inf)
    order = np.lexsort((ys, xs, angle), 0)
    xs, ys = (np.take_along_axis(v, order, 0) for v in (xs, ys))
    total = np.zeros(len(size))
    for i in range(int(size.max(initial=0))):
        j = min(i + 1, len(xs) - 1)
        nx, ny = (np.where(i + 1 < size, v[j], v[0]) for v in (xs, ys))
        total = np.where(i < size, total + (xs[i] * ny - ys[i] * nx), total)
    return np.abs(total) / 2


def overlap(one: dict[str, Point], two: dict[str, Point], n1: Point, n2: Point) -> tuple[Array, Array, Array]:
    """Areas of both triangles in the plane between them, and of what they share there."""
    with np.errstate(all="ignore"):
        flat = flattened(one, two, n1, n2)
        doubled = [_doubled(t) for t in flat]
        shared = _shared(*(_counterclockwise(t, d) for t, d in zip(flat, doubled, strict=True)))
        return np.abs(doubled[0]) / 2, np.abs(doubled[1]) / 2, shared
