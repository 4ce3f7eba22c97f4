"""Scalar geometry as SQL text, so that Catalyst compiles it and any engine can check it. Points are three columns with a
common prefix; triangles are the points a, b, c."""

from __future__ import annotations

import math

from meshlake.config import DEFAULT
from meshlake.functions.layers import Layers

Vector = tuple[str, str, str]


def point(prefix: str) -> Vector:
    return tuple(f"{prefix}{c}" for c in "xyz")


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))


def dot(a: Vector, b: Vector) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: Vector, b: Vector) -> Vector:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a: Vector) -> str:
    return f"sqrt({dot(a, a)})"


def named(prefix: str, v: Vector) -> dict[str, str]:
    return dict(zip(point(prefix), v, strict=True))


def quantized(v: str, accuracy: int = DEFAULT.accuracy) -> str:
    """A FLOAT column on the integer grid: rounded half to even in single precision, scaled, and cut off."""
    scale = f"CAST({10**accuracy} AS FLOAT)"
    return f"CAST(CAST(CAST(CAST(rint({v} * {scale}) AS FLOAT) / {scale} AS FLOAT) * {scale} AS FLOAT) AS BIGINT)"


def normal(prefix: str = "", out: str = "n", least: float = 0.1) -> Layers:
    """Unit normal as {out}x.., NULL where the cross product is shorter than least."""
    a, b, c = (point(f"{prefix}{p}") for p in "abc")
    double = tuple(f"CAST({x} AS DOUBLE)" for x in cross(minus(b, a), minus(c, a)))
    raw = point(f"{out}raw")
    return [named(f"{out}raw", double), {f"{out}len": norm(raw)}, {k: f"CASE WHEN {out}len >= {least} THEN {v} / {out}len END" for k, v in zip(point(out), raw, strict=True)}]


def metrics() -> Layers:
    """Edges, least edge, perimeter and area of the triangle a, b, c."""
    a, b, c = (tuple(f"CAST({x} AS DOUBLE)" for x in point(p)) for p in "abc")
    edges = {"e0": minus(a, c), "e1": minus(b, a), "e2": minus(c, b)}
    return [
        {f"{k}_len": norm(v) for k, v in edges.items()} | named("w", cross(edges["e0"], edges["e1"])),
        {"min_edge": "least(e0_len, e1_len, e2_len)", "max_edge": "greatest(e0_len, e1_len, e2_len)", "perimeter": "e0_len + e1_len + e2_len", "area": f"0.5 * {norm(point('w'))}"},
    ]


def grade(value: str, bounds: tuple[float, ...], upper: bool = True) -> str:
    """0 to 4: the first bound, inclusive, that value is within."""
    sign = "<=" if upper else ">="
    return "CASE " + " ".join(f"WHEN {value} {sign} {b} THEN {i}" for i, b in enumerate(bounds)) + f" ELSE {len(bounds)} END"


def grades(diagonal: str, user_edge: float = 0.0) -> Layers:
    """Shape, error and area grades; needs metrics(). diagonal: of the object's box."""
    return [
        {"shape_ratio": f"CASE WHEN area > 0 THEN perimeter * perimeter / ({math.pi} * area) ELSE 1e300 END", "error": f"greatest(CAST({user_edge} AS DOUBLE), 1e-10 * {diagonal})"},
        {
            "shape_grade": grade("shape_ratio", DEFAULT.shape_grades),
            "error_grade": grade("CASE WHEN min_edge > 0 THEN error / min_edge ELSE 1e300 END", DEFAULT.error_grades),
            "area_grade": grade("CASE WHEN area > 0 THEN 0.5 * max_edge * error / area ELSE 1e300 END", DEFAULT.error_grades),
        },
    ]


def band(grades_: list[str]) -> str:
    """The worst grade's name."""
    return f"CASE greatest({', '.join(grades_)}) WHEN 4 THEN 'critical' WHEN 3 THEN 'bad' WHEN 2 THEN 'warn' WHEN 1 THEN 'ok' ELSE 'safe' END"


def box(prefix: str = "") -> dict[str, str]:
    return {f"{m}{c}": f"{f}({', '.join(f'{prefix}{p}{c}' for p in 'abc')})" for m, f in (("mn", "least"), ("mx", "greatest")) for c in "xyz"}


def boxes_overlap(a: str, b: str) -> str:
    """Closed overlap of two boxes whose columns have the prefixes a and b."""
    return " AND ".join(f"{a}mn{c} <= {b}mx{c} AND {b}mn{c} <= {a}mx{c}" for c in "xyz")


def degrees_between(n: str, m: str) -> str:
    """Angle of two unit normals without regard to their sense, in degrees; NULL if one is NULL."""
    cosine = f"abs({dot(point(n), point(m))})"
    return f"degrees(acos(CASE WHEN {cosine} > 1.0D THEN 1.0D ELSE {cosine} END))"  # least() would pass over a NULL


def clamp(v: str) -> str:
    return f"greatest(0.0D, least(1.0D, {v}))"


def point_segment(p: str, a: str, b: str, out: str) -> Layers:
    """Squared distance of a point to a segment."""
    d = minus(point(b), point(a))
    return [
        {f"{out}t": f"CASE WHEN {dot(d, d)} > 0 THEN {clamp(f'{dot(minus(point(p), point(a)), d)} / {dot(d, d)}')} ELSE 0.0D END"},
        {out: " + ".join(f"({p}{c} - {a}{c} - {out}t * ({b}{c} - {a}{c})) * ({p}{c} - {a}{c} - {out}t * ({b}{c} - {a}{c}))" for c in "xyz")},
    ]


def point_triangle() -> Layers:
    """Distance of the point p to the triangle a, b, c (all DOUBLE): to the plane if the foot is inside, else to an edge."""
    a, b, c, p = (point(x) for x in "abcp")
    sides = [point_segment("p", x, y, f"d{x}{y}") for x, y in ("ab", "bc", "ca")]
    both = [{k: v for s in sides for k, v in s[i].items()} for i in range(2)]
    n = point("q")
    inside = [dot(cross(minus(y, x), minus(p, x)), n) for x, y in ((a, b), (b, c), (c, a))]
    return [
        both[0] | named("q", cross(minus(b, a), minus(c, a))),
        both[1] | {"qq": dot(n, n), "height": dot(minus(p, a), n)} | {f"in{k}": e for k, e in enumerate(inside)},
        {"distance": "sqrt(CASE WHEN qq > 0 AND in0 >= 0 AND in1 >= 0 AND in2 >= 0 THEN height * height / qq ELSE least(dab, dbc, dca) END)"},
    ]


def segment_segment() -> Layers:
    """Distance of the segments a-b and c-d (all DOUBLE)."""
    a, b, c, d = (point(x) for x in "abcd")
    u, v, r = minus(b, a), minus(d, c), minus(a, c)
    zero = lambda over_, under: f"CASE WHEN {under} > 1e-10 THEN {clamp(f'{over_} / {under}')} ELSE 0.0D END"
    return [
        {"uu": dot(u, u), "vv": dot(v, v), "uv": dot(u, v), "ur": dot(u, r), "vr": dot(v, r)},
        {"den": "uu * vv - uv * uv"},
        {"s0": zero("(uv * vr - ur * vv)", "den")},
        {"t0": "CASE WHEN vv > 1e-10 THEN (uv * s0 + vr) / vv ELSE 0.0D END"},
        {"s1": f"CASE WHEN t0 < 0 THEN {zero('(-ur)', 'uu')} WHEN t0 > 1 THEN {zero('(uv - ur)', 'uu')} ELSE s0 END", "t1": clamp("t0")},
        {"distance": "sqrt(" + " + ".join(f"(a{k} - c{k} + s1 * (b{k} - a{k}) - t1 * (d{k} - c{k})) * (a{k} - c{k} + s1 * (b{k} - a{k}) - t1 * (d{k} - c{k}))" for k in "xyz") + ")"},
    ]


def orient(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], eps: float = 1e-9) -> str:
    value = f"(({b[0]} - {a[0]}) * ({c[1]} - {a[1]}) - ({b[1]} - {a[1]}) * ({c[0]} - {a[0]}))"
    return f"CASE WHEN {value} > {eps} THEN 1 WHEN {value} < -{eps} THEN -1 ELSE 0 END"


def strictly_cross(a, b, c, d, eps: float = 1e-9) -> str:
    return f"(({orient(a, b, c, eps)}) * ({orient(a, b, d, eps)}) < 0 AND ({orient(c, d, a, eps)}) * ({orient(c, d, b, eps)}) < 0)"


def location(p, a, b, c, eps: float = 1.0) -> str:
    """INSIDE, ON_EDGE or OUTSIDE of a 2-D triangle. A cross product within eps means ON_EDGE, outside as well."""
    turn = lambda x, y: f"(({y[0]} - {x[0]}) * ({p[1]} - {x[1]}) - ({y[1]} - {x[1]}) * ({p[0]} - {x[0]}))"
    t = [turn(a, b), turn(b, c), turn(c, a)]
    return f"CASE WHEN {' OR '.join(f'abs({x}) <= {eps}' for x in t)} THEN 'ON_EDGE' WHEN ({' AND '.join(f'{x} > 0' for x in t)}) OR ({' AND '.join(f'{x} < 0' for x in t)}) THEN 'INSIDE' ELSE 'OUTSIDE' END"


def rotation_to(v: tuple[float, float, float]) -> list[list[float]]:
    """The matrix that turns the z axis to v (Rodrigues' formula); constants of a plan."""
    length = math.sqrt(sum(x * x for x in v))
    if not math.isfinite(length) or length == 0:
        raise ValueError("a direction needs a finite length")
    x, y, z = (c / length for c in v)
    if z <= -1 + 1e-12:
        return [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]]
    k = 1 / (1 + z)
    return [[1 - x * x * k, -x * y * k, x], [-x * y * k, 1 - y * y * k, y], [-x, -y, z]]


def mixed_box(matrix: list[list[float]]) -> tuple[dict[str, str], dict[str, str]]:
    """Vertices of a triangle combined by a matrix over the vertices (not the axes), and the box around the results."""
    combined = {f"m{j}{c}": " + ".join(f"({matrix[j][i]!r}D) * {p}{c}" for i, p in enumerate("abc")) for j in range(3) for c in "xyz"}
    return combined, {f"{m}{c}": f"{f}({', '.join(f'm{j}{c}' for j in range(3))})" for m, f in (("mn", "least"), ("mx", "greatest")) for c in "xyz"}
