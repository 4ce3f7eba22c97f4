"""SQL for scalar geometry, written by hand from what each function means. It shares no text with the library's expressions, so that a fault in one shows.

Each function takes SQL for triangles (object_id, tri_id, ax .. cz) and gives a statement.
"""

from __future__ import annotations


def boxes(t: str) -> str:
    return f"SELECT object_id, tri_id, least(ax, bx, cx) AS mnx, least(ay, by_, cy) AS mny, least(az, bz, cz) AS mnz, greatest(ax, bx, cx) AS mxx, greatest(ay, by_, cy) AS mxy, greatest(az, bz, cz) AS mxz FROM ({_renamed(t)})"


def _renamed(t: str) -> str:
    """The corner's y under a name that isn't a keyword."""
    return f'SELECT object_id, tri_id, ax, ay, az, bx, "by" AS by_, bz, cx, cy, cz FROM ({t})'


def normals(t: str, least: str) -> str:
    """(b - a) x (c - a) over its length; none if that is under least."""
    return f"""SELECT object_id, tri_id, CASE WHEN d >= {least} THEN i / d END AS nx, CASE WHEN d >= {least} THEN j / d END AS ny, CASE WHEN d >= {least} THEN k / d END AS nz
FROM (SELECT object_id, tri_id, i, j, k, sqrt(i * i + j * j + k * k) AS d FROM (
    SELECT object_id, tri_id, CAST(v2 * w3 - v3 * w2 AS DOUBLE) AS i, CAST(v3 * w1 - v1 * w3 AS DOUBLE) AS j, CAST(v1 * w2 - v2 * w1 AS DOUBLE) AS k
    FROM (SELECT object_id, tri_id, bx - ax AS v1, by_ - ay AS v2, bz - az AS v3, cx - ax AS w1, cy - ay AS w2, cz - az AS w3 FROM ({_renamed(t)}))))"""


def metrics(t: str) -> str:
    """Sides by Pythagoras, area by the length of the cross product."""
    return f"""SELECT object_id, tri_id, least(p, q, r) AS min_edge, greatest(p, q, r) AS max_edge, p + q + r AS perimeter, sqrt((u2 * w3 - u3 * w2) ^ 2 + (u3 * w1 - u1 * w3) ^ 2 + (u1 * w2 - u2 * w1) ^ 2) / 2 AS area
FROM (SELECT *, sqrt(u1 ^ 2 + u2 ^ 2 + u3 ^ 2) AS p, sqrt((w1 - u1) ^ 2 + (w2 - u2) ^ 2 + (w3 - u3) ^ 2) AS q, sqrt(w1 ^ 2 + w2 ^ 2 + w3 ^ 2) AS r
    FROM (SELECT object_id, tri_id, (bx - ax)::DOUBLE AS u1, (by_ - ay)::DOUBLE AS u2, (bz - az)::DOUBLE AS u3, (cx - ax)::DOUBLE AS w1, (cy - ay)::DOUBLE AS w2, (cz - az)::DOUBLE AS w3 FROM ({_renamed(t)})))"""


def _steps(value: str, one: str, two: str, three: str, four: str) -> str:
    return f"(({value}) > {one})::INT + (({value}) > {two})::INT + (({value}) > {three})::INT + (({value}) > {four})::INT"


def graded(t: str) -> str:
    """How many of four bounds each ratio is beyond: perimeter squared over pi times the area; a billionth of a tenth of the object's diagonal over the shortest side; half the
    longest side times the same over the area. Nothing divided by is beyond all."""
    return f"""SELECT object_id, tri_id, CASE WHEN area > 0 THEN {_steps("perimeter * perimeter / (pi() * area)", "12", "50", "400", "1000")} ELSE 4 END AS shape_grade,
CASE WHEN min_edge > 0 THEN {_steps("1e-10 * diagonal / min_edge", "0.1", "1", "2", "10")} ELSE 4 END AS error_grade, CASE WHEN area > 0 THEN {_steps("0.5 * max_edge * 1e-10 * diagonal / area", "0.1", "1", "2", "10")} ELSE 4 END AS area_grade
FROM ({metrics(t)}) JOIN (SELECT object_id, sqrt((max(mxx) - min(mnx))::DOUBLE ^ 2 + (max(mxy) - min(mny))::DOUBLE ^ 2 + (max(mxz) - min(mnz))::DOUBLE ^ 2) AS diagonal FROM ({boxes(t)}) GROUP BY object_id) USING (object_id)"""


def measured(t: str) -> str:
    """Triangles with their sides, area, normal, box and grades; object_id and tri_id name a triangle."""
    key = "USING (object_id, tri_id)"
    return f"SELECT r.*, m.min_edge, m.max_edge, m.perimeter, m.area, n.nx, n.ny, n.nz, x.mnx, x.mny, x.mnz, x.mxx, x.mxy, x.mxz, g.shape_grade, g.error_grade, g.area_grade FROM ({t}) r JOIN ({metrics(t)}) m {key} JOIN ({normals(t, '0.1')}) n {key} JOIN ({boxes(t)}) x {key} JOIN ({graded(t)}) g {key}"


BAND = "['safe', 'ok', 'warn', 'bad', 'critical'][1 + greatest(shape_grade, error_grade, area_grade)]"
CLASSIFIED = "SELECT l_orderkey, l_linenumber, " + _steps("l_quantity", "5", "20", "30", "45") + " AS upper_grade, (l_quantity < 45)::INT + (l_quantity < 30)::INT + (l_quantity < 20)::INT + (l_quantity < 5)::INT AS lower_grade FROM lineitem"


def halves(t: str) -> str:
    """The angle between the planes of the two triangles of a square, from 0 to 90 degrees."""
    n = normals(t, "0.1")
    return f"SELECT a.object_id, a.tri_id, b.tri_id AS neighbour, round(least(90, degrees(acos(least(1, abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))))) + 0 * a.nx * b.nx, 6) AS angle FROM ({n}) a JOIN ({n}) b ON b.object_id = a.object_id AND b.tri_id = a.tri_id + 1 WHERE a.tri_id % 2 = 0"


def point_to_triangle(t: str) -> str:
    """The point 150 east and 60 south of the first corner, 35 over the second: by the regions of the plane of the triangle that it can lie over (two sides' dot products tell which)."""
    return f"""WITH s AS (
    SELECT object_id, tri_id, bx - ax AS u1, by_ - ay AS u2, bz - az AS u3, cx - ax AS w1, cy - ay AS w2, cz - az AS w3, 150.0e0 AS g1, -60.0e0 AS g2, (bz + 35 - az)::DOUBLE AS g3 FROM ({_renamed(t)})),
d AS (
    SELECT *, u1 * g1 + u2 * g2 + u3 * g3 AS d1, w1 * g1 + w2 * g2 + w3 * g3 AS d2, u1 * (g1 - u1) + u2 * (g2 - u2) + u3 * (g3 - u3) AS d3, w1 * (g1 - u1) + w2 * (g2 - u2) + w3 * (g3 - u3) AS d4,
        u1 * (g1 - w1) + u2 * (g2 - w2) + u3 * (g3 - w3) AS d5, w1 * (g1 - w1) + w2 * (g2 - w2) + w3 * (g3 - w3) AS d6 FROM s),
v AS (SELECT *, d1 * d4 - d3 * d2 AS vc, d5 * d2 - d1 * d6 AS vb, d3 * d6 - d5 * d4 AS va FROM d),
f AS (
    SELECT *, CASE WHEN d1 <= 0 AND d2 <= 0 THEN [0, 0] WHEN d3 >= 0 AND d4 <= d3 THEN [1, 0] WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN [d1 / (d1 - d3), 0] WHEN d6 >= 0 AND d5 <= d6 THEN [0, 1]
        WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN [0, d2 / (d2 - d6)] WHEN va <= 0 AND d4 >= d3 AND d5 >= d6 THEN [1 - (d4 - d3) / (d4 - d3 + d5 - d6), (d4 - d3) / (d4 - d3 + d5 - d6)] ELSE [vb / (va + vb + vc), vc / (va + vb + vc)] END AS foot FROM v)
SELECT object_id, tri_id, round(sqrt((g1 - foot[1] * u1 - foot[2] * w1) ^ 2 + (g2 - foot[1] * u2 - foot[2] * w2) ^ 2 + (g3 - foot[1] * u3 - foot[2] * w3) ^ 2), 5) AS distance FROM f"""


def _to_segment(p: str, a: str, u: str, n: int) -> str:
    """Distance of a point to the segment from a along u, columns p1 .. p3 and so on."""
    d = [f"({p}{k} - {a}{k})" for k in (1, 2, 3)]
    along = f"greatest(0, least(1, ({' + '.join(f'{d[k]} * {u}{k + 1}' for k in range(3))}) / nullif({u}1 ^ 2 + {u}2 ^ 2 + {u}3 ^ 2, 0)))"
    return f"sqrt({' + '.join(f'({d[k]} - coalesce({along}, 0) * {u}{k + 1}) ^ 2' for k in range(3))}) AS e{n}"


def segment_to_segment(t: str) -> str:
    """The side a-b, and the segment from 40 past c to 90 past a in all axes: where the lines' nearest points lie on both, the distance of the lines; else the least from an end to the other segment."""
    return f"""WITH s AS (
    SELECT object_id, tri_id, ax::DOUBLE AS a1, ay::DOUBLE AS a2, az::DOUBLE AS a3, bx::DOUBLE AS b1, by_::DOUBLE AS b2, bz::DOUBLE AS b3, cx + 40.0e0 AS c1, cy + 40.0e0 AS c2, cz + 40.0e0 AS c3, ax + 90.0e0 AS d1, ay + 90.0e0 AS d2, az + 90.0e0 AS d3 FROM ({_renamed(t)})),
u AS (SELECT *, b1 - a1 AS u1, b2 - a2 AS u2, b3 - a3 AS u3, d1 - c1 AS v1, d2 - c2 AS v2, d3 - c3 AS v3, c1 - a1 AS w1, c2 - a2 AS w2, c3 - a3 AS w3 FROM s),
n AS (SELECT *, u2 * v3 - u3 * v2 AS n1, u3 * v1 - u1 * v3 AS n2, u1 * v2 - u2 * v1 AS n3 FROM u),
m AS (SELECT *, n1 ^ 2 + n2 ^ 2 + n3 ^ 2 AS nn FROM n),
e AS (
    SELECT *, ((w2 * v3 - w3 * v2) * n1 + (w3 * v1 - w1 * v3) * n2 + (w1 * v2 - w2 * v1) * n3) / nullif(nn, 0) AS f, ((w2 * u3 - w3 * u2) * n1 + (w3 * u1 - w1 * u3) * n2 + (w1 * u2 - w2 * u1) * n3) / nullif(nn, 0) AS g,
        {_to_segment('c', 'a', 'u', 1)}, {_to_segment('d', 'a', 'u', 2)}, {_to_segment('a', 'c', 'v', 3)}, {_to_segment('b', 'c', 'v', 4)} FROM m)
SELECT object_id, tri_id, round(CASE WHEN f BETWEEN 0 AND 1 AND g BETWEEN 0 AND 1 THEN abs(w1 * n1 + w2 * n2 + w3 * n3) / sqrt(nn) ELSE least(e1, e2, e3, e4) END, 5) AS distance FROM e"""


def turned(t: str) -> str:
    """Corner a under the rotation that takes z to (1, 2, 3): p + k x p + k x (k x p) / (1 + c), k the cross product of z with the direction, c its third part."""
    return f"""WITH d AS (SELECT object_id, tri_id, ax::DOUBLE AS x, ay::DOUBLE AS y, az::DOUBLE AS z, -2 / sqrt(14) AS k1, 1 / sqrt(14) AS k2, 3 / sqrt(14) AS c FROM ({t})),
o AS (SELECT *, k2 * z AS i, -k1 * z AS j, k1 * y - k2 * x AS k FROM d)
SELECT object_id, tri_id, round(x + i + k2 * k / (1 + c), 5) AS rx, round(y + j - k1 * k / (1 + c), 5) AS ry, round(z + k + (k1 * j - k2 * i) / (1 + c), 5) AS rz FROM o"""


def planar(t: str) -> str:
    """Points against triangles and segments in the plane: sides by signs of doubled areas, 1 wide for lying on a side."""
    area = lambda a, b, c: f"(({b}x - {a}x) * ({c}y - {a}y) - ({c}x - {a}x) * ({b}y - {a}y))"
    apart = lambda a, b: f"(sign({area(a, b, 'p')}) * sign({area(a, b, 'o')}) = -1 AND sign({area('p', 'o', a)}) * sign({area('p', 'o', b)}) = -1)"
    s, u, v = area("a", "b", "p"), area("b", "c", "p"), area("c", "a", "p")
    return f"""SELECT k, CASE WHEN least(abs({s}), abs({u}), abs({v})) <= 1 THEN 'ON_EDGE' WHEN sign({s}) = sign({u}) AND sign({u}) = sign({v}) THEN 'INSIDE' ELSE 'OUTSIDE' END AS place, sign({s})::INT AS turn,
{apart('a', 'b')} OR {apart('b', 'c')} OR {apart('c', 'a')} AS crosses FROM (SELECT k, x AS px, y AS py, ax, ay, bx, "by", cx, cy, ox, oy FROM ({t}))"""
