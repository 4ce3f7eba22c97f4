"""SQL written by hand for slices of the sheet that fixtures.GRID spans over the parts: it shares no text with the library's expressions.

Corners are those of squares between neighbouring parts on a 40-wide sheet, each cut along one diagonal; planes stand at half layers of height 7 over the lowest corner.
"""

#: CTEs up to lines (layer, z, object_id, x1, y1, x2, y2): from where a triangle's border rises through the plane to where it falls.
LINES = """sheet AS (SELECT p_partkey // 40 AS i, p_partkey % 40 AS j, p_size::DOUBLE AS z FROM part),
squares AS (
    SELECT a.i // 5 AS object_id, 100.0e0 * a.j AS w, 100.0e0 * a.i AS s, 100.0e0 * a.j + 100 AS e, 100.0e0 * a.i + 100 AS n, a.z AS sw, b.z AS se, c.z AS nw, d.z AS ne, a.i * 40 + a.j AS k
    FROM sheet a JOIN sheet b ON b.i = a.i AND b.j = a.j + 1 JOIN sheet c ON c.i = a.i + 1 AND c.j = a.j JOIN sheet d ON d.i = a.i + 1 AND d.j = a.j + 1 WHERE a.j < 39),
sides AS (
    SELECT object_id, 2 * k AS t, w AS px, s AS py, sw AS pz, e AS qx, s AS qy, se AS qz FROM squares UNION ALL SELECT object_id, 2 * k, e, s, se, e, n, ne FROM squares UNION ALL SELECT object_id, 2 * k, e, n, ne, w, s, sw FROM squares
    UNION ALL SELECT object_id, 2 * k + 1, w, s, sw, e, n, ne FROM squares UNION ALL SELECT object_id, 2 * k + 1, e, n, ne, w, n, nw FROM squares UNION ALL SELECT object_id, 2 * k + 1, w, n, nw, w, s, sw FROM squares),
planes AS (SELECT l AS layer, (SELECT min(least(pz, qz)) FROM sides) + 7 * (l + 0.5e0) AS z FROM range(0, 8) x(l)),
cuts AS (
    SELECT layer, z, object_id, t, qz >= z AS rising, px + (z - pz) / (qz - pz) * (qx - px) AS x, py + (z - pz) / (qz - pz) * (qy - py) AS y
    FROM sides JOIN planes ON (pz < z AND qz >= z) OR (pz >= z AND qz < z)),
lines AS (
    SELECT a.layer, a.z, a.object_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM cuts a JOIN cuts b ON a.layer = b.layer AND a.object_id = b.object_id AND a.t = b.t AND a.rising AND NOT b.rising)"""
_SOLID = f"""{LINES},
fine AS (SELECT layer, object_id, round_even(x1 * 10000, 0)::BIGINT AS x1, round_even(y1 * 10000, 0)::BIGINT AS y1, round_even(x2 * 10000, 0)::BIGINT AS x2, round_even(y2 * 10000, 0)::BIGINT AS y2 FROM lines),
solid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY layer, object_id, x1, y1, x2, y2) AS id, * FROM fine WHERE x1 <> x2 OR y1 <> y2)"""
#: Up to loops (layer, object_id, loop_id, place, x, y): every walk from a segment goes on as long as it meets later ones only, and counts if it comes back.
_LOOPS = f"""{_SOLID},
links AS MATERIALIZED (
    SELECT c.id, g.id AS next FROM (SELECT *, row_number() OVER (PARTITION BY layer, object_id, x2, y2 ORDER BY id) AS n FROM solid) c
    JOIN (SELECT *, row_number() OVER (PARTITION BY layer, object_id, x1, y1 ORDER BY id) AS n FROM solid) g ON g.layer = c.layer AND g.object_id = c.object_id AND g.x1 = c.x2 AND g.y1 = c.y2 AND g.n = c.n),
walk AS (SELECT id AS root, id, 0 AS place FROM solid UNION ALL SELECT w.root, l.next, w.place + 1 FROM walk w JOIN links l ON l.id = w.id WHERE l.next > w.root),
closed AS (SELECT w.root FROM walk w JOIN links l ON l.id = w.id AND l.next = w.root WHERE w.place >= 2),
named AS (SELECT root, row_number() OVER (PARTITION BY layer, object_id ORDER BY root) - 1 AS loop_id FROM closed JOIN solid ON id = root),
loops AS (SELECT s.layer, s.object_id, n.loop_id, w.place, s.x1 AS x, s.y1 AS y FROM named n JOIN walk w ON w.root = n.root JOIN solid s ON s.id = w.id)"""
DIRECTED = f"WITH RECURSIVE {_LOOPS} SELECT layer, object_id, loop_id, list(x ORDER BY place) AS xs, list(y ORDER BY place) AS ys FROM loops GROUP BY ALL"
#: A walk leaves a segment by its end 2 (in its own sense) or 1; at a point, the first and second, third and fourth end belong together.
UNDIRECTED = f"""WITH RECURSIVE {_SOLID},
ends AS (SELECT layer, object_id, id, 1 AS e, x1 AS x, y1 AS y FROM solid UNION ALL SELECT layer, object_id, id, 2, x2, y2 FROM solid),
counted AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY layer, object_id, x, y ORDER BY id, e) AS n FROM ends),
links AS MATERIALIZED (SELECT a.id, a.e, b.id AS next, 3 - b.e AS leaves FROM counted a JOIN counted b ON a.layer = b.layer AND a.object_id = b.object_id AND a.x = b.x AND a.y = b.y AND b.n = CASE WHEN a.n % 2 = 1 THEN a.n + 1 ELSE a.n - 1 END),
walk AS (SELECT id AS root, id, 2 AS e, 0 AS place FROM solid UNION ALL SELECT w.root, l.next, l.leaves, w.place + 1 FROM walk w JOIN links l ON l.id = w.id AND l.e = w.e WHERE l.next > w.root),
closed AS (SELECT w.root FROM walk w JOIN links l ON l.id = w.id AND l.e = w.e AND l.next = w.root AND l.leaves = 2 WHERE w.place >= 2),
named AS (SELECT root, layer, object_id, row_number() OVER (PARTITION BY layer, object_id ORDER BY root) - 1 AS loop_id FROM closed JOIN solid ON id = root)
SELECT n.layer, n.object_id, n.loop_id, list(p.x ORDER BY w.place) AS xs, list(p.y ORDER BY w.place) AS ys
FROM named n JOIN walk w ON w.root = n.root JOIN ends p ON p.id = w.id AND p.e = 3 - w.e GROUP BY ALL"""
_BESIDE = ", ".join(f"coalesce(lead({c}) OVER o, first_value({c}) OVER o) AS next_{c}, coalesce(lag({c}) OVER o, last_value({c}) OVER (l ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS last_{c}" for c in "xy")


def _seen(of: str) -> str:
    """With the number of a loop's points, and the points before and after each."""
    return f"SELECT *, count(*) OVER l AS n, {_BESIDE} FROM {of} WINDOW l AS (PARTITION BY layer, object_id, loop_id), o AS (PARTITION BY layer, object_id, loop_id ORDER BY place)".replace("OVER (l ORDER", "OVER (PARTITION BY layer, object_id, loop_id ORDER")


#: Points at least 50 from the next; then points off the line of their neighbours; then loops of at least 10000, counterclockwise, from the least point.
NORMALIZED = f"""WITH RECURSIVE {_LOOPS},
far AS (SELECT layer, object_id, loop_id, place, x, y FROM ({_seen('loops')}) WHERE n < 3 OR sqrt((next_x - x) ^ 2 + (next_y - y) ^ 2) >= 50),
bent AS (SELECT layer, object_id, loop_id, place, x, y FROM ({_seen('far')}) WHERE n < 3 OR abs((x - last_x) * (next_y - y) - (y - last_y) * (next_x - x)) > 1),
turns AS (SELECT *, sum(x * next_y - y * next_x) OVER (PARTITION BY layer, object_id, loop_id) / 2.0e0 AS area FROM ({_seen('bent')})),
sized AS (SELECT *, CASE WHEN area > 0 THEN row_number() OVER l ELSE n + 1 - row_number() OVER l END AS spot FROM turns WHERE n >= 3 AND abs(area) >= 10000 WINDOW l AS (PARTITION BY layer, object_id, loop_id ORDER BY place)),
begun AS (SELECT *, first_value(spot) OVER (PARTITION BY layer, object_id, loop_id ORDER BY x, y, spot) AS begin FROM sized)
SELECT layer, object_id, loop_id, list(x / 10000.0e0 ORDER BY (spot - begin + n) % n) AS xs, list(y / 10000.0e0 ORDER BY (spot - begin + n) % n) AS ys, any_value(abs(area)) / 1e8 AS signed_area FROM begun GROUP BY layer, object_id, loop_id"""
