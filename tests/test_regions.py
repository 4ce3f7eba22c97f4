"""Regions and rings against plain forms: odd polygons, holes, edges and corners that touch, rings that cross themselves; loops with forks, and one slice over many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from meshlake.operators import chains, regions, slicing

PAIR = "key string, subject array<array<struct<x: double, y: double>>>, clip array<array<struct<x: double, y: double>>>, area string"


def rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def table(spark, rows):
    points = lambda rings: None if rings is None else [[(float(x), float(y)) for x, y in r] for r in rings]
    return spark.createDataFrame([(k, points(a), points(b), "x") for k, a, b in rows], PAIR)


def turn(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_closed_forms(spark):
    frame = [rect(0, 0, 10, 10), rect(2, 2, 8, 8)]
    rows = table(spark, [("cross", [rect(0, 0, 60, 40)], [rect(20, -10, 40, 50)]), ("frame", frame, [rect(4, 4, 6, 6)]), ("half", frame, [rect(0, 0, 5, 10)]), ("same", frame, frame[::-1]), ("corner", [rect(0, 0, 1, 1)], [rect(1, 1, 2, 2)]), ("line", [[(0, 0), (5, 0), (9, 0)]], [rect(0, 0, 1, 1)]), ("empty", [], [rect(0, 0, 1, 1)]), ("null", None, None), ("short", [[(0, 0), (1, 1)]], [])])
    want = {
        "union": {"cross": [2800], "frame": [-36, 4, 100], "half": [-18, 100], "same": [-36, 100], "corner": [1, 1], "line": [1], "empty": [1], "null": [], "short": []},
        "difference": {"cross": [800, 800], "frame": [-36, 100], "half": [32], "same": [], "corner": [1], "line": [], "empty": [], "null": [], "short": []},
        "intersection": {"cross": [800], "frame": [], "half": [32], "same": [-36, 100], "corner": [], "line": [], "empty": [], "null": [], "short": []},
        "xor": {"cross": [200, 200, 800, 800], "frame": [-36, 4, 100], "half": [18, 32], "same": [], "corner": [1, 1], "line": [1], "empty": [1], "null": [], "short": []},
    }
    for how, areas in want.items():
        found = {r.key: r for r in regions.combined(rows, how).collect()}
        assert {k: sorted(turn([tuple(p) for p in q]) for q in r.rings) for k, r in found.items()} == {k: pytest.approx(v) for k, v in areas.items()}, how
        assert all(r.area == pytest.approx(sum(areas[k])) for k, r in found.items())
    with pytest.raises(ValueError):
        regions.combined(rows, "minus")


def test_fill_rules(spark):
    """A square run around twice, and a pentagram: the middle is in by one rule alone."""
    star = [(0, 100), (59, -81), (-95, 31), (95, 31), (-59, -81)]
    rows = table(spark, [("twice", [rect(0, 0, 2, 2) + rect(0, 0, 2, 2)], []), ("star", [star], [])])
    odd, any_ = ({r.key: r for r in regions.combined(rows, "union", fill=f).collect()} for f in ("evenodd", "nonzero"))
    assert (odd["twice"].area, any_["twice"].area) == (0.0, 4.0)
    assert len(odd["star"].rings) == 5 and len(any_["star"].rings) == 1 and any_["star"].area > odd["star"].area > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_polygons(spark, seed):
    """Against the plain form, which tests every edge against every other; corners on a coarse lattice, so that edges often touch and overlap."""
    r = random.Random(seed)

    def ring():
        step = r.choice([1, 10])
        pts = [(r.randint(0, 6) * step, r.randint(0, 6) * step) for _ in range(3)]
        return pts if abs(turn(pts)) > 0 else ring()

    rows = [(str(k), [ring()], [ring()]) for k in range(60)]
    for how in ("union", "difference", "intersection"):
        found = {x.key: x.area for x in regions.combined(table(spark, rows), how).collect()}
        for k, a, b in rows:
            plain = sum(map(turn, slicing.combined(a, b, how)))
            assert found[k] == pytest.approx(plain, abs=2e-3), (how, a, b)


def test_equal_parts_make_the_whole(spark):
    """Many-cornered regions: union and intersection add up, whatever the shapes."""
    import math

    r = random.Random(3)
    wheel = lambda x, y, n: [(x + far * math.cos(2 * math.pi * i / n), y + far * math.sin(2 * math.pi * i / n)) for i in range(n) for far in [5 + 4 * r.random()]]
    rows = table(spark, [(str(k), [wheel(0, 0, 60)], [wheel(r.random() * 8, 0, 40)]) for k in range(4)])
    sweep = regions.swept(regions.edges(rows, "key", "subject", 0).unionByName(regions.edges(rows, "key", "clip", 1)))
    area = {how: {x.key: x.area for x in regions.measured(regions.boundary(sweep, how)).collect()} for how in regions.HOW}
    own = {x.key: x for x in rows.collect()}
    for k, x in own.items():
        a, b = (abs(turn([tuple(p) for p in q[0]])) for q in (x.subject, x.clip))
        assert area["union"][k] + area["intersection"][k] == pytest.approx(a + b, rel=1e-6)
        assert area["difference"][k] + area["intersection"][k] == pytest.approx(a, rel=1e-6)
        assert area["xor"][k] == pytest.approx(area["union"][k] - area["intersection"][k], rel=1e-6)


def test_no_task_holds_a_region(spark):
    plan = regions.swept(regions.edges(table(spark, [("a", [rect(0, 0, 1, 1)], [])]), "key", "subject", 0))
    assert "Python" not in regions.rings(regions.boundary(plan, "union"))._jdf.queryExecution().toString()


def segments(spark, rows):
    return spark.createDataFrame([(0, 0, *map(float, r)) for r in rows], "layer long, object_id long, x1 double, y1 double, x2 double, y2 double")


def test_loops_with_forks_and_ways_that_end(spark):
    ring = lambda *p: [(*a, *b) for a, b in zip(p, p[1:] + p[:1], strict=True)]
    eight = ring((0, 0), (1, 0), (1, 1)) + ring((0, 0), (-1, 0), (-1, -1))  # two rings that meet in a point
    tail = [(5, 5, 6, 5), (6, 5, 7, 5), (7, 5, 6, 6), (9, 9, 9, 9)]  # doesn't close; no length
    found = slicing.loops(segments(spark, eight + tail), scale=1).collect()
    assert sorted(len(x.pts) for x in found) == [6] or sorted(len(x.pts) for x in found) == [3, 3]
    assert {tuple(p) for x in found for p in x.pts} == {(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)}
    both = slicing.loops(segments(spark, [r if k % 2 else (*r[2:], *r[:2]) for k, r in enumerate(ring((0, 0), (4, 0), (4, 3), (0, 3)))]), directed=False, scale=1).collect()
    assert [len(x.pts) for x in both] == [4]
    assert slicing.loops(segments(spark, [])).count() == 0 and slicing.loops(segments(spark, tail), directed=False).count() == 0


def test_one_long_loop_is_many_rows(spark):
    """A loop of 3,000 segments in one slice: twelve rounds, and no operator that takes a slice or a loop whole."""
    n = 3000
    side = [(k, 0) for k in range(n // 2)] + [(k, 1) for k in range(n // 2 - 1, -1, -1)]
    rows = [(*a, *b) for a, b in zip(side, side[1:] + side[:1], strict=True)]
    random.Random(1).shuffle(rows)
    points = slicing.loop_points(segments(spark, rows), scale=1)
    assert [(r.x, r.y) for r in points.orderBy("place").collect()] == side
    plan = points._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    links = spark.range(10).select("id", (F.col("id") + 1).alias("next"))  # a way that never comes back
    assert chains.rings(links).count() == 0


def test_groups_are_chained_in_tasks_or_as_rows(spark, monkeypatch):
    """The same rings whichever way: groups within the bound in few stages, larger ones by doubling; ways that end and ids over several batches among them."""
    links, want = [], {}
    for g, size in enumerate((3, 40, 7, 1, 2, 25)):
        ids = random.Random(g).sample(range(1000 * g, 1000 * g + 999), size)
        root = ids.index(min(ids))
        links += [(g, i, g, ids[(k + 1) % size]) for k, i in enumerate(ids)] + [(g, 1000 * g + 999, g, 9999)]
        want |= {i: (g, min(ids), (k - root) % size, size) for k, i in enumerate(ids)}
    df = spark.createDataFrame(links, "g long, id long, x1 long, next long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    jobs = {}
    try:
        for held in (1 << 17, 10, 1):
            monkeypatch.setattr(chains, "_near", _bounded(held))
            spark.sparkContext.setJobGroup(f"held-{held}", "")
            got = {r.id: (r.x1, r.root, r.place, r.length) for r in chains.grouped_rings(df, ["g"]).collect()}
            jobs[held] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"held-{held}"))
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert jobs[1 << 17] < jobs[10]


def _bounded(held):
    def near(batches):
        from meshlake.operators import chains

        usual, chains.HELD = chains.HELD, held
        try:
            yield from chains._near(batches)
        finally:
            chains.HELD = usual

    return near
