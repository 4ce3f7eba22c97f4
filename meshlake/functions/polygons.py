"""Polygons as arrays of structs (x, y), with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlake.config import DEFAULT


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def at(points: Column, i: Column) -> Column:
    """The i-th point, counted around."""
    n = F.size(points)
    return F.get(points, (i + n) % n)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(points: Column) -> Column:
    """Positive if counterclockwise."""
    turn = lambda p, i: p.x * at(points, i + 1).y - p.y * at(points, i + 1).x
    return total(F.transform(points, lambda p, i: turn(p, i).cast("double"))) / 2


def oriented(points: Column, counterclockwise: bool = True) -> Column:
    return bound(points, lambda q: F.when((signed_area(q) > 0) == F.lit(counterclockwise), q).otherwise(F.reverse(q)))


def aligned(points: Column) -> Column:
    """Turned so that the point with the least x, then y, comes first."""

    def turned(q: Column) -> Column:
        k = F.array_position(q, F.array_min(q)).cast("int")
        return F.when(F.size(q) > 0, F.concat(F.slice(q, k, F.size(q)), F.slice(q, 1, k - 1))).otherwise(q)

    return bound(points, turned)


def cleaned(points: Column, close: float = DEFAULT.close_points, flat: float = 1.0) -> Column:
    """Without points close to the next one; then without those on the line of their neighbours. Fewer than three
    points are left as they are, and so is what would become fewer."""

    def far(q: Column) -> Column:
        step = lambda p, i: F.sqrt(F.pow(at(q, i + 1).x - p.x, 2) + F.pow(at(q, i + 1).y - p.y, 2))
        return F.filter(q, lambda p, i: step(p, i) >= close)

    def bent(q: Column) -> Column:
        def turn(p, i):
            a, b = at(q, i - 1), at(q, i + 1)
            return F.abs((p.x - a.x) * (b.y - p.y) - (p.y - a.y) * (b.x - p.x))

        return F.filter(q, lambda p, i: turn(p, i) > flat)

    first = bound(points, lambda q: F.when(F.size(q) < 3, q).otherwise(far(q)))
    return bound(first, lambda q: F.when(F.size(q) < 3, q).otherwise(bent(q)))


def clipped(subject: Column, clip: Column, corners: int) -> Column:
    """A convex polygon cut by a counterclockwise convex one with that many corners, edge by edge."""
    result = subject
    for k in range(corners):
        result = bound(result, _cut(F.get(clip, F.lit(k)), F.get(clip, F.lit((k + 1) % corners))))
    return result


def _cut(a: Column, b: Column):
    """A function that keeps what lies left of the line from a to b."""

    def side(p: Column) -> Column:
        return (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x)

    def whole(q: Column) -> Column:
        def parts(p: Column, i: Column) -> Column:
            own = F.struct(p.x.alias("x"), p.y.alias("y"))
            none = F.filter(F.array(own), lambda _: F.lit(False))

            def pair(s: Column) -> Column:
                t = s.u / (s.u - s.v)
                cut = F.struct((p.x + t * (s.q.x - p.x)).alias("x"), (p.y + t * (s.q.y - p.y)).alias("y"))
                inside = s.u >= -1e-12
                return F.concat(F.when(inside, F.array(own)).otherwise(none), F.when(inside != (s.v >= -1e-12), F.array(cut)).otherwise(none))

            other = at(q, i + 1)
            return bound(F.struct(side(p).alias("u"), side(other).alias("v"), other.alias("q")), pair)

        return F.flatten(F.transform(q, parts))

    return whole


def grid(points: Column, scale: int = 10_000) -> Column:
    return F.transform(points, lambda p: F.struct(F.rint(p.x * scale).cast("long").alias("x"), F.rint(p.y * scale).cast("long").alias("y")))
