"""Joins of boxes that overlap, as equi-joins of grid cells.

Each box enters all cells that it reaches, both sides are joined by cell, and a pair counts only in the cell where the
overlap begins, so no pair is found twice and nothing has to be made distinct. Boxes that reach more than WIDE cells stay
out of the grid and are joined by a coarser one, whose cells are that many times as long; so a few huge boxes don't flood
the cells, and no box is joined with all others.

Boxes of which each meets thousands (mixed ones) are joined by where they begin: of two that overlap, one begins within the other along each axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import geometry as G
from meshlake.functions.layers import over
from meshlake.operators import kd
from meshlake.schemas import BOX, POINTS
from meshlake.session import Scratch

WIDE = 64
#: A cell's length in long boxes: a box that just fits a cell reaches two in each axis, so small cells copy each row more often than they save comparisons.
GRAIN = 2
#: Cells in a long box, along each axis, where boxes are joined by where they begin: more of them copy more rows and leave fewer comparisons without result.
FINE = 4
AXES = "xy"


def levels(df: DataFrame, cell: float, axes: str = AXES, wide: int = WIDE) -> Column:
    """How many times the cells' length must be multiplied by wide for a box to reach at most wide of them an axis."""
    longest = F.greatest(*((F.col(f"mx{c}") - F.col(f"mn{c}")).cast("double") for c in axes)) if len(axes) > 1 else (F.col(f"mx{axes}") - F.col(f"mn{axes}")).cast("double")
    return _level(longest / cell, wide)


def _level(reached: Column, wide: int = WIDE) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log(float(wide), F.greatest(F.lit(1.0), reached / (wide - 1))))).cast("int")


def _cells(df: DataFrame, length: Column, axes: str) -> DataFrame:
    for c in axes:
        reach = F.sequence(F.floor(F.col(f"mn{c}") / length), F.floor(F.col(f"mx{c}") / length))
        df = df.withColumn(f"cell{c}", F.explode(reach))
    return df


def cell_size(boxes: DataFrame, axes: str = AXES) -> float:
    """The length of a cell: what 95 of 100 boxes don't exceed, approximately. One small aggregate."""
    longest = F.greatest(*(F.col(f"mx{c}") - F.col(f"mn{c}") for c in axes))
    found = boxes.agg(F.percentile_approx(longest.cast("double"), 0.95, 1000)).first()[0]
    return float(found) if found else 1.0


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], cell: float | None = None, axes: str = AXES) -> DataFrame:
    """Pairs of rows of left and right that agree in keys and whose boxes overlap, closed. Columns of left get the prefix
    l_, those of right r_; keys stay."""
    size = cell or GRAIN * cell_size(left, axes)
    sides = []
    for prefix, df in (("l_", left), ("r_", right)):
        sides.append((prefix, df.withColumn("_level", levels(df, size, axes))))
    found = None
    all_levels = sorted({r[0] for _, d in sides for r in d.select("_level").distinct().collect()}) or [0]
    for a in all_levels:
        for b in all_levels:
            length = F.lit(float(size * WIDE ** max(a, b)))
            parts = []
            for (prefix, df), level in zip(sides, (a, b), strict=True):
                own = _cells(df.where(F.col("_level") == level), length, axes).drop("_level")
                parts.append(own.select(*keys, *(f"cell{c}" for c in axes), *(F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in (*keys, "_level"))))
            where = F.expr(G.boxes_overlap("l_", "r_"))
            for c in axes:
                where &= F.col(f"cell{c}") == F.floor(F.greatest(F.col(f"l_mn{c}"), F.col(f"r_mn{c}")) / length)
            pairs = parts[0].join(parts[1], [*keys, *(f"cell{c}" for c in axes)]).where(where).drop(*(f"cell{c}" for c in axes))
            found = pairs if found is None else found.unionByName(pairs)
    return found


def beginning(boxes: DataFrame, fine: int = FINE) -> DataFrame:
    """Pairs of rows of different objects whose boxes overlap, closed, each once. Columns get the prefixes l_ and r_; l begins later in y (at the same place the larger object).

    In x, too, one of them begins within the other. If that is l, its one cell meets all cells that r reaches; if it is r, l's one cell in y and all in x meet r's one in x and all in y. In cells that
    both sides reach, short ones find a pair many times; here they hold hardly more pairs than overlap. Each axis has its own length of cells, so boxes that are long in one don't make cells large in the other.
    Nulls overlap nothing; without them, coordinates are columns that can't be null, which the join compares in half the time."""
    known = ["object_id", *BOX]
    boxes = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in known)).select(*(F.coalesce(c, F.lit(0).cast(t)).alias(c) if c in known else c for c, t in boxes.dtypes))
    length = {c: (F.col(f"mx{c}") - F.col(f"mn{c}")).cast("double") for c in AXES}
    long = boxes.agg(*(F.percentile_approx(length[c], 0.95, 1000).alias(c) for c in AXES)).first()
    cell = {c: (long[c] or 1.0) / fine for c in AXES}
    levelled = boxes.withColumn("_level", _level(F.greatest(*(length[c] / cell[c] for c in AXES))))
    all_levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())
    spark = boxes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # given, as few bytes are much work here and aren't to be put together by their size
    rest = "l_mny <= r_mxy AND r_mny <= l_mny AND l_mnz <= r_mxz AND r_mnz <= l_mxz AND l_object_id <> r_object_id AND (r_mny < l_mny OR r_object_id < l_object_id)"
    found = None
    for a in all_levels or [0]:
        for b in all_levels or [0]:
            for l_x, r_x, begins in (("one", "all", "r_mnx <= l_mnx AND l_mnx <= r_mxx"), ("all", "one", "l_mnx < r_mnx AND r_mnx <= l_mxx")):
                parts = []
                for prefix, level, reached in (("l_", a, {"x": l_x, "y": "one"}), ("r_", b, {"x": r_x, "y": "all"})):
                    own = levelled.where(F.col("_level") == level)
                    for c, cells in reached.items():
                        first, last = (F.floor(F.col(f"{m}{c}") / (cell[c] * WIDE ** max(a, b))) for m in ("mn", "mx"))
                        own = own.withColumn(f"cell{c}", first if cells == "one" else F.explode(F.sequence(first, last)))
                    parts.append(own.select("cellx", "celly", *(F.col(c).alias(f"{prefix}{c}") for c in boxes.columns)).repartition(tasks, "cellx", "celly"))
                pairs = parts[0].join(parts[1], ["cellx", "celly"]).where(f"{begins} AND {rest}").drop("cellx", "celly")
                found = pairs if found is None else found.unionByName(pairs)
    return found


def object_pairs(boxes: DataFrame) -> DataFrame:
    """(obj1 < obj2) of objects whose boxes overlap; objects are few next to triangles, but are dealt by cells as well."""
    a = boxes.select(F.lit(0).alias("all"), *boxes.columns)
    pairs = overlapping(a, a, ["all"])
    return pairs.where("l_object_id < r_object_id").select(F.col("l_object_id").alias("obj1"), F.col("r_object_id").alias("obj2"))


def triangle_pairs(triangles: DataFrame, mode: str = "aabb", grow: float = 0.0, cells: str = "grid", kept: Sequence[str] = ()) -> DataFrame:
    """(obj1, obj2, tri1, tri2) of triangles of different objects whose boxes overlap, obj1 < obj2, and the columns kept of both, as t1_.. and t2_...

    aabb: their boxes; mixed: the boxes of their vertices combined by the matrix that turns z to (1, 1, 100), as well;
    expanded: boxes grown by grow times the shorter edge, which finds all pairs within the largest gap.
    cells: grid, of one size in x and y; kd, fitted to the boxes in all three axes (kd.py), for models that are tall or dense in places.
    Mixed boxes are long, so each meets thousands: by the grid, they are joined by where they begin. Pairs of the boxes themselves that mixed ones give as well are left out where they are found, so
    that no pair comes twice, none is shuffled to see that, and the large join carries nothing for it."""
    if cells not in ("grid", "kd"):
        raise ValueError("cells must be grid or kd")
    if mode not in ("aabb", "mixed", "expanded"):
        raise ValueError("mode must be aabb, mixed or expanded")
    kept = list(kept)
    plain = triangles.select("object_id", "tri_id", *POINTS, *(c for c in kept if c not in POINTS))
    boxed = over(plain, [G.box()])
    if mode == "expanded":
        edged = over(plain.drop("min_edge"), [*G.metrics(), G.box()])
        boxed = edged.select("object_id", "tri_id", *kept, *((F.col(k) + (grow if k.startswith("mx") else -grow) * F.col("min_edge")).alias(k) for k in BOX))
    if mode != "mixed":
        return _pairs(boxed.select("object_id", "tri_id", *kept, *BOX), cells, kept)
    combined, turned = G.mixed_box(G.rotation_to((1, 1, 100)))
    both = over(plain, [combined, {f"mixed_{k}": v for k, v in turned.items()} | G.box()]).select("object_id", "tri_id", *kept, *BOX, *(f"mixed_{k}" for k in BOX))
    written = Scratch(triangles.sparkSession, "mixed").write(both, "boxes")  # read for each side of each join; the expressions are long
    found = _pairs(written, cells, kept, f"NOT ({G.boxes_overlap('l_mixed_', 'r_mixed_')})")
    mixed = written.select("object_id", "tri_id", *kept, *(F.col(f"mixed_{k}").alias(k) for k in BOX))
    if cells == "kd":
        return found.union(_pairs(mixed, cells, kept))
    ordered = F.col("l_object_id") < F.col("r_object_id")
    one = {k: {c: F.when(ordered, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")) for c in ("object_id", "tri_id", *kept)} for k, a, b in ((1, "l", "r"), (2, "r", "l"))}
    ids = (one[k][c].alias(f"{n}{k}") for c, n in (("object_id", "obj"), ("tri_id", "tri")) for k in (1, 2))
    return found.union(beginning(mixed).select(*ids, *(one[k][c].alias(f"t{k}_{c}") for k in (1, 2) for c in kept)))


def _pairs(boxes: DataFrame, cells: str, kept: Sequence[str] = (), condition: str = "true") -> DataFrame:
    if cells == "kd":
        found = kd.overlapping(boxes, boxes, [], condition="l_object_id < r_object_id").where(condition)
    else:
        a = boxes.select(F.lit(0).alias("all"), *boxes.columns)
        found = overlapping(a, a, ["all"]).where("l_object_id < r_object_id").where(condition)
    ids = (F.col(f"{s}_{c}").alias(n) for s, c, n in (("l", "object_id", "obj1"), ("r", "object_id", "obj2"), ("l", "tri_id", "tri1"), ("r", "tri_id", "tri2")))
    return found.select(*ids, *(F.col(f"{s}_{c}").alias(f"t{k}_{c}") for s, k in ("l1", "r2") for c in kept))


def layers_of(triangles: DataFrame, z0: float, height: float, name: str = "layer") -> DataFrame:
    """Each triangle once for each plane z0 + layer * height that it reaches, closed: a sequence, not a join."""
    low, high = F.ceil((F.col("mnz") - z0) / height), F.floor((F.col("mxz") - z0) / height)
    reached = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return triangles.withColumn(name, F.explode(reached)).withColumn("z", z0 + F.col(name) * height)
