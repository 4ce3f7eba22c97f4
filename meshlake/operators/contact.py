"""Contacts of triangles: candidates through the gates of angle, gap and overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.config import DEFAULT, Config
from meshlake.functions import geometry as G
from meshlake.functions import kernels as K
from meshlake.operators.canonical import measured
from meshlake.operators.spatial_join import triangle_pairs
from meshlake.schemas import POINTS
from meshlake.session import Scratch

PAIR = ["obj1", "obj2", "tri1", "tri2"]
KEPT = [*POINTS, "nx", "ny", "nz", "min_edge", "shape_grade"]


def angle_gate(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """With the angle of the normals; pairs with a triangle without normal, or beyond the angle, go."""
    turned = [f"t{k}_n" for k in "12"]
    return pairs.withColumn("angle", F.expr(G.degrees_between(*turned))).where(F.col("angle") <= config.normal_angle)


def _batches(pairs: DataFrame, more: list[str], compute) -> DataFrame:
    """compute(columns), over Arrow batches, gives the new columns (DOUBLE) and which rows stay (None: all); columns(names) are arrays of doubles."""
    schema = T.StructType([*pairs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in more)])

    def run(batches):
        for batch in batches:
            columns = lambda names: tuple(batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names)  # noqa: B023, E731
            made, kept = compute(columns)
            out = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64()) for v in made)], schema.names)
            yield out if kept is None else out.filter(pa.array(kept))

    return pairs.mapInArrow(run, schema)


def _triangle(columns, k: str) -> dict[str, tuple]:
    return {p: columns([f"t{k}_{p}{c}" for c in "xyz"]) for p in "abc"}


def least_distances(pairs: DataFrame, corners: bool = True, edges: bool = True) -> DataFrame:
    """(pair, gap): the least distance of the six corners to the other triangle, of the nine pairs of edges, or of both."""
    points = [f"t{k}_{p}" for k in "12" for p in POINTS]
    found = _batches(pairs.select(*PAIR, *points), ["gap"], lambda columns: ([K.least_distance(_triangle(columns, "1"), _triangle(columns, "2"), corners, edges)], None))
    return found.select(*PAIR, "gap")


def _gaps(columns, config: Config) -> tuple[np.ndarray, np.ndarray]:
    short = np.fmin(*columns(["t1_min_edge", "t2_min_edge"]))
    gap = K.least_distance(_triangle(columns, "1"), _triangle(columns, "2"))
    gap = np.where(gap < config.snap_gap * short, 0.0, gap)
    return gap, gap <= config.most_gap * short


def gap_gate(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """With the gap, 0 below a hundredth of the shorter edge; pairs beyond half of it go. Rows stay where they are: nothing is shuffled."""

    def compute(columns):
        gap, near = _gaps(columns, config)
        return [gap], near

    return _batches(pairs, ["gap"], compute)


def overlap() -> list[dict[str, str]]:
    """Layers that turn both triangles so that the mean of their normals points up, and drop that axis: u and v of the
    corners, t1_au.. and so on. The normals' senses are made to agree first; corners are relative to the mean of both."""
    dot = G.dot(G.point("t1_n"), G.point("t2_n"))
    mean = {f"o{c}": "(" + " + ".join(f"t{k}_{p}{c}" for k in "12" for p in "abc") + ") / 6.0D" for c in "xyz"}
    axis = {f"w{c}": f"t1_n{c} + {{s}} * t2_n{c}".replace("{s}", "side") for c in "xyz"}
    out = [{"side": f"CASE WHEN {dot} < 0 THEN -1.0D ELSE 1.0D END"}, mean | axis, {"wl": G.norm(G.point("w"))}]
    out += [{f"m{c}": f"w{c} / wl" for c in "xyz"}, {"tip": "CASE WHEN mz < -1.0D + 1e-12 THEN 0.0D ELSE 1.0D / (1.0D + mz) END"}]
    flat = {}
    for k in "12":
        for p in "abc":
            x, y, z = (f"(t{k}_{p}{c} - o{c})" for c in "xyz")
            flat[f"t{k}_{p}u"] = f"CASE WHEN tip = 0.0D THEN {x} ELSE (1.0D - mx * mx * tip) * {x} - mx * my * tip * {y} - mx * {z} END"
            flat[f"t{k}_{p}v"] = f"CASE WHEN tip = 0.0D THEN -{y} ELSE (1.0D - my * my * tip) * {y} - mx * my * tip * {x} - my * {z} END"
    return [*out, flat]


COVERS = ["cover1", "cover2", "cover_max", "intersection_area"]


def _covers(columns) -> list[np.ndarray]:
    """COVERS. Two triangles of the worst shape cover nothing."""
    a1, a2, raw = K.overlap(_triangle(columns, "1"), _triangle(columns, "2"), *(columns([f"t{k}_n{c}" for c in "xyz"]) for k in "12"))
    worst1, worst2 = columns(["t1_shape_grade", "t2_shape_grade"])
    none = (np.fmin(a1, a2) < 1e-12) | ((worst1 == 4) & (worst2 == 4))
    area = np.where(none, 0.0, np.fmin(np.fmin(raw, a1), a2))
    with np.errstate(all="ignore"):
        cover1, cover2 = (np.where(none, 0.0, np.fmin(1.0, area / a)) for a in (a1, a2))
    return [cover1, cover2, np.fmax(cover1, cover2), area]


def _covered(pairs: DataFrame, config: Config) -> DataFrame:
    return pairs.select(*PAIR, "angle", "gap", *COVERS, (F.col("cover_max") >= config.overlap).alias("area_pass"))


def overlap_gate(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """With cover1, cover2, cover_max, intersection_area and area_pass."""
    return _covered(_batches(pairs, COVERS, lambda columns: (_covers(columns), None)), config)


def gates(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """gap_gate and overlap_gate in one pass over the pairs."""

    def compute(columns):
        gap, near = _gaps(columns, config)
        covers = _covers(lambda names: tuple(v[near] for v in columns(names)))
        whole = [np.full(len(gap), np.nan) for _ in covers]
        for v, c in zip(whole, covers, strict=True):
            v[near] = c
        return [gap, *whole], near

    return _covered(_batches(pairs, ["gap", *COVERS], compute), config)


def candidates(whole: DataFrame, mode: str = "aabb", config: Config = DEFAULT) -> DataFrame:
    """Pairs of measured triangles with overlapping boxes, with both triangles' columns, prefixed t1_ and t2_. The columns go through the join of
    the boxes, where a triangle stands once for each cell; pairs, which are many more, aren't shuffled again to fetch them."""
    return triangle_pairs(whole, mode, config.most_gap, kept=KEPT)


def contacts(triangles: DataFrame, config: Config = DEFAULT, mode: str = "aabb", whole: DataFrame | None = None) -> DataFrame:
    """The pair table of a model: candidates by boxes, then the three gates, cheapest first, in one stage. It is written to the shared
    folder, as most results read it several times. whole: the measured triangles, if they're written already."""
    scratch = Scratch(triangles.sparkSession, "contacts")
    whole = scratch.write(measured(triangles), "triangles") if whole is None else whole
    return scratch.write(gates(angle_gate(candidates(whole, mode, config), config), config), "pairs")
