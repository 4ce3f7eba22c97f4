"""From contact pairs to patches: summaries, promotion, adjacency-curvature-area graphs, components and their links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.config import DEFAULT, Config
from meshlake.functions import geometry as G
from meshlake.operators import graph

SIDE = ["obj1", "obj2", "side"]


def sides(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both objects: side 1 and 2, tri_id, other, cover, and the pair's values."""
    seen = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"tri{k}").alias("tri_id"), F.col(f"tri{3 - k}").alias("other"), F.col(f"cover{k}").alias("cover")) for k in (1, 2))))
    return pairs.select("obj1", "obj2", "intersection_area", "area_pass", seen.alias("s")).select("obj1", "obj2", "s.*", "intersection_area", "area_pass")


def with_object(df: DataFrame) -> DataFrame:
    return df.withColumn("object_id", F.when(F.col("side") == 1, F.col("obj1")).otherwise(F.col("obj2")))


def summary(pairs: DataFrame, triangles: DataFrame) -> DataFrame:
    """Of passing pairs, a row for each side and triangle: cover_sum, the opposite triangles, the triangle's area grade."""
    sums = sides(pairs).where("area_pass").groupBy(*SIDE, "tri_id").agg(F.sum("cover").alias("cover_sum"), F.array_sort(F.collect_set("other")).alias("adj_obj_list"))
    grade = triangles.select("object_id", "tri_id", F.col("area_grade").alias("parametric_area_grade"))
    return with_object(sums).join(grade, ["object_id", "tri_id"], "left").drop("object_id")


def threshold(grade: Column, config: Config = DEFAULT) -> Column:
    chosen = F
    for g, value in config.cover_thresholds.items():
        chosen = chosen.when(grade == g, value)
    return chosen.otherwise(config.cover_threshold)


def validated(summed: DataFrame, rule=threshold) -> DataFrame:
    """With threshold, main_evaluation (cover above it), adj_obj_tri_evaluation (the opposite triangles' main evaluations,
    NULL where one has no row) and final_evaluation: by itself, or by one opposite triangle. One hop, no fixpoint."""
    own = summed.withColumn("threshold", rule(F.col("parametric_area_grade"))).withColumn("main_evaluation", F.col("cover_sum") > F.col("threshold"))
    other = own.select("obj1", "obj2", (3 - F.col("side")).alias("side"), F.col("tri_id").alias("other"), F.col("main_evaluation").alias("other_main"))
    seen = own.select(*SIDE, "tri_id", F.explode("adj_obj_list").alias("other")).join(other, [*SIDE, "other"], "left")
    told = seen.groupBy(*SIDE, "tri_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("other", "other_main")))).alias("adj_obj_tri_evaluation"), F.coalesce(F.bool_or("other_main"), F.lit(False)).alias("_any"))
    return own.join(told, [*SIDE, "tri_id"], "left").withColumn("final_evaluation", F.col("main_evaluation") | F.coalesce("_any", F.lit(False))).drop("_any")


def cover_areas(pairs: DataFrame) -> DataFrame:
    """A row for each side and triangle: sums of cover and area and the opposite triangles, of passing pairs and others."""
    part = lambda flag: F.struct(F.coalesce(F.sum(F.when(flag, F.col("cover"))), F.lit(0.0)).alias("area_ratio"), F.coalesce(F.sum(F.when(flag, F.col("intersection_area"))), F.lit(0.0)).alias("area_acc"), F.array_sort(F.collect_set(F.when(flag, F.col("other")))).alias("adj_tri_ids"))
    return sides(pairs).groupBy(*SIDE, "tri_id").agg(part(F.col("area_pass")).alias("cover_true"), part(~F.col("area_pass")).alias("cover_false"))


def accepted_graph(accepted: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(obj1, obj2, side, tri_id, neighbour) of neighbours that are accepted both."""
    nodes = with_object(accepted.select(*SIDE, "tri_id"))
    near = nodes.join(neighbours, ["object_id", "tri_id"])
    return near.join(nodes.select(*SIDE, F.col("tri_id").alias("neighbour")), [*SIDE, "neighbour"], "left_semi").select(*SIDE, "tri_id", "neighbour")


def curvature(accepted: DataFrame, edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """With adj, deg (largest angle to an accepted neighbour, 0 below one degree; NULL without any) and ddeg (largest
    difference of deg to a neighbour)."""
    normals = triangles.select("object_id", "tri_id", "nx", "ny", "nz")
    near = with_object(edges).join(normals, ["object_id", "tri_id"]).join(normals.toDF("object_id", "neighbour", "mx", "my", "mz"), ["object_id", "neighbour"])
    angle = near.withColumn("angle", F.expr(G.degrees_between("n", "m")))
    deg = angle.groupBy(*SIDE, "tri_id").agg(F.array_sort(F.collect_set("neighbour")).alias("adj"), F.max(F.when(F.col("angle") < 1, 0.0).otherwise(F.col("angle"))).alias("deg"))
    other = deg.select(*SIDE, F.col("tri_id").alias("neighbour"), F.col("deg").alias("other_deg"))
    step = F.abs(F.col("deg") - F.col("other_deg"))
    ddeg = edges.join(deg.select(*SIDE, "tri_id", "deg"), [*SIDE, "tri_id"]).join(other, [*SIDE, "neighbour"]).groupBy(*SIDE, "tri_id").agg(F.max(F.when(step < 1, 0.0).otherwise(step)).alias("ddeg"))
    joined = accepted.select(*SIDE, "tri_id").join(deg, [*SIDE, "tri_id"], "left").join(ddeg, [*SIDE, "tri_id"], "left")
    return joined.withColumn("adj", F.coalesce("adj", F.array().cast("array<bigint>")))


def area_graph(accepted: DataFrame, pairs: DataFrame, edges: DataFrame, triangles: DataFrame) -> DataFrame:
    """The adjacency-curvature-area graph: accepted triangles only, sums over all pairs that came through the gates."""
    return curvature(accepted, edges, triangles).join(cover_areas(pairs), [*SIDE, "tri_id"], "left")


def patch_components(accepted: DataFrame, edges: DataFrame) -> DataFrame:
    """(obj1, obj2, side, comp_id, tri_id): comp_id is the smallest tri_id. Sides are kept apart by nodes that hash them."""
    key = lambda c: F.xxhash64(*SIDE, c)
    nodes = accepted.select(*SIDE, "tri_id", key("tri_id").alias("id"))
    found = graph.components(edges.select(key("tri_id").alias("a"), key("neighbour").alias("b")), nodes.select("id"))
    joined = nodes.join(found, "id")
    names = joined.groupBy("component").agg(F.min("tri_id").alias("comp_id"))
    return joined.join(names, "component").select(*SIDE, "comp_id", "tri_id")


def component_links(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(obj1, obj2, comp1, comp2) of components with a passing pair between them."""
    side = lambda k: parts.where(F.col("side") == k).select("obj1", "obj2", F.col("tri_id").alias(f"tri{k}"), F.col("comp_id").alias(f"comp{k}"))
    return pairs.where("area_pass").join(side(1), ["obj1", "obj2", "tri1"]).join(side(2), ["obj1", "obj2", "tri2"]).select("obj1", "obj2", "comp1", "comp2").distinct()


def object_graph(links: DataFrame) -> DataFrame:
    """(a, b): objects whose components are linked, both ways."""
    return links.select(F.col("obj1").alias("a"), F.col("obj2").alias("b")).union(links.select("obj2", "obj1")).distinct()


def first_links(links: DataFrame) -> DataFrame:
    """Each component of the first object with the smallest component that it's linked with."""
    return links.groupBy("obj1", "obj2", "comp1").agg(F.min("comp2").alias("comp2"))
