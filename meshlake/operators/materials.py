"""Material libraries and assignments over the graph of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import materials as M


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """(object_id, neighbours)."""
    return both_ways(edges).groupBy(F.col("a").alias("object_id")).agg(F.array_sort(F.collect_list("b")).alias("neighbours"))


def statuses(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, status): objects (object_id, material) are Pending without a material, Completed with one if all their
    neighbours have one, else InProgress. A neighbour that isn't among the objects has none."""
    has = objects.select(F.col("object_id").alias("b"), F.col("material").isNotNull().alias("done"))
    near = both_ways(edges).join(has, "b", "left").groupBy(F.col("a").alias("object_id")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"))
    status = F.when(F.col("material").isNull(), "Pending").when(F.coalesce("all_done", F.lit(True)), "Completed").otherwise("InProgress")
    return objects.join(near, "object_id", "left").select("object_id", status.alias("status"))


def buckets(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.array_sort(F.collect_list("object_id")).alias("object_ids"), F.count("*").alias("n"))


def gradient_eligible(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects (object_id, material_type) with more than one neighbour, of which two or more aren't isolation."""
    kinds = objects.select(F.col("object_id").alias("b"), "material_type")
    near = both_ways(edges).join(kinds, "b").groupBy(F.col("a").alias("object_id")).agg(F.count("*").alias("n"), F.count_if(F.col("material_type") != "isolation").alias("solid"))
    return near.where("n > 1 AND solid >= 2").select("object_id", "n", "solid")


def new_names(candidates: DataFrame, library: DataFrame) -> DataFrame:
    """Candidates whose name isn't in the library and isn't empty."""
    named = candidates.where(F.coalesce(F.btrim("name"), F.lit("")) != "")
    return named.join(library.select("name"), "name", "left_anti")


def with_properties(assignments: DataFrame, library: DataFrame) -> DataFrame:
    return assignments.join(library, assignments["material_name"] == library["name"], "left").drop("name")


def known_assignments(assignments: DataFrame, objects: DataFrame) -> DataFrame:
    return assignments.join(objects.select("object_id"), "object_id", "left_semi")


def upserted(library: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """The library with the changes' values where they have one, and their new rows."""
    rest = [c for c in library.columns if c != key]
    joined = library.alias("l").join(changes.alias("c"), key, "full_outer")
    return joined.select(key, *(F.coalesce(f"c.{c}", f"l.{c}").alias(c) for c in rest))


def removed(library: DataFrame, gone: DataFrame, key: str = "name") -> DataFrame:
    return library.join(gone.select(key), key, "left_anti")


def referenced_names(assignments: DataFrame) -> DataFrame:
    """Names of materials that assignments use or restrict."""
    used = assignments.select(F.col("material_name").alias("name"))
    return used.union(assignments.select(F.explode("restricted_materials"))).where("name IS NOT NULL AND name <> ''").distinct()


def restrictions_broken(assignments: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, name): object a restricts the material name, and its neighbour b has it."""
    limits = assignments.select(F.col("object_id").alias("a"), F.explode("restricted_materials").alias("name"))
    return limits.join(both_ways(edges), "a").join(assignments.select(F.col("object_id").alias("b"), F.col("material_name").alias("name")), ["b", "name"]).select("a", "b", "name")


def merged_compositions(rows: DataFrame, key: str, composition: str) -> DataFrame:
    """The sum of shares of each component, for each key."""
    parts = rows.select(key, F.explode(composition).alias("component", "share")).groupBy(key, "component").agg(F.sum("share").alias("share"))
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("component", "share")))).alias("composition"))


def gradient_at(table: DataFrame, points: DataFrame, key: str = "position") -> DataFrame:
    """Points with the composition at their position, NULL where there is none."""
    return points.join(table, key, "left")


def unpivoted(library: DataFrame, key: str, properties: list[str]) -> DataFrame:
    """(key, property, value, unit): a row for each property that isn't NULL, with the first unit offered for it."""
    rows = F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties))
    long = library.select(key, F.explode(rows).alias("r")).select(key, "r.*").where("value IS NOT NULL")
    return long.withColumn("unit", M.units(F.col("property"))[0])


def differs(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """NULLs are equal to each other; numbers differ by more than eps."""
    return ~(a.eqNullSafe(b)) & F.coalesce(F.abs(a - b) > eps, F.lit(True))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str], eps: float = 1e-6) -> DataFrame:
    """Rows of new that differ from the old row of their key in any of the columns."""
    joined = new.alias("n").join(old.alias("o"), key)
    test = F.lit(False)
    for c in columns:
        test = test | differs(F.col(f"n.{c}"), F.col(f"o.{c}"), eps)
    return joined.where(test).select(key, *(F.col(f"n.{c}").alias(c) for c in columns))


def ragged_union(tables: list[DataFrame], first: list[str]) -> DataFrame:
    """All rows with all columns: the preferred ones first, then the others by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.select(*(c for c in first if c in out.columns), *sorted(c for c in out.columns if c not in first))


def opposite_roles(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, neighbour, role) of neighbours whose role is another one."""
    role = objects.select("object_id", "role")
    joined = both_ways(edges).join(role.toDF("a", "own"), "a").join(role.toDF("b", "role"), "b")
    return joined.where("own <> role").select(F.col("a").alias("object_id"), F.col("b").alias("neighbour"), "role")


def inferred_roles(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """(object_id, role): gradient between two different materials that it touches, support if its material is one, part with
    a material, else ignore."""
    has = objects.select(F.col("object_id").alias("b"), F.col("material").alias("other"))
    near = both_ways(edges).join(has, "b").where("other IS NOT NULL").groupBy(F.col("a").alias("object_id")).agg(F.count_distinct("other").alias("kinds"))
    joined = objects.join(near, "object_id", "left")
    role = F.when((F.col("material_type") == "gradient") & (F.coalesce("kinds", F.lit(0)) >= 2), "gradient").when(F.col("material_type") == "isolation", "support").when(F.col("material").isNotNull(), "part").otherwise("ignore")
    return joined.select("object_id", role.alias("role"))


def digest(df: DataFrame) -> DataFrame:
    """One row: a fingerprint that doesn't depend on the order of rows or columns, and the number of rows. Floating-point
    columns are normalized first. Sums only, so it is as parallel as the table."""
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    cells = [M.plain(F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.to_json(F.struct(c)) if kinds[c][:3] in ("arr", "map", "str") and kinds[c] != "string" else F.col(c) for c in columns]
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
