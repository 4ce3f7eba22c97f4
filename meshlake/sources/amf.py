"""AMF (XML) models as tables."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from meshlake.schemas import AMF_OBJECT
from meshlake.session import Scratch

GREY = 0.5


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target) is not None and len(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)) > 0


def read_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """meshes, vertices and triangles of a file, a folder or a pattern, by the extension. Raises FileNotFoundError for what
    isn't there and ValueError for other formats."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if PurePosixPath(path.rstrip("/")).suffix.lower() != ".amf":
        raise ValueError(f"{PurePosixPath(path).suffix or path}: only .amf is read")
    return tables(raw_objects(spark, path))


def scanned_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, model_id, length, reason): a row for each file. model_id is the SHA-256 of its content, so that a file that is moved or copied stays the
    same model. reason: NULL, `cut off` (it doesn't end with its root) or `repeated` (the same content has a smaller path).
    Spark's reader of whole files takes up to 2 GB each; its scans pass over files without a byte, which have no row here."""
    end = F.decode(F.expr("substring(content, greatest(1, length(content) - 1023))"), "UTF-8")
    whole = F.regexp_like(end, F.lit(r"</\s*(\w+:)?amf\s*>\s*(<!--[^>]*-->\s*)*$"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("model_id"), "length", F.when(~whole, "cut off").alias("reason"))
    files = Scratch(spark, "amf-files").write(files, "files")
    first = files.groupBy("model_id").agg(F.min("path").alias("first"))
    return files.join(first, "model_id").select("path", "model_id", "length", F.coalesce("reason", F.when(F.col("path") > F.col("first"), "repeated")).alias("reason")).hint("merge")


def raw_objects(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(path, model_id, _place, _broken, object): every object of the files that can be read. Prefixes of tags are ignored. An object that can't be
    parsed has its XML in _broken. The rows are written: whether an object is broken depends on the columns that a
    scan of the files asks for, and all tables must number the same ones. As those of session.Scratch, they and what is made of them aren't broadcast
    of themselves: an object's row is small, but its vertices and triangles are not."""
    files = scanned_files(spark, path) if files is None else files
    schema = StructType([*AMF_OBJECT.fields, StructField("_broken", StringType())])
    objects = spark.read.format("xml").option("rowTag", "object").option("ignoreNamespace", "true").option("columnNameOfCorruptRecord", "_broken").schema(schema).load(path)
    placed = objects.select(*schema.fieldNames(), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_place"))
    parsed = Scratch(spark, "amf-objects").write(placed, "objects")
    return parsed.join(files.where("reason IS NULL").select("path", "model_id"), "path").hint("merge")


def rejected(files: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, model_id, reason, record): files without an object that can be read, and each broken object with its XML: what a person has to look at. A
    repeated file isn't one of them."""
    whole = files.join(objects.select("path").distinct().withColumn("some", F.lit(True)), "path", "left")
    bad = whole.withColumn("reason", F.when(F.col("some").isNull(), F.coalesce("reason", F.lit("no object")))).where("reason <> 'repeated'")
    broken = objects.where("_broken IS NOT NULL").select("path", "model_id", F.lit("broken object").alias("reason"), F.col("_broken").alias("record"))
    return bad.select("path", "model_id", "reason", F.lit(None).cast("string").alias("record")).union(broken)


def numbered_objects(objects: DataFrame) -> DataFrame:
    """Objects that could be read, numbered within their model."""
    return objects.where("_broken IS NULL").withColumn("mesh_id", F.row_number().over(Window.partitionBy("model_id").orderBy("_place")).cast("long") - 1)


def numbered_ids(objects: DataFrame) -> DataFrame:
    """(model_id, mesh_id, xml_id): the ids that objects have in their file."""
    return numbered_objects(objects).select("model_id", "mesh_id", F.col("_id").alias("xml_id"))


def tables(objects: DataFrame) -> dict[str, DataFrame]:
    """Objects are numbered within their file; vertices without coordinates go, which moves up the ids of later ones."""
    numbered = numbered_objects(objects)
    colours = F.coalesce(F.col("color"), F.get(F.filter(F.transform("mesh.volume", lambda v: v.color), lambda c: c.isNotNull()), F.lit(0)), F.struct(*(F.lit(GREY).alias(c) for c in "rgb")))
    meshes = numbered.select("model_id", "mesh_id", "path", colours.alias("color"))
    good = F.transform(F.filter("mesh.vertices.vertex", lambda v: v.coordinates.isNotNull()), lambda v: v.coordinates)
    vertices = numbered.select("model_id", "mesh_id", F.posexplode(good).alias("vid", "p")).select("model_id", "mesh_id", F.col("vid").cast("long").alias("vid"), "p.*")
    faces = F.flatten(F.transform(F.filter("mesh.volume", lambda v: v.triangle.isNotNull()), lambda v: v.triangle))
    triangles = numbered.select("model_id", "mesh_id", F.posexplode(faces).alias("tid", "t")).select("model_id", "mesh_id", F.col("tid").cast("long").alias("tid"), "t.*")
    return {"meshes": meshes, "vertices": vertices, "triangles": triangles}


def corners(found: dict[str, DataFrame]) -> DataFrame:
    """(object_id, tri_id, ax..cz FLOAT): triangles with their corners; object_id is the mesh's number."""
    out = found["triangles"]
    for k, p in enumerate("abc", 1):
        side = found["vertices"].select("model_id", "mesh_id", F.col("vid").alias(f"v{k}"), *(F.col(c).alias(f"{p}{c}") for c in "xyz"))
        out = out.join(side, ["model_id", "mesh_id", f"v{k}"])
    return out.select(F.col("mesh_id").alias("object_id"), F.col("tid").alias("tri_id"), *(f"{p}{c}" for p in "abc" for c in "xyz"))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of whole files, any format; uploads land in a folder and are read the same way."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def object_xml(triangles: DataFrame) -> DataFrame:
    """(object_id, value): each object as one XML element; the inverse of the reader for one object a row."""
    number = lambda c: F.col(c).cast("string")
    vertex = F.concat(*(F.concat(F.lit("<vertex><coordinates>"), *(F.concat(F.lit(f"<{c}>"), number(f"{p}{c}"), F.lit(f"</{c}>")) for c in "xyz"), F.lit("</coordinates></vertex>")) for p in "abc"))
    listed = triangles.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("tri_id", vertex.alias("xml")))).alias("t"))
    faces = F.transform("t", lambda t, i: F.concat(F.lit("<triangle><v1>"), (3 * i).cast("string"), F.lit("</v1><v2>"), (3 * i + 1).cast("string"), F.lit("</v2><v3>"), (3 * i + 2).cast("string"), F.lit("</v3></triangle>")))
    points = F.array_join(F.transform("t", lambda t: t.xml), "")
    return listed.select("object_id", F.concat(F.lit('<object id="'), F.col("object_id").cast("string"), F.lit('"><mesh><vertices>'), points, F.lit("</vertices><volume>"), F.array_join(faces, ""), F.lit("</volume></mesh></object>")).alias("value"))
