"""Tables of the engine, and the check that one has what an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POINTS = [f"{p}{c}" for p in "abc" for c in "xyz"]
BOX = ["mnx", "mny", "mnz", "mxx", "mxy", "mxz"]


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TRIANGLES = _of(object_id=T.LongType(), tri_id=T.LongType(), **{p: T.LongType() for p in POINTS})
_COORDINATES = _of(coordinates=_of(x=T.FloatType(), y=T.FloatType(), z=T.FloatType()))
COLOR = _of(r=T.DoubleType(), g=T.DoubleType(), b=T.DoubleType())
AMF_OBJECT = _of(
    _id=T.StringType(),
    color=COLOR,
    mesh=_of(
        vertices=_of(vertex=T.ArrayType(_COORDINATES)),
        volume=T.ArrayType(_of(color=COLOR, triangle=T.ArrayType(_of(v1=T.LongType(), v2=T.LongType(), v3=T.LongType())))),
    ),
)
MATERIAL = _of(id=T.StringType(), name=T.StringType(), color=T.StringType(), melting_temperature=T.DoubleType(), soft_temperature=T.DoubleType(), composition=T.MapType(T.StringType(), T.DoubleType()), density=T.DoubleType(), elastic_modulus=T.DoubleType(), poisson_ratio=T.DoubleType())
ASSIGNMENT = _of(
    schema_version=T.IntegerType(), source_file=T.StringType(), model_hash_id=T.StringType(), saved_at=T.StringType(), processing_obj_id=T.IntegerType(), object_count=T.IntegerType(),
    objects=T.MapType(T.StringType(), _of(material_type=T.StringType(), material_name=T.StringType(), restricted_materials=T.ArrayType(T.StringType()), include=T.ArrayType(T.IntegerType()), exclude=T.ArrayType(T.IntegerType()))),
)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
