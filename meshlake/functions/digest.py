"""Digests of nested values: one expression a level, built by walking the schema.

A value's text says its kind and, where it could run into its neighbours, its length, so that different values have different texts; structs,
arrays and maps are replaced by the md5 of their texts, so that a row's text stays short however deep it is.

* NULL, NaN and infinities are alike; -0 is 0; FLOAT counts as DOUBLE and all widths of whole numbers as one. With number=printed, doubles count as
  other engines print them: -0 isn't 0, and NaN and infinities differ from NULL.
* Fields go by their names and entries of maps by their keys, in any order. Arrays are lists; those whose path is among bags count without
  regard to order, repeated elements included. A path is the fields' names with dots between them, `[]` for an array's elements and `{}` for a map's values.
* Dates and timestamps go by days and microseconds. What has no rule here (intervals, variants, user-defined types) raises TypeError.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.functions.materials import plain

VERSION = 1
HEADER = f"digest={VERSION}\n"


def _inner(path: str, name: str) -> str:
    return f"{path}.{name}" if path else name


def _listed(opening: str, parts: Column, closing: str) -> Column:
    return F.md5(F.concat(F.lit(opening), F.array_join(parts, ","), F.lit(closing)))


def unsigned(value: Column) -> Column:
    """A double's text as Spark writes it, without a sign of zero; NULL for NaN and infinities."""
    return plain(value).cast("string")


def printed(value: Column) -> Column:
    """A double's text as Python and DuckDB write it: the sign of zero stays, and only from 1e16 on and below 1e-4 there is an exponent."""
    found = value.cast("string")
    sign, size = F.regexp_extract(found, "^-?", 0), F.regexp_extract(found, "E(-?[0-9]+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_extract(found, "^-?([0-9.]+)E", 1), r"\.0$|\.", "")
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), size + 1), size + 1, "0"), F.lit("."), F.when(F.length(digits) > size + 1, F.substring(digits, size + 2, F.length(digits))).otherwise("0"))
    point = F.when(F.length(digits) > 1, ".").otherwise("")
    short = F.concat(F.substring(digits, 1, 1), point, F.substring(digits, 2, 99), F.when(size < 0, "e-").otherwise("e+"), F.lpad(F.abs(size).cast("string"), F.greatest(F.lit(2), F.length(F.abs(size).cast("string"))), "0"))
    finite = F.when(size.between(7, 15), whole).when(size == -4, F.concat(F.lit("0.000"), digits)).otherwise(short)
    odd = F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
    return F.coalesce(odd, F.when(~F.contains(found, F.lit("E")), found).otherwise(F.concat(sign, finite)))


def text(value: Column, kind: T.DataType, path: str = "", bags: Collection[str] = (), number: Callable[[Column], Column] = unsigned) -> Column:
    """What stands for a value of this type at this path; never NULL. number: the text of a double."""
    match kind:
        case T.NullType():
            return F.lit("n")
        case T.BooleanType():
            known = F.when(value, "true").otherwise("false")
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            known = F.concat(F.lit("i"), value.cast("string"))
        case T.FloatType() | T.DoubleType():
            return F.coalesce(F.concat(F.lit("f"), number(value.cast("double"))), F.lit("n"))
        case T.DecimalType():
            known = F.concat(F.lit("d"), value.cast("string"))
        case T.StringType():
            known = F.concat(F.lit("s"), F.length(value).cast("string"), F.lit(":"), value)
        case T.BinaryType():
            known = F.concat(F.lit("x"), F.hex(value))
        case T.DateType():
            known = F.concat(F.lit("t"), F.unix_date(value).cast("string"))
        case T.TimestampType():
            known = F.concat(F.lit("u"), F.unix_micros(value).cast("string"))
        case T.TimestampNTZType():
            known = F.concat(F.lit("v"), value.cast("string"))
        case T.StructType():
            known = struct_text([(f.name, value.getField(f.name), f.dataType) for f in kind.fields], path, bags, number)
        case T.ArrayType():
            parts = F.transform(value, lambda v: text(v, kind.elementType, f"{path}[]", bags, number))
            known = _listed("(", F.array_sort(parts), ")") if path in bags else _listed("[", parts, "]")
        case T.MapType():
            entry = lambda e: F.concat(text(e["key"], kind.keyType, path, (), number), F.lit("="), text(e["value"], kind.valueType, f"{path}{{}}", bags, number))
            known = _listed("<", F.array_sort(F.transform(F.map_entries(value), entry)), ">")
        case _:
            raise TypeError(f"{path or 'value'}: no digest for {kind.simpleString()}")
    return F.when(value.isNull(), "n").otherwise(known)


def struct_text(fields: list[tuple[str, Column, T.DataType]], path: str = "", bags: Collection[str] = (), number: Callable[[Column], Column] = unsigned) -> Column:
    """Fields in the order of their names; those of one name in their own order."""
    parts = [F.concat(F.lit(f"{len(name)}:{name}="), text(value, kind, _inner(path, name), bags, number)) for name, value, kind in sorted(fields, key=lambda f: f[0])]
    return _listed("{", F.array(*parts), "}") if parts else F.md5(F.lit("{}"))


def array_paths(kind: T.DataType, path: str = "") -> set[str]:
    """The paths of all arrays in a type."""
    match kind:
        case T.StructType():
            return set().union(*(array_paths(f.dataType, _inner(path, f.name)) for f in kind.fields))
        case T.ArrayType():
            return {path} | array_paths(kind.elementType, f"{path}[]")
        case T.MapType():
            return array_paths(kind.valueType, f"{path}{{}}")
    return set()
