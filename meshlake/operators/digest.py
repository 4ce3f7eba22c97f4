"""Digests of rows, groups and tables with nested columns: independent of the order of rows, columns, entries and bags."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.functions import digest as D
from meshlake.schemas import require_columns

#: Hex digits of a row's digest that go into each of two sums: what a BIGINT holds.
DIGITS = 15


def row_digest(df: DataFrame, bags: Collection[str] = (), without: Sequence[str] = (), number: Callable[[Column], Column] = D.unsigned) -> Column:
    """md5 of the version and all columns but some. number: the text of a double, as in functions.digest. bags: paths of arrays without an order; ValueError for one that df hasn't got."""
    if unknown := sorted(set(bags) - D.array_paths(df.schema)):
        raise ValueError(f"no arrays: {', '.join(unknown)}")
    fields = [(f.name, F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields if f.name not in without]
    return F.md5(F.concat(F.lit(D.HEADER), D.struct_text(fields, "", bags, number)))


def with_digest(df: DataFrame, name: str = "digest", bags: Collection[str] = (), number: Callable[[Column], Column] = D.unsigned) -> DataFrame:
    """A digest for each row beside its columns. An own column of that name is replaced and doesn't count."""
    return df.withColumn(name, row_digest(df, bags, [name], number))


def digests(df: DataFrame, by: Sequence[str] = (), bags: Collection[str] = (), number: Callable[[Column], Column] = D.unsigned) -> DataFrame:
    """(by, n, digest): the number of rows and a digest of each group, or of the whole table (one row, also for an empty one). Repeated rows count
    each time. Digests of rows are summed, in two halves, so groups of any size are combined in every task before they are
    shuffled; sums find changes, they don't withstand forgery. The group's own columns are part of its rows."""
    require_columns(df, *by)
    rows = df.select(*by, row_digest(df, bags, number=number).alias("_h"))
    half = lambda k: F.conv(F.substring("_h", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(half(k)), F.lit(0).cast("decimal(38,0)")).cast("string").alias(f"_s{k}") for k in (0, 1)))
    return sums.select(*by, "n", F.md5(F.concat(F.lit(D.HEADER), F.concat_ws(",", F.col("n").cast("string"), "_s0", "_s1"))).alias("digest"))
