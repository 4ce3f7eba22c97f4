"""Whole texts through Python workers: Arrow in, one struct of results a row out, batches bounded by bytes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one call of an operator's function gets, unless one text alone is longer.
BATCH_BYTES = 4 << 20
#: Bytes of one Arrow batch on its way to a Python worker, of which the executor and the worker hold a copy or two each.
ARROW_BYTES = 4 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"

Texts = list[bytes | None]

#: What operators keep in a worker from one task to the next, by operator: how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, let_go: Callable[[], None]) -> None:
    """An operator keeps something in this worker for its next tasks; a task of another operator calls let_go first."""
    _kept[operator] = let_go


def let_others_go(operator: str) -> None:
    for other in [k for k in _kept if k != operator]:
        _kept.pop(other)()


def bounded(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ARROW_BYTES at most (and a row at least); a smaller bound of its own stays."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmg]?)b?", spark.conf.get(_ARROW).lower()).groups()
    bytes_ = int(number) << 10 * "bkmg".index(unit or "b")
    if not 0 < bytes_ <= ARROW_BYTES:
        spark.conf.set(_ARROW, str(ARROW_BYTES))


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores where the table has such a column already."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def slices(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes; a longer row has a range of its own."""
    start = held = at = 0
    for at, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, at
            start, held = at, 0
        held += n
    if held or at >= start:
        yield start, at + 1


def as_bytes(column: pa.Array) -> Texts:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def annotate(df: DataFrame, text: str, fields: T.StructType, make: Callable[[], Callable[[Texts], list[tuple]]], keep: list[str] | None = None, name: str = "found", limit: int = BATCH_BYTES) -> tuple[DataFrame, str]:
    """The kept columns of df (all, if None) and a struct column of what the function made by make() returns for
    each text (UTF-8 bytes, or None for null). The struct's name never clashes with a column of df; it's returned. What other
    operators (by the wished name) keep in the worker goes first."""
    bounded(df.sparkSession)
    columns = df.columns if keep is None else keep
    operator, name = name, free_name(df, name)
    kept = [F.col(f"`{c}`") for c in columns]
    own = text in columns and dict(df.dtypes)[text] == "string"  # then it isn't sent twice
    at = columns.index(text) if own else len(columns)
    passed = df.select(*kept, *([] if own else [F.col(f"`{text}`").cast("string").alias(f"{name}_text")]))
    schema = T.StructType([*passed.schema.fields[: len(columns)], T.StructField(name, fields)])
    struct = to_arrow_type(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_others_go(operator)
        function = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = as_bytes(batch.column(at))
            for a, b in slices((len(t or b"") + 1 for t in texts), limit):
                rows = function(texts[a:b])
                made = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=struct.field(i).type) for i in range(struct.num_fields)], fields=list(struct))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(columns)]), made], names=[*columns, name])

    return passed.mapInArrow(run, schema), name


def smallest(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """Of rows (of ids, not texts) the ones with the smallest 64-bit hashes, at most so many, ties by the columns. Where there are far more,
    what surely isn't among them is left out before the sort, so that one task never gets the best of every other one."""
    total = rows.count()
    if total > 4 * most:
        rows = rows.where(hashed < F.lit(int(-(1 << 63) + (1 << 65) * most // total)))  # about twice as many are left
    return rows.orderBy(hashed, *rows.columns).limit(most)


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
