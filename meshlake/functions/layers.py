"""Expressions in layers: each layer's columns are computed from those of the layers before, once.

The same text is laid over a DataFrame or over a SQL subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Layers = list[dict[str, str]]


def over(df: DataFrame, layers: Layers) -> DataFrame:
    for layer in layers:
        df = df.select("*", *(F.expr(e).alias(n) for n, e in layer.items()))
    return df


def over_sql(sql: str, layers: Layers) -> str:
    for layer in layers:
        sql = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM ({sql})"
    return sql
