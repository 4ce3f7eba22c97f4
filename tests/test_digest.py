"""Digests: the same for what counts as the same, another one for any change, refused where there is no rule."""

from __future__ import annotations

import copy

import pytest
from pyspark.sql import functions as F

from meshlake.operators import digest as DG

SCHEMA = "id long, name string, size double, `a.b` array<int>, bag array<struct<k: int, v: string>>, deep map<string, array<map<string, double>>>, at timestamp, day date, raw binary, price decimal(9,2), ok boolean"
BAGS = ["bag", "deep{}"]


def rows():
    import datetime as dt

    one = {"id": 1, "name": "x", "size": 1.5, "a.b": [1, 2], "bag": [{"k": 1, "v": "p"}, {"k": 2, "v": None}], "deep": {"u": [{"w": 1.0}, {"z": 2.0}], "t": []}, "at": dt.datetime(2024, 1, 2, 3, 4, 5, 678901), "day": dt.date(1969, 12, 30), "raw": b"\x00\xff", "price": None, "ok": True}
    return [one, {**copy.deepcopy(one), "id": 2, "name": None, "deep": None, "bag": []}]


def table(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def of(df) -> str:
    return DG.digests(df, bags=BAGS).first().digest


def test_order_does_not_count_where_there_is_none(spark):
    base, other = rows(), rows()[::-1]
    for r in other:
        r["bag"] = r["bag"][::-1]
        if r["deep"]:
            r["deep"] = {"t": r["deep"]["t"], "u": r["deep"]["u"][::-1]}
    df = table(spark, other)
    assert of(df.select(*(F.col(f"`{c}`") for c in reversed(df.columns))).repartition(3)) == of(table(spark, base))


@pytest.mark.parametrize("change", range(16))
def test_every_leaf_counts(spark, change):
    import datetime as dt
    from decimal import Decimal

    found = rows()
    one = found[0]
    changes = [
        ("id", 3), ("name", ""), ("name", "n"), ("size", 1.25), ("size", float("nan")), ("a.b", [2, 1]), ("a.b", [12]), ("a.b", None), ("bag", one["bag"][:1]), ("bag", [*one["bag"], one["bag"][0]]),
        ("deep", {"u": [{"w": 1.0}, {"z": 2.0}], "s": []}), ("deep", {"u": [{"w": 1.0, "z": 2.0}], "t": []}), ("at", dt.datetime(2024, 1, 2, 3, 4, 5, 678902)), ("day", dt.date(1969, 12, 31)), ("raw", b"\x00"), ("price", Decimal("0.00")),
    ]
    name, value = changes[change]
    one[name] = value
    assert of(table(spark, found)) != of(table(spark, rows()))


def test_values_that_count_as_the_same(spark):
    make = lambda v: DG.digests(spark.createDataFrame([(v,)], "v double")).first().digest
    assert len({make(v) for v in (None, float("nan"), float("inf"), float("-inf"))}) == 1
    assert make(0.0) == make(-0.0) != make(None)
    assert DG.digests(spark.sql("SELECT CAST(3 AS SMALLINT) AS v")).first().digest == DG.digests(spark.sql("SELECT 3L AS v")).first().digest


def test_texts_do_not_run_into_each_other(spark):
    df = spark.createDataFrame([(["a,b"],), (["a", "b"],), (["a", None],), (["a", "n"],), ([],), (None,), ([""],), (["a,s1:b"],)], "v array<string>")
    found = [r.digest for r in DG.with_digest(df).collect()]
    assert len(set(found)) == len(found)


def test_repeated_rows_empty_tables_and_names(spark):
    df = table(spark, rows())
    assert of(df.union(df)) != of(df) and of(df.union(df).dropDuplicates(["id"])) == of(df)
    assert DG.digests(df.limit(0)).first().n == 0 and DG.digests(df.limit(0), ["id"]).count() == 0
    clashing = df.select("id").withColumn("digest", F.lit("own"))
    assert [r.digest for r in DG.with_digest(clashing).collect()] == [r.digest for r in DG.with_digest(df.select("id")).collect()]
    groups = {r.name: r.n for r in DG.digests(df, ["name"]).collect()}
    assert groups == {"x": 1, None: 1}


def test_what_has_no_rule_is_refused(spark):
    with pytest.raises(TypeError, match="wait"):
        DG.digests(spark.sql("SELECT named_struct('wait', INTERVAL '1' DAY) AS s"))
    with pytest.raises(ValueError, match="nothing"):
        DG.digests(table(spark, rows()), bags=["nothing"])


def test_printed_doubles_are_those_of_the_sql(spark, duck):
    from meshlake.functions.digest import printed

    found = [0.0, -0.0, 0.01, -12.5, 9999999.99, 1e7, 12345678.25, -123456789012345.0, 1e15, 1e16, -2.5e17, 1.5e300, 0.001, 0.0001, 0.00012345, -0.00001, 2.5e-7, float("nan"), float("inf"), float("-inf")]
    got = [r.t for r in spark.createDataFrame([(v,) for v in found], "v double").select(printed(F.col("v")).alias("t")).collect()]
    assert got == [duck.execute("SELECT CAST(?::DOUBLE AS VARCHAR)", [v]).fetchone()[0] for v in found]


@pytest.mark.parametrize("name", ["n14_row_digests", "n13_nested_digest"])
def test_digests_of_odd_balances_are_those_of_the_sql(spark, tmp_path, name):
    import duckdb

    from conftest import SF
    from meshlake import registry

    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE c_custkey WHEN 1 THEN -0.0::DOUBLE WHEN 2 THEN 12345678.25 WHEN 4 THEN 0.0001 ELSE c_acctbal END AS c_acctbal) FROM '{SF}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    c.execute(f"COPY (SELECT * FROM '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    for t in ("customer", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
