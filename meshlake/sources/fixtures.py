"""Meshes derived from ordinary tables, as SQL that any engine runs, and as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CORNERS = """
p AS (SELECT p_partkey AS k, CAST(floor(p_partkey / 40) AS BIGINT) AS i, p_partkey % 40 AS j, CAST(p_size AS BIGINT) AS z FROM {part}),
cell AS (SELECT a.k, a.i, a.j, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM p a JOIN p b ON b.k = a.k + 1 JOIN p c ON c.k = a.k + 40 JOIN p d ON d.k = a.k + 41 WHERE a.j < 39),
grid AS (
  SELECT CAST(floor(i / 5) AS BIGINT) AS object_id, 2 * k AS tri_id, 100 * j AS ax, 100 * i AS ay, za AS az, 100 * j + 100 AS bx, 100 * i AS by, zb AS bz, 100 * j + 100 AS cx, 100 * i + 100 AS cy, zd AS cz FROM cell
  UNION ALL
  SELECT CAST(floor(i / 5) AS BIGINT), 2 * k + 1, 100 * j, 100 * i, za, 100 * j + 100, 100 * i + 100, zd, 100 * j, 100 * i + 100, zc FROM cell)"""
GRID = f"WITH {_CORNERS} SELECT * FROM grid"
SHELL = f"""WITH {_CORNERS} SELECT * FROM grid UNION ALL
SELECT object_id + 100000, tri_id, ax + 50, ay + 50, az + 1, bx + 50, by + 50, bz + 1, cx + 50, cy + 50, cz + 1 FROM grid"""
#: One row a coordinate; seven triangles a vector, placed on a lattice.
SOUP_FIELDS = [f"{p}{c}" for p in "abc" for c in "xyz"]


def soup_sql(element: str) -> str:
    """element: SQL for the 0-based item {i} of an embedding."""
    items = [element.format(i=f"(9 * k + {m})") for m in range(9)]
    moved = [f"CAST({x} + CAST({m} AS FLOAT) AS FLOAT)" if m else f"CAST({x} AS FLOAT)" for x, m in zip(items, ["vec_id % 25", "floor(vec_id / 25)", ""] * 3, strict=True)]
    return f"SELECT CAST(label AS BIGINT) AS object_id, 7 * vec_id + k AS tri_id, {', '.join(f'{x} AS {n}' for x, n in zip(moved, SOUP_FIELDS, strict=True))} FROM (SELECT *, {{sevens}} AS k FROM {{embeddings}})"


SOUP_SPARK = soup_sql("embedding[{i}]").replace("{sevens}", "explode(sequence(0, 6))")
SOUP_SQL = soup_sql("embedding[{i} + 1]").replace("{sevens}", "unnest(generate_series(0, 6))").replace("{embeddings}", "embeddings")
#: Which pairs of suppliers' nations meet in an order: all of them (FX-EDGE), and a thinned graph with short ways.
MEETINGS = """WITH n AS (SELECT DISTINCT l_orderkey AS o, s_nationkey AS k FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey)
SELECT DISTINCT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b FROM n a JOIN n b ON a.o = b.o AND a.k < b.k"""
EDGES = """WITH n AS (SELECT DISTINCT l_orderkey AS o, s_nationkey AS k FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey WHERE l_orderkey % 97 = 0)
SELECT DISTINCT CAST(a.k AS BIGINT) AS a, CAST(b.k AS BIGINT) AS b FROM n a JOIN n b ON a.o = b.o AND a.k < b.k WHERE (a.k + b.k) % 3 = 0"""
#: Loops of six points, from a rule on keys.
LOOPS_POINTS = "SELECT CAST(floor(c_custkey / 6) AS BIGINT) AS loop_id, c_custkey % 6 AS pos, CAST((c_custkey * 7919) % 1009 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 997 AS DOUBLE) AS y FROM {customer}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark joins the cells' corners by sorting: the few columns of a large part file seem small enough to broadcast, but aren't."""
    names = [n for n in ("part", "embeddings", "lineitem", "supplier", "customer") if f"{{{n}}}" in sql]
    sql = sql.replace("SELECT a.k, a.i, a.j,", "SELECT /*+ MERGE(b, c, d) */ a.k, a.i, a.j,")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    """The same over tables of these names."""
    for n in ("part", "embeddings", "lineitem", "supplier", "customer"):
        sql = sql.replace(f"{{{n}}}", n)
    return sql
