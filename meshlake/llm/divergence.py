"""Which sources of a language speak differently, from each other and from the language, and in which terms.

A group is a (lang, source); a lang keeps the terms of at least MIN_DOCS of its documents. Probabilities are integers, in parts of
SCALE, smoothed over the kept terms; two of them diverge by f(p, q) = floor((p - q)^2 / (p + q)). All arithmetic is exact.

Counting: a worker counts the terms of its texts by group in bounded dictionaries, Spark sums them by (lang, term), where
a hot group is spread by its terms.

Pairs of groups: the sum of f over all kept terms needs only the postings (the groups in which a term occurs). With p0 the probability of a
term that a group lacks, value(a, b) = V f(p0a, p0b) + what a's terms add against p0b + what b's terms add against p0a + a correction for
each term of both. What a group's terms add is summed by its different counts, not its terms; the correction joins the postings of a term.

Terms of a group: upper-bound search. A group's terms are in buckets by the power of two of their counts, and f grows with p and falls with q, so
the largest count and the lang's smallest count in a bucket bound all of its f. Buckets are evaluated best first, twice as many each round, in all
groups at once; a group is through when the bounds of its unseen buckets are strictly below its k-th value, or no bucket of it is left in which p > q is possible.

Null text, lang and source count as ''; texts without terms make groups with no counts; where a lang keeps no term, pairs are 0 and there are no terms.
Repeated rows count as often as they stand. Ties rank by the item's UTF-8 bytes. Only text, lang and source are read, so other columns may
have any name; an empty table gives no rows. Texts of any length are taken whole, each at once in one worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.texts import as_bytes, bounded, read
from meshlake.session import Scratch

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Counts that one worker holds at once; beyond that, what it has goes on to Spark.
HELD = 400_000
#: A-Z become a-z; ASCII that isn't a letter becomes a blank; UTF-8's other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each group, a row with no term, and its counts of occurrences and documents by term. Sums of what is handed on are whole."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            size = len(n) + 1
            words = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, size), pa.repeat(source, size), words, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[w] for w in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for text, lang, source in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms(text)
            size -= len(n)
            n.update(words)
            docs.update(dict.fromkeys(words, 1).keys())
            size += len(n)
            if size > most:
                yield from out()
                size = 0
    yield from out()


def counted(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs), partly summed; each group has a row without a term."""
    bounded(documents.sparkSession)
    plain = documents.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((text, "text"), (lang, "lang"), (source, "source"))))
    return plain.mapInArrow(partial(_counted, most=held), _COUNTED)


def postings(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, bucket, first) of the kept terms; first marks one of a term's rows. Dealt by (lang, term) once."""
    term = Window.partitionBy("lang", "term")
    summed = counts.where("term IS NOT NULL").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = summed.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_n", F.sum("n").over(term)).withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return whole.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", F.floor(F.log2("n")).cast("int").alias("bucket"), "first")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), null where there are no terms and no counts."""
    return F.expr("1L") + F.call_function("div", (SCALE * (count + 2).cast("decimal(28,0)")).cast("decimal(38,0)"), (total + 2 * terms).cast("decimal(28,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, terms, total, lang_total, p0) of every group; p0 is null where the lang keeps no term."""
    there = counts.where("term IS NULL").select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("terms"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    joined = there.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "lang_total", "total"])
    return joined.withColumn("p0", F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))))


def pairs(kept: DataFrame, grouped: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a lang's groups."""
    here = grouped.select("lang", "source", "terms", "total", "p0")
    a, b = here.alias("a"), here.alias("b")
    both = a.join(b, F.expr("a.lang = b.lang AND a.source <> b.source")).select("a.lang", "a.source", F.col("b.source").alias("item"), F.col("a.terms").alias("terms"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("other0"))
    known = kept.join(here, ["lang", "source"]).select("lang", "term", "source", "p0", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    by_count = known.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    alone = by_count.alias("c").join(here.alias("b"), F.expr("c.lang = b.lang AND c.source <> b.source"))
    alone = alone.groupBy("c.lang", "c.source", F.col("b.source").alias("item")).agg(F.sum(F.col("k") * (divergence(F.col("c.p"), F.col("b.p0")) - divergence(F.col("c.p0"), F.col("b.p0")))).alias("v"))
    x, y = known.alias("x"), known.alias("y")
    met = x.join(y, F.expr("x.lang = y.lang AND x.term = y.term AND x.source < y.source"))
    more = divergence(F.col("x.p"), F.col("y.p")) - divergence(F.col("x.p"), F.col("y.p0")) - divergence(F.col("x.p0"), F.col("y.p")) + divergence(F.col("x.p0"), F.col("y.p0"))
    met = met.groupBy("x.lang", "x.source", F.col("y.source").alias("item")).agg(F.sum(more).alias("v"))
    base = both.select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * divergence(F.col("p0"), F.col("other0"))).otherwise(0).alias("v"))
    turned = lambda t: t.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v")
    parts = base.unionByName(alone).unionByName(turned(alone)).unionByName(met).unionByName(turned(met))
    return parts.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def best_terms(kept: DataFrame, grouped: DataFrame, scratch: Scratch, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of each group's terms with the largest f among those with p > q."""
    key = ["lang", "source"]
    p = lambda n: probability(n, F.col("total"), F.col("terms"))
    q = lambda n: probability(n, F.col("lang_total"), F.col("terms"))
    sizes = grouped.where("terms > 0").select(*key, "terms", "total", "lang_total")
    extremes = kept.groupBy(*key, "bucket").agg(F.max("n").alias("most"), F.min("lang_n").alias("least")).join(sizes, key)
    ceiling = extremes.select(*key, "bucket", p(F.col("most")).alias("p"), q(F.col("least")).alias("q")).where("p > q").select(*key, "bucket", divergence(F.col("p"), F.col("q")).alias("bound"))
    order = Window.partitionBy(*key).orderBy(F.desc("bound"), F.desc("bucket"))
    buckets = scratch.write(ceiling.withColumn("place", F.row_number().over(order)), "buckets")
    ranked = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    best, seen, width = None, 0, 1
    while True:
        turn = buckets.where(f"place > {seen} AND place <= {seen + width}")
        if best is not None:
            kth = best.where(f"rank = {top}").select(*key, F.col("value").alias("kth"))
            turn = turn.join(kth, key, "left").where("kth IS NULL OR bound >= kth")
        if best is not None and turn.isEmpty():  # bounds fall with the place: later buckets are below, too
            return best
        found = kept.join(turn.select(*key, "bucket"), [*key, "bucket"]).join(sizes, key).select(*key, F.col("term").alias("item"), p(F.col("n")).alias("p"), q(F.col("lang_n")).alias("q"))
        found = found.where("p > q").select(*key, "item", divergence(F.col("p"), F.col("q")).alias("value"))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = scratch.write(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top), f"best-{seen}")
        seen, width = seen + width, 2 * width


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, **options) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs, and the top terms of each group. options: those of counted()."""
    scratch = Scratch(documents.sparkSession, "divergence")
    counts = scratch.write(counted(documents, **options), "counts")
    kept = scratch.write(postings(counts, min_docs), "kept")
    grouped = scratch.write(groups(counts, kept), "groups")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    compared = pairs(kept, grouped).withColumn("rank", F.row_number().over(ranked))
    told = best_terms(kept, grouped, scratch, top)
    shown = lambda t, part: t.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return shown(compared, "pair").unionByName(shown(told, "term"))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents),
words AS (SELECT row_id, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM words w SEMI JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS n FROM kept GROUP BY lang),
members AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
    SELECT m.lang, m.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 2) // (l.n + 2 * l.v) AS q
    FROM members m JOIN kept k ON k.lang = m.lang JOIN langs l ON l.lang = m.lang
    LEFT JOIN totals t ON t.lang = m.lang AND t.source = m.source
    LEFT JOIN counts c ON c.lang = m.lang AND c.source = m.source AND c.term = k.term),
summed AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM members a JOIN members b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
