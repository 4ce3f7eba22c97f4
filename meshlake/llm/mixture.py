"""Mixing sources to target weights, in DataFrame functions only.

Sources share the words of all documents by weight; no source is asked for more than `epochs` times its own words, and what
it can't give is shared among the others (water filling). A source's budget is spent on complete epochs over all its documents
first, and the rest by Efraimidis-Spirakis sampling: each document draws an exponential key, -ln(u) / quality, from a hash of
the seed, its id and its text, and documents are taken in the order of their keys until the budget is spent.

Keys are sorted within a source in two steps, so that no task ever holds a source. A key's bucket, floor(BUCKETS * k / (1 + k)),
grows with the key; sizes are summed by source and range of buckets, then by bucket within one range, and their running sums (a few hundred rows a source) name
the bucket in which the budget ends. Only that bucket's documents are sorted, about one in BUCKETS of its source.

Where the budget ends inside a document, the document is cut there; so a source's words are its budget, the target rounded to
the nearest integer (half up). Documents of equal key and size (repeated rows) share what is left for them equally, rounded down: then a source
may miss a word a copy. Null texts have size 0 and are taken with 0 words; a null source is a source of its own, the last one; null ids count as
empty ones. Extra columns, of any name, are kept or left out, as asked; an empty table gives no rows; without any words all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.quality import MARKS
from meshlake.llm.texts import read
from meshlake.session import Scratch

WORD, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
WEIGHTS, EPOCHS = (5, 2, 1), 3
#: Of keys; the task that sorts the last bucket of the largest source gets about one in so many of its documents.
BUCKETS = 1 << 16
#: Buckets that are summed as one at first, so that running sums go over at most BUCKETS / COARSE rows a source, then over COARSE.
COARSE = 1 << 8
#: The least weight, so that junk is rare but not impossible.
LEAST_QUALITY = 0.05
_DRAWS = 1 << 52


def text_quality(text: Column) -> Column:
    """From LEAST_QUALITY to 1: the share of characters that aren't ASCII marks or digits, times the share of different lines."""
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    lines = F.split(text, "\n")
    return F.greatest(F.lit(LEAST_QUALITY), (1 - marks / F.greatest(F.length(text), F.lit(1))) * (F.size(F.array_distinct(lines)) / F.size(lines)))


def exponential_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    """-ln(u) / quality, u from the first 52 bits of a hash of seed, id and text."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text))
    return -F.ln((F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + 0.5) / _DRAWS) / quality


def drawn(documents: DataFrame, keep: Sequence[str] | None = None, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None) -> DataFrame:
    """Struct d of the kept columns (all, if None), and the source, size, key and bucket of each document."""
    kept = F.struct(*(F.col(f"`{c}`") for c in (documents.columns if keep is None else keep)))
    rows = documents.select(kept.alias("d"), F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"), F.col(f"`{source}`").cast("string").alias("source"), (F.lit(None) if quality is None else quality).cast("double").alias("given"))
    weight = F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.col("given"), text_quality(F.col("t"))))
    keyed = rows.select("d", "source", F.regexp_count("t", F.lit(WORD)).cast("long").alias("size"), exponential_key(F.col("id"), F.col("t"), weight, seed).alias("key"))
    return keyed.withColumn("bucket", F.floor(BUCKETS * (F.col("key") / (1 + F.col("key")))).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target, whole (epochs) and rest (words) from one row a source. Sources in the order of their code points, null
    last, have the weights in turn. Capped sources are those whose cap is under their share of what the sources with a smaller
    cap for their weight leave over; the share of the first one that isn't capped is everyone's. One task holds this table of sources."""
    by_cap = Window.orderBy("ratio", "place")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    capped = placed.withColumn("weight", turn).withColumn("cap", epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(Window.partitionBy()) - (F.sum("cap").over(by_cap) - F.col("cap"))
    share = left / (F.sum("weight").over(Window.partitionBy()) - (F.sum("weight").over(by_cap) - F.col("weight")))
    level = F.max(F.when(F.col("share") <= F.col("ratio"), F.col("share"))).over(Window.partitionBy())
    level = capped.withColumn("share", share).withColumn("level", level)
    asked = level.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))
    budget = F.least(F.floor(F.col("target") + 0.5), epochs * F.col("source_size"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return asked.withColumn("whole", F.expr("0L") + F.floor(budget / size)).withColumn("rest", budget - F.col("whole") * size)


def _last_part(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(source, part, rest): the part in which each source's rest ends, and what of the rest the parts before it leave."""
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    found = parts.alias("p").join(needed.alias("n"), F.expr("p.source <=> n.source")).where("before < rest AND rest <= before + words")
    return found.select("p.source", "part", (F.col("rest") - F.col("before")).alias("rest"))


def ends(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """asked with where each source's rest ends: documents with a smaller (key, size) than (end_key, end_size) are taken once more,
    those equal to it with end_words, later ones not. Nulls where the rest is 0."""
    rows, needed = documents.where("size > 0"), asked.where("rest > 0").select("source", "rest")
    for part in (F.expr(f"bucket DIV {COARSE}"), F.col("bucket")):
        rows = rows.withColumn("part", part)
        last = _last_part(rows, needed).alias("l")
        rows = rows.drop("rest").alias("d").join(last, F.expr("d.source <=> l.source AND d.part = l.part")).select("d.source", "d.bucket", "key", "size", "rest")
        needed = last.select("source", "rest")
    groups = rows.groupBy("source", "rest", "key", "size").agg(F.count("*").alias("copies"))
    words = F.col("copies") * F.col("size")
    past = F.coalesce(F.sum(words).over(Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = groups.withColumn("past", past).where("past < rest AND rest <= past + copies * size")
    end = found.select("source", F.col("key").alias("end_key"), F.col("size").alias("end_size"), F.expr("(rest - past) DIV copies").alias("end_words"))
    return asked.alias("a").join(end.alias("e"), F.expr("a.source <=> e.source"), "left").select("a.*", "end_key", "end_size", "end_words")


def mixed(documents: DataFrame, keep: Sequence[str] | None = None, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0, quality: Column | None = None, **columns: str) -> DataFrame:
    """Struct d of the kept columns, source, size, source_size, target and passes: an array of the words that the mix takes in each epoch, the last
    of which may be fewer than the document has. columns: doc_id, text and source by their names; quality: a weight of one's own."""
    scratch = Scratch(documents.sparkSession, "mixture")
    rows = scratch.write(drawn(documents, keep, seed, quality=quality, **columns), "drawn")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    asked = scratch.write(targets(sizes, weights, epochs), "targets")
    plan = scratch.write(ends(rows, asked), "ends")
    again = F.expr("CASE WHEN end_key IS NULL OR key > end_key OR (key = end_key AND d.size > end_size) THEN 0L WHEN key = end_key AND d.size = end_size THEN end_words ELSE d.size END")
    joined = rows.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
    passes = F.filter(F.concat(F.array_repeat(F.col("d.size"), F.col("whole").cast("int")), F.array(again)), lambda n: n > 0)
    return joined.select(F.col("d.d").alias("d"), "d.source", "d.size", "source_size", "target", passes.alias("passes"))


def cut(text: Column, n_words: Column) -> Column:
    """The first n_words words of text and what stands between them."""
    body = F.ltrim(text, F.lit(" \t\n\x0b\x0c\r"))
    tail = F.element_at(F.split(body, BLANKS, (n_words + 1).cast("int")), -1)
    kept = F.substring(body, F.lit(1), F.length(body) - F.length(tail))
    return F.when(n_words >= F.regexp_count(text, F.lit(WORD)), text).otherwise(F.rtrim(kept, F.lit(" \t\n\x0b\x0c\r")))


def mixture(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix itself: the columns of documents, once for each epoch that takes the document (`epoch`, from 1), the text cut where the budget ended."""
    taken = mixed(documents, None, text=text, **options)
    passed = taken.select("d", F.posexplode("passes").alias("epoch", "n"))
    epoch = "epoch"
    while epoch in documents.columns:
        epoch += "_"
    own = [cut(F.col(f"d.`{c}`").cast("string"), F.col("n")).alias(c) if c == text else F.col(f"d.`{c}`").alias(c) for c in documents.columns]
    return passed.select(*own, (F.col("epoch") + 1).alias(epoch))


def op11_source_mixture(spark, sf_dir: str) -> DataFrame:
    found = mixed(read(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(F.col("d.doc_id").alias("doc_id"), "size", "source_size", "target", F.aggregate("passes", F.lit(0).cast("long"), lambda a, n: a + n).alias("taken"))


SQL = rf"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
shaped AS (
    SELECT doc_id, source, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
        (length(t) - length(regexp_replace(t, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g'))) AS marks, string_split(t, chr(10)) AS lines
    FROM texts),
keyed AS (
    SELECT doc_id, source, size,
        -ln((('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::BIGINT + 0.5::DOUBLE) / {_DRAWS}::DOUBLE)
        / greatest({LEAST_QUALITY}::DOUBLE, (1 - marks::DOUBLE / greatest(length(t), 1)) * (len(list_distinct(lines))::DOUBLE / len(lines))) AS key
    FROM shaped),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
    SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap FROM sources),
levels AS (
    SELECT w.source, (SELECT sum(source_size) FROM weighed) AS total,
        coalesce(sum(o.cap) FILTER (WHERE o.cap / o.weight < w.cap / w.weight), 0) AS capped, sum(o.weight) FILTER (WHERE o.cap / o.weight >= w.cap / w.weight) AS open
    FROM weighed w, weighed o GROUP BY w.source, w.cap, w.weight),
leveled AS (
    SELECT max((l.total - l.capped)::DOUBLE / l.open) AS level FROM levels l JOIN weighed w ON w.source IS NOT DISTINCT FROM l.source
    WHERE (l.total - l.capped)::DOUBLE / l.open <= w.cap / w.weight),
asked AS (
    SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 0) * weight) AS target, least(floor(least(cap::DOUBLE, coalesce(level, 0) * weight) + 0.5), cap)::BIGINT AS budget FROM weighed, leveled),
placed AS (
    SELECT k.doc_id, k.size, a.source_size, a.target, a.budget, k.key,
        count(*) OVER same AS copies, coalesce(sum(k.size) OVER earlier, 0)::BIGINT AS past
    FROM keyed k JOIN asked a ON a.source IS NOT DISTINCT FROM k.source
    WINDOW same AS (PARTITION BY k.source, k.key, k.size), earlier AS (PARTITION BY k.source ORDER BY k.key, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP))
SELECT doc_id, size::BIGINT AS size, source_size, target,
    CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, (budget % source_size - past) // copies)) END::BIGINT AS taken
FROM placed
"""
