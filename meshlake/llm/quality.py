"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one feature of a text and votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over
the counts of all vote patterns (at most 3 to the number of rules, whatever the corpus) estimates how often each rule votes
what for good texts and for each of a few kinds of bad ones, and so each text's probability of being good. All of these
tables are free: a rule whose objections go with no other rule's is found to be noisy, and loses its veto; an objection
that the other rules of its kind confirm counts. What fails the base rules goes whatever the vote.

Null and empty texts have no words and fail the base. Ties (a posterior at the threshold) are kept. Every row counts,
repeated ones too; only the columns asked for are read, so others may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.texts import read
from meshlake.session import Scratch

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: ASCII characters that are neither letters nor blanks.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
WINDOW = 5
#: Name, feature (SQL over the columns of features()), bad if beyond, good if within: a rule abstains between.
RULES = (
    ("symbols", "n_symbols / n_words", "x > 0.15", "x < 0.05"),
    ("marks", "n_marks / word_chars", "x > 0.12", "x < 0.08"),
    ("capitals", "n_upper / word_chars", "x > 0.4", "x < 0.15"),
    ("shouting", "n_exclaim / n_words", "x > 0.3", "x < 0.1"),
    ("repeats", "n_repeat_words / n_words", "x > 0.1", "x < 0.05"),
    ("lines", "n_dup_lines / n_lines", "x > 0.5", "x < 0.2"),
    ("variety", "n_distinct / n_words", "x < 0.1 AND n_words < 1000", "x > 0.35"),
    ("stops", "n_stops / n_words", "x < 0.02 AND n_words >= 40", "x BETWEEN 0.03 AND 0.4"),
    ("word_length", "word_chars / n_words", "x < 2 OR x > 12", "x BETWEEN 3 AND 9"),
)
#: The kinds of bad texts that the search starts from, by the rules that object to each.
KINDS = (("symbols", "marks"), ("capitals", "shouting", "marks"), ("repeats", "lines", "variety"), ("stops", "word_length", "variety"))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def repeated_words(grams: Column, window: int) -> Column:
    """Of the hashes of all windows in order, how many words lie in windows that occur twice or more."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(window), F.get(places, k + 1) - p)).otherwise(F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def twins(ordered: Column) -> Column:
        same = F.filter(ordered, lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)))
        return bound(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(bound(ordered, twins))


def removed(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def without(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def features(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use."""
    t = F.col("t")
    raw = documents.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    trimmed = F.btrim(t, F.lit(SPACE))
    split = raw.select(
        "id", "t", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    n = F.size("w")
    counted = split.select(
        "id", n.cast("long").alias("n_words"), (F.length(t) - removed(t, SPACE)).cast("long").alias("word_chars"), removed(t, SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(t, r"\P{Lu}+", "")).cast("long").alias("n_upper"), without(t, "!").cast("long").alias("n_exclaim"), without(t, ".").cast("long").alias("n_stops"), removed(t, MARKS).cast("long").alias("n_marks"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).otherwise(F.array().cast("array<long>")).alias("grams"),
    )
    return counted.withColumn("n_repeat_words", repeated_words(F.col("grams"), WINDOW)).drop("grams")


def voted(counted: DataFrame) -> DataFrame:
    """With each rule's vote and base_failed."""
    votes = [F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad.replace('x ', f'({of}) ')} THEN -1 WHEN {good.replace('x ', f'({of}) ')} THEN 1 ELSE 0 END").cast("byte").alias(f"v_{name}") for name, of, bad, good in RULES]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), *votes)


Table = list[dict[int, float]]
Votes = tuple[int, ...]

_GOOD, _OBJECTS, _ELSE = {1: 0.85, 0: 0.1, -1: 0.05}, {1: 0.1, 0: 0.1, -1: 0.8}, {1: 0.6, 0: 0.2, -1: 0.2}
#: The starting values weigh as much as this share of a kind's texts, and one text: so no rule is taken to be never wrong.
TRUST = 0.1


def _joint(votes: Votes, weights: list[float], tables: list[Table]) -> list[float]:
    return [w * math.prod(t[v] for t, v in zip(table, votes, strict=True)) for w, table in zip(weights, tables, strict=True)]


def estimate(patterns: list[tuple[Votes, int]], names: list[str] | None = None, kinds: tuple[tuple[str, ...], ...] = KINDS, rounds: int = 300) -> tuple[list[float], list[Table]]:
    """Shares of the kinds of text, the good kind first, and for each kind P(vote) of each rule, by expectation-maximisation
    from (votes, count). kinds say where the search starts; shares and tables all come from the counts, with a weak prior."""
    names = [r[0] for r in RULES] if names is None else names
    total = sum(c for _, c in patterns)
    starts = [[_GOOD] * len(names), *([_OBJECTS if n in kind else _ELSE for n in names] for kind in kinds)]
    weights, tables = [0.8, *[0.2 / len(kinds)] * len(kinds)], [[dict(t) for t in s] for s in starts]
    for _ in range(rounds if total else 0):
        sums = [[{1: 0.0, 0: 0.0, -1: 0.0} for _ in names] for _ in starts]
        mass = [0.0] * len(starts)
        for votes, count in patterns:
            joint = _joint(votes, weights, tables)
            whole = sum(joint) or 1.0
            for k, p in enumerate(joint):
                share = count * p / whole
                mass[k] += share
                for s, v in zip(sums[k], votes, strict=True):
                    s[v] += share
        was, weights = weights, [(m + 1) / (total + len(starts)) for m in mass]
        tables = [[{v: (s[v] + (1 + TRUST * m) * start[v]) / (m + 1 + TRUST * m) for v in s} for s, start in zip(sums[k], starts[k], strict=True)] for k, m in enumerate(mass)]
        if max(abs(a - b) for a, b in zip(was, weights, strict=True)) < 1e-7:
            break
    return weights, tables


def accuracies(weights: list[float], tables: list[Table]) -> list[tuple[float, float]]:
    """For each rule, P(its vote is right, given that it votes) and P(it abstains)."""
    bad, out = sum(weights[1:]), []
    for j in range(len(tables[0])):
        right = weights[0] * tables[0][j][1] + sum(w * t[j][-1] for w, t in zip(weights[1:], tables[1:], strict=True))
        idle = sum(w * t[j][0] for w, t in zip(weights, tables, strict=True)) / (weights[0] + bad)
        out.append((right / max(1e-12, (weights[0] + bad) * (1 - idle)), idle))
    return out


def posterior(weights: list[float], tables: list[Table]) -> Column:
    """P(good | votes) as an expression."""
    kinds = []
    for w, table in zip(weights, tables, strict=True):
        p = F.lit(w)
        for (name, *_), t in zip(RULES, table, strict=True):
            p = p * F.when(F.col(f"v_{name}") == 1, t[1]).when(F.col(f"v_{name}") == -1, t[-1]).otherwise(t[0])
        kinds.append(p)
    return kinds[0] / sum(kinds[1:], kinds[0])


def quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality (the posterior
    probability) and kept. The counts are computed once, into a scratch table that both passes read."""
    table = Scratch(documents.sparkSession, "quality").write(voted(features(documents, doc_id, text)), "votes")
    names = [f"v_{r[0]}" for r in RULES]
    patterns = [(tuple(row[n] for n in names), row["n"]) for row in table.where("n_words > 0").groupBy(*names).agg(F.count("*").alias("n")).collect()]
    scored = table.withColumn("quality", F.when(F.col("n_words") > 0, posterior(*estimate(sorted(patterns)))).otherwise(0.0))
    return scored.select(F.col("id").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    q = quality(read(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
