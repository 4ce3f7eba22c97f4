"""Language identification as inference over mixtures of languages.

A model holds, for each language, the probabilities of hashed byte n-grams, from counts over all training rows. A document
is a mixture: expectation-maximisation estimates the languages' proportions from the n-grams' likelihoods, and the set of
languages is the one with the best penalised likelihood of those that dropping the smallest share, one after the other,
leads through, and of the best single language.

Null texts and texts without a letter are "und", with score 0 and no shares; so is everything if no row has a language.
Ties go to the language that sorts first. An empty table gives no rows. Repeated rows count each; only text, lang and the id's hash are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, as_bytes, bounded, read

BITS, ORDERS = 16, (3, 4)
#: Each letter is in so many n-grams, so their likelihoods count by the inverse; what a further language must gain.
REPEATED, PENALTY = float(sum(ORDERS)), 3.0
_PLAIN = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))
_FACTORS = (np.array([40503, 30011, 51437, 60493], np.uint32), np.array([7919, 48611, 22307, 36809], np.uint32))

FIELDS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.MapType(T.StringType(), T.DoubleType()))])


def grams(text: bytes | None) -> np.ndarray | None:
    """Buckets of the n-grams of the lower-case text, non-letters as single blanks; None without a letter."""
    lower = (text or b"").decode().lower()
    if not any(map(str.isalpha, lower)):  # numerals and signs that regular expressions take for word characters aren't letters
        return None
    form = np.frombuffer(b" " + b" ".join(lower.encode().translate(_PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for order, factors in zip(ORDERS, _FACTORS, strict=True):
        if len(form) >= order:
            n = len(form) - order + 1
            h = sum((form[k : k + n] * factors[k] << np.uint32(2 * k) for k in range(order)), np.zeros(n, np.uint32))
            out.append(((h ^ (h >> np.uint32(15))) * np.uint32(2654435769)) >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            h = grams(text)
            if h is not None:
                sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
                sums[lang] += np.bincount(h, minlength=1 << BITS)
    for lang, s in sorted(sums.items()):
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(s[at], pa.int64())})


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language) of shape buckets x languages). Counts cover all rows; what comes to the
    driver is one number for a language and bucket."""
    bounded(rows.sparkSession)
    known = rows.where(F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    sums = known.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(sums.column("lang").to_pylist()))
    table = np.full((1 << BITS, max(1, len(names))), 0.5)
    where = {x: i for i, x in enumerate(names)}
    table[sums.column("bucket").to_numpy(), [where[x] for x in sums.column("lang").to_pylist()]] += sums.column("n").to_numpy()
    return names, np.log(table / table.sum(0))


def mixture(p: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the columns of p, and the log-likelihood, by expectation-maximisation."""
    shares, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
    for _ in range(rounds):
        r = p * shares
        shares = (n / r.sum(1)) @ r / total
    return shares, float(n @ np.log(p @ shares))


def infer(h: np.ndarray, names: list[str], table: np.ndarray, penalty: float = PENALTY, rounds: int = 8) -> tuple[str, float, list[tuple[str, float]]]:
    at, n = np.unique(h, return_counts=True)
    n = n / REPEATED
    logs = table[at]
    top = logs.max(1, keepdims=True)
    p = np.exp(logs - top)
    alone = n @ (logs - top)
    left = np.arange(len(names))
    now, fit = mixture(p, n, rounds)
    first, best = now, int(np.argmax(alone))
    chosen, shares, value = left, now, fit - penalty * len(left)
    while len(left) > 2:
        left = np.delete(left, int(np.argmin(now)))
        now, fit = mixture(p[:, left], n, rounds)
        if fit - penalty * len(left) >= value:
            chosen, shares, value = left, now, fit - penalty * len(left)
    if alone[best] - penalty >= value:
        chosen, shares = np.array([best]), np.ones(1)
    k = int(np.argmax(shares))
    return names[chosen[k]], float(min(1.0, first[chosen[k]] if len(chosen) == 1 else shares[k])), [(names[i], float(s)) for i, s in zip(chosen, shares, strict=True)]


def identify(documents: DataFrame, names: list[str], table: np.ndarray, doc_id: str | None = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct: lang, score (the language's share), shares (of the chosen set)."""
    shared = documents.sparkSession.sparkContext.broadcast((names, table))

    def make():
        known, logs = shared.value

        def one(text: bytes | None) -> tuple:
            h = grams(text) if known else None
            return ("und", 0.0, []) if h is None else infer(h, known, logs) if len(h) else (known[0], 1 / len(known), [])

        return lambda texts: [one(t) for t in texts]

    return annotate(documents, text, FIELDS, make, None if doc_id is None else [doc_id], "language")


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    names, table = train(documents.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    found, name = identify(documents, names, table)
    r = F.col(name)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), r.lang.alias("lang_pred"), r.score.alias("score"), r.shares.alias("shares"))
