"""Toxicity by weak supervision.

Lexicons are mined from a bounded sample of labelled training rows: words and word beginnings that toxic texts have, or have
often, far oftener than others. They are dealt into many lexicons, and with patterns that look at a text's form they make many
voters, each of which says toxic, not toxic, or abstains; voters that the labels of the sample speak against are left out. That is all that
labels are used for. A generative label model estimates by expectation-maximisation from the votes alone how
accurate the voters are, finds which of them vote together beyond what the class explains, and models those jointly, so that five
lexicons that see one word don't count as five witnesses. A logistic regression on the lexicons' entries and the patterns is trained on the posterior labels and scores every text.

Scores use the text alone. Null and empty texts score as texts without any evidence. Without labelled rows, without
toxic ones, or without voters, every score is the prior of the rows there are (0 if none). Rows and labels whose id is null teach nothing, and are scored;
repeated rows are scored each by itself. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, as_bytes, bounded, read, smallest
from meshlake.session import Scratch

#: Labelled rows that lexicons, label model and classifier are fitted on, at most: those with the smallest hashes.
LABELLED = 8000
#: Features of the lexicons, at most; toxic rows of the sample that a feature must occur in; least odds ratio; and least
#: log-likelihood ratio against chance, as a sample has millions of rare words.
FEATURES, SUPPORT, ODDS, EVIDENCE = 4000, 6, 100.0, 15.0
#: Minimum hashes of word pairs by which near copies in the sample are found: copies would make any of their words evidence.
COPIES = 8
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Lexicons that whole words are dealt into, and beginnings of each length. An entry is frequent in a text that has it twice and once in so
#: many words. Words from which a text without any entry of a lexicon counts against it.
SHARDS, HALVES, RATE, ENOUGH = 8, 2, 100, 20
#: Of the labelled texts that a voter calls toxic, the share that must be, and its least multiple of the share of all.
RIGHT, LIFT = 0.5, 2.0
WORDS = 60_000
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of form that vote, each by itself: words of address before an exclamation mark, capitals, and sentences in small letters.
_ADDRESS = re.compile(r"\b(?:you|your|tu|du|usted|vous)\b[^.!?\n]{0,20}!", re.I)
_SMALL_START = re.compile(r"(?:^|[.!?]\s+)(?=[^\W\d_])(.)")
PATTERNS = ("address", "capitals", "small")
FIELDS = T.StructType([T.StructField("score", T.DoubleType())])


def features_of(word: str) -> list[str]:
    return [f"w{word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: bytes | None) -> Counter[str]:
    """How often each word occurs; words are runs of letters."""
    found = Counter(_WORD.findall((text or b"").decode().lower()))
    for w in [w for w in found if not w.isalpha()]:  # numerals that regular expressions take for word characters
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def entries(words: Counter[str]) -> set[str]:
    """All that a lexicon could have of a text: words and beginnings, and after a "!" those that are frequent."""
    total, sums = sum(words.values()), Counter()
    for w, n in words.items():
        for f in features_of(w):
            sums[f] += n
    return {*sums, *(f"!{f}" for f, n in sums.items() if n > 1 and n * RATE >= total)}


def pattern(name: str, text: str) -> int:
    """The vote of a voter that looks at the form of the text."""
    if name == "address":
        return int(bool(_ADDRESS.search(text)))
    if name == "capitals":
        letters = sum(map(str.isalpha, text))
        return int(letters >= ENOUGH and sum(map(str.isupper, text)) > 0.6 * letters)
    starts = _SMALL_START.findall(text)
    return int(any(map(str.islower, starts)))


def voter_of(entry: str) -> str:
    """The lexicon that an entry belongs to."""
    often, plain = entry[0] == "!", entry.lstrip("!")
    return f"{'often' if often else 'any'} {plain[0]} {zlib.crc32(plain.encode()) % (SHARDS if plain[0] == 'w' else HALVES)}"


def votes(found: set[int], n_words: int, forms: list[int], owner: list[int], lexicons: int) -> list[int]:
    """One vote for each lexicon, from the entries found, then those of the patterns. A lexicon that finds nothing where others do
    abstains: it may be of another language."""
    by = {owner[i] for i in found}
    return [1 if v in by else -1 if n_words >= ENOUGH and not by else 0 for v in range(lexicons)] + forms


class LabelModel:
    """P(toxic | votes). Voters that vote together given the class, beyond a bound, form groups of up to three, and a group's
    votes are one outcome; groups are independent given the class, and one that abstains says nothing."""

    def __init__(self, matrix: np.ndarray, start: np.ndarray | None = None, bound: float = 0.35, most: int = 3, rounds: int = 25):
        self.groups = [[j] for j in range(matrix.shape[1])]
        start = np.where((matrix > 0).any(1), 0.9, 0.05) if start is None else np.clip(start, 0.05, 0.95)
        self.correlation = np.maximum(self._residual(matrix, start), self._residual(matrix, 1 - start))  # before voters that agree can pose as the class
        p = self._fit(matrix, start, rounds)
        self.accuracy = [float(((matrix[:, j] > 0) * p + (matrix[:, j] < 0) * (1 - p)).sum() / max(1, (matrix[:, j] != 0).sum())) for j in range(matrix.shape[1])]
        pairs = sorted(((self.correlation[i, j], i, j) for i in range(len(self.groups)) for j in range(i)), reverse=True)
        for c, i, j in pairs:
            a, b = (next(g for g in self.groups if x in g) for x in (i, j))
            if c >= bound and a is not b and len(a) + len(b) <= most:
                self.groups.remove(b)
                a.extend(b)
        self._fit(matrix, p, rounds)

    @staticmethod
    def _residual(matrix: np.ndarray, w: np.ndarray) -> np.ndarray:
        w = w / max(w.sum(), 1e-9)
        x = matrix - w @ matrix
        cov = (x * w[:, None]).T @ x
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        return np.abs(cov) / np.outer(sd, sd)

    def _codes(self, matrix: np.ndarray) -> list[np.ndarray]:
        return [sum((matrix[:, j].astype(np.int64) + 1) * 3**k for k, j in enumerate(g)) for g in self.groups]

    def _fit(self, matrix: np.ndarray, p: np.ndarray, rounds: int) -> np.ndarray:
        codes = self._codes(matrix)
        for _ in range(rounds):
            self.prior = float(np.clip(p.mean(), 1e-4, 1 - 1e-4))
            self.tables = []
            for g, c in zip(self.groups, codes, strict=True):
                n = 3 ** len(g)
                yes, no = np.bincount(c, p, n) + 0.5, np.bincount(c, 1 - p, n) + 0.5
                self.tables.append(np.log(yes / yes.sum()) - np.log(no / no.sum()))
                self.tables[-1][(n - 1) // 2] = 0.0  # all of them abstain: that says nothing
            p = self.posterior(matrix)
        return p

    def posterior(self, matrix: np.ndarray) -> np.ndarray:
        odds = math.log(self.prior / (1 - self.prior)) + sum((t[c] for t, c in zip(self.tables, self._codes(matrix), strict=True)), np.zeros(len(matrix)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(rows: list[list[int]], target: np.ndarray, n: int, l2: float = 1e-3, rounds: int = 400, step: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on binary features, from soft labels, by Adam on all rows; the rare
    class counts the more, but not in full proportion."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.fromiter((i for r in rows for i in r), np.int64, len(owner))
    toxic = max(float(target.sum()), 1e-6)
    weight = np.where(target > 0.5, (len(rows) / toxic) ** 0.75, 1.0) / max(1, len(rows))
    w, b = np.zeros(n), 0.0
    mw, vw, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, w[index], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        gw, gb = np.bincount(index, g[owner], n) + l2 * w / max(1, n), float(g.sum())
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = step * min(1.0, 40 / t) * 0.2
        w = w - rate * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.99**t)) + 1e-8)
        b = b - rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, b


def sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(id, text, toxic) of a bounded number of labelled training rows: those whose ids have the smallest hashes."""
    train = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("id")))
    chosen = smallest(train.select("id", "toxic"), F.xxhash64("id"), most)
    return documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").select(F.col("id").cast("string").alias("id"), "text", "toxic")


def minima(text: bytes | None) -> list[int]:
    words = _WORD.findall((text or b"").decode().lower())
    h = np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:] or [""])], np.uint64)
    if not len(h):
        return [0] * COPIES
    return [int(((h * np.uint64(2 * k + 3) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).min() >> np.uint64(1)) for k in range(COPIES)]


def without_copies(rows: DataFrame) -> DataFrame:
    """The bounded sample with one row of each set of copies or near copies: the first by its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "h": pa.array([minima(t) for t in as_bytes(batch.column(1))], pa.list_(pa.int64()))})

    kept, seen = [], set()
    for row in sorted(rows.select("id", "text").mapInArrow(run, "id string, h array<long>").collect(), key=lambda r: (list(r["h"]), r["id"])):
        twos = {(i, j, row["h"][i], row["h"][j]) for i in range(COPIES) for j in range(i)}  # two agree: one common pair is chance
        if not twos & seen:
            kept.append((row["id"],))
        seen |= twos
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "id string")), "id").dropDuplicates(["id"]).select("text", "toxic")


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, toxic rows with it, rows with it: summed within the task as far as a bounded table holds."""
    yes, all_ = Counter(), Counter()

    def flush():
        out = pa.RecordBatch.from_pydict({"feature": pa.array(list(all_), pa.string()), "yes": pa.array([yes[f] for f in all_], pa.int64()), "n": pa.array(list(all_.values()), pa.int64())})
        yes.clear(), all_.clear()
        return out

    for batch in batches:
        for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            found = entries(words_of(text))
            all_.update(found)
            if toxic == 1:
                yes.update(found)
            if len(all_) > 200_000:
                yield flush()
    yield flush()


class Model:
    """Lexicon and patterns with their weights; the lexicon's entries come first."""

    def __init__(self, lexicon: dict[str, int], patterns: list[str], weights: np.ndarray, bias: float):
        self.lexicon, self.patterns, self.weights, self.bias = lexicon, patterns, weights, bias
        self._memo: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def __getstate__(self):
        return self.lexicon, self.patterns, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def found(self, text: bytes | None) -> tuple[set[int], int]:
        """The entries that a text has, and its number of words."""
        words = words_of(text)
        total, found, sums = sum(words.values()), set(), Counter()
        memo = self._memo
        for w, n in words.items():
            hit = memo.get(w)
            if hit is None:
                if len(memo) > WORDS:
                    memo.clear()
                of = features_of(w)
                hit = memo[w] = tuple(tuple(self.lexicon[f] for f in fs if f in self.lexicon) for fs in (of, [f"!{f}" for f in of]))
            if hit[0]:
                found.update(hit[0])
            for i in hit[1]:
                sums[i] += n
        found.update(i for i, n in sums.items() if n > 1 and n * RATE >= total)
        return found, total

    def forms(self, text: bytes | None) -> list[int]:
        plain = (text or b"").decode() if self.patterns else ""
        return [pattern(name, plain) for name in self.patterns]

    def score(self, text: bytes | None) -> float:
        n = len(self.lexicon)
        z = self.bias + sum(self.weights[i] for i in sorted(self.found(text)[0])) + sum(self.weights[n + i] for i, v in enumerate(self.forms(text)) if v)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def chosen(matrix: np.ndarray, gold: np.ndarray) -> list[int]:
    """Voters that the labels don't speak against."""
    share = gold.mean()
    right = [(gold[matrix[:, j] > 0].mean() if (matrix[:, j] > 0).sum() >= SUPPORT else 0.0) for j in range(matrix.shape[1])]
    return [j for j, r in enumerate(right) if r >= RIGHT and r >= LIFT * share]


def learned(seen: list[tuple[list[int], int, list[int], int]], lexicon: dict[str, int], patterns: list[str]) -> Model:
    """From (entries found, number of words, patterns' votes, label) of the sample's rows."""
    seen = sorted(seen)
    names = sorted({voter_of(f) for f in lexicon})
    where = {v: i for i, v in enumerate(names)}
    owner = [where[voter_of(f)] for f in lexicon]
    matrix = np.array([votes(set(found), n, forms, owner, len(names)) for found, n, forms, _ in seen], np.int64).reshape(len(seen), len(names) + len(patterns))
    gold = np.array([toxic == 1 for *_, toxic in seen], float)
    kept = chosen(matrix, gold)
    if not kept:
        return Model({}, [], np.zeros(0), math.log(gold.mean() / (1 - gold.mean())))
    posterior = LabelModel(matrix[:, kept]).posterior
    used = [j - len(names) for j in kept if j >= len(names)]
    rows = [[*found, *(len(lexicon) + k for k, j in enumerate(used) if forms[j] > 0)] for found, _, forms, _ in seen]
    weights, bias = logistic(rows, posterior(matrix[:, kept]), len(lexicon) + len(used))
    return Model(lexicon, [patterns[j] for j in used], weights, bias)


def lexicon_of(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, int]:
    """Entries by (feature, toxic rows with it, rows with it): those with the odds and the evidence, the strongest first."""
    kept, share = [], toxic / (toxic + clean)
    for f, yes, n in counts:
        ratio = ((yes + 0.5) / (toxic + 1)) / ((n - yes + 0.5) / (clean + 1))
        part = yes / n
        evidence = yes * math.log(part / share) + ((n - yes) * math.log((1 - part) / (1 - share)) if part < 1 else 0.0)
        if yes >= SUPPORT and ratio >= ODDS and evidence >= EVIDENCE:
            kept.append((-yes * math.log(ratio), f))
    return {f: i for i, (_, f) in enumerate(sorted(kept)[:FEATURES])}


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> Model:
    scratch = Scratch(documents.sparkSession, "toxicity")
    bounded(documents.sparkSession)
    rows = scratch.write(without_copies(scratch.write(sample(documents, labels, doc_id, text, label, most), "sample")), "rows")
    total = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
    toxic, clean = total[1], total[0] - total[1]
    if not toxic or not clean:
        return Model({}, [], np.zeros(0), -30.0 if not toxic else 30.0)
    counted = rows.mapInArrow(_mined, "feature string, yes long, n long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).where(F.col("yes") >= SUPPORT)
    ratio = ((F.col("yes") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("yes") + 0.5) / (clean + 1))
    lexicon = lexicon_of([tuple(r) for r in counted.where(ratio >= ODDS).collect()], toxic, clean)
    shared = documents.sparkSession.sparkContext.broadcast(Model(lexicon, list(PATTERNS), np.zeros(0), 0.0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(0))
            made = [shared.value.found(t) for t in texts]
            yield pa.RecordBatch.from_pydict({"found": pa.array([sorted(f) for f, _ in made], pa.list_(pa.int32())), "words": pa.array([n for _, n in made], pa.int64()), "forms": pa.array([shared.value.forms(t) for t in texts], pa.list_(pa.int32())), "toxic": batch.column(1)})

    seen = rows.mapInArrow(look, "found array<int>, words long, forms array<int>, toxic int").collect()
    return learned([(list(r["found"]), r["words"], list(r["forms"]), r["toxic"]) for r in seen], lexicon, list(PATTERNS))


def toxicity(documents: DataFrame, model: Model, doc_id: str | None = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct with the score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: [(shared.value.score(t),) for t in texts]

    return annotate(documents, text, FIELDS, make, None if doc_id is None else [doc_id], "toxicity")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found, name = toxicity(documents, fit(documents, read(spark, sf_dir, "labels")))
    score = F.col(name).score
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
