"""The divergence audit against a dense reading of its contract in Python's integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from meshlake.llm import divergence

DOCS = "value string, text string, lang string, source string, term string, rank int"


def table(spark, rows):
    return spark.createDataFrame([("v", t, lang, source, "x", 1) for t, lang, source in rows], DOCS)


def dense(rows, min_docs=10, top=10):
    """Every kept term in every group, with bytes for terms."""
    docs, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = [w.lower() for w in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())]
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(words))
        n[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, c in docs[lang].items() if c >= min_docs]
        count = {s: {w: n[lang, s][w] for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources - {s})
            terms = sorted((-f(p[s][w], p[None][w]), w) for w in kept if count[s][w] and p[s][w] > p[None][w])[:top]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_audit(spark, seed):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ["x", "É", "ß漢", "Q", "yz"]] + ["word", "e", "Ünter"]
    rows = [(" ".join(r.choices(words, [1 / (1 + (k + 7 * len(source or '')) % len(words)) for k in range(len(words))], k=r.choice([0, 3, 30]))) + r.choice([".", "1a", "\x00-z"]), lang, source) for _ in range(60) for lang, source in [("en", "hot"), ("en", "hot"), ("en", r.choice(["s1", "src22", "üü"])), ("de", r.choice(["a", "bb"])), (None, None)]]
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("rare words", "fr", "b"), (None, "xx", None)] + [rows[0]] * 15 + [("lang " * 30_000, "de", "bb")]
    found = divergence.audit(table(spark, rows).repartition(3), held=20 if seed else divergence.HELD).collect()  # 20: counts are handed on in parts
    assert len(found) == len(set(map(tuple, found)))
    assert set(map(tuple, found)) == dense(rows)


def test_ties_end_the_search_late_enough(spark):
    """Thirty terms with the same value: ranks go by bytes, so that the last bucket's terms count, too."""
    rows = [(" ".join(f"t{chr(97 + k)}{chr(97 + j)}" for k in range(6) for j in range(5)), "en", "a")] * 10 + [("tother " * 3, "en", "b")] * 12
    assert set(map(tuple, divergence.audit(table(spark, rows)).collect())) == dense(rows)
    assert set(map(tuple, divergence.audit(table(spark, rows), min_docs=11, top=2).collect())) == dense(rows, 11, 2)


def test_the_bounds_leave_buckets_unread(spark):
    """A term far more frequent than all others and k = 1: its bucket alone is evaluated."""
    rows = [("own " * 500 + "a b c d e f g h", "en", "s")] * 12 + [("a b c d e f g h", "en", "o")] * 40
    scratch = divergence.Scratch(spark, "bounds")
    counts = scratch.write(divergence.counted(table(spark, rows)), "counts")
    kept = scratch.write(divergence.postings(counts), "kept")
    best = divergence.best_terms(kept, scratch.write(divergence.groups(counts, kept), "groups"), scratch, 1)
    assert [r.item for r in best.where("source = 's'").collect()] == ["own"] and {r.source for r in best.collect()} == {"s", "o"}


def test_empty(spark):
    assert divergence.audit(table(spark, [])).collect() == []
    assert {tuple(r) for r in divergence.audit(table(spark, [(None, "en", "a"), ("x", "en", "b")])).collect()} == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
