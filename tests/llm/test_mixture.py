"""Source mixtures against a plain reading of their contract, with hot sources, caps, ties, nulls and the texts themselves."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meshlake.llm import mixture

DOCS = "doc_id long, text string, source string, size int, epoch int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, 8) for i, t, s in rows], DOCS)


def filled(sizes: dict, weights, epochs) -> dict:
    """Water filling by rounds: the excess of the capped ones is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, found = sum(sizes.values()), set(sizes), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > epochs * sizes[s]}
        if not over:
            return found | {s: left * weight[s] / whole for s in open_}
        found |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(found[s] for s in over)
        open_ -= over
    return found


def test_budgets_are_met_and_no_document_is_over_its_epochs(spark):
    r = random.Random(5)
    source = lambda: r.choice(["a", "a", "a", "b", "ü", None, "z"])
    rows = [(k, " ".join(["wort"] * r.choice([0, 1, 5, 40, 300])), source()) for k in range(700)] + [(1000, None, "empty"), (None, "one two", "b"), (None, "one two", "b"), (1001, "x " * 9000, "long")]
    found = mixture.mixed(table(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for row in found:
        sizes[row.source] += row.size
        taken[row.source] += sum(row.passes)
        assert sum(row.passes) <= 3 * row.size and all(n == row.size for n in row.passes[:-1])
    want = filled(sizes, (5, 2, 1), 3)
    for row in found:
        assert row.source_size == sizes[row.source] and row.target == pytest.approx(want[row.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.5
    assert sorted(map(str, found)) == sorted(map(str, mixture.mixed(table(spark, rows).repartition(7)).collect()))  # reruns agree


def test_the_rest_goes_by_keys_in_order(spark):
    rows = [(k, f"{k} " * (k % 7 + 1), "ab"[k % 2]) for k in range(400)]
    docs = table(spark, rows)
    keys = {r.d.doc_id: (r.key, r.size) for r in mixture.drawn(docs).collect()}
    for name in "ab":
        mine = [r for r in mixture.mixed(docs, weights=(5, 1)).collect() if r.source == name]
        budget = int(mine[0].target + 0.5) % mine[0].source_size
        for row in sorted(mine, key=lambda r: keys[r.d.doc_id]):
            share = min(row.size, budget)
            assert sum(row.passes) % row.size == share % row.size or share == row.size
            assert sum(row.passes) == int(row.target + 0.5) // row.source_size * row.size + share
            budget -= share
        assert budget == 0


def test_better_documents_are_taken_more_often(spark):
    rows = [(k, "good words only here" if k % 2 else "5%1 #2& $$3$ (4)", "ab"[k // 2 % 2]) for k in range(4000)]
    found = mixture.mixed(table(spark, rows), weights=(1, 5)).where("source = 'a'").collect()
    good = sum(sum(r.passes) for r in found if r.d.doc_id % 2)
    assert good > 0.7 * sum(sum(r.passes) for r in found)
    same = mixture.mixed(table(spark, rows), weights=(1, 5), quality=F.lit(1.0)).where("source = 'a'").collect()
    good = sum(sum(r.passes) for r in same if r.d.doc_id % 2)
    assert 0.4 < good / sum(sum(r.passes) for r in same) < 0.6


def test_repeated_rows_share_the_end(spark):
    rows = [(1, "a b c", "s")] * 50 + [(2, "a b c d", "t")] * 10
    found = mixture.mixed(table(spark, rows), weights=(1, 4)).collect()
    for name, size in (("s", 150), ("t", 40)):
        mine = [sum(r.passes) for r in found if r.source == name]
        assert len(set(mine)) == 1 and found[0].target >= 0
        assert abs(sum(mine) - next(r.target for r in found if r.source == name)) < len(mine)


def test_the_mix_itself(spark):
    rows = [(1, "\tone  two\nthree four ", "a"), (2, "five six", "a"), (3, "seven", "b"), (4, "", "b"), (5, None, None)]
    docs = table(spark, rows)
    plan = {r.d.doc_id: r.passes for r in mixture.mixed(docs, weights=(1, 3)).collect()}
    mix = mixture.mixture(docs, weights=(1, 3))
    assert mix.columns == [*docs.columns, "epoch_"]
    text = {i: t for i, t, _ in rows}
    got: dict = {}
    for r in mix.orderBy("epoch_").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert {i: [len(re.findall(mixture.WORD, t)) for t in ts] for i, ts in got.items()} == {i: p for i, p in plan.items() if p}
    assert all(text[i].lstrip().startswith(t) or t == text[i] for i, ts in got.items() for t in ts)
    assert mixture.mixed(docs.limit(0)).count() == 0 and mixture.mixture(docs.limit(0)).count() == 0
    assert [r.target for r in mixture.mixed(docs.where("doc_id > 3")).collect()] == [0.0, 0.0]


def test_no_python_worker(spark):
    from conftest import SF

    assert "Python" not in (plan := mixture.op11_source_mixture(spark, SF)._jdf.queryExecution().toString()) and "Arrow" not in plan
