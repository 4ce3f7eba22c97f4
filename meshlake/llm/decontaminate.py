"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised benchmark items.

Normal form: A-Z in lower case, every other ASCII byte that is neither letter nor digit a blank, bytes of longer
UTF-8 sequences as they are. Documents are scanned once, as " w1 w2 ... wn "; the words of a match are found by
the blanks around them, and their offsets in the original text by the same table, which maps byte to byte.

Null and empty texts have no words and aren't contaminated. Items without words, and items whose id is null, have
no windows; an empty table gives no rows. Repeated items count once; repeated documents each have their row. Only the id and the text are read,
so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, keeps, read

WINDOW = 13
#: Characters of windows in one automaton, which takes some 50 bytes a character, and in one broadcast; more windows make more
#: automata, all of them in the same pass over the texts.
AUTOMATON_CHARS = 4_000_000
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("contaminated", T.BooleanType()),
])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FORM).split()


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, chars: int) -> Iterator[list[tuple[str, list[str]]]]:
    """(window, ids of its items), in blocks of bounded size. An item's rows come one by one to the driver."""
    held: dict[str, set[str]] = {}
    size = 0
    for row in benchmark.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{text}`").cast("string")).toLocalIterator():
        if row[0] is None:
            continue
        w = words(row[1].encode() if row[1] is not None else None)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            key = f" {b' '.join(w[i : i + window]).decode('latin-1')} "
            if key not in held:
                if size and size + len(key) > chars:
                    yield [(k, sorted(v)) for k, v in held.items()]
                    held, size = {}, 0
                size += len(key)
            held.setdefault(key, set()).add(row[0])
    yield [(k, sorted(v)) for k, v in held.items()]


def automaton(block: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, (key, items) in enumerate(block):
        made.add_word(key, (k, len(key), items))
    made.make_automaton()
    return made


def scan(text: bytes | None, automata: list, percent: int) -> tuple:
    """One document's row."""
    w = words(text)
    hit, items = np.zeros(len(w), bool), set()
    if w and automata:
        form = b" " + b" ".join(w) + b" "
        plain, blanks = form.decode("latin-1"), None
        steps, seen = np.zeros(len(w) + 2, np.int64), set()
        for n, search in enumerate(automata):
            for end, (k, size, ids) in search.iter(plain):
                blanks = np.flatnonzero(np.frombuffer(form, np.uint8) == 32) if blanks is None else blanks
                first, last = np.searchsorted(blanks, (end - size + 1, end))
                steps[first] += 1
                steps[last] -= 1
                if (n, k) not in seen:
                    seen.add((n, k))
                    items.update(ids)
        hit = np.cumsum(steps)[: len(w)] > 0
    marked = np.flatnonzero(hit)
    spans = []
    if len(marked):  # back to the original text, in code points
        raw = np.frombuffer(text, np.uint8)
        inside = np.frombuffer(text.translate(_FORM), np.uint8) != 32
        edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
        point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        starts, ends = point[np.flatnonzero(edge == 1)], point[np.flatnonzero(edge == -1)]
        for run in np.split(marked, np.flatnonzero(np.diff(marked) > 1) + 1):
            spans.append({"start": int(starts[run[0]]), "end": int(ends[run[-1]])})
    n = len(marked)
    return len(w), n, len(items), sorted(items), spans, bool(n and n * 100 >= percent * len(w))


class Search:
    """The automata over all blocks of windows, one after another within a document. A worker makes them once, and keeps those
    of one benchmark until a task of another operator comes."""

    _kept: tuple[str, list] = ("", [])

    def __init__(self, shared: list):
        self.shared, self.key = shared, uuid.uuid4().hex

    def automata(self) -> list:
        if Search._kept[0] != self.key:
            Search._forget()  # the former ones go first
            Search._kept = (self.key, [automaton(b.value) for b in self.shared if b.value])
            keeps("contamination", Search._forget)
        return Search._kept[1]

    @staticmethod
    def _forget() -> None:
        Search._kept = ("", [])


def contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str | None = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = 5, chars: int = AUTOMATON_CHARS) -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct: n_words, n_hit, n_items, items, spans (code points of the original
    text), contaminated (at least percent of the words hit). The windows are broadcast in blocks of bounded size."""
    context = documents.sparkSession.sparkContext
    search = Search([context.broadcast(b) for b in blocks(benchmark, item_id, item_text, window, chars)])

    def make():
        automata = search.automata()
        return lambda texts: [scan(t, automata, percent) for t in texts]

    return annotate(documents, text, FIELDS, make, None if doc_id is None else [doc_id], "contamination")


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found, name = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    r = F.col(name)
    return found.select("doc_id", r.n_words.alias("n_words"), r.n_hit.alias("n_hit"), r.n_items.alias("n_items"), F.sha2(F.array_join(r.items, ","), 256).alias("items_sha256"), r.contaminated.alias("contaminated"))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS w
  FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, win.n, i FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
