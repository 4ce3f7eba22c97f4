"""Removal of repeated passages by a sparse suffix array, sorted by a common-prefix-aware distributed merge sort.

A byte goes if a string of 100 bytes covers it that also starts earlier: in a document with a smaller id, or earlier in
the same one. Sorting the suffixes at all bytes would take many times the input, so suffixes are taken at anchors: the
place of the least hash among the 40-byte strings of each window of 100. Equal windows have the same anchor, wherever
they are, so nothing is lost by looking only at windows whose anchor's 40 bytes occur more than once.

1. Anchors' hashes are exchanged; what occurs once is left out. A map task sends one of each hash, and so do the next
   steps with strings, so a passage that a third of all documents share is no heavier than others.
2. The suffixes at the remaining anchors, each with the bytes before it in reverse, are sorted in the map task and sent
   as front-coded runs to the task of their range, whose loser tree merges the runs: of two strings that share different
   lengths with the last one out, the one that shares more is less, and else they are compared from there on only.
   Equal suffixes are repeats as far as their windows reach; the first of them, by (id, place), stands for all.
3. Where different suffixes share an anchor's 40 bytes, what any two of them share before and after it says which windows
   of the later one repeat. Beyond GROUP suffixes, their windows are sorted and merged in the same way instead, as suffixes
   of 100 bytes.
Texts and what is found about them meet by the id's share of the table: packed arrays come first, then the texts.

Null and empty texts are empty. Texts under 100 bytes keep all. Rows without an id match nothing and keep all; rows that
repeat an id and text are one document and don't repeat each other. Rows that share an id but not the text are documents of
their own, the one with the smaller SHA-256 of its text before the other. An empty table gives no rows. Only the id and the
text are read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from meshlake.llm.texts import as_bytes, bounded, read, smallest
from meshlake.session import Scratch

LENGTH, ANCHOR = 100, 40
#: k-mers in a window; bytes before an anchor that its windows can reach.
SPAN, LEFT = LENGTH - ANCHOR + 1, LENGTH - ANCHOR
#: Anchors, or strings, that a task holds before it sends a run; bytes of a text in one piece; sampled strings a range.
CHUNK, RUN, PIECE, SAMPLED = 1 << 19, 1 << 17, 1 << 22, 48
#: Rows of a run that are unpacked at once when runs are merged; bytes of text for each part of the table.
FRAME, PART_BYTES = 1 << 12, 32 << 20
#: Different suffixes at one anchor that are held against each other in pairs.
GROUP = 48
#: Ids of documents with repeats that are broadcast, at most, so that the other texts need not be shuffled once more.
BROADCAST_IDS = 1_000_000
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []

Run = Iterator[tuple[int, bytes, tuple[int, int, int]]]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def _anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes, and the first and last window of each anchor of a piece of at least LENGTH bytes."""
    power, inverse = _tables(len(raw))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[raw] * power[: len(raw)])))
    n = len(raw) - ANCHOR + 1
    h = (sums[ANCHOR:] - sums[:n]) * inverse[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)  # of equal hashes the leftmost
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    last = len(raw) - LENGTH + 1
    least = np.minimum(least[:last], least[SPAN - width : SPAN - width + last])
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    return place[first], h[place[first]], first, np.concatenate((first[1:] - 1, [last - 1]))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As _anchors, for texts of any length: long ones in pieces that overlap by less than a window. An anchor that windows
    of neighbouring pieces share is one."""
    raw = np.frombuffer(text, np.uint8)
    made = []
    for a in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
        piece = raw[a : a + PIECE + LENGTH - 1]
        if len(piece) >= LENGTH:
            p, h, first, last = _anchors(piece)
            p, first, last = p + a, first + a, last + a
            if made and made[-1][0][-1] == p[0]:
                made[-1][3][-1] = last[0]
                p, h, first, last = p[1:], h[1:], first[1:], last[1:]
            if len(p):
                made.append((p, h, first, last))
    return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


# --- 1: which anchors occur more than once ---------------------------------------------------------------------------

SENT = "part int, ids binary, numbers binary"


def deltas(ids: np.ndarray) -> bytes:
    return np.diff(ids, prepend=np.int64(0)).astype(np.int64).tobytes()


def planes(values: np.ndarray, size: int) -> bytes:
    """The low bytes of 64-bit numbers, all first bytes first, which packs better."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8")[:, 0]


def _sent(parts: int) -> Callable:
    """Anchors as packed arrays a part, one of each hash: the others are repeats already, and go along as such. 48 bits of
    the hash do: what happens to agree in them is told apart later."""

    def packed(ids: list[int], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, owner, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, owner, place = h[order], owner[order], place[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        count = np.diff(np.concatenate((np.flatnonzero(new), [len(h)])))
        many = np.repeat(count > 1, count)
        part = np.where(new, (h >> np.uint64(48)) % np.uint64(parts), np.uint64(TaskContext.get().partitionId() % parts)).astype(np.int64)
        h = np.where(new, (h & np.uint64(0xFFFFFFFFFFFF)) | np.uint64(1), np.uint64(0))  # 0: nothing to compare
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        known = np.array(ids, np.int64)
        rows = []
        for k in range(parts):
            at = order[bounds[k] : bounds[k + 1]]
            if len(at):
                used, owners = np.unique(owner[at], return_inverse=True)
                numbers = len(at).to_bytes(4, "big") + planes(h[at], 6) + planes(owners, 3) + planes(place[at], 4) + np.packbits(many[at]).tobytes()
                rows.append((k, zstandard.compress(deltas(known[used]), 1), zstandard.compress(numbers, 1)))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["part", "ids", "numbers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                place, h, _, _ = anchors(text or b"")
                if not len(place):
                    continue
                held.append((h, np.full(len(h), len(ids), np.int64), place))
                ids.append(doc)
                size += len(h)
                if size >= CHUNK:
                    yield from packed(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield from packed(ids, held)

    return run


def _repeated(parts: int) -> Callable:
    """Places of anchors that occur more than once, from the rows of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for ids, numbers in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = zstandard.decompress(numbers)
                n = int.from_bytes(data[:4], "big")
                cuts = np.cumsum([4, 6 * n, 3 * n, 4 * n])
                h, owner, place = (from_planes(data[a:b], k) for a, b, k in zip(cuts[:-1], cuts[1:], (6, 3, 4), strict=True))
                many = np.unpackbits(np.frombuffer(data[cuts[3] :], np.uint8), count=n).astype(bool)
                known = np.cumsum(np.frombuffer(zstandard.decompress(ids), np.int64))
                held.append((h, known[owner.astype(np.int64)], place, many))
        if not held:
            return
        h, ids, place, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        at = np.flatnonzero(many | (twice & (h != 0)))
        yield from delivery(ids[at], place[at], parts=parts)

    return run


DELIVERED = "part int, kind int, id long, text string, packed binary"


def share(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part of the table that an id belongs to; as in delivered()."""
    u = ids.astype(np.int64)
    return (u ^ (u >> 7) ^ (u >> 17)) % parts


def delivery(ids: np.ndarray, *columns: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows for delivered(): ids and numbers about them, packed by part."""
    part = share(ids, parts)
    order = np.lexsort((ids, part))
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    rows = []
    for k in range(parts):
        at = order[bounds[k] : bounds[k + 1]]
        if len(at):
            rows.append((k, zstandard.compress(len(at).to_bytes(4, "big") + deltas(ids[at]) + b"".join(planes(c[at], 4) for c in columns), 1)))
    part_column, packed = zip(*rows, strict=True) if rows else ((), ())
    none = [None] * len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(part_column, pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.string()), pa.array(packed, pa.binary())], names=["part", "kind", "id", "text", "packed"])


def delivered(source: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """Texts with what was delivered for them, part by part, the packed rows first."""
    mixed = F.col("id").bitwiseXOR(F.shiftright("id", 7)).bitwiseXOR(F.shiftright("id", 17))
    texts = source.select(F.coalesce(F.pmod(mixed, F.lit(parts)), F.lit(0)).cast("int").alias("part"), F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("packed"))
    return packed.union(texts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def received(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[tuple[int | None, bytes, np.ndarray]]]:
    """For each batch of delivered texts: (id, text, the numbers about it, one row each)."""
    part, held, index = None, [], None
    for batch in batches:
        out = []
        for p, kind, doc, text, packed in zip(*(batch.column(i).to_pylist() if i != 3 else as_bytes(batch.column(3)) for i in range(5)), strict=True):
            if p != part:
                part, held, index = p, [], None
            if not kind:
                held.append(zstandard.decompress(packed))
                continue
            if index is None:
                ids, numbers = [np.zeros(0, np.int64)], [np.zeros((0, columns), np.int64)]
                for data in held:
                    n = int.from_bytes(data[:4], "big")
                    ids.append(np.cumsum(np.frombuffer(data[4 : 4 + 8 * n], np.int64)))
                    rest = data[4 + 8 * n :]
                    numbers.append(np.stack([from_planes(rest[4 * n * c : 4 * n * (c + 1)], 4) for c in range(columns)], 1).astype(np.int64))
                held = []
                all_ids, table = np.concatenate(ids), np.concatenate(numbers)
                order = np.argsort(all_ids, kind="stable")
                index = all_ids[order], table[order]
            a, b = np.searchsorted(index[0], [doc, doc + 1]) if doc is not None else (0, 0)
            out.append((doc, text or b"", index[1][a:b]))
        yield out


# --- 2 and 3: runs, front-coded; loser trees -------------------------------------------------------------------------


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b, which share start bytes."""
    n = min(len(a), len(b))
    while start < n:
        x, y = a[start : start + 32], b[start : start + 32]
        if x != y:
            m = min(len(x), len(y))
            differ = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return start + m - (differ.bit_length() + 7) // 8
        start += len(x)
    return n


def encoded(rows: list[tuple[bytes, int, int, int]]) -> bytes:
    """A sorted run, in frames of FRAME rows: shared lengths, rest lengths, ids, two numbers a row, and the rests of the strings."""
    frames, last = [], b""
    for start in range(0, len(rows), FRAME):
        part = rows[start : start + FRAME]
        shared, rests = [], []
        for s, *_ in part:
            k = common(last, s, 0)
            shared.append(k)
            rests.append(s[k:])
            last = s
        numbers = [np.array(shared, np.uint8), np.array([len(r) for r in rests], np.uint8), np.array([r[1] for r in part], np.int64), np.array([r[2] for r in part], np.uint32), np.array([r[3] for r in part], np.uint32)]
        frame = zstandard.compress(len(part).to_bytes(4, "big") + b"".join(x.tobytes() for x in numbers) + b"".join(rests), 6)
        frames += [len(frame).to_bytes(4, "big"), frame]
    return b"".join(frames)


def decoded(data: bytes) -> Run:
    """(bytes shared with the row before, string, (id, a, b)) of a run, one at a time; one frame at a time is unpacked."""
    last, start = b"", 0
    while start < len(data):
        size = int.from_bytes(data[start : start + 4], "big")
        frame = zstandard.decompress(data[start + 4 : start + 4 + size])
        start += 4 + size
        n, at, columns = int.from_bytes(frame[:4], "big"), 4, []
        for kind in (np.uint8, np.uint8, np.int64, np.uint32, np.uint32):
            width = n * np.dtype(kind).itemsize
            columns.append(np.frombuffer(frame[at : at + width], kind).tolist())
            at += width
        for k, rest, *payload in zip(*columns, strict=True):
            last = last[:k] + frame[at : at + rest]
            at += rest
            yield k, last, tuple(payload)


def merged(runs: list[Run]) -> Run:
    """The rows of all runs in order of (string, payload), each with what it shares with the one before, by a loser tree.
    Each player carries what it shares with the last winner; a match starts at that byte."""
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[list | None] = [None] * width  # shared, string, payload
    for i, r in enumerate(runs):
        head = next(r, None)
        heads[i] = [0, head[1], head[2]] if head else None

    def beats(i: int, j: int) -> bool:
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return y is None
        if x[0] != y[0]:
            return x[0] > y[0]  # the loser shares with the winner what it shares with the last one: no change
        s, t = x[1], y[1]
        k = common(s, t, x[0])
        first = s[k : k + 1] < t[k : k + 1] or (len(s) == k == len(t) and x[2] <= y[2])
        (y if first else x)[0] = k
        return first

    losers, winners = [0] * width, list(range(width))
    while len(winners) > 1:
        level = []
        for m in range(0, len(winners), 2):
            i, j = winners[m], winners[m + 1]
            w, lost = (i, j) if beats(i, j) else (j, i)
            losers[len(winners) // 2 + m // 2] = lost
            level.append(w)
        winners = level
    top = winners[0]
    while heads[top] is not None:
        yield tuple(heads[top])
        head = next(runs[top], None)
        heads[top] = [head[0], head[1], head[2]] if head else None
        node = (top + width) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


class Sender:
    """Sorts strings by (string, id, a, b) in runs of bounded size. Of equal strings in a run only the first is sent; the
    rest are repeats, which go along as such."""

    def __init__(self, splitters: list[bytes], repeat: Callable[[int, int, int], tuple[int, int, int]]):
        self.splitters, self.repeat, self.rows, self.known = splitters, repeat, [], []

    def add(self, string: bytes, doc: int, a: int, b: int) -> Iterator[tuple]:
        self.rows.append((string, doc, a, b))
        if len(self.rows) >= RUN:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        self.rows.sort()
        kept: list[tuple[bytes, int, int, int]] = []
        for row in self.rows:
            if kept and row[0] == kept[-1][0]:
                if row[1:] != kept[-1][1:]:
                    self.known.append(self.repeat(*row[1:]))
            else:
                kept.append(row)
        self.rows = []
        a = 0
        while a < len(kept):
            part = bisect_right(self.splitters, kept[a][0])
            b = len(kept) if part == len(self.splitters) else bisect_right(kept, (self.splitters[part],), a + 1 if a + 1 < len(kept) else a)
            b = max(b, a + 1)
            yield part, 1, encoded(kept[a:b])
            a = b
        if self.known:
            found = np.array(self.known, np.int64)
            self.known = []
            yield TaskContext.get().partitionId() % (len(self.splitters) + 1), 0, zstandard.compress(found.tobytes(), 3)


BLOCKS = "part int, kind int, block binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["part", "kind", "block"])


def _suffixes(splitters: list[bytes]) -> Callable:
    """Runs of suffixes at the repeated anchors of delivered texts. Payload: first window, and the lengths
    before and after the anchor packed into one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(splitters, lambda doc, p0, packed: (doc, p0, p0 + (packed & 0xFF)))
        for found in received(batches, 1):
            out = []
            for doc, text, places in found:
                if not len(places) or len(text) < LENGTH:
                    continue
                place, _, first, last = anchors(text)
                want = np.isin(place, places[:, 0])
                for a, p0, p1 in zip(place[want].tolist(), first[want].tolist(), last[want].tolist(), strict=True):
                    right, left = text[a : a + LENGTH], text[max(0, a - LEFT) : a]
                    out += send.add(right + left[::-1] + bytes((len(right),)), doc, p0, (p1 - p0) | (a - p0) << 8)
            if out:
                yield _batch(out)
        yield _batch(list(send.flush()))

    return run


def _windows(splitters: list[bytes]) -> Callable:
    """Merges the suffix runs of a range. Repeats go on as such, and so do windows that suffixes with the same anchor share.
    Windows of large groups, and of those that may go on in the next range, are sent on as runs of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = Sender(splitters, lambda doc, p0, p1: (doc, p0, p0))
        runs, out = [], []
        for batch in batches:
            for part, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    runs.append(decoded(block))
                else:
                    out.append((part, 0, block))

        def windows(string: bytes, payload: tuple[int, int, int]) -> None:
            doc, p0, packed = payload
            before, n, right = packed >> 8, packed & 0xFF, string[-1]
            around = string[right : right + before][::-1] + string[:right]
            for k in range(n + 1):
                out.extend(send.add(around[k : k + LENGTH], doc, p0 + k, 0))

        group: list[tuple[int, bytes, tuple[int, int, int]]] = []  # different suffixes at one anchor
        sent, first, last = 0, True, (b"", ())

        def close(edge: bool) -> None:
            if edge or sent:
                for _, string, payload in group[sent:]:
                    windows(string, payload)
            elif len(group) > 1:
                send.known.extend(shared_windows(group))

        for shared, string, payload in merged(runs):
            if string == last[0]:
                if payload != last[1]:
                    send.known.append((payload[0], payload[1], payload[1] + (payload[2] & 0xFF)))
                continue
            last = (string, payload)
            if group and shared < ANCHOR:
                close(first)
                group, sent, first = [], 0, False
            group.append((shared, string, payload))
            if len(group) > GROUP:
                for _, s, p in group[sent:]:
                    windows(s, p)
                group, sent = group[:1], 1
            if len(out) >= 16:
                yield _batch(out)
                out.clear()
        close(True)
        out.extend(send.flush())
        yield _batch(out)

    return run


def shared_windows(group: list[tuple[int, bytes, tuple[int, int, int]]]) -> Iterator[tuple[int, int, int]]:
    """(id, first, last start) of windows of a suffix that another one, which starts earlier, has as well. What suffixes
    share after the anchor follows from what each shares with the one before; only what lies before it is compared."""
    for j in range(1, len(group)):
        _, t, q = group[j]
        least = 255
        for i in range(j - 1, -1, -1):
            least = min(least, group[i + 1][0])
            _, s, p = group[i]
            right = min(least, s[-1], t[-1])
            left = common(s[s[-1] : -1], t[t[-1] : -1], 0)
            if left + right < LENGTH:
                continue
            doc, p0, packed = max(p, q)
            before, n = packed >> 8, packed & 0xFF
            a, b = max(0, before - left), min(n, before + right - LENGTH)
            if a <= b:
                yield doc, p0 + a, p0 + b


def _starts(parts: int) -> Callable:
    """First and last starts of repeated windows, from the window runs of a range and what is known already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, known, ids, starts = [], [np.zeros((0, 3), np.int64)], [], []
        for batch in batches:
            for _, kind, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    runs.append(decoded(block))
                else:
                    known.append(np.frombuffer(zstandard.decompress(block), np.int64).reshape(-1, 3))
        last: tuple[bytes, tuple] = (b"", ())
        for _, string, payload in merged(runs) if runs else ():
            if string != last[0]:
                last = (string, payload)
            elif payload != last[1]:
                ids.append(payload[0])
                starts.append(payload[1])
        table = np.concatenate([*known, np.array([ids, starts, starts], np.int64).T.reshape(-1, 3)])
        yield from delivery(table[:, 0], table[:, 1], table[:, 2], parts=parts)

    return run


# --- the operator ----------------------------------------------------------------------------------------------------

FIELDS = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept_sha256", T.StringType()),
])


def cut(text: bytes, pairs: np.ndarray) -> tuple:
    """What the text loses, as byte spans, and what is left."""
    spans: list[list[int]] = []
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        end = min(len(text), b + LENGTH)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        elif a < end:
            spans.append([a, end])
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], kept.hexdigest()


def repeated_starts(source: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """First and last starts of windows that also start earlier, ready to be delivered to the texts of (id, text), and the
    number of parts."""
    spark = source.sparkSession
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    chosen = source.where("id IS NOT NULL").select(F.xxhash64("id").alias("h"), F.expr(f"substring(text, cast(1 + pmod(xxhash64(id, 1), greatest(length(text) - {ANCHOR}, 1)) as int), {ANCHOR})").alias("s"))
    sample = sorted(r["s"].encode() for r in smallest(chosen.where("s <> ''"), F.col("h"), SAMPLED * parts).collect())
    splitters = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    ranges = len(splitters) + 1
    known = source.where("id IS NOT NULL")
    anchored = known.mapInArrow(_sent(parts), SENT).repartitionById(parts, F.col("part")).mapInArrow(_repeated(parts), DELIVERED)
    suffixes = delivered(known, anchored, parts).mapInArrow(_suffixes(splitters), BLOCKS)
    windows = suffixes.repartitionById(ranges, F.col("part")).mapInArrow(_windows(splitters), BLOCKS)
    return scratch.write(windows.repartitionById(ranges, F.col("part")).mapInArrow(_starts(parts), DELIVERED), "starts"), parts


def numbered(source: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) in which an id stands for one text, and (id, own) if that took new ids: the numbers of the distinct (id, digest)
    in order. Ids that have several texts are rare; without them nothing but ids and hashes is shuffled, and nothing changes."""
    body = F.coalesce("text", F.lit(""))
    known = source.where("id IS NOT NULL").select("id", F.sha2(body.cast("binary"), 256).alias("sha"))
    hashes = source.where("id IS NOT NULL").select("id", F.xxhash64(body).alias("h"), F.xxhash64(F.lit(1), body).alias("g"))
    several = hashes.groupBy("id").agg(*(f(c).alias(f"{n}_{c}") for c in "hg" for n, f in (("low", F.min), ("high", F.max)))).where("low_h <> high_h OR low_g <> high_g")
    if several.isEmpty():
        return source, None
    pairs = scratch.write(known.distinct().repartitionByRange("id", "sha").sortWithinPartitions("id", "sha").select(F.spark_partition_id().alias("part"), "id", "sha"), "pairs")
    sizes = pairs.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    place = F.row_number().over(Window.partitionBy("part").orderBy("id", "sha"))
    numbers = scratch.write(pairs.join(F.broadcast(before), "part").select("id", "sha", (F.col("before") + place).alias("number")), "numbers")
    with_sha = source.withColumn("sha", F.sha2(body.cast("binary"), 256))
    return with_sha.join(numbers, ["id", "sha"], "left").select(F.col("number").alias("id"), "text"), numbers.select(F.col("number").alias("id"), F.col("id").alias("own"))


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a struct "repeats": n_bytes, n_removed, spans (removed bytes), kept_sha256."""
    scratch = Scratch(documents.sparkSession, "suffix-dedup")
    bounded(documents.sparkSession)
    plain = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    source, own = numbered(plain, scratch)
    found = found_repeats(source, scratch)
    if own is not None:
        found = found.join(own, "id", "left").select(F.col("own").alias("id"), "repeats")
    return found.select(F.col("id").alias(doc_id), "repeats")


def found_repeats(source: DataFrame, scratch: Scratch) -> DataFrame:
    """id and the struct, of (id, text) in which an id stands for one text."""
    starts, parts = repeated_starts(source, scratch)
    struct = to_arrow_type(FIELDS)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)]
        for batch in batches:
            for packed in batch.column(1).to_pylist():
                data = zstandard.decompress(packed)
                n = int.from_bytes(data[:4], "big")
                held.append(np.unique(np.cumsum(np.frombuffer(data[4 : 4 + 8 * n], np.int64))))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in received(batches, 2):
            if not found:
                continue
            rows = [cut(t, pairs) for _, t, pairs in found]
            made = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], type=struct.field(i).type) for i in range(struct.num_fields)], fields=list(struct))
            yield pa.RecordBatch.from_arrays([pa.array([doc for doc, *_ in found], pa.int64()), made], names=["id", "repeats"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("repeats", FIELDS)])
    hit = scratch.write(starts.select("part", "packed").repartitionById(parts, F.col("part")).mapInArrow(ids, "id long"), "hit")
    if hit.count() > BROADCAST_IDS:
        return delivered(source, starts, parts).mapInArrow(run, schema)
    others = source.join(F.broadcast(hit), "id", "left_anti").select(F.lit(0).alias("part"), F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("packed"))
    return delivered(source.join(F.broadcast(hit), "id", "left_semi"), starts, parts).mapInArrow(run, schema).union(others.mapInArrow(run, schema))


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    r = F.col("repeats")
    return repeats(read(spark, sf_dir, "documents")).select("doc_id", r.n_bytes.alias("n_bytes"), r.n_removed.alias("n_removed"), F.size(r.spans).cast("long").alias("n_spans"), r.kept_sha256.alias("kept_sha256"))
