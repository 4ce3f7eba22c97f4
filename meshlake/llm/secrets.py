"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

Candidates are all runs of 8 or more characters of keys that have a digit, a sign or a capital within, or are 16 or longer,
and what a pattern has matched but dropped for its length. The network scores them all, the patterns' findings too, which stay whatever
it says; others become findings of the kind "network" from its threshold on. It sees windows of the candidate, which overlap
by half and cover it all, and the characters around each; the highest score counts. It learns from labelled findings: positive is what the
patterns have found, and keys of other shapes in plain words, made from each; negatives are the candidates that no pattern found, other
runs, and names, paths and numbers made from the same texts. It is begun on a bounded number of rows (ROWS), in several rounds, and then learns from
all rows in one pass (all findings and candidates, and a made name of each text). Its scores are calibrated on findings of all rows that
it hasn't seen (if there are such), and the threshold is the highest that still recalls the wanted share of them.

Null and empty texts have no findings. Without findings of both labels to learn from, only the patterns speak. Every row is
scanned by itself, repeated ones too; an empty table gives no rows. Only the text (and the id, to choose rows by its hash) is
read; rows without an id are scanned, but nothing is learned from them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, as_bytes, bounded, read, smallest
from meshlake.session import Scratch

#: Rows and windows of each label that the network is begun on, at most: those with the smallest hashes. It then learns from all rows.
ROWS, LABELLED = 16_000, 4000
#: Windows of a step over all rows, and its length; raw scores are counted from -EDGE to EDGE, BINS to one.
BATCH, STEP_ALL, EDGE, BINS = 256, 0.001, 32, 64
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
KERNEL, FILTERS, EMBEDDED = 5, 24, 8
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = [k for k, *_ in PATTERNS]
_WORDS = re.compile(rb"passw|secret|token|api_?key", re.I)
_HEX = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: A candidate's least length; the length from which a run of letters alone is one, too; the sum of what a byte adds to: digits,
#: signs, capitals, small letters, 16 bits each.
LEAST, LONG = 8, 16
_SIGNS = "+/_=-"
_INSIDE = np.array([b < 128 and (chr(b).isalnum() or chr(b) in _SIGNS + ".") for b in range(256)])
_ADDS = np.array([0 if b > 127 else 1 if chr(b).isdigit() else 1 << 16 if chr(b) in _SIGNS else 1 << 32 if chr(b).isupper() else 1 << 48 if chr(b).islower() else 0 for b in range(256)], np.uint64)
#: Words that negatives are made of, and how many words make one; one of how many plain runs is a negative.
_LETTERS, STEP, PLAIN = re.compile(r"[A-Za-z]{2,}"), 6, 16
#: Classes of characters: blank, other, quote, assignment, other punctuation, and each letter and digit.
_CLASS = np.ones(256, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
    _CLASS[ord(_c)] = 6 + _i
for _c, _k in ((" \t\r\n\x00", 0), ("\"'`", 2), ("=:", 3), ("+/_-.", 4), (",;()[]{}<>|#*$%&!?@\\^~", 5)):
    for _x in _c:
        _CLASS[ord(_x)] = _k
CLASSES = 68

FIELDS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])))])

Span = tuple[int, int, str, int, int]
Place = tuple[int, int]


def base(text: str, raw: bytes) -> tuple[list[Span], list[Place]]:
    """The patterns' findings (start, end, kind, and the value's start and end) by (start, kind as listed), and the values of
    matches that are too short. What can't match is known from the bytes beforehand."""
    found, dropped = [], []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "hex" and b"h" * least not in raw.translate(_HEX) or kind == "access" and b"AKIA" not in raw or kind == "assign" and not _WORDS.search(raw):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if b - a >= least:
                found.append((m.start(), order, m.end(), a, b))
            elif kind != "hex":
                dropped.append((a, b))
    return [(s, e, KINDS[o], a, b) for s, o, e, a, b in sorted(found)], dropped


def runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of all runs of a key's characters that are long enough, and which of them are candidates."""
    inside = _INSIDE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    enough = end - start >= LEAST
    start, end = start[enough], end[enough]
    end = end - (raw[end - 1] == 46)  # the full stop of a sentence
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_ADDS[raw])))
    inner = sums[end] - sums[start + 1]
    first = raw[start]
    digits = ((inner & np.uint64(0xFFFF)) > 0) | ((first >= 48) & (first <= 57))
    signs, capitals, small = ((inner >> np.uint64(k)) & np.uint64(0xFFFF) for k in (16, 32, 48))
    size = end - start
    return start, end, (size >= LEAST) & (digits | (signs > 0) | ((capitals > 0) & (small > 0)) | (size >= LONG))


def points(raw: np.ndarray, text: str) -> np.ndarray | None:
    """The code point that each byte offset is at; None where the two are the same."""
    return None if len(text) == len(raw) else np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))


def outside(places: list[Place], spans: list[Span]) -> list[Place]:
    """The places that no span meets, each once."""
    if not spans:
        return sorted(set(places))
    starts, ends = [s for s, *_ in spans], np.maximum.accumulate([e for _, e, *_ in spans]).tolist()
    return sorted({(a, b) for a, b in places if not (k := bisect_left(starts, b)) or ends[k - 1] <= a})


def candidates(text: str, raw: bytes, spans: list[Span], dropped: list[Place]) -> list[Place]:
    array = np.frombuffer(raw, np.uint8)
    start, end, key = runs(array)
    if not key.any():
        return outside(dropped, spans) if dropped else []
    at = points(array, text)
    start, end = start[key], end[key]
    if at is not None:
        start, end = at[start], at[end]
    return outside([*zip(start.tolist(), end.tolist(), strict=True), *dropped], spans)


def window(text: str, start: int, end: int) -> bytes:
    """What the network sees: the characters before, the run of INSIDE ones at most, those after, each padded."""
    byte = lambda s: s.encode("ascii", "replace")
    return byte(text[max(0, start - BEFORE) : start]).rjust(BEFORE, b"\0") + byte(text[start:end]).ljust(INSIDE, b"\0") + byte(text[end : end + AFTER]).ljust(AFTER, b"\0")


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of INSIDE characters at most that cover a run, each half over the one before."""
    last = max(start, end - INSIDE)
    return [(a, min(end, a + INSIDE)) for a in [*range(start, last, INSIDE // 2), last]]


_DIGITS, _SMALL, _LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def disguised(value: str, form: int) -> str:
    """A key that depends on value and form alone, and looks unlike the patterns' findings: without their alphabet and names."""
    stream = hashlib.blake2b(value.encode(), digest_size=64, salt=bytes([form])).digest()
    alphabet = (_SMALL + _LARGE + _DIGITS, _LARGE + _DIGITS, _SMALL + _LARGE + _DIGITS + "+/", _SMALL + _DIGITS)[form % 4]
    size = 16 + stream[60] % 29
    key = "".join(alphabet[b % len(alphabet)] for b in stream[:size])
    if stream[61] % 3 == 0:  # a short name before it
        key = "".join(_SMALL[b % 26] for b in stream[50 : 52 + stream[62] % 3]) + "_-"[stream[63] % 2] + key
    elif stream[61] % 3 == 1 and form % 4 == 0:  # in groups
        key = "-".join(key[k : k + 8] for k in range(0, len(key), 8))
    return key


def odd_name(word: str, n: int) -> str:
    """A short name of n small letters that isn't a word."""
    return "".join(_SMALL[b % 26] for b in hashlib.blake2b(word.encode(), digest_size=n).digest())


def names(words: list[str], turn: int) -> str:
    """A long name, path, address or number, which is no secret, from six words."""
    a, b = odd_name(words[0], 4 + turn % 4), odd_name(words[1], 5 + turn % 3)
    return (
        "_".join(words[:4]) + "_2024", "/".join(words[:4]) + "/1", "-".join(words[:3]) + "-v10", "".join(words[:4]) + "12", "".join(w.capitalize() for w in words[:4]),
        f"{words[0]}.{words[1]}@{words[2]}.com", f"2024-{turn % 12 + 1:02d}-{turn % 28 + 1:02d}T{turn % 24:02d}:{turn % 60:02d}", f"{zlib.crc32(words[0].encode()):010d}{zlib.crc32(words[1].encode()):010d}"[: 8 + turn % 9],
        f"v{turn % 30}.{turn % 7}.{turn % 11}-{words[0]}", f"{words[0]}{turn % 100}/{words[1]}.{words[2][:3]}",
        f"//www.{a}.com/{b}/{words[2]}", f"{a}.{turn % 100}", f"//{a}.{words[1]}.org/{b}?{words[3]}={turn % 90}", f"{b}/{a}/{words[2]}.{a[:3]}",
    )[turn % 14]


class Network:
    """Embedding, one convolution, the greatest value of each filter over the text, one logistic output; in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.3, (CLASSES, EMBEDDED)), "k": r.normal(0, (KERNEL * EMBEDDED) ** -0.5, (KERNEL * EMBEDDED + 1, FILTERS)), "o": r.normal(0, FILTERS**-0.5, 2 * FILTERS + 1)}
        self.a, self.b, self.threshold = 1.0, 0.0, 2.0

    def _forward(self, x: np.ndarray):
        c = _CLASS[x]
        e = self.p["e"][c]
        n = WIDTH - KERNEL + 1
        cols = np.concatenate([e[:, i : i + n] for i in range(KERNEL)], 2)
        z = np.maximum(0, cols @ self.p["k"][:-1] + self.p["k"][-1])
        cut = BEFORE - KERNEL // 2  # the context and the run are pooled apart
        parts = (z[:, :cut], z[:, cut:])
        top = [p.argmax(1) for p in parts]
        pooled = np.concatenate([np.take_along_axis(p, t[:, None], 1)[:, 0] for p, t in zip(parts, top, strict=True)], 1)
        return c, cols, top, pooled, pooled @ self.p["o"][:-1] + self.p["o"][-1]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.raw(x) + self.b, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, step: float = 0.005, seed: int = 6) -> None:
        r, learner = np.random.default_rng(seed), Learner(self, step)
        for _ in range(rounds):
            order = r.permutation(len(x))
            for s in range(0, len(order), 64):
                at = order[s : s + 64]
                learner.learn(x[at], y[at], np.full(len(at), 1 / len(at)))

    def calibrate(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """Platt's scaling by Newton's method over raw scores that come n times each, then the threshold."""
        w = np.array([1.0, 0.0])
        f = np.stack([z, np.ones_like(z)], 1)
        positive, negative = n[y > 0.5].sum(), n[y < 0.5].sum()
        aim = np.where(y > 0.5, (positive + 1) / (positive + 2), 1 / (negative + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            h = (f * (n * p * (1 - p))[:, None]).T @ f + 1e-4 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, f.T @ (n * (p - aim)) + 1e-4 * (w - [1, 0])), -2, 2)
        self.a, self.b = float(w[0]), float(w[1])
        scores = 1 / (1 + np.exp(-np.clip(self.a * z[y > 0.5] + self.b, -30, 30)))
        order = np.argsort(scores)
        below = np.cumsum(n[y > 0.5][order])
        self.threshold = float(scores[order][np.searchsorted(below, int((1 - recall) * positive), "right")]) if positive else 2.0


class Learner:
    """Adam's steps on a network."""

    def __init__(self, network: Network, step: float):
        self.network, self.step, self.t = network, step, 0
        self.m, self.v = ({k: np.zeros_like(p) for k, p in network.p.items()} for _ in range(2))

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        p, cut = self.network.p, BEFORE - KERNEL // 2
        c, cols, top, pooled, z = self.network._forward(x)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = {"o": np.append(pooled.T @ d, d.sum()), "e": np.zeros_like(p["e"])}
        dp = np.outer(d, p["o"][:-1]) * (pooled > 0)
        dk = np.zeros_like(p["k"])
        rows, filters = np.repeat(np.arange(len(x)), FILTERS), np.tile(np.arange(FILTERS), len(x))
        for half, t0 in enumerate(top):
            place = t0.reshape(-1) + (cut if half else 0)
            dz = dp[:, half * FILTERS : (half + 1) * FILTERS].reshape(-1)
            np.add.at(dk[:-1].T, filters, cols[rows, place] * dz[:, None])
            np.add.at(dk[-1], filters, dz)
            de = (p["k"][:-1].T[filters] * dz[:, None]).reshape(-1, KERNEL, EMBEDDED)
            for i in range(KERNEL):
                np.add.at(g["e"], c[rows, place + i], de[:, i])
        g["k"] = dk
        self.t += 1
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - self.step * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _key(text: str, a: int, b: int) -> int:
    return zlib.crc32(text[max(0, a - BEFORE) : b + AFTER].encode("ascii", "replace"))


def _among(words: list[str], made: str) -> tuple[str, int, int]:
    before = " ".join(words[:3]) + " "
    return f"{before}{made} {' '.join(words[-2:])}", len(before), len(before) + len(made)


def _found(raw: bytes, dense: bool) -> Iterator[tuple[int, str, int, int]]:
    """(label, text, start, end) of a text: the patterns' findings and the keys made from them, the candidates that no pattern found, and a name made of six of its
    words; dense: names made of all its words, and other runs."""
    text = raw.decode()
    spans, dropped = base(text, raw)
    words = _LETTERS.findall(text)
    for s, _, _, a, b in spans:
        yield 1, text, a, b
        near = _LETTERS.findall(text, max(0, s - 80), s)[-3:] or ["it"]
        for form in range(4):
            yield 1, *_among(near, disguised(text[a:b], form))
    for a, b in candidates(text, raw, spans, dropped):
        yield 0, text, a, b
    if not dense:
        if len(words) > STEP:
            h = zlib.crc32(raw)
            i = h % (len(words) - STEP)
            yield 0, *_among(words[i : i + STEP], names(words[i : i + STEP], h // 65536))
        return
    array = np.frombuffer(raw, np.uint8)
    start, end, key = runs(array)
    some = ~key & ((start * 2654435761 + len(raw)) % 65537 % PLAIN == 0)
    at = points(array, text)
    for a, b in outside(list(zip(*((x[some] if at is None else at[x[some]]).tolist() for x in (start, end)), strict=True)), spans):
        yield 0, text, a, b
    for i in range(0, len(words) - STEP, STEP):
        yield 0, *_among(words[i : i + STEP], names(words[i : i + STEP], (i // STEP + len(raw))))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, window, hash) of the patterns' findings and of other runs in all texts: of each label those with the smallest
    hashes. What is above the hashes held is left out before its window is made."""
    held: list[dict[tuple[int, bytes], None]] = [{}, {}]
    bound = [1 << 32, 1 << 32]

    def add(label: int, text: str, start: int, end: int) -> None:
        for a, b in parts(start, end):
            h = _key(text, a, b)
            if h < bound[label]:
                held[label][h, window(text, a, b)] = None
                if len(held[label]) > 4 * LABELLED:
                    held[label] = dict.fromkeys(sorted(held[label])[:LABELLED])
                    bound[label] = next(reversed(held[label]))[0] + 1

    for batch in batches:
        for raw in as_bytes(batch.column(0)):
            for found in _found(raw or b"", True):
                add(*found)
    best = [(label, w, h) for label in (0, 1) for h, w in sorted(held[label])[:LABELLED]]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in best], pa.int32()), pa.array([r[1] for r in best], pa.binary()), pa.array([r[2] for r in best], pa.int64())], names=["label", "window", "h"])


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All labelled windows of all texts, about so many at once: windows, labels, and which are set aside for the threshold."""
    held: list[tuple[bytes, int, bool]] = []

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out = np.frombuffer(b"".join(w for w, _, _ in held), np.uint8).reshape(-1, WIDTH), np.array([y for _, y, _ in held], float), np.array([u for _, _, u in held])
        held.clear()
        return out

    for batch in batches:
        for raw in as_bytes(batch.column(0)):
            for label, text, start, end in _found(raw or b"", False):
                for a, b in parts(start, end):
                    held.append((window(text, a, b), label, _key(text, a, b) % 4 == 0))
                    if len(held) >= size:
                        yield made()
    if held:
        yield made()


def _learned(texts: DataFrame, network: Network, aside: bool) -> list:
    """A row for each task: the network's numbers after one pass over the task's windows (without those set aside), which start from network; both labels weigh the same in a step. Also how many windows
    it has seen, by label, set aside and not."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network()
        own.p = {k: v.copy() for k, v in shared.value.p.items()}
        learner, seen = Learner(own, STEP_ALL), np.zeros((2, 2), np.int64)
        for x, y, unseen in _windows(batches, BATCH):
            np.add.at(seen, (unseen.astype(int), y.astype(int)), 1)
            if aside:
                x, y = x[~unseen], y[~unseen]
            if len(y):
                learner.learn(x, y, np.where(y > 0.5, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([v.reshape(-1) for v in own.p.values()]).tolist()], pa.list_(pa.float64())), pa.array([seen.reshape(-1).tolist()], pa.list_(pa.int64()))], names=["p", "seen"])

    return texts.select("text").mapInArrow(run, "p array<double>, seen array<long>").collect()


def _averaged(network: Network, rows: list) -> np.ndarray:
    """The tasks' networks, weighed by their windows, become network; the windows' numbers (set aside, label)."""
    seen = np.array([r["seen"] for r in rows]).reshape(-1, 4)
    if seen.sum():
        flat, at = np.average(np.array([r["p"] for r in rows]), 0, seen.sum(1)), 0
        for k, v in network.p.items():
            network.p[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
    return seen.sum(0).reshape(2, 2)


def _counted(texts: DataFrame, network: Network, aside: bool) -> list:
    """(label, bin, n): how often the windows set aside (all, if not aside) have a raw score in each bin."""
    shared = texts.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 2 * EDGE * BINS), np.int64)
        for x, y, unseen in _windows(batches, 512):
            if aside:
                x, y = x[unseen], y[unseen]
            bins = np.floor((np.clip(shared.value.raw(x), -EDGE, EDGE - 1 / BINS) + EDGE) * BINS).astype(int)
            np.add.at(n, (y.astype(int), bins), 1)
        label, bins = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(bins, pa.int32()), pa.array(n[label, bins], pa.int64())], names=["label", "bin", "n"])

    return texts.select("text").mapInArrow(run, "label int, bin int, n long").groupBy("label", "bin").agg(F.sum("n").alias("n")).orderBy("label", "bin").collect()


def begun(texts: DataFrame, rows: int = ROWS, most: int = LABELLED) -> Network:
    """A network to start from: trained on the labelled windows of at most so many rows, at most so many of each label."""
    network, scratch = Network(), Scratch(texts.sparkSession, "secrets")
    chosen = scratch.write(smallest(texts.select("id"), F.xxhash64("id"), rows), "chosen")
    found = scratch.write(texts.join(F.broadcast(chosen), "id", "left_semi").select("text").mapInArrow(_labelled, "label int, window binary, h long"), "labelled")
    seen = [r for label in (0, 1) for r in found.where(F.col("label") == label).distinct().orderBy("h", "window").limit(most).collect()]
    y = np.array([r["label"] for r in seen], float)
    if 0 < y.sum() < len(y):
        x = np.frombuffer(b"".join(bytes(r["window"]) for r in seen), np.uint8).reshape(-1, WIDTH)
        train = np.array([r["h"] % 4 != 0 for r in seen])
        if any(len(set(y[part])) < 2 for part in (train, ~train)):  # too few to set some aside
            train[:] = True
        network.train(x[train], y[train])
    return network


def fit(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS, most: int = LABELLED, recall: float = RECALL) -> Network:
    """The network begun on some rows learns from all rows in one pass, each task by itself, and the tasks' networks are averaged. Calibration and threshold come
    from the windows of all rows that were set aside (all windows, where too few have both labels)."""
    bounded(documents.sparkSession)
    texts = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id IS NOT NULL")
    network, aside = begun(texts, rows, most), True
    seen = _averaged(network, _learned(texts, network, aside))
    if not seen.sum(0).all():
        return network
    if not seen.all():
        aside = False
        _averaged(network, _learned(texts, network, aside))
    counts = _counted(texts, network, aside)
    z, y, n = np.array([r["bin"] for r in counts]) / BINS - EDGE, np.array([r["label"] for r in counts], float), np.array([r["n"] for r in counts], float)
    network.calibrate(z, y, n, recall)
    return network


def scores(text: str, places: list[Place], network: Network) -> np.ndarray:
    """The highest score of each place's windows; a bounded number of windows is held at once."""
    best, held, owner = np.zeros(len(places)), [], []

    def settle() -> None:
        if held:
            np.maximum.at(best, owner, network.score(np.frombuffer(b"".join(held), np.uint8).reshape(-1, WIDTH)))
        held.clear()
        owner.clear()

    for i, place in enumerate(places):
        for a, b in parts(*place):
            held.append(window(text, a, b))
            owner.append(i)
            if len(held) >= 2048:
                settle()
    settle()
    return best


def scan(raw: bytes | None, network: Network | None) -> list[tuple[int, int, str, float | None]]:
    """All spans of a text in code points, by start, then kind, with the network's score of each (null without a network)."""
    raw = raw or b""
    text = raw.decode()
    spans, dropped = base(text, raw)
    if network is None or network.threshold > 1:
        return [(s, e, k, None) for s, e, k, _, _ in spans]
    places = candidates(text, raw, spans, dropped)
    if not places and not spans:
        return []
    got = scores(text, [*((a, b) for *_, a, b in spans), *places], network).tolist()
    out = [(s, e, k, v) for (s, e, k, _, _), v in zip(spans, got, strict=False)]
    out += [(s, e, "network", v) for (s, e), v in zip(places, got[len(spans) :], strict=True) if v >= network.threshold]
    order = {k: i for i, k in enumerate([*KINDS, "network"])}
    return sorted(out, key=lambda x: (x[0], order[x[2]]))


def scanned(documents: DataFrame, network: Network | None, doc_id: str | None = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct of spans: kind, start, end (code points), score."""
    shared = documents.sparkSession.sparkContext.broadcast(network)

    def make():
        return lambda texts: [([{"kind": k, "start": s, "end": e, "score": v} for s, e, k, v in scan(t, shared.value)],) for t in texts]

    return annotate(documents, text, FIELDS, make, None if doc_id is None else [doc_id], "secrets")


def redacted(text: F.Column, spans: F.Column) -> F.Column:
    """text with "[SECRET]" for each stretch that spans cover."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(spans, start, lambda a, s: F.when(s.end <= a.at, a).when(s.start < a.at, F.struct(a.out.alias("out"), s.end.alias("at"))).otherwise(F.struct(F.concat(a.out, F.substring(text, (a.at + 1).cast("int"), (s.start - a.at).cast("int")), F.lit("[SECRET]")).alias("out"), s.end.alias("at"))))
    whole = F.transform(F.array(done), lambda d: F.concat(d.out, F.substring(text, (d.at + 1).cast("int"), F.length(text))))[0]
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    found, name = scanned(documents, fit(documents))
    spans = F.col(name).spans
    of_kind = lambda kind: F.filter(spans, lambda s: s.kind == kind)
    number = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *number, F.sha2(joined(F.filter(spans, lambda s: s.kind != "network")), 256).alias("base_sha256"), joined(spans).alias("spans"))
