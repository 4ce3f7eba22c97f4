"""Near duplicates: a multi-index Hamming join of b-bit minimum-hash signatures, confirmed on full shingle sets.

1. Each text's set of two-word shingles, as 64-bit hashes, gets a signature of 60 components of 16 bits. Texts with the
   same set are one class from here on, whose representative has the smallest id.
2. A signature is cut into 12 chunks of 5 components. Two signatures that differ in at most 23 components agree, by the
   pigeonhole principle, in some chunk but for one component; so each chunk is entered once for each component left out
   (the allowed errors, enumerated), and all pairs under that distance meet in a bucket. At a similarity of exactly 0.8 a
   pair fails to meet with a probability of about 1e-7.
3. In no bucket are all pairs made. Each member is confirmed against the bucket's hub: the member that comes first in one
   of three orders, so that a large group of copies is held against several of its members. What is linked with a hub is
   one component already. Pairs across components must share one of the first shingles of both sets, in an order common
   to all texts, at places that leave enough for the wanted overlap. Shingles that a bounded sample shows to be common
   come last, so texts that differ each in its own way share none; the sample decides about speed alone. The pairs'
   signatures are compared before their texts.
4. Components by large-star and small-star rounds, written to the shared folder after each.

Words are what lies between blanks, A-Z in lower case. A text of one word has that as its only shingle. Texts without
words, null ones included, have no set and are linked with nothing. Rows without an id keep their text's size, have no
component, and are kept. Rows that repeat an id are one document; if their texts differ, the one with the greatest hash is
its text, and all its rows have its component. Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, as_bytes, bounded, read, smallest
from meshlake.session import Scratch

CHUNKS, WIDTH = 12, 5
COMPONENTS = CHUNKS * WIDTH
#: Components of 8 bits of the longer signatures that pairs across components are held against first, and in how many they
#: may differ: a pair with a similarity of exactly 0.8 goes beyond with a probability of about 1e-8.
LONG, DISTANCE = 256, 88
#: Orders in which buckets choose their hubs. Texts whose shingles are sampled, shingles of a text, and common shingles kept,
#: at most.
HUBS, SAMPLE, SAMPLE_SHINGLES, COMMON = 3, 4096, 8192, 500_000
#: Members of a hub that are confirmed in one block, about.
BLOCK = 256
#: Ids that are broadcast at most to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(0, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _rng.integers(0, 1 << 63, LONG, dtype=np.uint64)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []

FIELDS = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingles, as hashes."""
    raw = np.frombuffer((text or b"").translate(_LOW), np.uint8)
    inside = (raw > 32) | (raw < 9) | ((raw > 13) & (raw < 32))
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(raw))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTES[raw] * power[: len(raw)])))
    word = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return np.unique(mixed(word[:-1] * np.uint64(3) + (word[1:] ^ (word[1:] >> np.uint64(7)))) if len(word) > 1 else mixed(word))


def signature(found: np.ndarray, components: int = COMPONENTS, bits: int = 16) -> np.ndarray:
    least = np.full(components, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), 512):
        least = np.minimum(least, (found[a : a + 512, None] * _FACTORS[:components] + _ADDED[:components]).min(0))
    return mixed(least) >> np.uint64(64 - bits)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature its 60 keys: each chunk once without each of its components."""
    chunks = signatures.reshape(-1, CHUNKS, WIDTH)
    keys = []
    for left_out in range(WIDTH):
        packed = np.zeros(chunks.shape[:2], np.uint64)
        for k in (k for k in range(WIDTH) if k != left_out):
            packed = (packed << np.uint64(16)) | chunks[:, :, k]
        keys.append(mixed(packed ^ mixed(np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(left_out + 1))))
    return np.concatenate(keys, 1).view(np.int64)


def signed(texts: list[bytes | None]) -> list[tuple]:
    sets = [shingles(t) for t in texts]
    keys = bucket_keys(np.array([signature(s) for s in sets], np.uint64).reshape(-1, COMPONENTS))
    rows = []
    for s, k in zip(sets, keys, strict=True):
        if len(s):
            h = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            rows.append((len(s), int(h[0]), int(h[1]), k))
        else:
            rows.append((0, None, None, None))
    return rows


def linked(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirmed(percent: int):
    """For the rows (hub, salt, member, text) of a block, the hub's own (member null) first: hub, member, linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hub_set = None, None
        for batch in batches:
            hubs, members, links = [], [], []
            for hub, member, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)), strict=True):
                own = shingles(text)
                if member is None:
                    held, hub_set = hub, own
                    continue
                if hub != held:
                    raise ValueError(f"no text of hub {hub}")
                hubs.append(hub)
                members.append(member)
                links.append(linked(len(own), len(hub_set), len(np.intersect1d(own, hub_set, assume_unique=True)), percent))
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(members, pa.int64()), pa.array(links, pa.bool_())], names=["hub", "member", "linked"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """hub, member, linked of each pair, from the full sets of both texts. A hub's members are dealt out in blocks of about
    BLOCK, and its text goes once to each block."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    dealt = pairs.join(blocks, "hub", "left").select("hub", "member", F.pmod(F.xxhash64("member"), F.coalesce("blocks", F.lit(1))).alias("salt"))
    members = dealt.join(texts.select(F.col("id").alias("member"), "text"), "member").select("hub", "salt", "member", "text")
    hubs = dealt.select("hub", "salt").distinct().join(texts.select(F.col("id").alias("hub"), "text"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("member"), "text")
    rows = hubs.union(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    return rows.mapInArrow(_confirmed(percent), "hub long, member long, linked boolean")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in three or more texts of a bounded sample, sorted, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                found = shingles(text)
                yield pa.RecordBatch.from_arrays([pa.array(found[:SAMPLE_SHINGLES].view(np.int64))], names=["shingle"])

    chosen = smallest(texts.select("id"), F.xxhash64("id"), SAMPLE)
    sample = texts.join(F.broadcast(chosen), "id", "left_semi").select("text")
    counts = sample.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    known, n = top.column("shingle").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(known)
    return known[order], n[order]


def prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(id, size, pos, shingle): the first shingles of each text's set, rare ones first, one of which any similar text has
    among its first ones, too."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in batches:
            sizes, firsts = [], []
            for text in as_bytes(batch.column(1)):
                own = shingles(text)
                n = len(own) - -(-percent * len(own) // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, counts[at], 0), kind="stable")]
                sizes.append(len(own))
                firsts.append(own[:n].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], names=["id", "size", "prefix"])

    return texts.mapInArrow(run, "id long, size long, prefix array<long>").select("id", "size", F.posexplode("prefix").alias("pos", "shingle"))


def across(texts: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (hub, member) of texts in different components that can be similar by their prefixes and signatures."""
    rows = prefixes(texts, percent).join(roots, "id", "left").select("id", "size", "pos", "shingle", F.coalesce("root", "id").alias("root"))
    split = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    kept = rows.join(split, "shingle").select("shingle", "id", "size", "pos", "root")
    a, b = kept.toDF("shingle", "ia", "sa", "pa", "ra"), kept.toDF("shingle", "ib", "sb", "pb", "rb")
    most = F.least(F.col("sa") - F.col("pa"), F.col("sb") - F.col("pb"))  # of shingles in common, if this is the first
    can = (F.col("ra") < F.col("rb")) & ((100 + percent) * most >= percent * (F.col("sa") + F.col("sb")))
    pairs = a.join(b, "shingle").where(can).select(F.col("ia").alias("hub"), F.col("ib").alias("member")).distinct()
    signs = texts.mapInArrow(_long_signatures, "id long, signature binary")
    signed_pairs = pairs.join(signs.toDF("hub", "a"), "hub").join(signs.toDF("member", "b"), "member").select("hub", "member", "a", "b")
    return signed_pairs.mapInArrow(_near, "hub long, member long")


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [signature(shingles(t), LONG, 8).astype(np.uint8).tobytes() for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "signature"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, LONG) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x != y).sum(1) <= DISTANCE))


def components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(id, root) of each node of the edges (a, b): root is the smallest id reachable. Each round joins every node with
    the least of its neighbours, first outwards, then inwards; it ends when a round changes nothing."""
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    before = None
    for k in range(1, rounds + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        before = mark
        ways = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = scratch.write(small, f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 2}")
    raise RuntimeError("components didn't settle")


def picked(documents: DataFrame, ids: DataFrame, odd: DataFrame | None) -> DataFrame:
    """(id, text) of the documents with these ids: by a broadcast as long as the ids are few, else by a shuffle. Ids with
    several texts have the one that odd (id, h1, h2) names."""
    few = ids.count() <= BROADCAST_IDS
    found = documents.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    if odd is None:
        return found.dropDuplicates(["id"])
    several, name = annotate(found.join(odd.select("id"), "id", "left_semi"), "text", FIELDS, lambda: signed, limit=1 << 20)
    chosen = several.select("id", "text", f"{name}.h1", f"{name}.h2").join(odd, ["id", "h1", "h2"], "left_semi").select("id", "text")
    return found.join(odd.select("id"), "id", "left_anti").union(chosen).dropDuplicates(["id"])


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is component_id)."""
    scratch = Scratch(documents.sparkSession, "near-duplicates")
    bounded(documents.sparkSession)
    source = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    found, name = annotate(source, "text", FIELDS, lambda: signed, ["id"], limit=1 << 20)
    signs = scratch.write(found.select("id", f"{name}.*"), "signatures")
    hashes = signs.where("id IS NOT NULL").select("id", "h1", "h2")
    several = hashes.groupBy("id").agg(*(f(F.coalesce(c, F.lit(0))).alias(f"{n}_{c}") for c in ("h1", "h2") for n, f in (("low", F.min), ("high", F.max)))).where("low_h1 <> high_h1 OR low_h2 <> high_h2")
    chosen = hashes.join(several.select("id"), "id", "left_semi").groupBy("id").agg(F.max(F.struct("h1", "h2")).alias("c"))
    odd = scratch.write(chosen.select("id", "c.h1", "c.h2"), "odd")
    odd = None if odd.isEmpty() else odd
    usable = signs.where("id IS NOT NULL AND n_shingles > 0")
    if odd is not None:
        usable = usable.join(odd.select("id"), "id", "left_anti").unionByName(usable.join(odd, ["id", "h1", "h2"], "left_semi"))
    classes = scratch.write(usable.groupBy("h1", "h2").agg(F.min("id").alias("rep")), "classes")
    entries = usable.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", F.explode("keys").alias("key"))
    order = F.pmod("key", F.lit(HUBS))
    rank = F.when(order == 0, F.col("id")).otherwise(F.xxhash64("id", order))
    hubs = entries.groupBy("key").agg(F.min_by("id", rank).alias("hub"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "hub")
    met = entries.join(hubs, "key").where("id <> hub").select(F.least("hub", "id").alias("low"), F.greatest("hub", "id").alias("high"), "hub")
    once = met.groupBy("low", "high").agg(F.min("hub").alias("hub"))  # the hub stays the hub, as it has the many members
    pairs = scratch.write(once.select("hub", F.when(F.col("hub") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("member")), "pairs")
    texts = scratch.write(picked(source, scratch.write(pairs.select(F.col("hub").alias("id")).union(pairs.select("member")).distinct(), "ids"), odd), "texts")
    edges = confirm(pairs, texts, percent).where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    roots = scratch.write(components(edges, scratch, "first"), "roots")
    met = scratch.write(across(texts, roots, percent), "across")  # confirm() reads the pairs several times
    second = scratch.write(confirm(met, texts, percent).where("linked").select(F.col("hub").alias("a"), F.col("member").alias("b")), "second")
    if second.isEmpty():
        ends = roots
    else:
        merged = components(second.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), scratch, "second-roots")
        merged = scratch.write(merged, "merged")
        known = roots.union(second.select("a", "a")).union(second.select("b", "b")).groupBy("id").agg(F.min("root").alias("root"))
        ends = known.join(merged.toDF("root", "end"), "root", "left").select("id", F.coalesce("end", "root").alias("root"))
    of_class = classes.join(ends.toDF("rep", "root"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("root"))
    joined = signs.select("id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    if odd is not None:  # all rows of such an id have the component of its chosen text
        chosen = odd.join(of_class, ["h1", "h2"]).select("id", F.col("root").alias("own"))
        joined = joined.join(chosen, "id", "left").select("id", "n_shingles", F.coalesce("own", "root").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return joined.select(F.col("id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
rare AS (SELECT g, count(*) AS df FROM e GROUP BY g),
ranked AS (SELECT doc_id, n, e.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, e.g) AS r FROM e JOIN rare USING (g)),
pre AS (SELECT doc_id, n, g FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
linked AS (
  SELECT a, b FROM (SELECT a, b, na, nb, len(list_intersect(x.s, y.s)) AS i FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b)
  WHERE 100 * i >= 80 * (na + nb - i)),
ways AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT reach.x, ways.b FROM reach JOIN ways ON reach.y = ways.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(y) AS component_id, min(y) = s.doc_id AS kept
FROM s JOIN reach ON x = s.doc_id GROUP BY s.doc_id, s.s
"""
