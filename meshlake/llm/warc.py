"""WARC archives: written with an index first, read back by coalesced byte ranges.

Every record is a gzip member of its own, so a record can be read by its offset and length alone. Tasks write archives
into the shared folder under names that hold the partition and the attempt; an archive counts only if the index, which
Spark commits, names it, so what a lost executor or a second attempt leaves is never read. A record's payload is the
body of its HTTP block. Of records with equal payloads the one with the smallest id is the response; the others are
revisits, with the HTTP headers only, whose Content-Length is the full payload's.

Null html is an empty payload. Every row is one record. Rows without an id are responses, and so are all rows that share
the smallest id of a payload; rows that share an id but not the payload are told apart by their payloads, each a response or
a revisit of the smallest id with the same one. Null urls are written as about:blank, and control characters and blanks in
urls are escaped. Empty tables give empty archives and no rows. Only id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from meshlake.llm.texts import bounded, read
from meshlake.session import Scratch

ARCHIVE_BYTES, LEVEL = 256 << 20, 3
#: Bytes of unwanted records that a read goes over rather than being split, and the most bytes of one read.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: Bytes of archives that one task reads.
TASK_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = T.StructType([T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("url", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_type", T.StringType())])
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that the workers reach: local or mounted folders, and what pyarrow has a client for."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, digest: str) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple:
    """A record's row; raises where the record isn't what its headers say."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda urn: int(urn[len("<urn:x-page:") : -1]) if urn and urn != "<urn:x-page:>" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what was written")
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def first_copies(pages: DataFrame, page_id: str, html: str, min_bytes: int) -> DataFrame:
    """(copy, sha, first): page_id and payload of each revisit, and the smallest page_id with this payload. Ids and digests
    are shuffled, no html."""
    body = payload_of(html)
    known = pages.where(F.col(f"`{page_id}`").isNotNull() & (F.octet_length(body) >= min_bytes)).select(F.col(f"`{page_id}`").cast("long").alias("copy"), F.sha1(body).alias("sha"))
    firsts = known.groupBy("sha").agg(F.min("copy").alias("first"), F.max("copy").alias("last")).where("first < last").select("sha", "first")
    return known.join(firsts, "sha").where("copy > first").select("copy", "sha", "first").distinct()


def payload_of(html: str) -> Column:
    return F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")


def write(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record a row; returns the index. The revisits are a table first, so that their measured size, and not
    a guess, decides whether they are broadcast or joined by a shuffle."""
    bounded(pages.sparkSession)
    copies = scratch.write(first_copies(pages, page_id, html, min_bytes), "copies")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("copy"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"), F.sha1(payload_of(html)).alias("sha")).join(copies, ["copy", "sha"], "left").select("copy", "url", "html", "first")
    jvm = pages.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch.root}/archives")
    folder = path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).makeQualified(path).toString()
    schema = to_arrow_schema(INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        store.create_dir(at, recursive=True)
        task, k, out, size, name = TaskContext.get(), 0, None, 0, ""
        try:
            for batch in batches:
                found = []
                for page, link, text, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or size >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, size, k = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k}.warc.gz", 0, k + 1
                        out = store.open_output_stream(name, compression=None)
                    payload = (text or "").encode()
                    digest = payload_digest(payload)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = packer.compress(record(page, link, payload, first, date, digest)) + packer.flush()
                    out.write(data)
                    found.append((name, size, len(data), link, digest, page, "response" if first is None else "revisit"))
                    size += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema) if found else pa.RecordBatch.from_pylist([], schema)
        finally:
            if out is not None:
                out.close()

    index = scratch.write(rows.mapInArrow(run, INDEX), "index")
    scratch.drop("copies")
    return index


def coalesced(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) as reads: (archive, start, end, the records in it)."""
    held: list[tuple[int, int]] = []
    archive, start, end = "", 0, 0
    for name, offset, length in rows:
        if held and (name != archive or offset > end + gap or max(end, offset + length) - start > most):
            yield archive, start, end, held
            held = []
        if not held:
            archive, start, end = name, offset, offset
        held.append((offset, length))
        end = max(end, offset + length)
    if held:
        yield archive, start, end, held


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows name, checked against their digests, whichever rows of the index are selected."""
    schema = to_arrow_schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(folder)
        opened, stream = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for archive, start, end, records in coalesced(rows):
                if archive != opened:
                    if stream is not None:
                        stream.close()
                    opened, stream = archive, store.open_input_file(archive)
                data = stream.read_at(end - start, start)
                made = [parsed(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in records]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
        if stream is not None:
            stream.close()

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    chosen = index.select("archive", "offset", "length").repartitionByRange(1 + total // TASK_BYTES, "archive", "offset").sortWithinPartitions("archive", "offset")
    return chosen.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, scratch: Scratch, **names) -> DataFrame:
    return fetch(write(pages, scratch, **names), scratch.root)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages"), Scratch(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT page_id, h, first, list_transform(generate_series(0, 39), lambda i: ('0x' || substr(sha1(h), i + 1, 1))::INT) AS x FROM f)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(generate_series(0, 4), lambda b: (1 << (4 - b)) * ((x[1 + (5 * k + b) // 4] >> (3 - (5 * k + b) % 4)) & 1)))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
