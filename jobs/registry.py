"""The jobs as queries: each runs twice into one new folder, and its output is read back as it stands then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import slice_report, upload_registry
from meshlake.queries.sheet import LINES
from meshlake.session import checkpoint_root
from meshlake.streaming import uploads


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        slice_report.run(spark, f"{sf_dir}/part.parquet", out)
    return spark.read.parquet(f"{out}/report").selectExpr("band", "layer", "object_id", "z", "n_segments", "round(cut_length, 4) AS cut_length", "round(area, 2) AS area", "open_ends")


def job2_upload_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        upload_registry.run(spark, f"{sf_dir}/documents.parquet", f"{out}/records", f"{out}/checkpoint")
    return uploads.records(spark, f"{out}/records")


QUERIES = {f.__name__: f for f in (job1_slice_report, job2_upload_registry)}
ORACLES = {
    "job1_slice_report": f"""
WITH {LINES},
ends AS (
    SELECT layer, object_id, x, y FROM (SELECT layer, object_id, round(x1, 6) AS x, round(y1, 6) AS y, 1 AS way FROM lines UNION ALL SELECT layer, object_id, round(x2, 6), round(y2, 6), -1 FROM lines)
    GROUP BY ALL HAVING sum(way) <> 0),
loose AS (SELECT layer, object_id, count(*) AS open_ends FROM ends GROUP BY ALL)
SELECT (layer // 2)::INT AS band, layer, object_id, z, count(*) AS n_segments, round(sum(sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2)), 4) AS cut_length, round(sum(x2 * y1 - x1 * y2) / 2, 2) AS area,
    coalesce(any_value(open_ends), 0) AS open_ends
FROM lines LEFT JOIN loose USING (layer, object_id) GROUP BY layer, object_id, z
""",
    "job2_upload_registry": """
WITH firsts AS (SELECT sha256(text) AS content_hash, min(doc_id) AS first_id FROM documents WHERE text <> '' GROUP BY ALL)
SELECT doc_id::VARCHAR AS upload_id, source AS name, '' AS format, coalesce(octet_length(encode(text)), 0) AS n_bytes, sha256(text) AS content_hash,
    CASE WHEN text IS NULL OR text = '' THEN 'rejected' WHEN doc_id = first_id THEN 'new' ELSE 'known' END AS status,
    CASE WHEN text IS NULL THEN 'no content' WHEN text = '' THEN 'empty' END AS reason, first_id::VARCHAR AS first_id, 0 AS batch
FROM documents LEFT JOIN firsts ON content_hash = sha256(text)
""",
}
