"""Documents through five text operators, each stage on all that the one before has kept.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage's decisions take effect:
toxic documents, copies and contaminated documents go, secrets are blotted out, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlake.llm import decontaminate, near_duplicates, pieces, secrets, toxicity
from meshlake.llm.texts import read
from meshlake.session import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half for toxicity. Rows without text score as texts without evidence."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored, name = toxicity.toxicity(docs, model, None)
    return scored.where(F.col(name).score < 0.5).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates; rows without an id stay. What goes is
    written first: if it is few enough to be broadcast, the texts need not be shuffled."""
    found = near_duplicates.near_duplicates(docs)
    gone = Scratch(spark, "copies").write(found.where("NOT kept").select("doc_id").distinct(), "gone")
    few = gone.count() <= near_duplicates.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    found, name = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), None)
    return found.where(~F.col(name).contaminated).select(*docs.columns)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with "[SECRET]" for each secret in their texts, and n_chars to match where it was a length."""
    found, name = secrets.scanned(docs, secrets.fit(docs), None)
    spans, text = F.col(name).spans, F.col("text")
    clean = secrets.redacted(text, spans)
    n_chars = F.when(F.col("n_chars") == F.length(text), F.length(clean)).otherwise(F.col("n_chars"))
    return found.select(*(clean.alias(c) if c == "text" else n_chars.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, how many, and whether decoding them gives the text back."""
    found, name = pieces.encoded(docs, pieces.model_path())
    r = F.col(name)
    return found.select("doc_id", r.ids.alias("ids"), r.n_ids.alias("n_tokens"), r.decoded.alias("decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_copy),
    ("decontamination", drop_contaminated),
    ("secrets", blot_secrets),
    ("sentencepiece", encode),
]
#: The first stage is a trained classifier, the fourth has a trained network: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
