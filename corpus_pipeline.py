"""A training-data pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results: a stage keeps the order of no rows and all columns it was given, whatever their names; texts
that a stage changes get their n_chars anew; null and empty texts fail the quality rules; texts that
lose all their lines go on empty; of repeated rows of one id one stays; very long texts are cut into pieces by
packing alone; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.llm import line_dedup, near_dedup, packing, quality_rules, secrets
from quadweave.llm.common import labels
from quadweave.session import Table


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs, quality_rules.trusted_ids(labels(spark, sf_dir)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; documents stay."""
    return _recounted(line_dedup.remove_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 or more) stays."""
    return near_dedup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _recounted(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: Packing needs a tokenizer, which SQL has not; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else Table(out).df
    return docs
