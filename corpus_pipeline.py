"""Corpus pipeline: quality, lines, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, packing, pii, quality_classifier
from tessera.llm.common import table
from tessera.llm.registry import vocabulary
from tessera.plans.storage import scratch, shared_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines.  A document of which nothing is
    left, every line standing in another one, goes; null and blank texts stay."""
    cleaned = line_dedup.dedup_lines(docs, counts=("__total", "__removed"))
    left = cleaned.where((F.col("__removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != ""))
    if "n_chars" in docs.columns:
        count = F.when(F.col("__removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id.  Rows
    without words all stay; of identical rows, whatever their doc_id, one stays."""
    return minhash.keep_first(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.mask_documents(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", best_fit),
]
#: Learned scores, MinHash and tokenisation have no SQL form; tests compare the stages
#: with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again.  What
    a stage wrote for itself is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = shared_path(spark, f"stage{i}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
