"""Queries of this subpackage: one thin opN_<name> per operator, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, fingerprints, licenses, line_dedup, minhash, packing, pii, quality_classifier, quality_rules, warc
from tessera.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold-scaled fingerprints of documents and of edited texts of them."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: 3-word shingles, similarity 85 % or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of documents, judged by an isolation forest."""
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the BPE ids of documents and of what they decode to."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents, plain and disguised."""
    return pii.scan_documents(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of documents by supervised subword embeddings."""
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to dictionary-compressed archives and read back."""
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that documents name."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_packing, op3_minhash, op4_quality_rules, op5_bpe, op6_line_dedup, op7_pii, op8_quality_classifier, op9_warc, op10_licenses,
    )
}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.dedup_report_sql()}


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_quality_rules counts before its forest judges."""
    return op4_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base identifiers that op7_pii counts."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


#: Those columns of operators that SQL can express, as queries of their own.
BASE_QUERIES: dict[str, Query] = {f.__name__: f for f in (rules_base, pii_base)}
ORACLE_SQL |= {
    "rules_base": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS three FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w) x),
twice AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, three) AS n FROM windows) x WHERE n > 1),
covered AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM twice) x GROUP BY k),
lines AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
counted AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN lines l ON l.k = w.k LEFT JOIN covered c ON c.k = w.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted""",
    "pii_base": r"""
SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
  CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: coalesce(TRY_CAST(p AS UBIGINT), 256))) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(list_transform(regexp_extract_all(t, '[0-9]([ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[ -]', '', 'g'))), lambda x: length(x) BETWEEN 14 AND 19
    AND list_sum(list_transform(generate_series(1, length(x)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INT) WHEN CAST(x[i] AS INT) > 4 THEN 2 * CAST(x[i] AS INT) - 9 ELSE 2 * CAST(x[i] AS INT) END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d""",
}
