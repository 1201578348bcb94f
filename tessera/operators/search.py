"""Ranked search over symbols, files and lines of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.catalog import CLASS_LIKE, clamp
from tessera.operators.ordered import fallback_below, first_wins, top

TEXT_LIMIT = (1, 500)


def tier(query: str, *fields: Column) -> Column:
    """0 exact, 1 prefix, 2 substring of the first field, then 3, 4, ... for the first
    later field that holds the query, 9 for none."""
    q, name = query.lower(), F.lower(fields[0])
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2)
    for i, field in enumerate(fields[1:], 3):
        rank = rank.when(F.lower(F.coalesce(field, F.lit(""))).contains(q), i)
    return rank.otherwise(9)


def kind_tier(kind: Column | str = "type") -> Column:
    k = F.coalesce(tx.col(kind), F.lit(""))
    return F.when(k.isin(*CLASS_LIKE), 0).when(F.lower(k).contains("function") | F.lower(k).contains("method"), 1).otherwise(2)


def search_symbols(symbols: DataFrame, pattern: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """Symbols(name, type, class_name, module_name, path, line, id) that hold every word
    of the pattern somewhere, by tier, kind, name and path.  Blank lists all."""
    limit, offset = clamp(limit, 100, 1, 10_000), min(offset, 1_000_000)
    if not pattern.strip():
        return list_symbols(symbols, limit, offset)
    everything = F.lower(F.concat_ws(" ", "name", "type", "class_name", "module_name", "path"))
    out = symbols
    for word in pattern.split():
        out = out.where(everything.contains(word.lower()))
    ranked = out.withColumn("rank", tier(pattern, *map(F.col, ("name", "class_name", "module_name", "path")))).withColumn("kind_rank", kind_tier())
    return top(ranked, ["rank", "kind_rank", F.lower("name"), "path", "line", "id"], limit, offset)


def list_symbols(symbols: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return top(symbols.where(~F.col("name").startswith("(")), [F.lower("name"), "id"], limit, offset)


def fast_find_symbols(symbols: DataFrame, places: DataFrame, pattern: str, limit: int) -> DataFrame:
    """Top symbols by name or class first, and only these joined with places(id, path,
    line); a symbol without a place leaves a shorter page."""
    hits = symbols.where(tx.contains_ci("name", pattern) | tx.contains_ci("class_name", pattern))
    ranked = hits.withColumn("rank", tier(pattern, F.col("name"), F.col("class_name")))
    page = top(ranked, ["rank", F.lower("name"), "id"], limit)
    return page.join(places, "id")


def search_files_ranked(files: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Files whose name or path holds the pattern: exact name, prefix, substring, path."""
    hits = files.where(tx.contains_ci("filename", pattern) | tx.contains_ci("path", pattern))
    ranked = hits.withColumn("rank", tier(pattern, F.col("filename"), F.col("path")))
    return top(ranked, ["rank", F.lower("filename"), F.lower("path"), "file_id"], limit)


def grep(texts: DataFrame, pattern: str, limit: int = 100, offset: int = 0, order: Sequence[str] = ("path",)) -> DataFrame:
    """Lines holding the pattern in any case, in order of file and line, as (keys, line
    from 1, text trimmed).  The pattern is taken as it is, blanks too; empty finds nothing.
    Where several texts have one key, equal lines of theirs go by length and text."""
    limit = clamp(limit, 100, *TEXT_LIMIT)
    source = texts.where(tx.contains_ci("text", pattern)) if pattern else texts.limit(0)
    lines = source.select(*order, F.posexplode(tx.text_lines("text")).alias("at", "raw"))
    hits = lines.where(tx.contains_ci("raw", pattern)).select(*order, (F.col("at") + 1).alias("line"), tx.strip("raw").alias("text"))
    return top(hits, [*order, "line", F.length("text"), "text"], limit, offset)


def found(df: DataFrame, kind: str, name: Column, path: Column, line: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), line.cast("long").alias("line"), F.col("ord").cast("long").alias("ord"))


def global_find(symbols: DataFrame, files: DataFrame, texts: DataFrame | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Symbols, then files, then text hits if the first two do not fill the page; equal
    (kind, path, line, name) count once.  All three as made by `found`, each best first,
    and in that order the page is cut."""
    both = symbols.withColumn("part", F.lit(0)).unionByName(files.withColumn("part", F.lit(1)))
    if texts is not None:
        both = fallback_below(both, texts.withColumn("part", F.lit(2)), limit + offset).drop("stage")
    unique = first_wins(both.fillna({"line": 1}), ["kind", "path", "line", "name"], ["part", "ord"])
    return top(unique, ["part", "ord"], limit, offset)


def grep_bytes(blobs: DataFrame, pattern: bytes, column: str = "content") -> DataFrame:
    """Rows whose binary column holds the bytes."""
    return blobs.where(F.contains(F.col(column).cast("binary"), F.lit(pattern)))
