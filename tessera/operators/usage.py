"""Whole-word usages of a symbol, what kind they are, and where to look for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.links import holding
from tessera.operators.ordered import first_wins, top

RESULT_CAP, FILE_CAP = 300, 2000


def word_hits(lines: DataFrame, word: str) -> DataFrame:
    """lines(path, line, text) with one row per whole occurrence and its `column`."""
    holding = lines.where(F.col("text").contains(word))
    return holding.withColumn("column", F.explode(tx.word_columns("text", word)))


def word_counts(lines: DataFrame, word: str) -> DataFrame:
    """(path, n): whole occurrences of a word by path, counted without their places."""
    counts = lines.where(F.col("text").contains(word)).select("path", F.regexp_count("text", F.lit(tx.whole_word(word))).alias("n"))
    return counts.groupBy("path").agg(F.sum("n").alias("n")).where("n > 0")


def usages(lines: DataFrame, word: str, limit: int = RESULT_CAP) -> DataFrame:
    """Usages in code, outside comments and strings, each with its kind; a place counts
    once; the first `limit` by path, line and column."""
    hits = word_hits(lines, word).where(tx.in_code("text", F.col("column")))
    kinds = hits.withColumn("kind", tx.usage_kind("text", F.col("column"), word))
    placed = kinds.groupBy("path", "line", "column").agg(F.min("text").alias("text"), F.min("kind").alias("kind"))
    return top(placed, ["path", "line", "column"], limit)


def candidate_files(definitions: DataFrame, callers: DataFrame, includes: DataFrame, everything: DataFrame, current: str | None = None, cap: int = FILE_CAP) -> DataFrame:
    """Files worth scanning: where the symbol is defined or called, what includes those,
    and the current one; without any, the first `cap` of everything.  All frames have a
    `path`; includes has `resolved` too."""
    core = definitions.select("path").union(callers.select("path")).where("path is not null").distinct()
    including = includes.join(core.select(F.col("path").alias("resolved")), "resolved", "left_semi").select("path")
    found = core.union(including)
    if current is not None:
        found = found.union(core.sparkSession.createDataFrame([(current,)], "path string"))
    found = found.distinct()
    none = found.limit(1).agg((F.count("*") == 0).alias("__none"))
    rest = everything.select("path").distinct().crossJoin(F.broadcast(none)).where("__none").drop("__none")
    return found.union(rest).orderBy("path").limit(cap)


def method_ranges(lines: DataFrame, head: str = r"([A-Za-z_][A-Za-z0-9_]*)::[~A-Za-z_]") -> DataFrame:
    """(path, class_name, start, stop): runs of lines between a `Class::method` head at
    brace depth 0 and the line that closes its block (gaps and islands over the running
    brace depth)."""
    braces = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    in_file = Window.partitionBy("path").orderBy("line")
    depth = lines.withColumn("delta", braces("{") - braces("}")).withColumn("after", F.sum("delta").over(in_file))
    depth = depth.withColumn("before", F.col("after") - F.col("delta"))
    heads = depth.withColumn("head", F.when(F.col("before") == 0, F.nullif(F.regexp_extract("text", head, 1), F.lit(""))))
    runs = heads.withColumn("island", F.count("head").over(in_file)).withColumn("class_name", F.last("head", True).over(in_file))
    closed = runs.where("island > 0 and delta <> 0 and after = 0").groupBy("path", "island", "class_name").agg(F.min("line").alias("stop"))
    starts = runs.where("head is not null").groupBy("path", "island").agg(F.min("line").alias("start"))
    return starts.join(closed, ["path", "island"]).select("path", "class_name", "start", "stop")


def within_ranges(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """hits with the class of the range that holds their line, or null; the innermost."""
    points = hits.select("path", F.col("line").alias("start"), F.col("line").alias("stop")).distinct()
    spans = ranges.select("path", "class_name", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    best = first_wins(holding(points, spans, "path"), ["path", "start"], [F.col("hi") - F.col("lo"), "class_name"])
    return hits.join(best.select("path", F.col("start").alias("line"), "class_name"), ["path", "line"], "left").select(*hits.columns, "class_name")
