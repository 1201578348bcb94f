"""Completion: ranked candidates, capped per class, merged first come, first kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import matching as mt
from tessera.functions import text as tx
from tessera.operators.catalog import header_rank
from tessera.operators.ordered import first_wins, staged_union, top

ITEMS, PER_CLASS, STRONG, INCLUDES, GLOBALS = 128, 96, 24, 80, 80


def member_items(members: DataFrame, prefix: str, per_class: int = PER_CLASS) -> DataFrame:
    """Members(class_name, depth, name, kind, detail) that complete the prefix, best
    first, at most `per_class` of each class; overloads differ by detail."""
    ranked = members.withColumn("rank", mt.match_rank("name", prefix)).where(F.col("rank") < mt.NONE)
    keyed = first_wins(ranked, ["class_name", "name", "detail"], ["depth", "rank"])
    keyed = keyed.withColumn("sort_text", mt.sort_text(F.col("depth") * 1000 + F.col("rank"), F.col("kind"), "name"))
    keyed = keyed.withColumn("score_offset", mt.score_offset(F.col("rank")))
    place = F.row_number().over(Window.partitionBy("class_name").orderBy("sort_text", "name", "detail"))
    return keyed.withColumn("place", place).where(F.col("place") <= per_class)


def accessible(access: Column, same_class: Column, subclass: Column) -> Column:
    """public to all, protected to subclasses, private to the class itself."""
    a = F.lower(F.coalesce(access, F.lit("public")))
    return F.when(same_class, True).when(a == "private", False).when(a == "protected", subclass).otherwise(True)


def prefer_included(candidates: DataFrame, included: DataFrame) -> DataFrame:
    """candidates(name, path, ...): where a name has several, those whose path is among
    the included ones, unless none of them is."""
    marked = candidates.join(included.select("path", F.lit(1).alias("__in")).distinct(), "path", "left")
    w = Window.partitionBy("name")
    sized = marked.withColumn("__all", F.count("*").over(w)).withColumn("__some", F.count("__in").over(w))
    keep = (F.col("__all") == 1) | (F.col("__some") == 0) | F.col("__in").isNotNull()
    return sized.where(keep).drop("__in", "__all", "__some")


def insert_path(path: Column | str) -> Column:
    """What an include of a header names: what follows its public, classes or private
    folder (the first in that order), else its name."""
    p = tx.col(path)
    out = tx.file_name(p)
    for marker in ("/Private/", "/Classes/", "/Public/"):
        after = F.substring(p, F.instr(p, marker) + len(marker), F.length(p))
        out = F.when(F.instr(p, marker) > 0, after).otherwise(out)
    return out


def include_items(headers: DataFrame, prefix: str) -> DataFrame:
    """Next path segments or whole files that complete an include prefix, from the first
    INCLUDES headers by folder kind, length and path; a label counts once."""
    low = prefix.lower()
    hits = headers.where(tx.contains_ci("path", "/" + prefix) | tx.starts_ci(tx.file_name("path"), prefix)) if prefix else headers
    page = top(hits, [header_rank("path"), F.length("path"), "path", "file_id"], INCLUDES)
    name = insert_path("path")
    rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
    begins = F.lower(name).startswith(low)
    slashed = F.ltrim(rest, F.lit("/")) if prefix else rest
    lead = F.when(rest.startswith("/"), F.lit(prefix + "/")).otherwise(F.lit(prefix))
    label = F.concat(lead, F.substring_index(slashed, "/", 1), F.when(slashed.contains("/"), "/").otherwise(""))
    whole = F.lit("/" not in prefix) & F.lower(tx.file_name(name)).startswith(low)
    items = page.withColumn("label", F.when(begins, label).when(whole, name)).where("label is not null")
    items = items.withColumn("kind", F.when(F.col("label").endswith("/"), 19).otherwise(17))
    bucket = F.when(F.col("kind") == 19, 5).when(begins, 10).otherwise(20)
    return first_wins(items.withColumn("sort_text", mt.sort_text(bucket, F.col("kind"), name)), ["label"], ["ord"])


def word_items(spark: SparkSession, words: Sequence[str], prefix: str, bucket: int, kind: int, ranked: bool = False) -> DataFrame:
    """Words of a literal list (label, kind, sort_text, ord) that start with the prefix,
    or match it otherwise where `ranked`; a word counts once."""
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(words))], "label string, ord int").withColumn("kind", F.lit(kind))
    rank = mt.match_rank("label", prefix) if ranked else F.when(F.lower("label").startswith(prefix.lower()), 0).otherwise(mt.NONE)
    hits = rows.withColumn("rank", rank).where(F.col("rank") < mt.NONE)
    base = F.lit(bucket) + (F.col("rank") if ranked else F.lit(0))
    return hits.withColumn("sort_text", mt.sort_text(base, F.col("kind"), "label")).select("label", "kind", "sort_text", "ord")


def global_items(symbols: DataFrame, prefix: str, bucket: int = 100_000, cap: int = GLOBALS) -> DataFrame:
    """Names that start with the prefix, then names that match it otherwise; once each."""
    ranked = symbols.withColumn("rank", mt.match_rank("name", prefix)).where(F.col("rank") < mt.NONE)
    strong = top(ranked.where("rank = 0"), ["name", "id"], cap)
    weak = top(ranked.where("rank > 0"), ["rank", "name", "id"], 200)
    unique = first_wins(staged_union([strong, weak]), ["name"], ["stage", "ord"])
    return top(unique.drop("ord"), ["stage", "rank", "name"], cap).withColumn("sort_text", mt.sort_text(F.col("rank") + bucket, F.lit(7), "name"))


def merge_items(stages: Sequence[DataFrame], limit: int = ITEMS) -> DataFrame:
    """Candidate lists(label, ord, ...) in the order given, each in its own, a label once;
    the first `limit` in that order."""
    unique = first_wins(staged_union(stages), ["label"], ["stage", "ord"])
    return top(unique, ["stage", "ord", "label"], limit)


def enum_items(values: DataFrame, prefix: str) -> DataFrame:
    """Values(enum_name, name) that complete the prefix, a name once, in order of name."""
    ranked = values.withColumn("rank", mt.match_rank("name", prefix)).where(F.col("rank") < mt.NONE)
    once = first_wins(ranked, ["name"], ["enum_name"])
    kind = F.lit(20)
    sort = mt.sort_text(F.col("rank"), kind, "name")
    return once.select(F.col("name").alias("label"), kind.alias("kind"), sort.alias("sort_text"), (F.row_number().over(Window.orderBy("name")) - 1).alias("ord"))
