"""Where things stand: near lines, headers of types, declarations, asset files, platforms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import assets
from tessera.operators.ordered import first_wins, top

#: Lines after an indexed place in which its name may have moved.
NEAR = 8
# Platforms known by name, wherever they have a folder.
PLATFORMS = ("Windows", "Mac", "Linux", "Android", "IOS", "TVOS", "Apple", "Unix")


def numbered_lines(texts: DataFrame) -> DataFrame:
    """texts(path, text) as (path, line from 1, text)."""
    return texts.select("path", F.posexplode(tx.text_lines("text")).alias("at", "text")).select("path", (F.col("at") + 1).cast("long").alias("line"), "text")


def near_line(hits: DataFrame, lines: DataFrame, word: str) -> DataFrame:
    """hits(path, line, ...) moved to the first of the line and the NEAR lines after it that
    holds the word, with its `column`; unmoved, at column 0, where none does."""
    holding = lines.where(F.col("text").contains(word)).withColumn("columns", tx.word_columns("text", word)).where(F.size("columns") > 0)
    found = holding.select(F.col("path").alias("__p"), F.col("line").alias("__l"), F.element_at("columns", 1).alias("__c"))
    first = F.greatest(F.col("line"), F.lit(1)).cast("long")
    tries = hits.withColumn("__at", F.explode(F.sequence(first, first + NEAR)))  # so that lines meet by equality
    joined = tries.join(found, (F.col("path") == F.col("__p")) & (F.col("__at") == F.col("__l")), "left")
    nearest = first_wins(joined, hits.columns, [F.col("__l").asc_nulls_last()])
    return nearest.select(*[c for c in hits.columns if c != "line"], F.coalesce("__l", "line").cast("long").alias("line"), F.coalesce("__c", F.lit(0)).cast("long").alias("column"))


def type_stem(name: str) -> str:
    """The name of a type's file: without a type letter before an upper-case one."""
    return name[1:] if re.match("[AUFETS][A-Z]", name) else name


def header_of_type(files: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """(path, line) of the declaration of a type in a header named for it: exactly or with
    the name inside; of all that declare it, the first by folder and length of path."""
    stem = type_stem(name)
    file = F.lower("filename")
    like = (file.endswith(".h") | file.endswith(".hpp")) & file.contains(stem.lower()) & ~file.endswith(".generated.h")
    folder = F.when(F.col("path").contains("/Classes/"), 0).when(F.col("path").contains("/Public/"), 1).when(F.col("path").contains("/Private/"), 2).otherwise(3)
    headers = files.where(like).select("path").distinct()
    lines = numbered_lines(texts.where(F.col("text").contains(name)).join(headers, "path", "left_semi"))
    # A macro or an attribute may part the keyword from the name by a line or two.
    bare = F.regexp_replace("text", "//.*$", "")
    from pyspark.sql import Window

    ahead = F.concat_ws(" ", bare, F.lead(bare, 1).over(Window.partitionBy("path").orderBy("line")), F.lead(bare, 2).over(Window.partitionBy("path").orderBy("line")))
    keyword = r"(?<![A-Za-z0-9_])(class|struct|enum)(?![A-Za-z0-9_])"
    declared = lines.withColumn("ahead", ahead).where(bare.rlike(keyword) & F.col("ahead").rlike(rf"{keyword}[^;{{:]*{tx.whole_word(name)}\s*(final\s*)?[:{{]"))
    first = declared.groupBy("path").agg(F.min("line").alias("line"))
    return top(first, [folder, F.length("path"), "path"], 1).select("path", "line")


def member_place_kind(path: Column | str, context: Column | str, name: str) -> Column:
    """definition in a source file's line that qualifies the name, else declaration."""
    p, c = F.lower(tx.col(path)), tx.col(context)
    source = p.endswith(".cpp") | p.endswith(".cc") | p.endswith(".cxx")
    return F.when(source & c.contains("::") & c.contains(name), "definition").otherwise("declaration")


def member_places(members: DataFrame, texts: DataFrame, name: str, owner: str) -> DataFrame:
    """(path, line, column, context, kind, class_name) of the declarations of a class's
    member, at the lines where it stands now; a place counts once."""
    own = members.where((F.col("name") == name) & (F.col("class_name") == owner)).select("path", "line", "class_name").distinct()
    lines = numbered_lines(texts.join(own.select("path").distinct(), "path", "left_semi"))
    moved = near_line(own, lines, name).distinct()
    at = lines.groupBy(F.col("path").alias("__p"), F.col("line").alias("__l")).agg(F.min(tx.strip("text")).alias("context"))
    placed = moved.join(at, (F.col("path") == F.col("__p")) & (F.col("line") == F.col("__l")), "left").drop("__p", "__l")
    placed = placed.withColumn("context", F.coalesce("context", F.lit(f"{owner}::{name}")))
    return placed.withColumn("kind", member_place_kind("path", "context", name))


def in_classes(hits: DataFrame, classes: DataFrame) -> DataFrame:
    """hits(text, column, class_name of the method around them) that concern one of
    classes(name): by an explicit Class:: before them, else by that method."""
    before = F.substring(F.col("text"), F.lit(1), F.col("column"))
    scope = F.regexp_extract(before, r"([A-Za-z_][A-Za-z0-9_]*)\s*::\s*$", 1)
    asked = F.when(scope != "", scope).otherwise(F.col("class_name"))
    return hits.withColumn("__asked", asked).join(classes.select(F.col("name").alias("__asked")).distinct(), "__asked", "left_semi").drop("__asked")


def candidate_assets(files: DataFrame) -> DataFrame:
    """Assets worth reading: important ones below a Content folder, each path once."""
    stem = F.regexp_replace(tx.file_name("path"), r"\.[^.]*$", "")
    inside = files.where(F.col("path").contains("/Content/") & F.lower(tx.extension(tx.file_name("path"))).isin("uasset", "umap"))
    kept = inside.where(assets.is_important(stem, tx.extension(tx.file_name("path"))))
    return kept.select(tx.normalize_path("path").alias("path")).distinct()


def find_asset_file(files: DataFrame, asset: str) -> DataFrame:
    """The file of an object path: that name as .uasset or .umap, where the path holds the
    asset's folders; the first in order of path."""
    relative = asset.replace("/Game/", "Content/", 1)
    name = relative.rsplit("/", 1)[-1]
    plain = tx.normalize_path("path")
    hits = files.where(tx.file_name(plain).isin(f"{name}.uasset", f"{name}.umap") & plain.contains(relative))
    return top(hits.select("path"), ["path"], 1).drop("ord")


def platforms(files: DataFrame, project: str, engine: str | None = None) -> DataFrame:
    """(name) of the platforms that have a folder below the configuration or platform
    folders: one of the known, or one with a layer, a description or a folder of its own."""
    roots = [f"{project}/Config", f"{project}/Platforms", *([f"{engine}/Config", f"{engine}/Platforms"] if engine else [])]
    found = None
    for root in roots:
        below = files.where(F.col("path").startswith(root + "/")).select(F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("rest"))
        parts = F.split("rest", "/")
        deep = below.where(F.size(parts) > 1).select(F.element_at(parts, 1).alias("name"), F.element_at(parts, 2).alias("next"), (F.size(parts) > 2).alias("deeper"))
        known = F.col("name").isin(*PLATFORMS)
        own = (F.col("next") == F.concat("name", F.lit("Engine.ini"))) | (F.col("next") == "DataDrivenPlatformInfo.ini") | ((F.col("next") == "Config") & F.col("deeper"))
        one = deep.where(known | (own & ~F.col("name").startswith("."))).select("name")
        found = one if found is None else found.union(one)
    return found.distinct()
