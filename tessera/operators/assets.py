"""Inverted asset graph: parents, imports and functions to the assets that use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ascii_lower

IMPORTANT = r"^(BP|ABP|WBP|AM|DA|DT)_"


def is_important(name: Column | str, extension: Column | str) -> Column:
    n, e = (F.col(x) if isinstance(x, str) else x for x in (name, extension))
    return (F.lower(e) == "umap") | ((F.lower(e) == "uasset") & n.rlike(IMPORTANT))


def postings(pairs: DataFrame) -> DataFrame:
    """(kind, key, assets): sorted distinct assets of pairs(kind, key, asset), all in
    lower case."""
    low = pairs.select("kind", ascii_lower("key").alias("key"), ascii_lower("asset").alias("asset")).where("key is not null and asset is not null")
    return low.groupBy("kind", "key").agg(F.sort_array(F.collect_set("asset")).alias("assets"))


def graph_pairs(assets: DataFrame) -> DataFrame:
    """Pairs of assets(asset, parent, imports, functions)."""
    parent = assets.select(F.lit("derived").alias("kind"), F.col("parent").alias("key"), "asset")
    imports = assets.select(F.lit("references"), F.explode("imports"), "asset")
    functions = assets.select(F.lit("functions"), F.explode("functions"), "asset")
    return parent.union(imports).union(functions)


def replace_assets(pairs: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """pairs with those of the changed assets replaced and of the removed ones dropped."""
    gone = changed.select("asset") if removed is None else changed.select("asset").union(removed.select("asset"))
    return pairs.join(gone.distinct(), "asset", "left_anti").select("kind", "key", "asset").unionByName(graph_pairs(changed))


def lookup_names(name: str) -> list[str]:
    """Lower-cased names of a class, with and without its one-letter type prefix."""
    last = name.rsplit(".", 1)[-1] if name.startswith("/Script/") else name
    names = {last.lower()}
    if len(last) > 1 and last[0].lower() in "aufets" and last[1].isupper():
        names.add(last[1:].lower())
    return sorted(names)


def asset_usages(graph: DataFrame, name: str) -> DataFrame:
    """(relation, asset): assets that reference or derive from a class, under any of its
    names; a key matches as a whole or as what follows its last dots, a function key also
    after a colon."""
    match = F.lit(False)
    for n in lookup_names(name):
        dotted = (F.col("key") == n) | F.col("key").endswith("." + n)
        match = match | dotted | ((F.col("kind") == "functions") & F.col("key").contains(":" + n))
    relation = F.when(F.col("kind") == "derived", "derived").otherwise("references")
    return graph.where(match).select(relation.alias("relation"), F.explode("assets").alias("asset")).distinct()


def all_assets(graph: DataFrame) -> DataFrame:
    """Every asset that references or derives from something (functions apart)."""
    return graph.where(F.col("kind").isin("references", "derived")).select(F.explode("assets").alias("asset")).distinct()
