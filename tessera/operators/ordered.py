"""Ordered unions in which the first row of a key wins, paging, and two-source merges.

Row order is data here: every source carries its ordinal, so results do not depend on
how rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, order: Sequence[Column | str], n: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + n - 1 of the order, with `ord` counted from 0.

    The limit comes first, so numbering meets offset + n rows whatever df holds.
    """
    head = df.orderBy(*order).limit(n + offset)
    numbered = head.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where(F.col("ord") >= offset) if offset else numbered


def staged_union(stages: Sequence[DataFrame]) -> DataFrame:
    """Union of frames with equal columns, with the `stage` each row came from."""
    out = None
    for i, df in enumerate(stages):
        tagged = df.withColumn("stage", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """For each key, the first row of the order; null is a key value like others."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lowest_stage(df: DataFrame) -> DataFrame:
    """Fallback cascade: only the rows of the first stage that has any."""
    best = df.agg(F.min("stage").alias("__best"))
    return df.crossJoin(F.broadcast(best)).where(F.col("stage") == F.col("__best")).drop("__best")


def fallback_below(first: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """first, and second too if first has fewer than `least` rows; both with `stage`."""
    enough = first.limit(least).agg(F.count("*").alias("__have"))
    gated = second.withColumn("stage", F.lit(1)).crossJoin(F.broadcast(enough)).where(F.col("__have") < least).drop("__have")
    return first.withColumn("stage", F.lit(0)).unionByName(gated, allowMissingColumns=True)


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """Adds `source` where a row has none."""
    own = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return df.withColumn("source", F.coalesce(own, F.lit(source)))


def append_source(page: DataFrame, more: DataFrame, limit: int, key: Sequence[str] = ()) -> DataFrame:
    """A page of the project (with `ord`), filled up to `limit` rows from the engine's page,
    of which only as many rows count as are missing; with a key, repeats are dropped."""
    have = page.agg(F.count("*").alias("__have"))
    missing = F.greatest(F.lit(1), F.lit(limit) - F.col("__have"))
    gated = more.crossJoin(F.broadcast(have)).where((F.col("__have") < limit) & (F.col("ord") < missing)).drop("__have")
    both = staged_union([tag_source(page, "project"), tag_source(gated, "engine")])
    unique = first_wins(both, key, ["stage", "ord"]) if key else both
    return top(unique, ["stage", "ord"], limit).drop("stage")


def merge_sources(primary: DataFrame, secondary: DataFrame, key: Sequence[str], order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """A page of the primary source, filled up from the secondary, first row of a key
    first.  The secondary counts only while the primary page is short, and its own page
    starts at 0; a row of it repeating a key of the page is dropped."""
    page = tag_source(top(primary, order, limit, offset), "project")
    more = tag_source(top(secondary, order, limit), "engine")
    merged = first_wins(fallback_below(page, more, limit), key, ["stage", "ord"])
    return top(merged.drop("ord"), ["stage", *order], limit).drop("stage")
