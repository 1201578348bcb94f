"""Binding late edges, matching by prefix and by interval, and diffing snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordered import first_wins


def resolve_first(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """edges(name, ...) with `target_id`: the smallest id of targets(name, id), or null."""
    best = targets.groupBy("name").agg(F.min("id").alias("target_id"))
    return edges.join(best, "name", "left")


def resolve_unique(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """As resolve_first, but only names that one target alone has are bound."""
    single = targets.groupBy("name").agg(F.count("*").alias("__n"), F.min("id").alias("target_id")).where("__n = 1").drop("__n")
    return edges.join(single, "name", "left")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """paths(path) with `root`: the longest of roots(root) that is a prefix of it, in any
    case, as plain text (/a/b is one of /a/bc).

    Only as many prefixes of a path are tried as roots have different lengths, each by
    equality, so no path meets every root.
    """
    lengths = roots.agg(F.sort_array(F.collect_set(F.length("root"))).alias("__lengths"))
    keyed = roots.groupBy(F.lower("root").alias("__key")).agg(F.min("root").alias("root"))
    own = paths.select("path").distinct().crossJoin(F.broadcast(lengths))
    tries = own.select("path", F.explode(F.filter("__lengths", lambda n: n <= F.length("path"))).alias("__n"))
    tries = tries.withColumn("__key", F.lower(F.substring("path", F.lit(1), F.col("__n"))))
    hits = tries.join(keyed, "__key").groupBy("path").agg(F.max_by("root", "__n").alias("root"))
    return paths.join(hits, "path", "left")


def holding(points: DataFrame, intervals: DataFrame, scope: str) -> DataFrame:
    """Pairs of points(scope, start, stop) and the intervals(scope, lo, hi) that hold them.

    An interval stands in the one or two cells of its own width (a power of two) that it
    touches; a point looks into its cell of every width in use.  So a point meets what lies
    near it, not all of its scope.
    """
    width = lambda level: F.pow(F.lit(2.0), level)
    cell = lambda at, level: F.floor(F.col(at) / width(F.col(level))).cast("long")
    sized = intervals.where("lo <= hi").withColumn("__level", F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))).cast("int"))
    cells = sized.withColumn("__cell", F.explode(F.array_distinct(F.array(cell("lo", "__level"), cell("hi", "__level"))))).withColumnRenamed(scope, "__scope")
    levels = sized.agg(F.collect_set("__level").alias("__levels"))  # some sixty at most
    asked = points.crossJoin(F.broadcast(levels)).withColumn("__at", F.explode("__levels")).withColumn("__of", cell("start", "__at")).drop("__levels")
    meets = (F.col(scope) == F.col("__scope")) & (F.col("__at") == F.col("__level")) & (F.col("__of") == F.col("__cell"))
    found = asked.join(cells, meets & (F.col("lo") <= F.col("start")) & (F.col("stop") <= F.col("hi")))
    return found.drop("__scope", "__level", "__cell", "__at", "__of")


def innermost(points: DataFrame, intervals: DataFrame, scope: str) -> DataFrame:
    """points(scope, id, start, stop) with `owner`: the shortest of intervals(scope,
    owner, lo, hi) that holds them."""
    best = first_wins(holding(points, intervals, scope), [scope, "id"], [F.col("hi") - F.col("lo"), "owner"])
    return points.join(best.select(scope, "id", "owner"), [scope, "id"], "left")


def nearest_before(probes: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """As-of lookup: probes(key, at) with the value of events(key, at, value) at the
    largest `at` not after their own; null if there is none.

    One sort by key and position carries the last value forward; no pair is formed.
    """
    marks = events.select(key, F.col("at"), F.struct("value").alias("__v"), F.lit(0).alias("__probe"))
    asks = probes.select(key, "at", F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__probe"))
    w = Window.partitionBy(key).orderBy("at", "__probe", "__v").rowsBetween(Window.unboundedPreceding, 0)
    filled = marks.unionByName(asks).withColumn("value", F.last("__v", True).over(w).getField("value"))
    return filled.where("__probe = 1").select(key, "at", "value")


def refresh_plan(disk: DataFrame, index: DataFrame) -> DataFrame:
    """What to do with each path of disk(path, mtime) or index(path, mtime): parse what
    is new or changed, keep what is equal, delete what is gone."""
    d, i = disk.select("path", F.col("mtime").alias("disk_mtime")), index.select("path", F.col("mtime").alias("index_mtime"))
    action = (
        F.when(F.col("disk_mtime").isNull(), "delete").when(F.col("index_mtime").isNull(), "parse")
        .when(F.col("disk_mtime") != F.col("index_mtime"), "parse").otherwise("keep")
    )
    return d.join(i, "path", "full").withColumn("action", action)


def upsert(old: DataFrame, new: DataFrame, key: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """old with the rows of new in place of those of their keys, without deleted keys."""
    kept = old.join(new.select(*key).distinct(), key, "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def header_sources(headers: DataFrame) -> DataFrame:
    """headers(path) with the places where their implementation may be: the same folder,
    and /Private/ in place of /Public/ or /Classes/, each as .cpp, .cc and .cxx."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    private = F.regexp_replace(stem, "/(Public|Classes)/", "/Private/")
    bases = F.array_distinct(F.array(private, stem))
    sources = F.flatten(F.transform(bases, lambda b: F.array(*(F.concat(b, F.lit(e)) for e in (".cpp", ".cc", ".cxx")))))
    return headers.select("*", F.explode(sources).alias("source"))


def without_definition(declared: DataFrame, sources: DataFrame) -> DataFrame:
    """Anti-join by containment: declared(path, signature) that none of their candidate
    sources(path, text) holds, blanks collapsed on both sides."""
    plain = lambda c: F.regexp_replace(tx.strip(c), r"\s+", " ")
    asked = header_sources(declared).select("path", "signature", F.col("source").alias("__at"))
    held = asked.join(sources.select(F.col("path").alias("__at"), plain(F.col("text")).alias("__text")), "__at")
    defined = held.where(F.col("__text").contains(plain(F.col("signature")))).select("path", "signature").distinct()
    return declared.join(defined, ["path", "signature"], "left_anti")


