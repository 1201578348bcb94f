"""Catalogue lookups over files, modules, classes, members and enum values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.ordered import fallback_below, first_wins, top

CLASS_LIKE = ("class", "struct", "enum", "UCLASS", "USTRUCT", "UENUM")
STRUCTS = ("struct", "USTRUCT")
SEARCH_CAP, SEARCH_FALLBACK = 500, 50
DISPLAYED_TEXT = ("cpp", "h", "hpp", "inl", "cs", "ini")


def clamp(n: int | None, default: int, least: int, most: int) -> int:
    return max(least, min(most, default if n is None else n))


def directory_tree(paths: DataFrame) -> DataFrame:
    """(id, parent_id, name, path): directories of paths(directory) with all ancestors,
    interned: ids follow the order of the path."""
    every = paths.select(F.explode(tx.path_prefixes("directory")).alias("path")).where("path <> ''").distinct()
    ids = dense_ids(every, "path")
    parent = ids.select(F.col("id").alias("parent_id"), F.col("path").alias("__parent"))
    return (
        ids.withColumn("__up", tx.directory("path")).join(parent, F.col("__up") == F.col("__parent"), "left")
        .select("id", "parent_id", tx.file_name("path").alias("name"), "path")
    )


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """Adds `id`, 0, 1, ... in the order of distinct keys, without one task that sorts
    them all: ranges are numbered apart and shifted by the sizes of those before."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key).withColumn("__r", F.spark_partition_id())
    from tessera.plans.storage import shared_table

    ranged = shared_table(ranged, "ranges")
    sizes = ranged.groupBy("__r").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__r").orderBy(key)) - 1
    return ranged.withColumn("__i", inner).join(F.broadcast(bases), "__r").withColumn("id", F.col("__base") + F.col("__i")).drop("__r", "__i", "__base")


def intern_strings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(text, id) of the distinct trimmed values of the columns."""
    values = None
    for c in columns:
        one = df.select(F.trim(F.col(c)).alias("text")).where("text is not null")
        values = one if values is None else values.union(one)
    return dense_ids(values.distinct(), "text")


def recursive_paths(spark: SparkSession, directories: DataFrame) -> DataFrame:
    """(id, path) of an adjacency list directories(id, parent_id, name), top down."""
    directories.createOrReplaceTempView("__tessera_directories")
    return spark.sql("""
        WITH RECURSIVE paths (id, path) AS (
          SELECT id, name FROM __tessera_directories WHERE parent_id IS NULL
          UNION ALL
          SELECT d.id, CASE WHEN p.path = '/' THEN concat('/', d.name) WHEN d.name = '/' THEN concat(p.path, '/')
                            ELSE concat(p.path, '/', d.name) END
          FROM __tessera_directories d JOIN paths p ON d.parent_id = p.id
        ) SELECT id, path FROM paths""")


def files_in_modules(files: DataFrame, modules: Sequence[str] | DataFrame, extensions: Sequence[str] = (), path_part: str = "") -> DataFrame:
    """Files of modules, given as names or as a frame with module_name."""
    wanted = [e.lstrip(".").lower() for e in extensions]
    if isinstance(modules, DataFrame):
        out = files.join(modules.select("module_name").distinct(), "module_name", "left_semi")
    else:
        out = files.where(F.col("module_name").isin(*modules)) if modules else files.limit(0)
    out = out.where(F.lower("extension").isin(*wanted)) if wanted else out
    return out.where(tx.normalize_path("path").contains(path_part)) if path_part else out


def search_files_in_modules(files: DataFrame, modules: Sequence[str] | DataFrame, part: str, limit: int = 100) -> DataFrame:
    """Case-insensitive path filter within modules, the first `limit` in path order."""
    return top(files_in_modules(files, modules).where(tx.contains_ci("path", part)), ["path", "file_id"], limit)


def search_files(files: DataFrame, part: str) -> DataFrame:
    """Files whose name holds the part; if these are fewer than SEARCH_FALLBACK, also
    those whose path does.  A path appears once; at most SEARCH_CAP rows."""
    if not part.strip():
        return files.limit(0).withColumn("stage", F.lit(0))
    order = ["path", "file_id"]
    by_name = top(files.where(tx.contains_ci("filename", part)), ["filename", *order], SEARCH_CAP)
    by_path = top(files.where(tx.contains_ci("path", part)), order, SEARCH_CAP)
    merged = first_wins(fallback_below(by_name, by_path, SEARCH_FALLBACK), ["path"], ["stage", "ord"])
    return merged.orderBy("stage", "ord").limit(SEARCH_CAP).drop("ord")


def find_file(files: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(path) with the file_id of the exact path, else the smallest of the base
    name, else null; `matched` says which."""
    wanted = paths.select(F.col("path").alias("wanted")).distinct()
    exact = files.groupBy(F.col("path").alias("wanted")).agg(F.min("file_id").alias("exact_id"))
    base = files.groupBy(F.col("filename").alias("__base")).agg(F.min("file_id").alias("base_id"))
    found = wanted.join(exact, "wanted", "left").join(base, tx.file_name("wanted") == F.col("__base"), "left")
    how = F.when(F.col("exact_id").isNotNull(), "path").when(F.col("base_id").isNotNull(), "name")
    return found.select("wanted", F.coalesce("exact_id", "base_id").alias("file_id"), how.alias("matched"))


def symbols_of_type(classes: DataFrame, types: Sequence[str]) -> DataFrame:
    return classes.where(F.col("symbol_type").isin(*types) & ~F.col("name").startswith("("))


def classes_with_prefix(classes: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Case-insensitive prefix; % and _ in it are wildcards.  Blank finds nothing."""
    if not prefix.strip():
        return classes.limit(0)
    return top(classes.where(tx.like_ci("name", prefix + "%")), ["name", "class_id"], clamp(limit, 50, 1, 1000))


def members_nested(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Each class with its members as an array of structs in line order."""
    fields = [c for c in ("line", "name", "type", "access", "return_type") if c in members.columns]
    nested = members.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("members"))
    return classes.join(nested, "class_id", "left").withColumn("members", F.coalesce("members", F.array().cast(nested.schema["members"].dataType)))


def classes_by_path(classes: DataFrame) -> DataFrame:
    """(path, items): the classes of each path, as structs in line order."""
    item = F.struct("line", "name", F.col("symbol_type").alias("type"), "base")
    return classes.groupBy("path").agg(F.sort_array(F.collect_list(item)).alias("items"))


def enum_candidates(name: str) -> list[str]:
    """Names under which an enum may be known: itself, and both sides of its last ::."""
    left, sep, right = name.rpartition("::")
    return list(dict.fromkeys([name, left, right] if sep else [name]))


def enum_values(values: DataFrame, name: str) -> DataFrame:
    """Values of the first candidate name that has any, in line order."""
    ranks = F.create_map(*(x for i, c in enumerate(enum_candidates(name)) for x in (F.lit(c), F.lit(i))))
    hits = values.withColumn("stage", F.try_element_at(ranks, F.col("enum_name"))).where("stage is not null")
    from tessera.operators.ordered import lowest_stage

    return lowest_stage(hits).orderBy("line", "name")


def access_pivot(members: DataFrame) -> DataFrame:
    """Counts of functions and fields of each class by access: one row a class."""
    is_function = F.lower("type").contains("function")
    counts = [
        F.count_if((is_function if kind == "methods" else ~is_function) & (F.col("access") == access)).alias(f"{access}_{kind}")
        for kind in ("methods", "fields") for access in ("public", "protected", "private")
    ]
    return members.groupBy("class_name").agg(*counts)


def type_rank(path: Column | str = "path") -> Column:
    """Preference of a definition's place: headers before the rest, generated ones last."""
    p = F.lower(tx.col(path))
    by_ext = F.when(p.endswith(".h"), 0).when(p.endswith(".hpp"), 1).when(p.endswith(".inl"), 2).otherwise(3)
    return F.when(p.contains(".generated."), 10).otherwise(0) + by_ext


def impl_order() -> list[Column]:
    """Order that prefers implementations, and of these those in source files."""
    p = F.lower("path")
    by_ext = F.when(p.endswith(".cpp"), 0).when(p.endswith(".cc"), 1).when(p.endswith(".cxx"), 2).otherwise(3)
    return [F.when(F.col("access") == "impl", 0).otherwise(1), by_ext, F.col("line")]


def declaration_order() -> list[Column]:
    """Order that prefers declarations outside generated files, by kind of folder."""
    return [F.when(F.col("access") == "impl", 1).otherwise(0), F.when(F.lower("path").contains(".generated."), 1).otherwise(0), header_rank(), F.col("line")]


def header_rank(path: Column | str = "path") -> Column:
    p = tx.col(path)
    return F.when(p.contains("/Public/"), 0).when(p.contains("/Classes/"), 1).when(p.contains("/Private/"), 2).otherwise(3)
