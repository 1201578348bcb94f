"""Files into tables: folder walks, text and binary readers, project descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

# What is read as source, what is searched as text, what is walked around.
SOURCE_EXTENSIONS = ("h", "hpp", "inl", "c", "cc", "cpp", "cxx")
TEXT_EXTENSIONS = ("h", "hpp", "inl", "c", "cc", "cpp", "cxx", "cs", "ini", "usf", "ush", "json", "uplugin", "uproject", "txt")
EXCLUDED = (".git", ".vs", ".idea", "binaries", "build", "deriveddatacache", "intermediate", "saved", "node_modules")
MARKERS = ("#include", "UCLASS", "USTRUCT", "UENUM", "UINTERFACE", "UDELEGATE", "UFUNCTION", "UPROPERTY", "GENERATED_BODY", "DECLARE_")


def walk(spark: SparkSession, roots: Sequence[str], extensions: Sequence[str], excluded: Sequence[str] = EXCLUDED) -> DataFrame:
    """(path, mtime, size, content) of the files below the roots with given extensions,
    outside excluded folders (any case).  Listing runs in parallel; contents are read
    only by what selects them."""
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    path = F.regexp_replace("path", "^file:(//)?", "")
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.size(F.split(path, "/")) - 1)
    kept = out.withColumn("path", path).where(~F.arrays_overlap(folders, F.array(*map(F.lit, excluded))))
    kept = kept.where(tx.extension(tx.file_name("path")).isin(*[e.lstrip(".").lower() for e in extensions]))
    return kept.select("path", F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def file_table(walked: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """The index's files: name, folder, extension, header flag, hash, and the module with
    the longest root (modules: root, name)."""
    f = walked.withColumn("filename", tx.file_name("path")).withColumn("directory", tx.directory("path")).withColumn("extension", tx.extension("filename"))
    f = f.withColumn("is_header", F.col("extension").isin("h", "hpp", "inl")).withColumn("file_hash", F.sha2("content", 256)).withColumn("file_id", F.xxhash64("path"))
    if modules is not None:
        from tessera.operators.links import longest_prefix

        best = longest_prefix(f.select("path"), modules.select("root")).withColumnRenamed("root", "module_root")
        names = modules.groupBy(F.col("root").alias("module_root")).agg(F.min("name").alias("module_name"))
        f = f.join(best, "path", "left").join(names, "module_root", "left")
    return f.drop("content")


def texts(walked: DataFrame, extensions: Sequence[str] = TEXT_EXTENSIONS) -> DataFrame:
    """(path, text) of the walked text files; bytes that are no UTF-8 become U+FFFD."""
    kept = walked.where(tx.extension(tx.file_name("path")).isin(*extensions))
    return kept.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def is_interesting_header(content: Column | str) -> Column:
    """Cheap test before parsing: whether any marker occurs."""
    c = tx.col(content)
    hit = F.lit(False)
    for m in MARKERS:
        hit = hit | c.contains(m)
    return hit


def changed(walked: DataFrame, known: DataFrame) -> DataFrame:
    """Walked files whose hash differs from known(path, file_hash), new ones included."""
    hashed = walked.withColumn("file_hash", F.sha2("content", 256))
    return hashed.join(known.select("path", "file_hash"), ["path", "file_hash"], "left_anti")


def ini_items(texts: DataFrame) -> DataFrame:
    """(path, line, section, op, key, value) of ini texts(path, text): + adds, - removes,
    ! clears, else sets; lines that start with ; or # are comments."""
    from pyspark.sql import Window

    lines = texts.select("path", F.posexplode(tx.text_lines("text")).alias("line", "raw")).withColumn("raw", tx.strip("raw"))
    head = F.regexp_extract("raw", r"^\[(.*)\]$", 1)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.last(F.when(F.col("raw").rlike(r"^\[.*\]$"), head), ignorenulls=True).over(w))
    pairs = lines.where(F.col("raw").contains("=") & ~F.col("raw").rlike(r"^[;#\[]") & F.col("section").isNotNull())
    sign = F.substring("raw", 1, 1)
    op = F.when(sign == "+", "add").when(sign == "-", "remove").when(sign == "!", "clear").otherwise("set")
    body = F.when(op == "set", F.col("raw")).otherwise(F.substring("raw", F.lit(2), F.length("raw")))
    key = tx.strip(F.substring_index(body, "=", 1))
    value = tx.strip(F.substring(body, F.instr(body, "=") + 1, F.length(body)))
    return pairs.select("path", "line", "section", op.alias("op"), key.alias("key"), value.alias("value"))


def config_stack(project: str, engine: str | None, platform: str | None, kind: str) -> list[str]:
    """Layer files of a configuration kind, lowest first, for a platform (None: default)."""
    unix = ["Unix"] if platform in ("Linux", "LinuxArm64") else ["Apple"] if platform in ("Mac", "IOS", "TVOS") else []
    layers = []
    if engine:
        layers += [f"{engine}/Config/Base.ini", f"{engine}/Config/Base{kind}.ini"]
        layers += [f"{engine}/Config/{p}/{p}{kind}.ini" for p in unix]
        layers += [f"{engine}/Config/{platform}/{platform}{kind}.ini", f"{engine}/Platforms/{platform}/Config/{platform}{kind}.ini"] if platform else []
    layers += [f"{project}/Config/Default{kind}.ini"]
    if platform:
        layers += [f"{project}/Config/{p}/{p}{kind}.ini" for p in unix]
        layers += [f"{project}/Config/{platform}/{platform}{kind}.ini", f"{project}/Platforms/{platform}/Config/{platform}{kind}.ini"]
    return layers


def resolve_config(items: DataFrame, stack: Sequence[str]) -> DataFrame:
    """Final values and histories over the layers of a stack; missing files are skipped."""
    from tessera.operators.oplog import fold

    spark = items.sparkSession
    layers = spark.createDataFrame([(p, i) for i, p in enumerate(stack)] or [("", 0)], "path string, layer int")
    return fold(items.join(F.broadcast(layers), "path"), ["section", "key"], ["layer", "line"])


def build_dependencies(texts: DataFrame) -> DataFrame:
    """(path, scope, name): module names in the dependency lists of build scripts."""
    out = None
    for scope in ("Public", "Private"):
        block = F.regexp_extract_all("text", F.lit(rf"{scope}DependencyModuleNames\s*\.\s*Add(?:Range)?\s*\(([^;]*)\)\s*;"), F.lit(1))
        one = texts.select("path", F.lit(scope).alias("scope"), F.explode(F.flatten(F.transform(block, lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))).alias("name"))
        out = one if out is None else out.union(one)
    return out.distinct()


def version_rows(text: str) -> list[tuple[str, str]]:
    """Key and value rows of a build version file."""
    import json

    data = json.loads(text)
    names = ("MajorVersion", "MinorVersion", "PatchVersion", "BranchName")
    return [(n, str(data[n])) for n in names if n in data]
