"""The index: its tables, building it from files, keeping it current."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import links
from tessera.sources import cpp
from tessera.sources import files as fs

VERSION = 1
SCHEMAS = {
    "files": "file_id long, path string, filename string, directory string, extension string, mtime long, size long, is_header boolean, file_hash string, module_name string, module_root string",
    "modules": "name string, type string, scope string, root string, owner string, component string, deps array<string>",
    "components": "name string, display_name string, type string, owner string, root_path string",
    "classes": "class_id long, name string, symbol_type string, base string, path string, line long, end_line long",
    "members": "member_id long, class_id long, class_name string, name string, type string, access string, detail string, return_type string, path string, line long",
    "enum_values": "enum_name string, name string, path string, line long",
    "inheritance": "child_id long, child string, parent string, parent_id long",
    "includes": "path string, include_path string, base_name string, resolved string",
    "calls": "path string, name string, line long",
    "texts": "path string, text string",
    "meta": "key string, value string",
}


@dataclass(frozen=True)
class Index:
    files: DataFrame
    modules: DataFrame
    components: DataFrame
    classes: DataFrame
    members: DataFrame
    enum_values: DataFrame
    inheritance: DataFrame
    includes: DataFrame
    calls: DataFrame
    texts: DataFrame
    meta: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def symbols(self) -> DataFrame:
        """Classes and members as one table to search."""
        place = self.files.groupBy("path").agg(F.min("module_name").alias("module_name"))
        c = self.classes.select(F.col("class_id").alias("id"), "name", F.col("symbol_type").alias("type"), F.lit(None).cast("string").alias("class_name"), "path", "line")
        m = self.members.select(F.col("member_id").alias("id"), "name", "type", "class_name", "path", "line")
        return c.union(m).join(place, "path", "left").select("id", "name", "type", "class_name", "module_name", "path", "line")

    def save(self, folder: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{folder}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Index:
        """The saved index; one of another version is refused."""
        out = Index(**{f.name: spark.read.schema(SCHEMAS[f.name]).parquet(f"{folder}/{f.name}") for f in fields(Index)})
        if out.meta.where((F.col("key") == "version") & (F.col("value") == str(VERSION))).isEmpty():
            raise ValueError(f"{folder}: index of another version")
        return out


def empty(spark: SparkSession) -> Index:
    return Index(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def _shaped(df: DataFrame, table: str) -> DataFrame:
    wanted = [c.split(" ", 1) for c in SCHEMAS[table].split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted))


def symbol_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Normalised tables of parsed symbol rows, edges not yet bound."""
    of = lambda kind: parsed.where(F.col("kind") == kind)
    classes = of("class").select(F.xxhash64("path", "name", "line").alias("class_id"), "name", F.col("type").alias("symbol_type"), F.substring_index("base", ",", 1).alias("base"), F.col("base").alias("bases"), "path", "line", "end_line")
    own = classes.groupBy(F.col("path").alias("__p"), F.col("name").alias("owner")).agg(F.min("class_id").alias("here"))
    any_ = classes.groupBy(F.col("name").alias("owner")).agg(F.min("class_id").alias("there"))
    members = of("member").join(own, (F.col("path") == F.col("__p")) & (of("member")["owner"] == own["owner"]), "left").drop(own["owner"]).join(any_, "owner", "left")
    members = members.select(
        F.xxhash64("path", "owner", "name", "line").alias("member_id"), F.coalesce("here", "there").alias("class_id"), F.col("owner").alias("class_name"),
        "name", "type", "access", "detail", "return_type", "path", "line",
    )
    edges = classes.where("bases is not null").select(F.col("class_id").alias("child_id"), F.col("name").alias("child"), F.explode(F.split("bases", ",")).alias("parent"))
    includes = of("include").select("path", F.col("name").alias("include_path"), tx.file_name("name").alias("base_name"))
    return {
        "classes": _shaped(classes, "classes"), "members": _shaped(members, "members"), "inheritance": _shaped(edges, "inheritance"),
        "includes": _shaped(includes, "includes"), "calls": _shaped(of("call"), "calls"),
        "enum_values": _shaped(of("enum_value").select(F.col("owner").alias("enum_name"), "name", "path", "line"), "enum_values"),
    }


def bind(index: Index) -> Index:
    """Resolve late edges: a parent by the smallest class of its name, an include by a
    base name that one file alone has."""
    parents = links.resolve_first(index.inheritance.drop("parent_id").withColumnRenamed("parent", "name"), index.classes.select("name", F.col("class_id").alias("id")))
    parents = parents.withColumnRenamed("name", "parent").withColumnRenamed("target_id", "parent_id")
    bound = links.resolve_unique(index.includes.drop("resolved").withColumnRenamed("base_name", "name"), index.files.select(F.col("filename").alias("name"), F.col("path").alias("id")))
    bound = bound.withColumnRenamed("name", "base_name").withColumnRenamed("target_id", "resolved")
    tables = {f.name: getattr(index, f.name) for f in fields(index)}
    return Index(**tables | {"inheritance": _shaped(parents, "inheritance"), "includes": _shaped(bound, "includes")})


def discover_modules(walked: DataFrame, scripts: DataFrame) -> DataFrame:
    """A module for every build script, by its folder, with direct dependencies; and the
    fallback module of what lies outside."""
    stem = F.regexp_replace(tx.file_name("path"), r"(?i)\.build\.cs$", "")
    found = scripts.select("path", stem.alias("name"), tx.directory("path").alias("root")).where(F.lower("path").endswith(".build.cs"))
    deps = fs.build_dependencies(scripts).groupBy("path").agg(F.sort_array(F.collect_set("name")).alias("deps"))
    real = found.join(deps, "path", "left").select("name", F.lit("Runtime").alias("type"), F.lit("Individual").alias("scope"), "root", "deps")
    spark = walked.sparkSession
    rest = spark.createDataFrame([("_Global", "Global", "Global", "", [])], "name string, type string, scope string, root string, deps array<string>")
    return _shaped(real.unionByName(rest), "modules")


def discover_components(descriptions: DataFrame) -> DataFrame:
    """The project and its plugins from their description files(path, text): named for the
    file, shown by their friendly name where they have one, rooted at its folder."""
    low = F.lower("path")
    stem = F.regexp_replace(tx.file_name("path"), r"\.[^.]*$", "")
    shown = F.get_json_object("text", "$.FriendlyName")
    kind = F.when(low.endswith(".uproject"), "Game").when(low.contains("/engine/plugins/"), "Engine").otherwise("Plugin")
    found = descriptions.where(low.endswith(".uproject") | low.endswith(".uplugin"))
    return _shaped(found.select(stem.alias("name"), F.coalesce(F.nullif(shown, F.lit("")), stem).alias("display_name"), kind.alias("type"), stem.alias("owner"), tx.directory("path").alias("root_path")), "components")


def virtual_modules(components: DataFrame) -> DataFrame:
    """Modules without a build script: the configuration of each project."""
    games = components.where("type = 'Game'")
    return _shaped(games.select(F.lit("_GameConfig").alias("name"), F.lit("Config").alias("type"), F.lit("Individual").alias("scope"), F.concat("root_path", F.lit("/Config")).alias("root"), "owner", F.array().cast("array<string>").alias("deps")), "modules")


def owned(modules: DataFrame, components: DataFrame) -> DataFrame:
    """modules with the component whose folder is the longest that holds their root, and
    its owner."""
    places = modules.select(F.col("root").alias("path")).distinct()
    best = links.longest_prefix(places, components.select(F.col("root_path").alias("root"))).withColumnRenamed("root", "__root")
    of = components.groupBy(F.col("root_path").alias("__root")).agg(F.min("name").alias("__component"), F.min_by("owner", "name").alias("__owner"))
    found = modules.join(best.withColumnRenamed("path", "root"), "root", "left").join(of, "__root", "left")
    return _shaped(found.withColumn("component", F.coalesce("component", "__component")).withColumn("owner", F.coalesce("owner", "__owner")), "modules")


def build(spark: SparkSession, roots: Sequence[str], excluded: Sequence[str] = fs.EXCLUDED) -> Index:
    """Index of all files below the roots."""
    walked = fs.walk(spark, roots, [*fs.TEXT_EXTENSIONS, "uasset", "umap"], excluded)
    texts = fs.texts(walked)
    modules = discover_modules(walked, texts.where(tx.extension(tx.file_name("path")) == "cs"))
    components = discover_components(texts.where(tx.extension(tx.file_name("path")).isin("uproject", "uplugin")))
    modules = owned(modules.unionByName(virtual_modules(components)), components)
    source = texts.where(tx.extension(tx.file_name("path")).isin(*fs.SOURCE_EXTENSIONS)).where(fs.is_interesting_header("text") | ~tx.extension(tx.file_name("path")).isin("h", "hpp", "inl"))
    tables = symbol_tables(cpp.parse_sources(source))
    meta = spark.createDataFrame([("version", str(VERSION))], SCHEMAS["meta"])
    files = _shaped(fs.file_table(walked, modules.where("root <> ''")).fillna({"module_name": "_Global"}), "files")
    return bind(Index(files=files, modules=modules, components=components, texts=texts, meta=meta, **tables))


def update(index: Index, changed: DataFrame, deleted: DataFrame | None = None) -> Index:
    """The index after changed(path, text) and deleted(path): rows of those paths are
    replaced in every table, and edges bound anew."""
    spark = index.spark
    gone = changed.select("path")
    gone = gone if deleted is None else gone.union(deleted.select("path"))
    gone = gone.distinct()
    fresh = symbol_tables(cpp.parse_sources(changed)) | {"texts": changed.select("path", "text")}
    named = changed.withColumn("filename", tx.file_name("path")).withColumn("directory", tx.directory("path")).withColumn("extension", tx.extension("filename"))
    for c in ("mtime", "size"):
        named = named if c in named.columns else named.withColumn(c, F.lit(None).cast("long"))
    named = named.withColumn("file_id", F.xxhash64("path")).withColumn("is_header", F.col("extension").isin("h", "hpp", "inl")).withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256))
    old = index.files.select("path", "module_name", "module_root")
    fresh["files"] = _shaped(named.join(old, "path", "left"), "files")
    tables = {f.name: getattr(index, f.name) for f in fields(index)}
    for name, new in fresh.items():
        if name != "inheritance":
            tables[name] = tables[name].join(gone, "path", "left_anti").unionByName(new)
    alive = tables["classes"].select(F.col("class_id").alias("child_id"))
    tables["inheritance"] = index.inheritance.unionByName(fresh["inheritance"]).dropDuplicates(["child_id", "parent"]).join(alive, "child_id", "left_semi")
    return bind(Index(**{n: (df if n == "meta" else df.select(*[c.split(" ")[0] for c in SCHEMAS[n].split(", ")])) for n, df in tables.items()}))


def refresh(index: Index, roots: Sequence[str], excluded: Sequence[str] = fs.EXCLUDED) -> Index:
    """The index brought up to what lies below the roots now.  Files whose time is that of
    the index are not read; of the others, those with the hash of the index are not parsed;
    what is gone is removed."""
    walked = fs.walk(index.spark, roots, fs.TEXT_EXTENSIONS, excluded)
    known = index.files.where(F.col("extension").isin(*fs.TEXT_EXTENSIONS))
    plan = links.refresh_plan(walked, known)
    touched = walked.join(plan.where("action = 'parse'").select("path"), "path", "left_semi")
    changed = fs.changed(touched, known)
    fresh = fs.texts(changed).join(changed.select("path", "mtime", "size"), "path")
    return update(index, fresh, plan.where("action = 'delete'").select("path"))


def save_version(index: Index, folder: str, version: int) -> None:
    """Saves beside earlier versions; a reader sees it once it is whole."""
    index.save(f"{folder}/v{version:012d}")
    done = index.spark.createDataFrame([(version,)], "version long")
    done.coalesce(1).write.mode("append").parquet(f"{folder}/versions")


def load_latest(spark: SparkSession, folder: str) -> tuple[Index, int]:
    """The last whole version and its number."""
    version = spark.read.schema("version long").parquet(f"{folder}/versions").agg(F.max("version")).first()[0]
    return Index.load(spark, f"{folder}/v{version:012d}"), version


def follow(changes: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """Keeps a saved index current over a stream of changes(path, text, deleted): every
    micro-batch makes a version; of several changes of a path in it, one counts.  A batch
    that is run again replaces the version it made."""
    from tessera.streaming.changes import maintain

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        index, version = load_latest(spark, folder)
        if version > epoch:  # this epoch, made whole before a failure
            return
        last = batch.groupBy("path").agg(F.max_by("text", F.struct("deleted", "text")).alias("text"), F.max("deleted").alias("deleted"))
        save_version(update(index, last.where("not deleted").select("path", "text"), last.where("deleted").select("path")), folder, epoch + 1)

    return maintain(changes, apply, checkpoint, trigger)
