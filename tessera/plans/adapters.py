"""Index views over generic tables, and the same views as SQL for checking.

pages give files, modules and html; part gives symbols; orders and lineitem give classes
and their members; documents give lines of text; events give an operation log.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.index import SCHEMAS, Index, _shaped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    out = table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.rtrim(bare, F.lit("/")).alias("path"))
    out = out.withColumn("filename", tx.file_name("path")).withColumn("directory", tx.directory("path"))
    out = out.withColumn("extension", tx.extension("filename")).withColumn("module_root", F.substring_index("path", "/", 2))
    return out.withColumn("module_name", F.substring_index("path", "/", 1))


FILES = """files AS (
  SELECT file_id, path, regexp_extract(path, '[^/]*$') AS filename,
         CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS directory,
         CASE WHEN contains(regexp_extract(path, '[^/]*$'), '.') THEN lower(regexp_extract(path, '[^./]*$')) END AS extension,
         split_part(path, '/', 1) AS module_name,
         CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE path END AS module_root
  FROM (SELECT page_id AS file_id, rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages) p
)"""


def modules(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and their first folders: nested roots."""
    f = files(spark, d)
    roots = f.select(F.col("module_name").alias("root")).union(f.select("module_root")).distinct()
    return roots.withColumn("name", F.col("root")).withColumn("type", F.when(F.col("root").contains("/"), "Runtime").otherwise("Global"))


MODULES = """modules AS (
  SELECT root, root AS name, CASE WHEN contains(root, '/') THEN 'Runtime' ELSE 'Global' END AS type
  FROM (SELECT module_name AS root FROM files UNION SELECT module_root FROM files) r
)"""


def symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("class_name"),
        F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("module_name"), F.concat_ws("/", F.lit("parts"), "p_type", "p_brand").alias("path"),
        F.col("p_size").cast("long").alias("line"),
    )


SYMBOLS = """symbols AS (
  SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS class_name, 'm' || (p_size % 5) AS module_name,
         'parts/' || p_type || '/' || p_brand AS path, CAST(p_size AS BIGINT) AS line FROM part
)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "text")


LINES = """lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t
)"""


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Tags and what follows them, one `line` each."""
    t = table(spark, d, "pages")
    return t.select(F.col("page_id").cast("string").alias("path"), F.posexplode(F.split("html", "<")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


FRAGMENTS = """fragments AS (
  SELECT CAST(page_id AS VARCHAR) AS path, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS text
  FROM (SELECT page_id, string_split(html, '<') AS parts FROM pages) t
)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cyclic edges k -> 7k + 3 and k -> 2k + 1, modulo the number of parts."""
    p = table(spark, d, "part").select("p_partkey")
    n = F.broadcast(p.agg(F.count("*").alias("n")))
    both = p.crossJoin(n).select("p_partkey", F.explode(F.array((F.col("p_partkey") * 7 + 3) % F.col("n"), (F.col("p_partkey") * 2 + 1) % F.col("n"))).alias("dst"))
    return both.select(F.col("p_partkey").alias("src"), "dst")


PART_EDGES = """edges AS (
  SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part
  UNION SELECT p_partkey, (p_partkey * 2 + 1) % (SELECT count(*) FROM part) FROM part
)"""


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a hierarchy with two parents, k -> k // 2 and k -> k // 3."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    both = p.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst"))
    return both.where("src <> dst").select("src", F.col("dst").cast("long").alias("dst"))


PARENTS = """parents AS (
  SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0
)"""


@lru_cache(maxsize=4)
def index(spark: SparkSession, d: str, part: int | None = None) -> Index:
    """An index over the generic tables: pages are files and texts, part gives classes (all,
    or those whose key has the remainder `part` modulo 2), lineitem members, events calls.
    """
    n = F.broadcast(table(spark, d, "pages").agg(F.count("*").alias("n_files")))
    at = lambda df, key: df.crossJoin(n).withColumn("__at", F.col(key) % F.col("n_files")).join(files(spark, d).select(F.col("file_id").alias("__at"), "path"), "__at")
    p, li, ev = table(spark, d, "part"), table(spark, d, "lineitem"), table(spark, d, "events")
    if part is not None:
        p, li, ev = p.where(F.col("p_partkey") % 2 == part), li.where(F.col("l_partkey") % 2 == part), ev.where(F.col("event_id") % 2 == part)
    key = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("C"), c)
    up = F.floor(key / 2).cast("long")
    classes = at(p, "p_partkey").select(
        key.alias("class_id"), name(key).alias("name"), F.element_at(F.array(*map(F.lit, ("class", "struct", "enum"))), (key % 3 + 1).cast("int")).alias("symbol_type"),
        F.when(key > 0, name(up)).alias("base"), "path", F.col("p_size").cast("long").alias("line"), (F.col("p_size") + 10).cast("long").alias("end_line"),
    )
    edges = p.where("p_partkey > 0").select(key.alias("child_id"), name(key).alias("child"), name(up).alias("parent"), F.when(key % 5 > 0, up).alias("parent_id"))
    member = li.withColumn("member_id", F.col("l_orderkey") * 8 + F.col("l_linenumber") + (1 << 40)).groupBy("member_id").agg(
        *(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"))
    )
    access = F.when(F.col("l_returnflag") == "A", "public").when(F.col("l_returnflag") == "N", "protected").otherwise("impl")
    members = at(member, "l_suppkey").select(
        "member_id", F.col("l_partkey").alias("class_id"), name(F.col("l_partkey")).alias("class_name"), F.concat(F.lit("m"), F.col("l_suppkey") % 50).alias("name"),
        F.when(F.col("l_linestatus") == "F", "function").otherwise("property").alias("type"), access.alias("access"),
        F.when(F.col("l_suppkey") % 2 == 0, "(int a, TMap<int, int> b)").otherwise("()").alias("detail"), name(F.col("l_suppkey")).alias("return_type"), "path", (F.col("l_linenumber") * 10).cast("long").alias("line"),
    )
    calls = at(ev, "event_id").select("path", F.concat(F.lit("m"), F.col("user_id") % 50).alias("name"), F.col("event_id").alias("line"))
    values = p.where("p_partkey % 3 = 2").select(name(key).alias("enum_name"), F.explode(F.array(F.lit("Red"), F.lit("Blue"))).alias("color"), key)
    f = files(spark, d)
    into = f.select("path", (F.col("file_id") * 7 + 3).alias("to")).crossJoin(n).withColumn("to", F.col("to") % F.col("n_files")).join(f.select(F.col("file_id").alias("to"), F.col("path").alias("resolved"), F.col("filename").alias("base_name")), "to")
    return Index(
        files=_shaped(f, "files"), modules=_shaped(modules(spark, d), "modules"), components=spark.createDataFrame([], SCHEMAS["components"]), classes=_shaped(classes, "classes"),
        members=_shaped(members, "members"), inheritance=_shaped(edges, "inheritance"), calls=_shaped(calls, "calls"),
        enum_values=_shaped(values.select("enum_name", F.concat(F.lit("V"), "color", "p_partkey").alias("name"), F.lit("e").alias("path"), F.col("p_partkey").alias("line")), "enum_values"),
        includes=_shaped(into.withColumn("include_path", F.col("resolved")), "includes"),
        texts=_shaped(table(spark, d, "pages").select(F.col("page_id").alias("file_id"), F.col("html").alias("text")).join(f.select("file_id", "path"), "file_id"), "texts"),
        meta=spark.createDataFrame([("version", "1")], SCHEMAS["meta"]),
    )


def index_sql(part: int | None = None, prefix: str = "") -> str:
    """The tables of `index` as views; with a prefix, of another part beside them."""
    of = lambda key: "" if part is None else f"WHERE {key} % 2 = {part}"
    and_ = lambda key: "" if part is None else f"AND {key} % 2 = {part}"
    return f"""
{prefix}classes AS (SELECT p_partkey AS class_id, 'C' || p_partkey AS name, ['class', 'struct', 'enum'][p_partkey % 3 + 1] AS symbol_type, CASE WHEN p_partkey > 0 THEN 'C' || (p_partkey // 2) END AS base, f.path, p_size AS line
  FROM part JOIN files f ON f.file_id = p_partkey % (SELECT count(*) FROM pages) {of("p_partkey")}),
{prefix}inheritance AS (SELECT p_partkey AS child_id, 'C' || p_partkey AS child, 'C' || (p_partkey // 2) AS parent, p_partkey // 2 AS parent_id FROM part WHERE p_partkey > 0 {and_("p_partkey")}),
{prefix}members AS (SELECT m.member_id, m.l_partkey AS class_id, 'C' || m.l_partkey AS class_name, 'm' || (m.l_suppkey % 50) AS name, CASE WHEN m.l_linestatus = 'F' THEN 'function' ELSE 'property' END AS type,
    CASE m.l_returnflag WHEN 'A' THEN 'public' WHEN 'N' THEN 'protected' ELSE 'impl' END AS access, CASE WHEN m.l_suppkey % 2 = 0 THEN '(int a, TMap<int, int> b)' ELSE '()' END AS detail,
    'C' || m.l_suppkey AS return_type, f.path, m.l_linenumber * 10 AS line
  FROM (SELECT l_orderkey * 8 + l_linenumber + {1 << 40} AS member_id, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_linenumber) AS l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
        FROM lineitem {of("l_partkey")} GROUP BY 1) m JOIN files f ON f.file_id = m.l_suppkey % (SELECT count(*) FROM pages)),
{prefix}calls AS (SELECT f.path, 'm' || (user_id % 50) AS name, event_id AS line FROM events JOIN files f ON f.file_id = event_id % (SELECT count(*) FROM pages) {of("event_id")}),
{prefix}all_symbols AS (SELECT s.*, f.module_name FROM (SELECT class_id AS id, name, symbol_type AS type, NULL AS class_name, path, line FROM {prefix}classes
  UNION ALL SELECT member_id, name, type, class_name, path, line FROM {prefix}members) s LEFT JOIN (SELECT path, min(module_name) AS module_name FROM files GROUP BY path) f ON f.path = s.path)"""


def operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "error", "clear").when(F.col("event_type") == "purchase", "remove").otherwise("add")
    return e.select(
        (F.col("user_id") % 10).alias("section"), F.col("user_id").alias("key"), "ts", "event_id", op.alias("op"), (F.col("event_id") % 5).cast("string").alias("value")
    )


OPERATIONS = """operations AS (
  SELECT user_id % 10 AS section, user_id AS key, ts, event_id, CAST(event_id % 5 AS VARCHAR) AS value,
         CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'clear' WHEN 'purchase' THEN 'remove' ELSE 'add' END AS op
  FROM events
)"""
