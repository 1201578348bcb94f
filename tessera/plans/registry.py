"""Queries over the index views, each with the SQL that says the same.

A query's columns are declared once, with s for text and l for whole numbers, and both
sides are cast to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import matching as mt
from tessera.functions import text as tx
from tessera.operators import assets, catalog, completion, diagnostics, graph, links, oplog, ordered, search, usage
from tessera.plans import adapters as ad

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(columns: str, sql: str | None = None, *views: str):
    fields = [c.split(":") for c in columns.split()]

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            kinds = {"s": "string", "l": "long"}
            return fn(spark, sf_dir).select(*(F.col(n).cast(kinds[k]).alias(n) for n, k in fields))

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[fn.__name__] = run
        if sql is not None:
            kinds = {"s": "VARCHAR", "l": "BIGINT"}
            shown = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
            head = "WITH RECURSIVE " + ", ".join(views) + " " if views else ""
            ORACLE_SQL[fn.__name__] = f"{head}SELECT {shown} FROM ({sql}) q"
        return fn

    return register


TIER = "CASE WHEN lower({a}) = '{q}' THEN 0 WHEN starts_with(lower({a}), '{q}') THEN 1 WHEN contains(lower({a}), '{q}') THEN 2 {more} ELSE 9 END"


def _tier(q: str, a: str, *rest: str) -> str:
    return TIER.format(a=a, q=q, more=" ".join(f"WHEN contains(lower(coalesce({r}, '')), '{q}') THEN {i}" for i, r in enumerate(rest, 3)))


# --- files and modules ---------------------------------------------------------------


@query("file_id:l filename:s path:s rank:l ord:l", f"""
SELECT *, row_number() OVER (ORDER BY rank, lower(filename), lower(path), file_id) - 1 AS ord FROM (
  SELECT file_id, filename, path, {_tier("en/7", "filename", "path")} AS rank FROM files
  WHERE contains(lower(filename), 'en/7') OR contains(lower(path), 'en/7')) r ORDER BY ord LIMIT 20""", ad.FILES)
def file_search_ranked(spark, d):
    """Ranked file search: name and path tiers, first 20."""
    return search.search_files_ranked(ad.files(spark, d), "en/7", 20)


@query("parent:s name:s path:s", """
SELECT DISTINCT CASE WHEN n = 1 THEN NULL ELSE array_to_string(parts[1:n-1], '/') END AS parent, parts[n] AS name, array_to_string(parts[1:n], '/') AS path
FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT string_split(directory, '/') AS parts FROM files WHERE directory <> '') a) b""", ad.FILES)
def dir_paths(spark, d):
    """Directory tree, interned, and its paths rebuilt by recursion from the root."""
    tree = catalog.directory_tree(ad.files(spark, d).select("directory"))
    from tessera.plans.storage import shared_table

    tree = shared_table(tree, "tree")
    rebuilt = catalog.recursive_paths(spark, tree.select("id", "parent_id", "name"))
    parent = rebuilt.select(F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return rebuilt.join(tree.select("id", "parent_id", "name"), "id").join(parent, "parent_id", "left")


@query("file_id:l path:s filename:s extension:s module_name:s module_type:s", """
SELECT file_id, path, filename, extension, module_name, m.type AS module_type FROM files LEFT JOIN modules m ON files.module_root = m.root""", ad.FILES, ad.MODULES)
def file_metadata(spark, d):
    """All files with their module's type."""
    m = ad.modules(spark, d).select(F.col("root").alias("__r"), F.col("type").alias("module_type"))
    f = ad.files(spark, d)
    return f.join(m, f.module_root == F.col("__r"), "left")


@query("file_id:l path:s module_name:s extension:s", """
SELECT file_id, path, module_name, extension FROM files
WHERE module_name IN (SELECT module_name FROM files GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) AND extension = 'html' AND contains(path, '/')""", ad.FILES)
def files_in_modules(spark, d):
    """Html files of the three largest modules."""
    f = ad.files(spark, d)
    top = f.groupBy("module_name").count().orderBy(F.desc("count"), "module_name").limit(3)
    return catalog.files_in_modules(f, top, [".HTML"], "/")


@query("file_id:l path:s ord:l", """
SELECT *, row_number() OVER (ORDER BY path, file_id) - 1 AS ord FROM (SELECT file_id, path FROM files WHERE module_name LIKE 'blog.%' AND contains(lower(path), '/e')) f ORDER BY ord LIMIT 100""", ad.FILES)
def files_in_modules_search(spark, d):
    """Path filter within modules, the first 100."""
    f = ad.files(spark, d)
    return catalog.search_files_in_modules(f, f.where("module_name like 'blog.%'"), "/E", 100)


@query("path:s stage:l", """
SELECT path, min(stage) AS stage FROM (
  SELECT path, 0 AS stage FROM (SELECT path FROM files WHERE contains(lower(filename), '88') ORDER BY filename, path, file_id LIMIT 500) a
  UNION ALL
  SELECT path, 1 FROM (SELECT path FROM files WHERE contains(lower(path), '88') ORDER BY path, file_id LIMIT 500) b
  WHERE (SELECT count(*) FROM files WHERE contains(lower(filename), '88')) < 50) u GROUP BY path""", ad.FILES)
def file_search_staged(spark, d):
    """Files by name; by path too where the names give fewer than 50."""
    return catalog.search_files(ad.files(spark, d), "88")


@query("wanted:s file_id:l matched:s", """
SELECT w.wanted, coalesce(e.id, b.id) AS file_id, CASE WHEN e.id IS NOT NULL THEN 'path' WHEN b.id IS NOT NULL THEN 'name' END AS matched
FROM (SELECT DISTINCT CASE WHEN file_id % 2 = 0 THEN path ELSE 'elsewhere/' || filename END AS wanted FROM files
      UNION SELECT 'nowhere/at/all') w
LEFT JOIN (SELECT path, min(file_id) AS id FROM files GROUP BY path) e ON e.path = w.wanted
LEFT JOIN (SELECT filename, min(file_id) AS id FROM files GROUP BY filename) b ON b.filename = regexp_extract(w.wanted, '[^/]*$')""", ad.FILES)
def file_id_fallback(spark, d):
    """File of a path: exact, else by base name, else none."""
    f = ad.files(spark, d)
    asked = f.select(F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise(F.concat(F.lit("elsewhere/"), "filename")).alias("path"))
    return catalog.find_file(f, asked.union(spark.createDataFrame([("nowhere/at/all",)], "path string")))


@query("name:s type:s n_files:l", """
SELECT m.name, m.type, count(f.file_id) AS n_files FROM modules m LEFT JOIN files f ON f.module_root = m.root WHERE contains(lower(m.name), 'example.org') GROUP BY 1, 2""", ad.FILES, ad.MODULES)
def module_search(spark, d):
    """Modules by substring with their number of files."""
    m, f = ad.modules(spark, d), ad.files(spark, d)
    hits = m.where(tx.contains_ci("name", "Example.ORG"))
    counts = f.groupBy("module_root").agg(F.count("*").alias("n"))
    return hits.join(counts, hits.root == counts.module_root, "left").withColumn("n_files", F.coalesce("n", F.lit(0)))


@query("name:s root:s type:s", "SELECT name, root, type FROM modules WHERE name = (SELECT min(name) FROM modules WHERE type = 'Runtime')", ad.FILES, ad.MODULES)
def module_lookup(spark, d):
    """One module by its exact name."""
    m = ad.modules(spark, d)
    first = m.where("type = 'Runtime'").agg(F.min("name").alias("name"))
    return m.join(F.broadcast(first), "name")


@query("file_id:l path:s root:s", """
SELECT file_id, path, root FROM (SELECT f.file_id, f.path, m.root, row_number() OVER (PARTITION BY f.file_id ORDER BY length(m.root) DESC) AS n
FROM files f LEFT JOIN modules m ON starts_with(lower(f.path), lower(m.root))) x WHERE n = 1""", ad.FILES, ad.MODULES)
def longest_prefix_module(spark, d):
    """Module of each file: the longest root that is a prefix of its path."""
    return links.longest_prefix(ad.files(spark, d).select("file_id", "path"), ad.modules(spark, d).select("root"))


# --- symbols -------------------------------------------------------------------------


@query("id:l name:s class_name:s rank:l ord:l", f"""
SELECT *, row_number() OVER (ORDER BY rank, kind_rank, lower(name), path, line, id) - 1 AS ord FROM (
  SELECT id, name, class_name, path, line, {_tier("red ring", "name", "class_name", "module_name", "path")} AS rank,
         CASE WHEN type IN ('class', 'struct', 'enum') THEN 0 WHEN contains(lower(type), 'function') OR contains(lower(type), 'method') THEN 1 ELSE 2 END AS kind_rank
  FROM symbols WHERE contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'red') AND contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'ring')) s
ORDER BY ord LIMIT 30 OFFSET 5""", ad.SYMBOLS)
def symbol_search_ranked(spark, d):
    """Every word somewhere, ranked in tiers; rows 5 to 34."""
    return search.search_symbols(ad.symbols(spark, d), "red ring", 30, 5)


@query("id:l name:s ord:l", """
SELECT id, name, row_number() OVER (ORDER BY lower(name), id) - 1 AS ord FROM symbols WHERE NOT starts_with(name, '(') ORDER BY ord LIMIT 50 OFFSET 100""", ad.SYMBOLS)
def symbol_list_page(spark, d):
    """A page of all symbols by name."""
    return search.search_symbols(ad.symbols(spark, d), "  ", 50, 100)


@query("id:l name:s rank:l quantity:l", f"""
SELECT t.id, t.name, t.rank, CAST(l.l_quantity AS BIGINT) AS quantity FROM (
  SELECT id, name, {_tier("blue", "name", "class_name")} AS rank FROM symbols WHERE contains(lower(name), 'blue') OR contains(lower(class_name), 'blue')
  ORDER BY rank, lower(name), id LIMIT 25) t JOIN lineitem l ON l.l_partkey = t.id""", ad.SYMBOLS)
def fast_find_topk_join(spark, d):
    """Top 25 symbols first; only these meet their places."""
    places = ad.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("quantity"))
    return search.fast_find_symbols(ad.symbols(spark, d), places, "blue", 25)


_KIND = "CASE WHEN type IN ('class', 'struct', 'enum') THEN 0 WHEN contains(lower(type), 'function') OR contains(lower(type), 'method') THEN 1 ELSE 2 END"
# Symbols by their search, files by theirs, and text where these do not fill the page: 60
# of each at most; the first of equal places counts, and the page follows that order.
_GLOBAL = f"""
s AS (SELECT 'symbol' AS kind, name, path, line, 0 AS part, row_number() OVER (ORDER BY {_tier("ring", "name", "class_name", "module_name", "path")}, {_KIND}, lower(name), path, line, id) - 1 AS ord
  FROM symbols WHERE contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'ring') ORDER BY ord LIMIT 60),
f AS (SELECT 'file' AS kind, filename AS name, path, 1 AS line, 1 AS part, row_number() OVER (ORDER BY {_tier("ring", "filename", "path")}, lower(filename), lower(path), file_id) - 1 AS ord FROM files WHERE contains(lower(filename), 'ring') OR contains(lower(path), 'ring') ORDER BY ord LIMIT 60),
t AS (SELECT 'text' AS kind, 'ring' AS name, CAST(doc_id AS VARCHAR) AS path, line, 2 AS part, row_number() OVER (ORDER BY doc_id, line) - 1 AS ord FROM lines WHERE contains(lower(text), 'ring') ORDER BY ord LIMIT 60),
u AS (SELECT * FROM s UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t WHERE (SELECT count(*) FROM (SELECT * FROM s UNION ALL SELECT * FROM f) c) < 60),
v AS (SELECT *, row_number() OVER (PARTITION BY kind, path, line, name ORDER BY part, ord) AS n FROM u)"""


@query("kind:s name:s path:s line:l ord:l", "SELECT kind, name, path, line, row_number() OVER (ORDER BY part, ord) - 1 AS ord FROM v WHERE n = 1 ORDER BY ord LIMIT 50 OFFSET 10", ad.SYMBOLS, ad.FILES, ad.LINES, _GLOBAL)
def global_find(spark, d):
    """Symbols, files and, where these do not fill the page, text hits; once each."""
    sy = ad.symbols(spark, d)
    hits = search.search_symbols(sy, "ring", 60)
    fi = search.search_files_ranked(ad.files(spark, d), "ring", 60)
    te = search.grep(ad.table(spark, d, "documents"), "ring", 60, 0, ("doc_id",))
    return search.global_find(
        search.found(hits, "symbol", F.col("name"), F.col("path"), F.col("line")), search.found(fi, "file", F.col("filename"), F.col("path"), F.lit(1)),
        search.found(te, "text", F.lit("ring"), F.col("doc_id").cast("string"), F.col("line")), 50, 10,
    )


@query("name:s line:l source:s", """
SELECT name, line, source FROM (SELECT *, row_number() OVER (PARTITION BY name, line ORDER BY stage, ord) AS n FROM (
  SELECT name, line, 'project' AS source, 0 AS stage, row_number() OVER (ORDER BY name, line, id) AS ord FROM symbols WHERE id % 2 = 0 AND contains(name, 'hot') QUALIFY ord <= 60
  UNION ALL
  SELECT * FROM (SELECT name, line, 'engine' AS source, 1 AS stage, row_number() OVER (ORDER BY name, line, id) AS ord FROM symbols WHERE id % 2 = 1 AND contains(name, 'hot') QUALIFY ord <= 60) e
  WHERE (SELECT count(*) FROM symbols WHERE id % 2 = 0 AND contains(name, 'hot')) < 60) u) w
WHERE n = 1 ORDER BY stage, name, line LIMIT 60""", ad.SYMBOLS)
def two_source_merge(spark, d):
    """A page of the first source, filled from the second; a repeated key counts once."""
    s = ad.symbols(spark, d).where(F.col("name").contains("hot"))
    return ordered.merge_sources(s.where("id % 2 = 0"), s.where("id % 2 = 1"), ["name", "line"], ["name", "line", "id"], 60)


@query("id:l name:s", "SELECT id, name FROM symbols WHERE name ILIKE 'R__ B%' ORDER BY name, id LIMIT 1000", ad.SYMBOLS)
def prefix_search_wildcard(spark, d):
    """Case-insensitive prefix in which _ and % are wildcards."""
    return catalog.classes_with_prefix(ad.symbols(spark, d).withColumn("class_id", F.col("id")), "R__ B", 5000)


@query("id:l name:s type:s", "SELECT id, name, type FROM symbols WHERE type IN ('SMALL', 'LARGE') AND NOT starts_with(name, '(')", ad.SYMBOLS)
def symbols_by_type(spark, d):
    """Symbols of given types."""
    return catalog.symbols_of_type(ad.symbols(spark, d).withColumn("symbol_type", F.col("type")), ["SMALL", "LARGE"])


@query("class_id:l n_members:l members:s", """
SELECT o_orderkey AS class_id, count(l_linenumber) AS n_members,
       coalesce(string_agg(l_linenumber || ':' || l_partkey || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_partkey, l_returnflag), '') AS members
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def members_nested(spark, d):
    """Classes with their members nested in line order."""
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("class_id"))
    m = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("class_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").alias("type"), F.col("l_partkey"))
    nested = catalog.members_nested(o, m.withColumn("name", F.lpad("name", 12, "0")))
    shown = F.transform("members", lambda x: F.concat_ws(":", x["line"], x["name"].cast("long"), x["type"]))
    return nested.withColumn("n_members", F.size("members")).withColumn("members", F.array_join(shown, ","))


@query("path:s items:s", "SELECT path, string_agg(line || ':' || name || ':' || class_name, ',' ORDER BY line, name, class_name) AS items FROM symbols GROUP BY path", ad.SYMBOLS)
def classes_grouped(spark, d):
    """Classes of each path in line order."""
    s = ad.symbols(spark, d).select("path", "line", "name", F.lit("").alias("symbol_type"), F.col("class_name").alias("base"))
    return catalog.classes_by_path(s).withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line"], x["name"], x["base"])), ","))


@query("enum_name:s name:s line:l", "SELECT class_name AS enum_name, name, line FROM symbols WHERE class_name = 'Brand#7'", ad.SYMBOLS)
def enum_candidates(spark, d):
    """Values of the first candidate of a scoped name that resolves."""
    return catalog.enum_values(ad.symbols(spark, d).withColumn("enum_name", F.col("class_name")), "Shop::Brand#7")


@query("class_name:s public_methods:l protected_methods:l private_methods:l public_fields:l protected_fields:l private_fields:l", """
SELECT l_shipmode AS class_name,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'A') AS public_methods, count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'N') AS protected_methods,
  count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R') AS private_methods, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'A') AS public_fields,
  count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'N') AS protected_fields, count(*) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R') AS private_fields
FROM (SELECT CAST(l_suppkey % 7 AS VARCHAR) AS l_shipmode, l_linestatus, l_returnflag FROM lineitem) x GROUP BY 1""")
def pivot_access(spark, d):
    """Methods and fields of each class by access."""
    access = F.when(F.col("l_returnflag") == "A", "public").when(F.col("l_returnflag") == "N", "protected").otherwise("private")
    kind = F.when(F.col("l_linestatus") == "F", "function").otherwise("property")
    return catalog.access_pivot(ad.table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).cast("string").alias("class_name"), kind.alias("type"), access.alias("access")))


# --- links and snapshots -------------------------------------------------------------


@query("text:s id:l", "SELECT text, row_number() OVER (ORDER BY text) - 1 AS id FROM (SELECT trim(p_name) AS text FROM part UNION SELECT trim(p_brand) FROM part UNION SELECT trim(p_type) FROM part) t")
def intern_strings(spark, d):
    """Distinct trimmed strings with ids in their order."""
    return catalog.intern_strings(ad.table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("src:l name:s target_id:l", """
SELECT src, name, target_id FROM (SELECT p_partkey AS src, CASE WHEN p_partkey % 3 = 0 THEN 'no ' || p_name ELSE p_name END AS name FROM part) e
LEFT JOIN (SELECT p_name, min(p_partkey) AS target_id FROM part GROUP BY p_name) t ON t.p_name = e.name""")
def resolve_first(spark, d):
    """Edges bound to the smallest target of their name."""
    p = ad.table(spark, d, "part")
    edges = p.select(F.col("p_partkey").alias("src"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return links.resolve_first(edges, p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")))


@query("file_id:l name:s target_id:l", """
SELECT f.file_id, f.filename AS name, t.target_id FROM files f LEFT JOIN (SELECT filename, min(file_id) AS target_id FROM files GROUP BY filename HAVING count(*) = 1) t USING (filename)""", ad.FILES)
def resolve_unique(spark, d):
    """Edges bound only where one target alone has the name."""
    f = ad.files(spark, d)
    return links.resolve_unique(f.select("file_id", F.col("filename").alias("name")), f.select(F.col("filename").alias("name"), F.col("file_id").alias("id")))


@query("path:s disk_mtime:l index_mtime:l action:s", """
SELECT coalesce(a.path, b.path) AS path, disk_mtime, index_mtime,
  CASE WHEN disk_mtime IS NULL THEN 'delete' WHEN index_mtime IS NULL THEN 'parse' WHEN disk_mtime <> index_mtime THEN 'parse' ELSE 'keep' END AS action
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey AS disk_mtime FROM orders WHERE o_orderkey % 5 <> 0) a
FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS index_mtime FROM orders WHERE o_orderkey % 3 <> 0) b ON a.path = b.path""")
def refresh_plan(spark, d):
    """Diff of what is on disk and what is indexed."""
    o = ad.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), "o_orderkey", "o_custkey")
    disk = o.where("o_orderkey % 5 <> 0").select("path", F.col("o_custkey").alias("mtime"))
    index = o.where("o_orderkey % 3 <> 0").select("path", (F.col("o_custkey") + (F.col("o_orderkey") % 7 == 0).cast("int")).alias("mtime"))
    return links.refresh_plan(disk, index)


@query("scope:l id:l owner:l", """
SELECT scope, id, owner FROM (SELECT p.scope, p.id, i.owner, row_number() OVER (PARTITION BY p.scope, p.id ORDER BY i.hi - i.lo, i.owner) AS n
 FROM (SELECT o_custkey AS scope, o_orderkey AS id, o_orderkey % 1000 AS start, o_orderkey % 1000 + 5 AS stop FROM orders) p
 LEFT JOIN (SELECT o_custkey AS scope, o_orderkey AS owner, o_orderkey % 400 AS lo, o_orderkey % 400 + o_orderkey % 997 AS hi FROM orders) i ON i.scope = p.scope AND i.lo <= p.start AND p.stop <= i.hi) x WHERE n = 1""")
def innermost_interval(spark, d):
    """The shortest interval of the scope that holds each point."""
    o = ad.table(spark, d, "orders")
    key, scope = F.col("o_orderkey"), F.col("o_custkey").alias("scope")
    points = o.select(scope, key.alias("id"), (key % 1000).alias("start"), (key % 1000 + 5).alias("stop"))
    spans = o.select(scope, key.alias("owner"), (key % 400).alias("lo"), (key % 400 + key % 997).alias("hi"))
    return links.innermost(points, spans, "scope")


@query("user_id:l place:l value:l", """
SELECT p.user_id, p.event_id AS place, (SELECT max(e.event_id) FROM events e WHERE e.user_id = p.user_id AND e.event_type = 'signup' AND e.event_id <= p.event_id) AS value
FROM events p WHERE p.event_type = 'purchase'""")
def asof_nearest(spark, d):
    """For each purchase, the user's last signup at or before it."""
    e = ad.table(spark, d, "events").withColumn("at", F.col("event_id"))
    return links.nearest_before(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'").withColumn("value", F.col("event_id")), "user_id").withColumn("place", F.col("at"))


@query("path:s signature:s", """
SELECT path, signature FROM (SELECT 'src/Public/' || source || '.h' AS path, regexp_extract(text, '[A-Za-z]+ [A-Za-z]+') AS signature FROM documents) d
WHERE signature <> '' AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE 'src' || b.item_id = regexp_extract(d.path, 'src[0-9]+') AND contains(regexp_replace(trim(b.text), '\\s+', ' ', 'g'), d.signature))
GROUP BY ALL""")
def missing_impl(spark, d):
    """Declared signatures that no candidate source holds."""
    docs, b = ad.table(spark, d, "documents"), ad.table(spark, d, "benchmark")
    declared = docs.select(F.concat(F.lit("src/Public/"), "source", F.lit(".h")).alias("path"), F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0).alias("signature"))
    sources = b.select(F.concat(F.lit("src/Private/src"), "item_id", F.lit(".cpp")).alias("path"), "text")
    return links.without_definition(declared.where("signature <> ''").distinct(), sources)


# --- graphs --------------------------------------------------------------------------


@query("node:l", "SELECT node FROM reach", ad.PART_EDGES, """reach AS (
  SELECT dst AS node FROM edges WHERE src = 0 UNION SELECT e.dst FROM edges e JOIN reach r ON e.src = r.node)""")
def include_closure_cyclic(spark, d):
    """All that node 0 reaches; itself only through a cycle."""
    return graph.bfs(ad.part_edges(spark, d), spark.createDataFrame([(0,)], "node long"), include_seeds=False)


@query("seed:s node:s depth:l", "SELECT seed, node, min(depth) AS depth FROM up GROUP BY 1, 2", """turns AS (
  SELECT conv_id || '.' || turn AS src, conv_id || '.' || (turn - 1) AS dst, turn FROM conversations WHERE turn > 0)""", """up AS (
  SELECT DISTINCT src AS seed, src AS node, 0 AS depth FROM turns UNION ALL SELECT u.seed, t.dst, u.depth + 1 FROM up u JOIN turns t ON t.src = u.node)""")
def include_closure(spark, d):
    """Every turn and the turns before it."""
    c = ad.table(spark, d, "conversations").where("turn > 0")
    edges = c.select(F.concat_ws(".", "conv_id", "turn").alias("src"), F.concat_ws(".", "conv_id", F.col("turn") - 1).alias("dst"), "turn").distinct()
    return graph.bfs(edges, edges.select(F.col("src").alias("node")))


@query("seed:l depth:l node:l", """
SELECT seed, depth, node FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM chain JOIN part ON p_partkey = node WHERE p_size >= 45) x WHERE n = 1""",
    ad.PARENTS, """chain AS (SELECT p_partkey AS seed, p_partkey AS node, 0 AS depth FROM part
  UNION SELECT c.seed, e.dst, c.depth + 1 FROM chain c JOIN parents e ON e.src = c.node)""")
def chain_first_owner(spark, d):
    """For every class, the nearest one on its chains of parents that owns a member."""
    seeds = ad.table(spark, d, "part").select(F.col("p_partkey").alias("node"))
    owned = ad.table(spark, d, "part").where("p_size >= 45").select(F.col("p_partkey").alias("node"))
    return graph.chain_lookup(ad.parents(spark, d), seeds, owned, [])


@query("node:s deps:s", "SELECT seed AS node, string_agg(node, ',' ORDER BY node) AS deps FROM deep WHERE seed <> node GROUP BY seed", """deps AS (
  SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON r_regionkey = n_regionkey UNION SELECT r_name, 'WORLD' FROM region)""", """deep AS (
  SELECT src AS seed, dst AS node FROM deps UNION SELECT p.seed, e.dst FROM deep p JOIN deps e ON e.src = p.node)""")
def module_deep_deps(spark, d):
    """Transitive dependencies of each module, sorted."""
    n, r = ad.table(spark, d, "nation"), ad.table(spark, d, "region")
    direct = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    edges = direct.union(r.select("r_name", F.lit("WORLD")))
    return graph.deep_dependencies(edges).withColumn("deps", F.array_join("deps", ","))


@query("child:l ancestor:l", "SELECT seed AS child, node AS ancestor FROM up WHERE seed <> node", """up AS (
  SELECT p_partkey AS seed, p_partkey AS node FROM part UNION SELECT u.seed, CASE WHEN u.node = 0 THEN 1 ELSE u.node // 2 END FROM up u)""")
def subclass_pairs(spark, d):
    """Ancestors of every class over single-parent edges that end in a cycle."""
    p = ad.table(spark, d, "part").select(F.col("p_partkey").alias("src"))
    single = p.withColumn("dst", F.when(F.col("src") == 0, 1).otherwise(F.floor(F.col("src") / 2)).cast("long"))
    return graph.bfs(single, p.select(F.col("src").alias("node"))).where("seed <> node").select(F.col("seed").alias("child"), F.col("node").alias("ancestor"))


@query("name:l target:l", """
SELECT a.name, coalesce(e.base, dd.base, c.base, b.base, a.name) AS target FROM (SELECT p_partkey AS name FROM part) a
LEFT JOIN al b ON b.name = a.name LEFT JOIN al c ON c.name = b.base LEFT JOIN al dd ON dd.name = c.base LEFT JOIN al e ON e.name = dd.base""",
    "al AS (SELECT p_partkey AS name, p_partkey // 2 AS base FROM part WHERE p_partkey // 2 <> p_partkey AND p_partkey % 5 <> 0)")
def typedef_hops(spark, d):
    """Aliases followed up to four times."""
    p = ad.table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    return graph.typedef_target(p, p.where("name % 5 <> 0").select("name", F.floor(F.col("name") / 2).cast("long").alias("base")))


@query("id:l name:s stage:l", """
SELECT id, name, stage FROM (SELECT *, min(stage) OVER () AS best FROM (
  SELECT id, name, 0 AS stage FROM symbols WHERE class_name = 'Brand#99' AND name = 'red ring' UNION ALL
  SELECT id, name, 1 FROM symbols WHERE type = 'SMALL' AND name = 'red ring' UNION ALL SELECT id, name, 2 FROM symbols WHERE name = 'red ring') u) w WHERE stage = best""", ad.SYMBOLS)
def fallback_cascade(spark, d):
    """Rows of the first stage that finds any: own class, own module, anywhere."""
    s = ad.symbols(spark, d).where("name = 'red ring'").select("id", "name", "type", "class_name")
    return ordered.lowest_stage(ordered.staged_union([s.where("class_name = 'Brand#99'"), s.where("type = 'SMALL'"), s]))


# --- text ----------------------------------------------------------------------------


@query("doc_id:l line:l text:s", "SELECT doc_id, line, trim(text) AS text FROM lines WHERE contains(lower(text), 'license') ORDER BY doc_id, line LIMIT 200 OFFSET 3", ad.LINES)
def grep_lines(spark, d):
    """Lines that hold a text, in order, a page of them."""
    return search.grep(ad.table(spark, d, "documents"), "License", 200, 3, ("doc_id",))


@query("doc_id:l n:l", """
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: x = 'the')) AS n FROM lines) c WHERE n > 0 GROUP BY doc_id""", ad.LINES)
def word_usages(spark, d):
    """Whole-word occurrences of a word by document."""
    lines = ad.lines(spark, d).withColumnRenamed("doc_id", "path")
    return usage.word_counts(lines, "the").withColumnRenamed("path", "doc_id")


@query("path:s line:l col0:l kind:s", r"""
SELECT path, line, instr(text, 'track') - 1 AS col0,
  CASE WHEN contains(text, 'UPROPERTY(') OR contains(text, 'UFUNCTION(') THEN 'declaration'
       WHEN contains(rtrim(substr(text, 1, instr(text, 'track') - 1)), '::') AND starts_with(ltrim(substr(text, instr(text, 'track') + 5)), '(') THEN 'definition'
       WHEN starts_with(ltrim(substr(text, instr(text, 'track') + 5)), '(') THEN 'call'
       WHEN regexp_matches(ltrim(substr(text, instr(text, 'track') + 5)), '^([-+*/]?=)') THEN 'write' ELSE 'read' END AS kind
FROM fragments WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])track([^A-Za-z0-9_]|$)')
  AND length(regexp_replace(substr(text, 1, instr(text, 'track') - 1), '[^"]', '', 'g')) % 2 = 0
  AND (instr(text, '//') = 0 OR instr(text, 'track') < instr(text, '//')) ORDER BY path, line LIMIT 300""", ad.FRAGMENTS)
def usage_kinds(spark, d):
    """Usages of a name in code with their kinds, the first 300."""
    return usage.usages(ad.fragments(spark, d), "track").withColumn("col0", F.col("column"))


@query("path:s", """
SELECT path FROM (SELECT path FROM core UNION SELECT 'src' || (p_partkey % 20) FROM part WHERE 'src' || (p_partkey % 7) IN (SELECT path FROM core)
  UNION SELECT source FROM documents WHERE NOT EXISTS (SELECT 1 FROM core)) u ORDER BY path LIMIT 2000""",
    "core AS (SELECT DISTINCT source AS path FROM documents WHERE contains(text, 'license') UNION SELECT DISTINCT source FROM documents WHERE contains(text, 'token ='))")
def candidate_files(spark, d):
    """Sources that define or call, and those that include them."""
    docs, p = ad.table(spark, d, "documents"), ad.table(spark, d, "part")
    hits = lambda s: docs.where(F.col("text").contains(s)).select(F.col("source").alias("path"))
    includes = p.select(F.concat(F.lit("src"), F.col("p_partkey") % 20).alias("path"), F.concat(F.lit("src"), F.col("p_partkey") % 7).alias("resolved"))
    return usage.candidate_files(hits("license"), hits("token ="), includes, docs.select(F.col("source").alias("path")))


@query("path:l class_name:s start:l stop:l", """
SELECT path, class_name, min(line) AS start, min(line) FILTER (WHERE delta <> 0 AND after = 0) AS stop FROM (
  SELECT *, count(head) OVER w AS island, last_value(head IGNORE NULLS) OVER w AS class_name FROM (
    SELECT path, line, delta, after, CASE WHEN after - delta = 0 AND head <> '' THEN head END AS head FROM (
      SELECT *, sum(delta) OVER (PARTITION BY path ORDER BY line) AS after FROM (
        SELECT user_id AS path, event_id AS line, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS delta, CASE WHEN event_type = 'view' THEN 'C' || (event_id % 3) ELSE '' END AS head FROM events) a) b) c
  WINDOW w AS (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING)) e
WHERE island > 0 GROUP BY path, island, class_name HAVING count(*) FILTER (WHERE delta <> 0 AND after = 0) > 0""")
def method_ranges(spark, d):
    """Runs of lines from a method's head to the brace that closes it."""
    e = ad.table(spark, d, "events")
    text = F.when(F.col("event_type") == "signup", "{").when(F.col("event_type") == "error", "}").when(F.col("event_type") == "view", F.concat(F.lit("void C"), F.col("event_id") % 3, F.lit("::run()"))).otherwise("")
    return usage.method_ranges(e.select(F.col("user_id").alias("path"), F.col("event_id").alias("line"), text.alias("text")))


@query("page_id:l", "SELECT page_id FROM pages WHERE contains(html, 'track(1')")
def grep_bytes(spark, d):
    """Pages whose bytes hold a pattern."""
    return search.grep_bytes(ad.table(spark, d, "pages"), b"track(1", "html")


# --- fold, assets --------------------------------------------------------------------


@query("section:l key:l value:s n_history:l", """
SELECT section, key, CASE WHEN n_items = 0 THEN 'nil' WHEN has_set AND n_items = 1 THEN last ELSE '[Array x' || n_items || '] ' || last END AS value, n_history FROM (
  SELECT o.section, o.key, max(h.n) AS n_history, count(*) FILTER (WHERE o.seq >= h.reset AND o.op <> 'clear') AS n_items,
         bool_or(o.seq = h.reset AND o.op = 'set') AS has_set, arg_max(o.value, o.seq) FILTER (WHERE o.seq >= h.reset AND o.op <> 'clear') AS last
  FROM numbered o JOIN (SELECT section, key, count(*) AS n, coalesce(max(seq) FILTER (WHERE op IN ('set', 'clear')), 0) AS reset FROM numbered GROUP BY 1, 2) h USING (section, key)
  GROUP BY 1, 2) x""", ad.OPERATIONS, "numbered AS (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY ts, event_id) AS seq FROM operations WHERE op <> 'remove')")
def config_fold(spark, d):
    """Final value of each key after its set, add and clear operations."""
    done = oplog.fold(ad.operations(spark, d).where("op <> 'remove'"), ["section", "key"], ["ts", "event_id"])
    return done.withColumn("n_history", F.size("history"))


@query("section:l key:l value:s history:s", """
SELECT section, key, list_last(history) AS value, array_to_string(history, '|') AS history FROM (SELECT *, max(seq) OVER (PARTITION BY section, key) AS last FROM folded) x WHERE seq = last""",
    ad.OPERATIONS, "numbered AS (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY ts, event_id) AS seq FROM operations)",
    """stepped AS (SELECT section, key, CAST(0 AS BIGINT) AS seq, 'null' AS kind, CAST([] AS VARCHAR[]) AS items, CAST([] AS VARCHAR[]) AS history FROM numbered WHERE seq = 1
  UNION ALL SELECT section, key, seq, CASE WHEN len(after) = 0 THEN 'null' ELSE now END, after, list_append(history, CASE WHEN len(after) = 0 THEN 'nil' WHEN now = 'scalar' THEN after[1] ELSE '[Array x' || len(after) || '] ' || list_last(after) END)
  FROM (SELECT o.section, o.key, o.seq, s.history, CASE o.op WHEN 'set' THEN 'scalar' WHEN 'add' THEN 'array' ELSE s.kind END AS now,
     CASE o.op WHEN 'clear' THEN CAST([] AS VARCHAR[]) WHEN 'set' THEN [o.value] WHEN 'add' THEN list_append(s.items, o.value) ELSE list_filter(s.items, lambda x: x <> o.value) END AS after
   FROM stepped s JOIN numbered o ON o.section = s.section AND o.key = s.key AND o.seq = s.seq + 1) y)""", "folded AS (SELECT * FROM stepped WHERE seq > 0)")
def config_fold_full(spark, d):
    """All four operations with the history of every key."""
    done = oplog.fold(ad.operations(spark, d), ["section", "key"], ["ts", "event_id"])
    return done.withColumn("history", F.array_join("history", "|"))


_POSTINGS = "pairs AS (SELECT 'derived' AS kind, lang AS key, CAST(doc_id AS VARCHAR) AS asset FROM documents UNION SELECT 'references', '/script/' || source || '.' || lang, CAST(doc_id AS VARCHAR) FROM documents)"


def _pairs(spark, d):
    docs = ad.table(spark, d, "documents").withColumn("asset", F.col("doc_id").cast("string"))
    low = docs.select(F.lit("derived").alias("kind"), F.col("lang").alias("key"), "asset")
    return low.union(docs.select(F.lit("references"), F.concat(F.lit("/Script/"), "source", F.lit("."), "lang"), "asset"))


@query("kind:s key:s assets:s", "SELECT kind, key, string_agg(asset, ',' ORDER BY asset) AS assets FROM pairs GROUP BY 1, 2", _POSTINGS)
def inverted_index(spark, d):
    """Posting lists of keys."""
    return assets.postings(_pairs(spark, d)).withColumn("assets", F.array_join("assets", ","))


@query("relation:s asset:s", "SELECT DISTINCT kind AS relation, asset FROM pairs WHERE key = 'fr' OR ends_with(key, '.fr')", _POSTINGS)
def asset_usages(spark, d):
    """Assets that reference or derive from a class, by any of its names."""
    return assets.asset_usages(assets.postings(_pairs(spark, d)), "Fr")


@query("asset:s", "SELECT DISTINCT asset FROM pairs", _POSTINGS)
def asset_list(spark, d):
    """All assets of the graph."""
    return assets.all_assets(assets.postings(_pairs(spark, d)))


# --- completion ----------------------------------------------------------------------


@query("id:l name:s rank:l", """
SELECT id, name, CASE WHEN starts_with(lower(name), 'ri') THEN 0 WHEN starts_with(replace(lower(name), ' ', ''), 'ri') THEN 1
  WHEN starts_with(split_part(lower(name), ' ', 1), 'ri') THEN 2 WHEN starts_with(split_part(lower(name), ' ', 2), 'ri') THEN 3
  WHEN contains(lower(name), 'ri') THEN 39 + instr(lower(name), 'ri') WHEN contains(replace(lower(name), ' ', ''), 'ri') THEN 99 + instr(replace(lower(name), ' ', ''), 'ri') ELSE 1000000 END AS rank FROM symbols""", ad.SYMBOLS)
def match_rank(spark, d):
    """Fuzzy rank of every name against a prefix."""
    return ad.symbols(spark, d).withColumn("rank", mt.match_rank("name", "ri"))


@query("class_name:s name:s sort_text:s place:l", """
SELECT class_name, name, sort_text, place FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY sort_text, name) AS place FROM (
  SELECT DISTINCT class_name, name, printf('%04d_%04d_%s', CASE WHEN starts_with(name, 're') THEN 0 WHEN starts_with(split_part(name, ' ', 2), 're') THEN 3 ELSE 39 + instr(name, 're') END, 2, lower(name)) AS sort_text
  FROM symbols WHERE contains(replace(name, ' ', ''), 're') AND contains(name, 're')) r) p WHERE place <= 96""", ad.SYMBOLS)
def topk_per_class(spark, d):
    """Best members of each class for a prefix, at most 96."""
    s = ad.symbols(spark, d).where(F.col("name").contains("re"))
    return completion.member_items(s.select("class_name", F.lit(0).alias("depth"), "name", F.lit(2).alias("kind"), F.lit("").alias("detail")), "re")


@query("label:s kind:l", """
SELECT DISTINCT CASE WHEN contains(substr(filename, 2), '/') THEN '' ELSE filename END AS label, 17 AS kind FROM (
  SELECT filename, path, file_id FROM files WHERE contains(lower(path), '/7') OR starts_with(lower(filename), '7') ORDER BY length(path), path, file_id LIMIT 80) p WHERE starts_with(filename, '7')""", ad.FILES)
def include_candidates(spark, d):
    """What completes an include prefix."""
    return completion.include_items(ad.files(spark, d), "7")


@query("name:s path:s id:l", """
SELECT name, path, id FROM (SELECT s.*, i.path IS NOT NULL AS inside, count(*) OVER w AS n, count(i.path) OVER w AS m FROM symbols s LEFT JOIN (SELECT DISTINCT path FROM symbols WHERE type = 'SMALL') i ON i.path = s.path
  WINDOW w AS (PARTITION BY name)) x WHERE n = 1 OR m = 0 OR inside""", ad.SYMBOLS)
def filter_by_closure_or_all(spark, d):
    """Of several classes of a name, those included, unless none is."""
    s = ad.symbols(spark, d)
    return completion.prefer_included(s, s.where("type = 'SMALL'"))


# --- diagnostics ---------------------------------------------------------------------


@query("line_no:l file:s line:l char:l severity:s source:s message:s", """
SELECT event_id AS line_no, 'C:\\src\\f' || user_id || '.cpp' AS file, event_id % 97 AS line, CASE WHEN event_type = 'error' THEN event_id % 13 ELSE 0 END AS char,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, CASE WHEN event_type = 'error' THEN 'MSVC' ELSE 'UHT' END AS source,
  CASE WHEN event_type = 'error' THEN 'C' || (2000 + user_id) || ': bad ' || user_id ELSE 'odd ' || user_id END AS message FROM events WHERE event_type IN ('error', 'view')""")
def log_regex(spark, d):
    """Diagnostics read out of a build log."""
    e = ad.table(spark, d, "events")
    head = F.concat(F.lit("C:\\src\\f"), "user_id", F.lit(".cpp"))
    n, c = (F.col("event_id") % 97 + 1).cast("string"), (F.col("event_id") % 13 + 1).cast("string")
    compiler = F.concat(head, F.lit("("), n, F.lit(","), c, F.lit("): error C"), F.col("user_id") + 2000, F.lit(": bad "), "user_id")
    reflection = F.concat(head, F.lit(":"), n, F.lit(": Warning: odd "), "user_id")
    text = F.when(F.col("event_type") == "error", compiler).when(F.col("event_type") == "view", reflection).otherwise(F.lit("Building..."))
    return diagnostics.log_diagnostics(e.select(F.col("event_id").alias("line_no"), text.alias("text"))).withColumn("char", F.col("column"))


@query("event_id:l ahead:l", """
SELECT event_id, CAST(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS BIGINT) AS ahead FROM events""")
def lookahead_rule(spark, d):
    """Whether one of a line and the next seven holds a marker."""
    e = ad.table(spark, d, "events")
    return diagnostics.look_ahead(e, F.col("event_type") == "purchase", 8, ["user_id"], "event_id").withColumn("ahead", F.col("ahead").cast("long"))


@query("event_id:l carried:s", """
SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), 'private') AS carried FROM events""")
def carry_forward(spark, d):
    """The last label within 80 lines before, else the default."""
    e = ad.table(spark, d, "events")
    label = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    return diagnostics.carry_forward(e, label, "private", 80, ["user_id"], "event_id")


@query("user_id:l event_id:l", "SELECT user_id, event_id FROM kept", """ordered AS (
  SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""", """kept AS (
  SELECT user_id, event_id, t, n FROM ordered WHERE n = 1
  UNION ALL SELECT o.user_id, o.event_id, o.t, o.n FROM kept k, LATERAL (SELECT * FROM ordered o WHERE o.user_id = k.user_id AND o.t - k.t >= 3600000000 ORDER BY o.n LIMIT 1) o)""")
def debounce(spark, d):
    """Events an hour or more after the last accepted one of their user."""
    from tessera.streaming.changes import debounced

    e = ad.table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return debounced(e, "user_id", "t", ["event_id"], 3_600_000_000)
