"""Queries that call the engine itself over an index made of the generic tables, and
queries of readers over texts made from them, each with its SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import engine as en
from tessera.functions import text as tx
from tessera.operators import assets, catalog, completion, diagnostics, links, ordered, places
from tessera.plans import adapters as ad
from tessera.plans.registry import _KIND, _tier, query
from tessera.sources import files as fs

ALL = ad.index_sql()
TWO = ad.index_sql(0) + "," + ad.index_sql(1, "e_")


def engine(spark, d) -> en.Engine:
    return en.Engine(ad.index(spark, d))


def two(spark, d) -> en.Engine:
    """Even keys in front, odd ones behind."""
    return en.Engine(ad.index(spark, d, 0), ad.index(spark, d, 1))


# --- files and modules ---------------------------------------------------------------


@query("path:s", "SELECT path FROM files", ad.FILES)
def all_file_paths(spark, d):
    """Paths of all files."""
    return engine(spark, d).all_file_paths()


@query("path:s filename:s module_name:s", "SELECT path, filename, module_name FROM files", ad.FILES)
def all_files_metadata(spark, d):
    """All files with name and module."""
    return engine(spark, d).all_files_metadata()


@query("path:s", "SELECT path FROM files WHERE filename ILIKE '%7'", ad.FILES)
def target_files(spark, d):
    """Files whose name has the ending of build targets (here: 7)."""
    i = ad.index(spark, d)
    named = i.files.withColumn("filename", F.concat("filename", F.when(F.col("filename").endswith("7"), ".target.cs").otherwise("")))
    from dataclasses import replace

    return en.Engine(replace(i, files=named)).target_files()


@query("name:s root:s type:s", "SELECT name, root, type FROM modules", ad.FILES, ad.MODULES)
def module_list(spark, d):
    """All modules."""
    return engine(spark, d).modules()


@query("name:s", "SELECT name FROM modules", ad.FILES, ad.MODULES)
def module_names(spark, d):
    """Names of all modules."""
    return engine(spark, d).module_names()


@query("name:s ord:l", "SELECT name, row_number() OVER (ORDER BY name, root) - 1 AS ord FROM modules WHERE contains(lower(name), '.org/') ORDER BY ord LIMIT 40", ad.FILES, ad.MODULES)
def module_search_page(spark, d):
    """The first 40 modules whose name holds a text."""
    return engine(spark, d).search_modules(".ORG/", 40)


@query("name:s type:s", "SELECT name, type FROM modules WHERE name = (SELECT min(name) FROM modules WHERE type = 'Runtime')", ad.FILES, ad.MODULES)
def module_by_name(spark, d):
    """One module by name."""
    e = engine(spark, d)
    return e.module_by_name(e.index.modules.where("type = 'Runtime'").agg(F.min("name")).first()[0])


@query("file_id:l path:s ord:l", "SELECT file_id, path, row_number() OVER (ORDER BY path, file_id) - 1 AS ord FROM files WHERE module_name IN (SELECT module_name FROM files WHERE file_id < 9) AND contains(lower(path), '/e') ORDER BY ord LIMIT 100", ad.FILES)
def module_files_search(spark, d):
    """Files of several modules whose path holds a text."""
    e = engine(spark, d)
    return catalog.search_files_in_modules(e.index.files, e.index.files.where("file_id < 9"), "/E", 100)


@query("path:s", """
SELECT DISTINCT node AS path FROM reach""", ad.FILES, """inc AS (SELECT a.path AS src, b.path AS dst FROM files a JOIN files b ON b.file_id = (a.file_id * 7 + 3) % (SELECT count(*) FROM pages))""",
    """reach AS (SELECT dst AS node FROM inc WHERE src = (SELECT path FROM files WHERE file_id = 5) UNION SELECT i.dst FROM inc i JOIN reach r ON i.src = r.node)""")
def depend_files(spark, d):
    """Files that one file includes, directly or not."""
    e = engine(spark, d)
    path = e.index.files.where("file_id = 5").first()["path"]
    return e.depend_files(path)


# --- classes and members -------------------------------------------------------------


@query("class_id:l name:s path:s line:l", "SELECT class_id, name, path, line FROM classes WHERE symbol_type = 'struct'", ad.FILES, ALL)
def structs_only(spark, d):
    """All structs."""
    return engine(spark, d).structs_only()


@query("class_id:l name:s ord:l", "SELECT class_id, name, row_number() OVER (ORDER BY name, class_id) - 1 AS ord FROM classes WHERE symbol_type = 'enum' ORDER BY ord LIMIT 300", ad.FILES, ALL)
def symbols_of_kind(spark, d):
    """The first 300 symbols of a type."""
    return engine(spark, d).symbols_by_type("enum", 300)


@query("class_id:l name:s ord:l", "SELECT class_id, name, row_number() OVER (ORDER BY name, class_id) - 1 AS ord FROM classes WHERE name ILIKE 'c1%' ORDER BY ord LIMIT 50", ad.FILES, ALL)
def class_prefix(spark, d):
    """Classes by prefix, 50 by default."""
    return engine(spark, d).search_classes_prefix("c1")


@query("member_id:l name:s type:s access:s line:l", "SELECT member_id, name, type, access, line FROM members WHERE class_name = 'C17'", ad.FILES, ALL)
def class_members(spark, d):
    """Members of a class."""
    return engine(spark, d).class_members("C17")


@query("member_id:l name:s", "SELECT member_id, name FROM members WHERE class_name = 'C18' AND type = 'function'", ad.FILES, ALL)
def class_methods(spark, d):
    """Functions of a class."""
    return engine(spark, d).class_methods("C18")


@query("class_id:l name:s n:l first:s", """
SELECT c.class_id, c.name, count(m.member_id) AS n, min(m.name) AS first FROM classes c LEFT JOIN members m ON m.class_id = c.class_id
WHERE c.path = (SELECT path FROM files WHERE file_id = 3) GROUP BY 1, 2""", ad.FILES, ALL)
def file_symbols(spark, d):
    """Classes of a file with their members nested."""
    e = engine(spark, d)
    found = e.file_symbols(e.index.files.where("file_id = 3").first()["path"])
    return found.withColumn("n", F.size("members")).withColumn("first", F.array_min(F.transform("members", lambda m: m["name"])))


@query("path:s items:s", "SELECT c.path, string_agg(c.line || ':' || c.name, ',' ORDER BY c.line, c.name) AS items FROM classes c WHERE c.path IN (SELECT path FROM files WHERE module_name LIKE 'm.%') GROUP BY 1", ad.FILES, ALL)
def module_classes(spark, d):
    """Classes in modules, grouped by file."""
    e = engine(spark, d)
    names = [r[0] for r in e.index.files.where("module_name like 'm.%'").select("module_name").distinct().collect()]
    return e.classes_in_modules(names).withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["line"], x["name"])), ","))


@query("name:s line:l", "SELECT 'V' || color || p_partkey AS name, p_partkey AS line FROM part, (SELECT unnest(['Red', 'Blue']) AS color) c WHERE p_partkey = 11")
def scoped_enum_values(spark, d):
    """Values of an enum named with its scope."""
    return engine(spark, d).enum_values("Space::C11")


@query("id:l name:s ord:l", f"""
SELECT id, name, row_number() OVER (ORDER BY rank, kind, lower(name), path, line, id) - 1 AS ord FROM (
  SELECT id, name, path, line, {_tier("c1", "name", "class_name", "module_name", "path")} AS rank, {_KIND} AS kind FROM all_symbols
  WHERE module_name = (SELECT module_name FROM files WHERE file_id = 4) AND contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'c1')) s ORDER BY ord LIMIT 30""", ad.FILES, ALL)
def module_symbol_search(spark, d):
    """Ranked search within a module."""
    e = engine(spark, d)
    return e.search_symbols_in_modules([e.index.files.where("file_id = 4").first()["module_name"]], "c1", None, 30)


@query("name:s path:s line:l", """
SELECT name, path, line FROM all_symbols WHERE name = 'm8' AND module_name = (SELECT module_name FROM files WHERE file_id = 8)
ORDER BY CASE WHEN contains(lower(path), '.generated.') THEN 10 ELSE 0 END + CASE WHEN ends_with(lower(path), '.h') THEN 0 WHEN ends_with(lower(path), '.hpp') THEN 1 WHEN ends_with(lower(path), '.inl') THEN 2 ELSE 3 END, line, id LIMIT 1""", ad.FILES, ALL)
def symbol_in_module(spark, d):
    """One symbol of a module: a type, else a member."""
    e = engine(spark, d)
    return e.symbol_in_module(e.index.files.where("file_id = 8").first()["module_name"], "m8")


@query("path:s line:l", "SELECT path, line FROM (SELECT path, line, row_number() OVER (ORDER BY path, line) AS n FROM calls WHERE name = 'm9') c WHERE n <= 200", ad.FILES, ALL)
def call_sites(spark, d):
    """The first 200 calls of a function."""
    return engine(spark, d).call_sites("m9")


# --- inheritance ---------------------------------------------------------------------


@query("class_id:l depth:l", "SELECT node AS class_id, min(depth) AS depth FROM up GROUP BY 1", ad.FILES, ALL, """up AS (
  SELECT parent_id AS node, 1 AS depth FROM inheritance WHERE child_id = 1234 % (SELECT count(*) FROM part) UNION ALL SELECT i.parent_id, u.depth + 1 FROM up u JOIN inheritance i ON i.child_id = u.node)""")
def parent_classes(spark, d):
    """All parents of a class with their distance; some edges are bound by name."""
    e = engine(spark, d)
    n = e.index.classes.count()
    return e.recursive_parent_classes(f"C{1234 % n}")


@query("class_id:l depth:l", "SELECT node AS class_id, min(depth) AS depth FROM down GROUP BY 1", ad.FILES, ALL, """down AS (
  SELECT child_id AS node, 1 AS depth FROM inheritance WHERE parent = 'C3' UNION ALL SELECT i.child_id, u.depth + 1 FROM down u JOIN inheritance i ON i.parent_id = u.node)""")
def child_classes(spark, d):
    """All classes that derive from one, with their distance."""
    return engine(spark, d).recursive_derived_classes("C3")


@query("name:s path:s line:l", "SELECT c.name, c.path, c.line FROM inheritance i JOIN classes c ON c.class_id = i.child_id WHERE i.parent = 'C6'", ad.FILES, ALL)
def derived_classes(spark, d):
    """Direct children of a class."""
    return engine(spark, d).derived_classes("C6")


@query("member_id:l name:s depth:l", "SELECT m.member_id, m.name, c.depth FROM chain c JOIN members m ON m.class_id = c.node", ad.FILES, ALL, """chain AS (
  SELECT 41 AS node, 0 AS depth UNION ALL SELECT i.parent_id, c.depth + 1 FROM chain c JOIN inheritance i ON i.child_id = c.node)""")
def members_over_chain(spark, d):
    """Members of a class and all its parents."""
    return engine(spark, d).class_members_recursive("C41")


@query("name:s n:l nearest_depth:l", "SELECT m.name, count(DISTINCT m.class_name) AS n, min(c.depth) AS nearest_depth FROM chain c JOIN members m ON m.class_id = c.node WHERE m.type = 'function' GROUP BY 1 HAVING count(DISTINCT m.class_name) > 1",
    ad.FILES, ALL, """chain AS (SELECT 41 AS node, 0 AS depth UNION ALL SELECT i.parent_id, c.depth + 1 FROM chain c JOIN inheritance i ON i.child_id = c.node)""")
def overridden_functions(spark, d):
    """Functions that several classes of a chain declare, with the distance of the nearest."""
    e = engine(spark, d)
    near = e.class_members_recursive("C41").where("type = 'function'").groupBy("name").agg(F.min("depth").alias("nearest_depth"))
    return e.virtual_functions("C41").join(near, "name")


_IMPL = "CASE WHEN m.access = 'impl' THEN 0 ELSE 1 END, CASE WHEN ends_with(lower(m.path), '.cpp') THEN 0 WHEN ends_with(lower(m.path), '.cc') THEN 1 WHEN ends_with(lower(m.path), '.cxx') THEN 2 ELSE 3 END, m.line, m.path, m.member_id"
_CHAIN = """chain AS (SELECT 'C37' AS owner, 37 AS node, 0 AS depth UNION ALL SELECT i.parent, i.parent_id, c.depth + 1 FROM chain c JOIN inheritance i ON i.child_id = c.node)"""


@query("name:s path:s line:l type:s", f"SELECT m.name, m.path, m.line, m.type FROM chain c JOIN members m ON m.class_name = c.owner WHERE m.name = 'm5' ORDER BY c.depth, {_IMPL} LIMIT 1", ad.FILES, ALL, _CHAIN)
def goto_implementation(spark, d):
    """Implementation of a member by class name, in the class or its nearest parent."""
    return engine(spark, d).goto_implementation("", 1, "m5", "C37")


_DECL = "CASE WHEN m.access = 'impl' THEN 1 ELSE 0 END, CASE WHEN contains(lower(m.path), '.generated.') THEN 1 ELSE 0 END, CASE WHEN contains(m.path, '/Public/') THEN 0 WHEN contains(m.path, '/Classes/') THEN 1 WHEN contains(m.path, '/Private/') THEN 2 ELSE 3 END, m.line, m.path, m.member_id"


@query("name:s path:s line:l how:s", f"SELECT m.name, m.path, m.line, 'member' AS how FROM members m WHERE m.name = 'm6' ORDER BY {_DECL} LIMIT 1", ad.FILES, ALL)
def goto_member_anywhere(spark, d):
    """A member that no class of the cursor has, found anywhere, declarations first."""
    return engine(spark, d).goto_definition("", 1, "m6")


@query("name:s path:s how:s", "SELECT name, path, 'type' AS how FROM classes WHERE name = 'C12'", ad.FILES, ALL)
def goto_type(spark, d):
    """A type by name, before members of that name."""
    return engine(spark, d).goto_definition("", 1, "C12")


@query("label:s path:s line:l parameters:l", """
SELECT label, path, line, parameters FROM (SELECT *, row_number() OVER (ORDER BY depth, path, line, label) AS n FROM (
  SELECT m.return_type || ' ' || m.name || m.detail AS label, m.path, m.line, min(c.depth) AS depth, min(CASE WHEN m.detail = '()' THEN 0 ELSE 2 END) AS parameters
  FROM chain c JOIN members m ON m.class_id = c.node WHERE m.name = 'm4' AND m.type = 'function' GROUP BY 1, 2, 3) u) v WHERE n <= 16""", ad.FILES, ALL, _CHAIN)
def signature_overloads(spark, d):
    """Overloads in a chain of classes; a template argument's comma parts no parameters."""
    found = engine(spark, d).signature_help("m4", "1, ", "C37")
    return found.withColumn("parameters", en.parameter_count("detail"))


# --- two sources ---------------------------------------------------------------------


def _fast(prefix: str, pattern: str, limit: int) -> str:
    return f"""
{prefix}fs AS (SELECT 'symbol' AS kind, s.name, s.path, s.line, 0 AS part, s.o AS ord FROM (SELECT id, name, path, line, row_number() OVER (ORDER BY {_tier(pattern, "name", "class_name")}, lower(name), id) - 1 AS o FROM {prefix}fa
  WHERE contains(lower(name), '{pattern}') OR contains(lower(class_name), '{pattern}')) s WHERE s.o < {limit}),
{prefix}ff AS (SELECT 'file' AS kind, filename AS name, path, 1 AS line, 1 AS part, row_number() OVER (ORDER BY {_tier(pattern, "filename", "path")}, lower(filename), lower(path), file_id) - 1 AS ord FROM files
  WHERE contains(lower(filename), '{pattern}') OR contains(lower(path), '{pattern}') ORDER BY ord LIMIT {limit}),
{prefix}fu AS (SELECT *, row_number() OVER (ORDER BY part, ord) - 1 AS o FROM (SELECT *, row_number() OVER (PARTITION BY kind, path, line, name ORDER BY part, ord) AS k FROM (SELECT * FROM {prefix}fs UNION ALL SELECT * FROM {prefix}ff) a) b WHERE k = 1)"""


_SYM = "fa AS (SELECT DISTINCT id, name, class_name, path, line FROM all_symbols), e_fa AS (SELECT DISTINCT id, name, class_name, path, line FROM e_all_symbols)"


@query("kind:s name:s path:s line:l ord:l", "SELECT kind, name, path, line, o AS ord FROM fu WHERE o < 40", ad.FILES, TWO, _SYM, _fast("", "c7", 40))
def fast_find_page(spark, d):
    """Symbols and then files, best first; the project's alone."""
    return two(spark, d).fast_find("C7", 40, scope="project")


@query("kind:s name:s path:s line:l source:s ord:l", """
SELECT kind, name, path, line, source, row_number() OVER (ORDER BY stage, o) - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY name, path, line ORDER BY stage, o) AS k2 FROM (
  SELECT kind, name, path, line, o, 'project' AS source, 0 AS stage FROM fu WHERE o < 400
  UNION ALL SELECT kind, name, path, line, o, 'engine', 1 FROM e_fu WHERE (SELECT count(*) FROM fu WHERE o < 400) < 400 AND o < greatest(1, 400 - (SELECT count(*) FROM fu WHERE o < 400))) u) v
WHERE k2 = 1 ORDER BY ord LIMIT 400""", ad.FILES, TWO, _SYM, _fast("", "c78", 400), _fast("e_", "c78", 400))
def fast_find_scope(spark, d):
    """A page of the project filled up from the engine."""
    return two(spark, d).fast_find("c78", 400)


@query("kind:s name:s path:s ord:l", "SELECT kind, name, path, o AS ord FROM e_fu WHERE o < 30", ad.FILES, TWO, _SYM, _fast("e_", "c77", 30))
def fast_find_engine(spark, d):
    """The engine's page alone."""
    return two(spark, d).fast_find("c77", 30, scope="engine")


@query("name:s path:s line:l ord:l", "SELECT name, path, line, row_number() OVER (ORDER BY lower(name), id) - 1 AS ord FROM all_symbols ORDER BY ord LIMIT 60", ad.FILES, ad.index_sql(0))
def fast_find_blank(spark, d):
    """A blank pattern lists symbols."""
    return two(spark, d).fast_find("  ", 60, scope="project")


@query("id:l name:s source:s ord:l", f"""
WITH ranked AS (SELECT id, name, path, line, {_tier("c99", "name", "class_name", "module_name", "path")} AS rank, {_KIND} AS kind, 0 AS stage FROM all_symbols WHERE contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'c99')
  UNION ALL SELECT id, name, path, line, {_tier("c99", "name", "class_name", "module_name", "path")}, {_KIND}, 1 FROM e_all_symbols WHERE contains(lower(concat_ws(' ', name, type, class_name, module_name, path)), 'c99')),
paged AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY rank, kind, lower(name), path, line, id) AS n FROM ranked),
kept AS (SELECT *, row_number() OVER (PARTITION BY name, path, line ORDER BY stage, n) AS k FROM paged WHERE n <= 500 AND (stage = 0 OR (SELECT count(*) FROM paged WHERE stage = 0 AND n <= 500) < 500))
SELECT id, name, CASE stage WHEN 0 THEN 'project' ELSE 'engine' END AS source, row_number() OVER (ORDER BY stage, rank, kind, name, path, line, id) - 1 AS ord FROM kept WHERE k = 1 ORDER BY ord LIMIT 500""", ad.FILES, TWO)
def symbol_search_two_sources(spark, d):
    """Ranked symbols of the project, filled up from the engine."""
    return two(spark, d).search_symbols("c99", 500)


@query("path:s line:l text:s ord:l", """
SELECT path, line, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS text, row_number() OVER (ORDER BY path, line) - 1 AS ord FROM (
  SELECT path, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM (SELECT f.path, regexp_split_to_array(regexp_replace(html, '\\r?\\n$', ''), '\\r?\\n') AS parts FROM pages JOIN files f ON f.file_id = page_id) a) l
WHERE contains(lower(text), 'track(') ORDER BY ord LIMIT 100""", ad.FILES)
def code_text_scope(spark, d):
    """Lines of the engine's texts that hold a text."""
    return two(spark, d).search_code_text("TRACK(", scope="engine")


# --- completion ----------------------------------------------------------------------


@query("label:s kind:l ord:l", """
SELECT 'V' || color || p_partkey AS label, 20 AS kind, row_number() OVER (ORDER BY 'V' || color || p_partkey) - 1 AS ord FROM part, (SELECT unnest(['Red', 'Blue']) AS color) c WHERE p_partkey % 3 = 2 AND color = 'Blue'""")
def enum_items(spark, d):
    """Enum values that complete a prefix."""
    return completion.enum_items(ad.index(spark, d).enum_values, "vbl")


@query("label:s stage:l ord:l", """
SELECT name AS label, stage, row_number() OVER (ORDER BY stage, o, name) - 1 AS ord FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY stage, o) AS k FROM (
  SELECT DISTINCT name, 0 AS stage, CAST(length(name) AS BIGINT) AS o FROM symbols WHERE type = 'SMALL' UNION ALL SELECT DISTINCT name, 1, CAST(0 AS BIGINT) FROM symbols) u) v WHERE k = 1 ORDER BY ord LIMIT 128""", ad.SYMBOLS)
def completion_merge(spark, d):
    """Candidate lists in order, each in its own, a label once, the first 128."""
    s = ad.symbols(spark, d)
    first = s.where("type = 'SMALL'").select(F.col("name").alias("label"), F.length("name").cast("long").alias("ord")).distinct()
    return completion.merge_items([first, s.select(F.col("name").alias("label"), F.lit(0).cast("long").alias("ord")).distinct()])


@query("member_id:l seen:l", """
SELECT member_id, CASE WHEN class_name = 'C7' THEN 1 WHEN access = 'impl' THEN 1 WHEN access = 'protected' THEN CASE WHEN class_id % 2 = 0 THEN 1 ELSE 0 END ELSE 1 END AS seen FROM members""", ad.FILES, ALL)
def member_access(spark, d):
    """Whether each member is seen from a class: its own, a subclass's, any."""
    m = ad.index(spark, d).members
    return m.withColumn("seen", completion.accessible(F.col("access"), F.col("class_name") == "C7", F.col("class_id") % 2 == 0).cast("long"))


@query("name:s rank:l ord:l", """
SELECT name, rank, row_number() OVER (ORDER BY name) - 1 AS ord FROM (SELECT DISTINCT name, 0 AS rank FROM classes WHERE starts_with(name, 'C55')) a ORDER BY ord LIMIT 80""", ad.FILES, ALL)
def global_types(spark, d):
    """Types that complete a prefix from anywhere."""
    c = ad.index(spark, d).classes
    return completion.global_items(c.where(F.col("name").startswith("C55")).withColumn("id", F.col("class_id")), "c55")


# --- readers -------------------------------------------------------------------------


@query("path:s section:s op:s key:s value:s", """
SELECT 'u' || user_id || '.ini' AS path, 'S' || (user_id % 3) AS section, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'clear' ELSE 'set' END AS op, 'K' || (event_id % 7) AS key, CAST(event_id AS VARCHAR) AS value
FROM events WHERE event_type <> 'click'""")
def ini_operations(spark, d):
    """Operations read out of configuration files: one file a user, clicks are comments."""
    e = ad.table(spark, d, "events")
    sign = F.when(F.col("event_type") == "signup", "+").when(F.col("event_type") == "error", "-").when(F.col("event_type") == "view", "!").when(F.col("event_type") == "click", "; ").otherwise("")
    line = F.concat(F.lit(" "), sign, F.lit("K"), F.col("event_id") % 7, F.lit(" = "), "event_id")
    body = e.select("user_id", "event_id", line.alias("line")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\r\n").alias("body"))
    texts = body.select(F.concat(F.lit("u"), "user_id", F.lit(".ini")).alias("path"), F.concat(F.lit("# head\nK = ignored\n["), F.lit("S"), F.col("user_id") % 3, F.lit("]\n\n"), "body").alias("text"))
    return fs.ini_items(texts)


@query("path:s scope:s name:s", """
SELECT DISTINCT 'p' || p_partkey AS path, scope, name FROM (SELECT p_partkey, 'Public' AS scope, unnest(['Core', 'M' || (p_partkey % 9)]) AS name FROM part UNION ALL SELECT p_partkey, 'Private', 'X' || p_size FROM part) x""")
def build_dependencies(spark, d):
    """Modules named in the dependency lists of build scripts."""
    p = ad.table(spark, d, "part")
    text = F.concat(
        F.lit('PublicDependencyModuleNames.AddRange(new string[] {\n  "Core", "M'), F.col("p_partkey") % 9, F.lit('" });\n'),
        F.lit('  PrivateDependencyModuleNames.Add( "X'), "p_size", F.lit('");\n Other.Add("Y");'),
    )
    return fs.build_dependencies(p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text")))


@query("path:s line:l severity:s code:s", """
SELECT 'h' || (p_partkey // 40) AS path, (p_partkey % 40) * 4 + a.step AS line, a.severity, a.code FROM part JOIN (VALUES (0, 0, 'error', 'UHT001'), (0, 1, 'error', 'UHT002'), (1, 1, 'error', 'UHT002'), (2, 0, 'hint', 'UEBP001'), (3, 0, 'error', 'UHT001')) a(kind, step, severity, code)
  ON a.kind = p_partkey % 5""")
def rule_diagnostics(spark, d):
    """Reflection rules over headers of many macros; every fifth is without fault."""
    p = ad.table(spark, d, "part")
    kind = F.col("p_partkey") % 5
    texts = {0: ("UCLASS()", "struct FThing"), 1: ("USTRUCT(BlueprintType)", "struct FOther"), 2: ("UFUNCTION(BlueprintCallable)", "void Run();"), 3: ("UENUM()", "class AName"), 4: ("UENUM()", "enum class EName")}
    at = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in texts.values())), (kind + 1).cast("int"))
    rows = p.select(F.concat(F.lit("h"), F.floor(F.col("p_partkey") / 40)).alias("path"), F.posexplode(F.array(at(0), at(1), F.lit(""), F.lit("};"))).alias("i", "text"), "p_partkey")
    return diagnostics.rule_diagnostics(rows.withColumn("line", ((F.col("p_partkey") % 40) * 4 + F.col("i")).cast("int")))


@query("path:s asset:s", "SELECT 'D:/G/Content/' || p_type || '/P' || p_partkey || '.uasset' AS path, '/Game/' || p_type || '/P' || p_partkey AS asset FROM part")
def asset_paths(spark, d):
    """Object paths of asset files."""
    p = ad.table(spark, d, "part").select(F.concat(F.lit("D:/G/Content/"), "p_type", F.lit("/P"), "p_partkey", F.lit(".uasset")).alias("path"))
    return p.withColumn("asset", tx.asset_path("path"))


_ASSETS = """kept AS (SELECT 'derived' AS kind, 'c' || (p_partkey // 2) AS key, 'a' || p_partkey AS asset FROM part WHERE p_partkey % 3 > 0
  UNION SELECT 'references', 'i' || (p_partkey % 11), 'a' || p_partkey FROM part WHERE p_partkey % 3 > 0
  UNION SELECT 'derived', 'n' || (p_partkey // 2), 'a' || p_partkey FROM part WHERE p_partkey % 6 = 0 UNION SELECT 'references', 'j' || (p_partkey % 11), 'a' || p_partkey FROM part WHERE p_partkey % 6 = 0)"""


def _graph(spark, d, parent: str, imported: str, where: str):
    p = ad.table(spark, d, "part").where(where)
    return p.select(
        F.concat(F.lit("a"), "p_partkey").alias("asset"), F.concat(F.lit(parent), F.floor(F.col("p_partkey") / 2)).alias("parent"),
        F.array(F.concat(F.lit(imported), F.col("p_partkey") % 11)).alias("imports"), F.array().cast("array<string>").alias("functions"),
    )


@query("kind:s key:s asset:s", "SELECT kind, key, asset FROM kept", _ASSETS)
def asset_graph_update(spark, d):
    """Pairs of the asset graph after some assets changed and others went."""
    pairs = assets.graph_pairs(_graph(spark, d, "c", "i", "true"))
    gone = ad.table(spark, d, "part").where("p_partkey % 6 = 3").select(F.concat(F.lit("a"), "p_partkey").alias("asset"))
    return assets.replace_assets(pairs, _graph(spark, d, "n", "j", "p_partkey % 6 = 0"), gone)


@query("dependency:s", "SELECT unnest(['/Script/' || p_type, p_brand, 'P' || p_size]) AS dependency FROM part WHERE p_partkey = 77")
def asset_dependencies(spark, d):
    """Imports and parent of an asset."""
    p = ad.table(spark, d, "part")
    packages = p.select(F.concat(F.lit("/x/Content/A"), "p_partkey", F.lit(".uasset")).alias("path"), F.array(F.concat(F.lit("/Script/"), "p_type"), F.col("p_brand")).alias("imports"), F.concat(F.lit("P"), "p_size").alias("parent"))
    return engine(spark, d).asset_dependencies(packages, "/Game/A77")


@query("key:l value:s", """
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 1 THEN 'new' ELSE o_orderpriority END AS value FROM orders WHERE o_orderkey % 4 <> 2""")
def upsert_rows(spark, d):
    """Rows replaced by key, others deleted, the rest kept."""
    old = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    new = old.where("key % 4 = 1").withColumn("value", F.lit("new"))
    return links.upsert(old, new, ["key"], old.where("key % 4 = 2"))


@query("path:s source:s", """
SELECT path, unnest(list_distinct(list_concat([replace(stem, '/Public/', '/Private/') || e FOR e IN ['.cpp', '.cc', '.cxx']], [stem || e FOR e IN ['.cpp', '.cc', '.cxx']]))) AS source FROM (
  SELECT 'm' || (p_size % 3) || CASE WHEN p_partkey % 2 = 0 THEN '/Public/' ELSE '/' END || 'F' || p_partkey || '.h' AS path, 'm' || (p_size % 3) || CASE WHEN p_partkey % 2 = 0 THEN '/Public/' ELSE '/' END || 'F' || p_partkey AS stem FROM part) h""")
def header_sources(spark, d):
    """Files where the implementation of each header may be."""
    p = ad.table(spark, d, "part")
    folder = F.when(F.col("p_partkey") % 2 == 0, "/Public/").otherwise("/")
    return links.header_sources(p.select(F.concat(F.lit("m"), F.col("p_size") % 3, folder, F.lit("F"), "p_partkey", F.lit(".h")).alias("path")))


@query("name:s line:l source:s ord:l", """
WITH own AS (SELECT name, line, row_number() OVER (ORDER BY name, line, id) - 1 AS o FROM symbols WHERE id % 2 = 0 AND contains(name, 'blue') QUALIFY o < 3000),
more AS (SELECT name, line, row_number() OVER (ORDER BY name, line, id) - 1 AS o FROM symbols WHERE id % 2 = 1 AND contains(name, 'blue') QUALIFY o < 3000)
SELECT name, line, source, row_number() OVER (ORDER BY stage, o) - 1 AS ord FROM (SELECT *, 'project' AS source, 0 AS stage FROM own
  UNION ALL SELECT *, 'engine', 1 FROM more WHERE (SELECT count(*) FROM own) < 3000 AND o < greatest(1, 3000 - (SELECT count(*) FROM own))) u ORDER BY ord LIMIT 3000""", ad.SYMBOLS)
def page_filled_from_engine(spark, d):
    """A page filled up from the second source without dropping repeats."""
    s = ad.symbols(spark, d).where(F.col("name").contains("blue"))
    own, more = (ordered.top(s.where(F.col("id") % 2 == k), ["name", "line", "id"], 3000) for k in (0, 1))
    return ordered.append_source(own, more, 3000)


# --- places --------------------------------------------------------------------------


@query("doc_id:l line:l col0:l", r"""
SELECT doc_id, coalesce(hit, 1) AS line, coalesce(col, 0) AS col0 FROM (SELECT d.doc_id, min(l.line) AS hit, arg_min(length(regexp_extract(l.text, '^(.*?)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)', 1)) + length(regexp_extract(l.text, '^(.*?)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)', 2)), l.line) AS col
  FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id AND l.line <= 9 AND regexp_matches(l.text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') GROUP BY 1) x""", ad.LINES)
def near_lines(spark, d):
    """The first of nine lines that holds a word, for the head of every document."""
    t = ad.table(spark, d, "documents").withColumn("path", F.col("doc_id").cast("string"))
    hits = t.select("path", "doc_id", F.lit(1).cast("long").alias("line"))
    return places.near_line(hits, places.numbered_lines(t.select("path", "text")), "the").withColumn("col0", F.col("column"))


@query("path:s line:l", "SELECT 'G/Public/Part12.h' AS path, 3 AS line FROM part WHERE p_partkey = 12")
def type_header(spark, d):
    """Declaration of a type in the header named for it, not in one that only names it."""
    p = ad.table(spark, d, "part")
    folder = F.when(F.col("p_partkey") % 2 == 0, "G/Public/").otherwise("G/Classes/")
    path = F.concat(folder, F.lit("Part"), "p_partkey", F.lit(".h"))
    body = F.concat(F.lit("class UPart12;\n// class UPart12 {\nclass G_API\n  UPart"), "p_partkey", F.lit(" final : public UBase\n{\n  UPart12* Next;\n};"))
    made = p.select(path.alias("path"), body.alias("text")).withColumn("filename", tx.file_name("path"))
    return places.header_of_type(made, made, "UPart12")


@query("path:s line:l kind:s context:s", """
SELECT DISTINCT m.path, m.line, 'declaration' AS kind, coalesce(l.text, 'C37::m5') AS context FROM members m LEFT JOIN (
  SELECT path, line, min(trim(text, chr(32) || chr(9) || chr(13) || chr(10))) AS text FROM (SELECT path, generate_subscripts(parts, 1) AS line, unnest(parts) AS text FROM (SELECT f.path, regexp_split_to_array(regexp_replace(html, '\\r?\\n$', ''), '\\r?\\n') AS parts FROM pages JOIN files f ON f.file_id = page_id) a) b GROUP BY 1, 2) l
  ON l.path = m.path AND l.line = m.line WHERE m.name = 'm5' AND m.class_name = 'C37'""", ad.FILES, ALL)
def member_places(spark, d):
    """Declarations of a member with the line they stand in."""
    return engine(spark, d).member_declarations("m5", "C37")


@query("path:s kind:s", """
SELECT path, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'definition' ELSE 'declaration' END AS kind
FROM (SELECT 'F' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.CPP' ELSE '.h' END AS path, * FROM part) x""")
def member_place_kinds(spark, d):
    """Definitions and declarations by file and line."""
    p = ad.table(spark, d, "part")
    path = F.concat(F.lit("F"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ".CPP").otherwise(".h"))
    context = F.when(F.col("p_partkey") % 3 == 0, "void A::Run()").when(F.col("p_partkey") % 3 == 1, "void Run();").otherwise("void A::Go()")
    return p.select(path.alias("path")).withColumn("kind", F.lit(None).cast("string")).drop("kind").join(
        p.select(path.alias("path"), places.member_place_kind(path, context, "Run").alias("kind")), "path")


@query("id:l", """
SELECT p_partkey AS id FROM part WHERE CASE WHEN p_partkey % 3 = 0 THEN 'A' || (p_size % 4) ELSE 'B' || (p_size % 5) END IN ('A1', 'B2', 'B3')""")
def usages_in_classes(spark, d):
    """Usages that concern a family of classes, by their scope or the method around."""
    p = ad.table(spark, d, "part")
    head = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  A"), F.col("p_size") % 4, F.lit(" :: "))).otherwise("  x.y; ")
    hits = p.select(F.col("p_partkey").alias("id"), F.concat(head, F.lit("Run()")).alias("text"), F.length(head).alias("column"), F.concat(F.lit("B"), F.col("p_size") % 5).alias("class_name"))
    return places.in_classes(hits, spark.createDataFrame([("A1",), ("B2",), ("B3",)], "name string"))


@query("path:s", """
SELECT DISTINCT 'D:/G/' || CASE WHEN p_size % 2 = 0 THEN 'Content/' ELSE 'Other/' END || ['BP_', 'T_', 'DA_'][p_partkey % 3 + 1] || p_partkey || ['.uasset', '.umap', '.txt'][p_size % 3 + 1] AS path FROM part
WHERE p_size % 2 = 0 AND (p_size % 3 = 1 OR (p_size % 3 = 0 AND p_partkey % 3 <> 1))""")
def candidate_assets(spark, d):
    """Important assets below a content folder."""
    p = ad.table(spark, d, "part")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % 3 + 1).cast("int"))
    path = F.concat(F.lit("D:\\G\\"), F.when(F.col("p_size") % 2 == 0, "Content\\").otherwise("Other\\"), pick(("BP_", "T_", "DA_"), F.col("p_partkey")), "p_partkey", pick((".uasset", ".umap", ".txt"), F.col("p_size")))
    return places.candidate_assets(p.select(tx.normalize_path(path).alias("path")))


@query("path:s", "SELECT 'D:/G/Content/X/P31.umap' AS path FROM part WHERE p_partkey = 31")
def asset_file(spark, d):
    """The file of an object path."""
    p = ad.table(spark, d, "part").select(F.concat(F.lit("D:/G/Content/X/P"), "p_partkey", F.when(F.col("p_partkey") % 2 == 0, ".uasset").otherwise(".umap")).alias("path"))
    return places.find_asset_file(p.union(p.select(F.replace("path", F.lit("/X/"), F.lit("/A/")))), "/Game/X/P31")


@query("name:s", "SELECT DISTINCT name FROM (SELECT CASE p_size % 5 WHEN 0 THEN 'Mac' WHEN 1 THEN 'P' || p_size WHEN 2 THEN 'Q' || p_size WHEN 3 THEN 'R' || p_size END AS name FROM part) x WHERE name IS NOT NULL")
def config_platforms(spark, d):
    """Platforms that have a folder of their own."""
    p, k, n = ad.table(spark, d, "part"), F.col("p_size") % 5, F.col("p_size")
    path = (
        F.when(k == 0, F.lit("/g/Config/Mac/x.txt")).when(k == 1, F.concat(F.lit("/g/Config/P"), n, F.lit("/P"), n, F.lit("Engine.ini")))
        .when(k == 2, F.concat(F.lit("/e/Platforms/Q"), n, F.lit("/DataDrivenPlatformInfo.ini"))).when(k == 3, F.concat(F.lit("/g/Platforms/R"), n, F.lit("/Config/a/b.ini")))
        .otherwise(F.concat(F.lit("/g/Config/S"), n, F.lit("/note.txt")))
    )
    return places.platforms(p.select(path.alias("path")), "/g", "/e")
