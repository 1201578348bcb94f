"""One method per query kind over an index, with an optional second index behind it.

Kinds that have parameters but no settled meaning are extensions of ours, derived from
the tables; their docstrings say "extension".
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import matching as mt
from tessera.functions import text as tx
from tessera.index import Index
from tessera.operators import assets, catalog, completion, diagnostics, graph, links, ordered, places, search, usage
from tessera.sources import cpp, words
from tessera.sources import files as fs

FUNCTION = "%function%"
OVERLOADS = 16
#: Completion lists and their rows that an engine keeps; the longest unused one goes first.
CACHED_LISTS = 400


def parameter_count(detail: Column | str) -> Column:
    """Number of parameters of a signature "(...)": commas within brackets of any kind
    part none."""
    inner = F.regexp_replace(tx.col(detail), r"^\s*\(|\)[^)]*$", "")
    step = lambda s, c: F.struct(
        (s["depth"] + F.when(c.isin("(", "<", "[", "{"), 1).when(c.isin(")", ">", "]", "}"), -1).otherwise(0)).alias("depth"),
        (s["n"] + F.when((c == ",") & (s["depth"] == 0), 1).otherwise(0)).alias("n"),
    )
    commas = F.aggregate(F.split(inner, ""), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(F.length(F.trim(inner)) > 0, commas + 1).otherwise(0)


class Engine:
    def __init__(self, index: Index, engine: Index | None = None, asset_graph: DataFrame | None = None) -> None:
        self.index, self.behind, self.assets = index, engine, asset_graph
        self._completed: OrderedDict[tuple, list] = OrderedDict()
        self._configured: dict[tuple, dict[str, list]] = {}

    # --- files -----------------------------------------------------------------------

    def files_in_modules(self, modules: Sequence[str], extensions: Sequence[str] = (), part: str = "") -> DataFrame:
        return catalog.files_in_modules(self.index.files, modules, extensions, part).orderBy("path")

    def search_files_in_modules(self, modules: Sequence[str], part: str, limit: int = 100) -> DataFrame:
        return catalog.search_files_in_modules(self.index.files, modules, part, min(limit, 1000))

    def search_files(self, part: str) -> DataFrame:
        return catalog.search_files(self.index.files, part)

    def depend_files(self, path: str, recursive: bool = True, game_only: bool = False) -> DataFrame:
        """Files that a file includes, directly or not; unknown paths give none."""
        i = self.index
        start = catalog.find_file(i.files, i.spark.createDataFrame([(path,)], "path string")).join(i.files.select("file_id", F.col("path").alias("node")), "file_id")
        edges = i.includes.select(F.col("path").alias("src"), F.col("resolved").alias("dst"))
        reached = graph.reachable(edges, start) if recursive else graph.bfs(edges, start, 1, include_seeds=False)
        found = reached.select(F.col("node").alias("path")).distinct()
        return found.where(~F.lower("path").contains("/engine/")) if game_only else found

    def target_files(self) -> DataFrame:
        return self.index.files.where(tx.like_ci("filename", "%.Target.cs")).orderBy("path")

    def all_file_paths(self) -> DataFrame:
        return self.index.files.select("path").orderBy("path")

    def all_files_metadata(self) -> DataFrame:
        return self.index.files.orderBy("path")

    def program_files(self) -> DataFrame:
        """Extension: source files below a Programs folder."""
        return self.index.files.where(tx.contains_ci("path", "/programs/") & F.col("extension").isin(*fs.SOURCE_EXTENSIONS))

    def all_ini_files(self) -> DataFrame:
        """Extension."""
        return self.index.files.where("extension = 'ini'").orderBy("path")

    # --- modules and components --------------------------------------------------------

    def modules(self) -> DataFrame:
        return self.index.modules.orderBy("name")

    def module_by_name(self, name: str) -> DataFrame:
        return ordered.top(self.index.modules.where(F.col("name") == name), ["root"], 1) if name.strip() else self.index.modules.limit(0)

    def search_modules(self, part: str, limit: int = 100) -> DataFrame:
        return ordered.top(self.index.modules.where(tx.contains_ci("name", part)), ["name", "root"], min(limit, 1000))

    def module_names(self) -> DataFrame:
        return self.index.modules.select("name").orderBy("name")

    def module_root_path(self, name: str) -> DataFrame:
        """Extension."""
        return self.module_by_name(name).select("root")

    def module_files(self, name: str, root: str | None = None) -> DataFrame:
        """Extension: files of a module, by name and, where given, root."""
        f = self.index.files.where(F.col("module_name") == name)
        return f if root is None else f.where(F.col("module_root") == root)

    def module_directories(self, name: str, root: str | None = None) -> DataFrame:
        """Extension."""
        return self.module_files(name, root).select("directory").distinct()

    def deep_dependencies(self) -> DataFrame:
        edges = self.index.modules.select(F.col("name").alias("src"), F.explode("deps").alias("dst"))
        return graph.deep_dependencies(edges)

    def components(self) -> DataFrame:
        return self.index.components

    def component_data(self, name: str) -> DataFrame:
        """Extension: modules of a component."""
        return self.index.modules.where(F.col("component") == name)

    # --- classes and members -------------------------------------------------------------

    def structs_only(self) -> DataFrame:
        return catalog.symbols_of_type(self.index.classes, catalog.STRUCTS).orderBy("name")

    def symbols_by_type(self, kind: str, limit: int | None = None) -> DataFrame:
        return ordered.top(catalog.symbols_of_type(self.index.classes, [kind]), ["name", "class_id"], catalog.clamp(limit, 1000, 1, 5000))

    def classes(self, where: Column | str = "true") -> DataFrame:
        """Extension: classes that satisfy the caller's condition."""
        return self.index.classes.where(where)

    def structs(self, where: Column | str = "true") -> DataFrame:
        """Extension."""
        return catalog.symbols_of_type(self.index.classes, catalog.STRUCTS).where(where)

    def search_classes_prefix(self, prefix: str, limit: int | None = None) -> DataFrame:
        return catalog.classes_with_prefix(self.index.classes, prefix, limit)

    def class_by_name(self, name: str) -> DataFrame:
        """Extension: the class of a name in the preferred place."""
        return ordered.top(self.index.classes.where(F.col("name") == name), [catalog.type_rank(), "line", "class_id"], 1)

    def class_file_path(self, name: str) -> DataFrame:
        """Extension."""
        return self.class_by_name(name).select("path")

    def file_symbols(self, path: str) -> DataFrame:
        i = self.index
        at = catalog.find_file(i.files, i.spark.createDataFrame([(path,)], "path string")).join(i.files.select("file_id", "path"), "file_id").select("path")
        return catalog.members_nested(i.classes.join(at, "path", "left_semi"), i.members).orderBy("line")

    def class_members(self, name: str, kind: str | None = None) -> DataFrame:
        m = self.index.members.where(F.col("class_name") == name)
        return (m if kind is None else m.where(F.lower("type").contains(kind))).orderBy("line", "member_id")

    def class_members_by_id(self, class_id: int) -> DataFrame:
        """Extension."""
        return self.index.members.where(F.col("class_id") == class_id).orderBy("line")

    def class_methods(self, name: str) -> DataFrame:
        """Extension."""
        return self.class_members(name, "function")

    def class_properties(self, name: str) -> DataFrame:
        """Extension."""
        return self.class_members(name, "property")

    def enum_values(self, name: str) -> DataFrame:
        return catalog.enum_values(self.index.enum_values, name)

    def classes_in_modules(self, modules: Sequence[str], kind: str | None = None, grouped: bool = True) -> DataFrame:
        f = catalog.files_in_modules(self.index.files, modules).select("path")
        c = self.index.classes.join(f, "path", "left_semi")
        c = c if kind is None else c.where(F.col("symbol_type") == kind)
        return catalog.classes_by_path(c).orderBy("path") if grouped else c

    def update_member_return_type(self, class_name: str, member: str, kind: str) -> Index:
        """Extension: the index with one member's return type replaced."""
        hit = (F.col("class_name") == class_name) & (F.col("name") == member)
        from dataclasses import replace

        return replace(self.index, members=self.index.members.withColumn("return_type", F.when(hit, F.lit(kind)).otherwise(F.col("return_type"))))

    # --- inheritance -----------------------------------------------------------------------

    def _edges(self, index: Index | None = None) -> DataFrame:
        i = index or self.index
        edges = i.inheritance.select(F.col("child_id").alias("src"), F.col("parent").alias("dst_name"), F.col("parent_id").alias("dst"))
        return graph.resolved_edges(edges, i.classes.select(F.col("class_id").alias("id"), "name"))

    def _ids(self, name: str, index: Index | None = None) -> DataFrame:
        i = index or self.index
        return i.classes.where(F.col("name") == name.split("::")[-1]).select(F.col("class_id").alias("node"))

    def _closure(self, name: str, down: bool) -> DataFrame:
        edges = self._edges()
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if down else edges
        found = graph.bfs(edges, self._ids(name), include_seeds=False).groupBy("node").agg(F.min("depth").alias("depth"))
        return found.join(self.index.classes, F.col("node") == F.col("class_id")).drop("node")

    def derived_classes(self, base: str) -> DataFrame:
        """Extension: direct children by parent name, and the assets that derive."""
        i = self.index
        own = i.inheritance.where(F.col("parent") == base).select(F.col("child_id").alias("class_id")).distinct().join(i.classes, "class_id").select("name", "path", "line")
        if self.assets is None:
            return own
        more = assets.asset_usages(self.assets, base).where("relation = 'derived'").select(tx.file_name("asset").alias("name"), F.col("asset").alias("path"), F.lit(0).cast("long").alias("line"))
        return ordered.first_wins(ordered.staged_union([own, more]).withColumn("__k", F.lower("path")), ["__k", "name"], ["stage", "line"]).drop("__k", "stage")

    def recursive_derived_classes(self, name: str) -> DataFrame:
        """Extension."""
        return self._closure(name, down=True)

    def recursive_parent_classes(self, name: str) -> DataFrame:
        """Extension."""
        return self._closure(name, down=False)

    def class_members_recursive(self, name: str) -> DataFrame:
        """Extension: members over the parent closure, with depth."""
        m = self.index.members.withColumnRenamed("class_id", "node")
        return graph.members_of_closure(self._edges(), self._ids(name), m).drop("seed")

    def virtual_functions(self, name: str) -> DataFrame:
        """Extension: functions that more than one class of the chain declares."""
        f = self.class_members_recursive(name).where(F.lower("type").contains("function"))
        return f.groupBy("name").agg(F.countDistinct("class_name").alias("n"), F.min_by("class_name", "depth").alias("nearest")).where("n > 1")

    def symbol_in_chain(self, class_name: str, symbol: str, index: Index | None = None) -> DataFrame:
        """The member of that name in the nearest class of the chain that owns one."""
        i = index or self.index
        owned = i.members.where(F.col("name") == symbol).withColumnRenamed("class_id", "node").withColumn("order", catalog.header_rank() + F.when(F.col("access") == "impl", 10).otherwise(0))
        hit = graph.chain_lookup(self._edges(i), self._ids(class_name, i), owned, ["order", "path", "line"])
        return ordered.top(hit, ["depth", "order", "path", "line"], 1)

    def is_subclass(self, child: str, parent: str) -> bool:
        return child == parent or not self.recursive_parent_classes(child).where(F.col("name") == parent).isEmpty()

    # --- search ------------------------------------------------------------------------------

    def search_symbols(self, pattern: str, limit: int = 100, offset: int = 0) -> DataFrame:
        keys, order = ["name", "path", "line"], ["rank", "kind_rank", "name", "path", "line", "id"]
        own = self._ranked(self.index, pattern, limit, offset)
        if self.behind is None:
            return ordered.tag_source(own, "project")
        page, more = ordered.tag_source(own, "project"), ordered.tag_source(self._ranked(self.behind, pattern, limit, 0), "engine")
        merged = ordered.first_wins(ordered.fallback_below(page, more, limit), keys, ["stage", "ord"])
        return ordered.top(merged.drop("ord"), ["stage", *order], limit)

    @staticmethod
    def _ranked(index: Index, pattern: str, limit: int, offset: int) -> DataFrame:
        out = search.search_symbols(index.symbols(), pattern, limit, offset)
        return out if "rank" in out.columns else out.withColumn("rank", F.lit(0)).withColumn("kind_rank", F.lit(0))

    def search_symbols_in_modules(self, modules: Sequence[str], pattern: str, kind: str | None = None, limit: int = 100) -> DataFrame:
        """Extension."""
        s = self.index.symbols().where(F.col("module_name").isin(*modules))
        return search.search_symbols(s if kind is None else s.where(F.col("type") == kind), pattern, limit)

    def symbol_in_module(self, module: str, symbol: str) -> DataFrame:
        """A type of the module, else a member in it."""
        s = self.index.symbols().where((F.col("module_name") == module) & (F.col("name") == symbol)).withColumn("order", catalog.type_rank())
        both = ordered.staged_union([s.where("class_name is null"), s.where("class_name is not null")])
        return ordered.top(ordered.lowest_stage(both), ["order", "line", "id"], 1)

    def fast_find(self, pattern: str, limit: int = 50, offset: int = 0, scope: str = "both") -> DataFrame:
        """Symbols and files, best first, of the project, the engine, or the project's page
        filled up from the engine; a repeated place counts once."""
        if scope == "engine":
            none = self.behind is None
            page = self._found(self.index if none else self.behind, pattern, limit, offset, False)
            return ordered.tag_source(page.limit(0) if none else page, "engine")
        page = self._found(self.index, pattern, limit, offset, False)
        if scope == "project" or self.behind is None:
            return ordered.tag_source(page, "project")
        return ordered.append_source(page, self._found(self.behind, pattern, limit, 0, False), limit, ["name", "path", "line"])

    def global_find(self, pattern: str, limit: int = 50, offset: int = 0) -> DataFrame:
        """Symbols, files and text of the project, filled up from the engine."""
        page = self._found(self.index, pattern, limit, offset, True)
        if self.behind is None:
            return ordered.tag_source(page, "project")
        return ordered.append_source(page, self._found(self.behind, pattern, limit, 0, True), limit)

    @staticmethod
    def _found(index: Index, pattern: str, limit: int, offset: int, in_text: bool) -> DataFrame:
        pattern, limit = pattern.strip(), catalog.clamp(limit, 50, 1, 500)
        s, wanted = index.symbols(), limit + offset
        if not pattern:
            hits = search.list_symbols(s, limit, offset)
            return search.found(hits, "symbol", F.col("name"), F.col("path"), F.col("line")).withColumn("ord", F.col("ord") - offset)
        if in_text:
            hits = search.search_symbols(s, pattern, wanted)
        else:
            hits = search.fast_find_symbols(s.drop("path", "line"), s.select("id", "path", "line"), pattern, min(wanted, 500))
        names = search.search_files_ranked(index.files, pattern, wanted)
        lines = search.grep(index.texts, pattern, wanted) if in_text else None
        return search.global_find(
            search.found(hits, "symbol", F.col("name"), F.col("path"), F.col("line")), search.found(names, "file", F.col("filename"), F.col("path"), F.lit(1)),
            None if lines is None else search.found(lines, "text", F.lit(pattern), F.col("path"), F.col("line")), limit, offset,
        ).withColumn("ord", F.col("ord") - offset)

    def search_code_text(self, pattern: str, limit: int = 100, offset: int = 0, scope: str = "project") -> DataFrame:
        at = self.behind if scope == "engine" and self.behind is not None else self.index
        return search.grep(at.texts, pattern, limit, offset)

    def references(self, symbol: str, current: str | None = None, limit: int = usage.RESULT_CAP, scope: str = "global") -> DataFrame:
        """Usages here, then, unless the scope is local or a member's, in the index behind;
        a place counts once, the first `limit` in that order."""
        own = ordered.tag_source(self.symbol_usages(symbol, current, limit), "project")
        if self.behind is None or scope in ("local", "member"):
            return own
        more = ordered.tag_source(Engine(self.behind).symbol_usages(symbol, None, limit), "engine")
        merged = ordered.first_wins(ordered.staged_union([own, more]), ["path", "line", "column"], ["stage"])
        return ordered.top(merged.drop("ord"), ["stage", "path", "line", "column"], limit).drop("stage")

    def symbol_usages(self, symbol: str, current: str | None = None, limit: int = usage.RESULT_CAP) -> DataFrame:
        i = self.index
        named = lambda df: df.where(F.col("name") == symbol).select("path")
        defined = named(i.classes).union(named(i.members)).union(named(i.enum_values))
        at = usage.candidate_files(defined, named(i.calls), i.includes.where("resolved is not null"), i.files, current)
        texts = i.texts.join(at, "path", "left_semi").where(F.col("text").contains(symbol))
        lines = texts.select("path", F.posexplode(tx.text_lines("text")).alias("n", "text")).withColumn("line", F.col("n") + 1)
        return usage.usages(lines, symbol, limit)

    def usage_scope(self, text: str, line: int, symbol: str, qualifier: str | None = None, enclosing: str | None = None) -> tuple[str, str | None]:
        """Where usages of a symbol may be: ("local", None) for a variable of the buffer,
        ("member", owner) for a member of the class that a qualifier or the place names,
        with the class of its chain that owns it, else ("global", None)."""
        if not qualifier and cpp.variable_type(text, symbol, line):
            return "local", None
        target = enclosing if qualifier in (None, "this", "Super") else self._class_of(text, line, qualifier)
        hit = self.symbol_in_chain(target, symbol).first() if target else None
        return ("member", hit["class_name"]) if hit else ("global", None)

    def member_usages(self, symbol: str, owner: str, context: str | None = None, limit: int = usage.RESULT_CAP) -> DataFrame:
        """Declarations of a member first, then its usages within methods of its class, of
        those that derive from it and of the class at the cursor, or qualified by one."""
        i = self.index
        declared = places.member_places(i.members, i.texts, symbol, owner)
        family = self._closure(owner, down=True).select("name").union(i.spark.createDataFrame([(n,) for n in {owner, context or owner}], "name string"))
        lines = places.numbered_lines(i.texts)
        hits = usage.usages(lines.where(F.col("text").contains(symbol)), symbol, usage.FILE_CAP)
        ranges = usage.method_ranges(lines.join(hits.select("path").distinct(), "path", "left_semi"))
        inside = places.in_classes(usage.within_ranges(hits.drop("ord"), ranges), family)
        rows = inside.select("path", "line", F.col("column").cast("long").alias("column"), tx.strip("text").alias("context"), "kind")
        both = ordered.staged_union([declared.select("path", "line", "column", "context", "kind"), rows])
        unique = ordered.first_wins(both, ["path", "line", "column"], ["stage"])
        return ordered.top(unique, ["stage", "path", "line", "column"], limit).drop("stage")

    def member_declarations(self, symbol: str, owner: str) -> DataFrame:
        return places.member_places(self.index.members, self.index.texts, symbol, owner)

    def header_of_type(self, name: str) -> DataFrame:
        return places.header_of_type(self.index.files, self.index.texts, name)

    def call_sites(self, symbol: str, limit: int | None = None) -> DataFrame:
        return ordered.top(self.index.calls.where(F.col("name") == symbol), ["path", "line"], limit or 200)

    # --- navigation -----------------------------------------------------------------------------

    def goto_definition(self, text: str, line: int, symbol: str, qualifier: str | None = None, enclosing: str | None = None, prefer_impl: bool = False) -> DataFrame:
        """Where a symbol of a buffer is defined: a local declaration, else a member of the
        qualifier's class chain, else of the enclosing class's, else a type, else a member
        anywhere; in this index, else in the one behind."""
        i = self.index
        local = None if qualifier or prefer_impl else cpp.variable_type(text, symbol, line)
        if local:
            return i.spark.createDataFrame([(symbol, None, local.line, local.type, "local")], "name string, path string, line long, type string, how string")
        stages = []
        for at in filter(None, (i, self.behind)):
            for owner in filter(None, (self._class_of(text, line, qualifier), enclosing)):
                stages.append(self._row(self.symbol_in_chain(owner, symbol, at), "chain"))
            kind = at.classes.where(F.col("name") == symbol).withColumn("type", F.col("symbol_type"))
            stages.append(self._row(ordered.top(kind, [catalog.type_rank(), "line", "class_id"], 1), "type"))
            member = at.members.where(F.col("name") == symbol)
            order = catalog.impl_order() if prefer_impl else catalog.declaration_order()
            stages.append(self._row(ordered.top(member, [*order, "path", "member_id"], 1), "member"))
        return ordered.lowest_stage(ordered.staged_union(stages)).drop("stage")

    def goto_implementation(self, text: str, line: int, symbol: str, qualifier: str | None = None, enclosing: str | None = None) -> DataFrame:
        """Where a member is implemented: by the name of its class, else of the nearest
        parent that has it, implementations in source files first; members of other classes
        are no answer.  In this index, else in the one behind."""
        i = self.index
        name = self._class_of(text, line, qualifier) or enclosing
        if not name:
            return self._row(i.members.limit(0), "impl")
        stages = [self._row(self.implementation_in_chain(name, symbol, at), "impl") for at in filter(None, (i, self.behind))]
        return ordered.lowest_stage(ordered.staged_union(stages)).drop("stage")

    def implementation_in_chain(self, class_name: str, symbol: str, index: Index | None = None) -> DataFrame:
        """The member of that name by the name of the class, else of its nearest parent.  A
        class that is not indexed still finds its members by name."""
        i = index or self.index
        own = i.spark.createDataFrame([(class_name.split("::")[-1], 0)], "class_name string, depth int")
        chain = graph.bfs(self._edges(i), self._ids(class_name, i)).join(i.classes, F.col("node") == F.col("class_id")).select(F.col("name").alias("class_name"), "depth")
        near = own.unionByName(chain).groupBy("class_name").agg(F.min("depth").alias("depth"))
        hits = i.members.where(F.col("name") == symbol).join(near, "class_name")
        return ordered.top(hits, ["depth", *catalog.impl_order(), "path", "member_id"], 1)

    @staticmethod
    def _row(df: DataFrame, how: str) -> DataFrame:
        return df.select("name", "path", "line", "type", F.lit(how).alias("how"))

    @staticmethod
    def _class_of(text: str, line: int, qualifier: str | None) -> str | None:
        if not qualifier:
            return None
        found = cpp.variable_type(text, qualifier, line)
        return found.type if found else qualifier

    def hover(self, text: str, line: int, symbol: str, qualifier: str | None = None, enclosing: str | None = None) -> DataFrame:
        hit = self.goto_definition(text, line, symbol, qualifier, enclosing)
        m = self.index.members.select(F.col("path").alias("__p"), F.col("line").alias("__l"), F.col("name").alias("__n"), "detail", "return_type", "access")
        return hit.join(m, F.col("path").eqNullSafe(F.col("__p")) & (F.col("line") == F.col("__l")) & (F.col("name") == F.col("__n")), "left").drop("__p", "__l", "__n")

    def signature_help(self, function: str, arguments: str, class_name: str | None = None) -> DataFrame:
        """Overloads of a function in a class chain, else anywhere, and which parameter the
        text between the parenthesis and the cursor has come to."""
        is_function = tx.like_ci("type", FUNCTION) & (F.col("name") == function)
        sources = []
        for i in filter(None, (self.index, self.behind)):
            stages = []
            if class_name:
                chain = graph.bfs(self._edges(i), self._ids(class_name, i)).select(F.col("node").alias("class_id"), "depth")
                stages.append(i.members.where(is_function).join(chain, "class_id"))
            stages.append(i.members.where(is_function).withColumn("depth", F.lit(0)))
            sources.append(ordered.lowest_stage(ordered.staged_union(stages)).drop("stage"))
        hits = ordered.staged_union(sources)
        label = F.concat(F.coalesce(F.concat("return_type", F.lit(" ")), F.lit("")), "name", F.coalesce("detail", F.lit("()")))
        unique = ordered.first_wins(hits.withColumn("label", label), ["label", "path", "line"], ["stage", "depth"])
        active = max(0, len(cpp.split_top_level(arguments + "_")) - 1)
        count = parameter_count("detail")
        return ordered.top(unique, ["stage", "depth", "path", "line", "label"], OVERLOADS).drop("stage").withColumn("active", F.greatest(F.lit(0), F.least(F.lit(active), count - 1)))

    def parse_buffer(self, text: str, path: str = "buffer") -> DataFrame:
        """Symbols of an unsaved text."""
        return self.index.spark.createDataFrame([(path, *r) for r in cpp.parse(text)], cpp.SYMBOLS)

    # --- completion --------------------------------------------------------------------------------

    def completions(self, text: str, line: int, column: int, within: str | None = None) -> DataFrame:
        """Candidates at a cursor (line from 1, column from 0): include paths, directives,
        macro specifiers, members of an expression's type, else locals, buffer symbols,
        members of the enclosing class, keywords and global types."""
        spark, above = self.index.spark, text.split("\n")[: line - 1]
        head = text.split("\n")[line - 1][:column]
        if include := re.match(r'\s*#\s*include\s+["<]([^">]*)$', head):
            items = completion.include_items(self.index.files.where("is_header"), include[1])
            return items.select("label", "kind", "sort_text", F.col("ord"))
        if directive := re.match(r"\s*#\s*(\w*)$", head):
            return completion.word_items(spark, words.DIRECTIVES, directive[1], 40, 14)
        if macro := cpp.open_macro("\n".join([*above, head])):
            return completion.word_items(spark, words.macro_words(macro[0], macro[1]), macro[2], 80, 12)
        prefix = re.search(r"\w*$", head)[0]
        if expression := cpp.receiver(head[: len(head) - len(prefix)]):
            return self._members(self.expression_type(text, line, expression, within) or "", prefix, within)
        local = [d.name for d in cpp.visible_declarations(text, line)]
        parsed = cpp.parse(text)
        stages = [
            completion.word_items(spark, local, prefix, 5, 6, ranked=True),
            completion.word_items(spark, [r[1] for r in parsed if r[0] == "class"], prefix, 200, 7, ranked=True),
            completion.word_items(spark, [r[1] for r in parsed if r[0] == "member" and "function" in r[3]], prefix, 250, 2, ranked=True),
        ]
        if within:
            stages.append(self._members(within, prefix, within))
        if len(prefix) >= 2 and prefix == prefix.lower():
            stages.append(completion.word_items(spark, words.KEYWORDS, prefix, 120, 14))
        if len(prefix) >= 3:
            for n, at in enumerate(filter(None, (self.index, self.behind if len(prefix) >= 4 else None))):
                g = completion.global_items(at.classes.withColumn("id", F.col("class_id")), prefix, 100_000 * (n + 1))
                stages.append(g.select(F.col("name").alias("label"), F.lit(7).alias("kind"), "sort_text", "ord"))
                stages.append(ordered.top(completion.enum_items(at.enum_values, prefix), ["sort_text", "label"], completion.GLOBALS))
        return completion.merge_items(stages)

    def completion_list(self, text: str, line: int, column: int, within: str | None = None) -> list:
        """Rows of `completions`, in order, kept for the next call of the same kind."""
        key = (hash(text), line, column, within)
        if key in self._completed:
            self._completed.move_to_end(key)
        else:
            self._completed[key] = self.completions(text, line, column, within).orderBy("ord").collect()
            if len(self._completed) > CACHED_LISTS:
                self._completed.popitem(last=False)
        return self._completed[key]

    @staticmethod
    def buffer_parents(text: str) -> dict[str, list[str]]:
        """Parents of each class that a buffer declares."""
        return {r[1]: [b.strip() for b in r[7].split(",")] for r in cpp.parse(text) if r[0] == "class" and r[7]}

    def expression_type(self, text: str, line: int, expression: str, within: str | None = None, depth: int = 4) -> str | None:
        """The type of a chained expression at a line of a buffer, one lookup a hop; None
        where a hop has no known type.  `auto` takes the type of what was assigned, up to
        `depth` times."""
        owner = None
        for n, hop in enumerate(cpp.hops(expression)):
            if n:
                kind = self._member_type(owner, hop.name) or (words.KNOWN_CALLS.get(hop.name) if hop.called else None)
            elif hop.name == "this":
                kind = within
            elif hop.called:
                kind = hop.argument or (within and self._member_type(within, hop.name)) or words.KNOWN_CALLS.get(hop.name) or hop.name
            else:
                kind = self._variable_type(text, line, hop.name, within, depth)
            for _ in range(hop.subscripts):
                kind = kind and cpp.element_type(kind)
            owner = kind and cpp.clean_type(kind)
            if not owner:
                return None
        return owner

    def _variable_type(self, text: str, line: int, name: str, within: str | None, depth: int) -> str:
        found = cpp.variable_type(text, name, line)
        if found and found.type == "auto":
            given = cpp.assigned_text(text, name, line)
            return (given and depth and self.expression_type(text, line, given, within, depth - 1)) or ""
        return found.type if found else (within and self._member_type(within, name)) or name

    def _member_type(self, owner: str, name: str) -> str | None:
        """Type of a member in the nearest class of the chain, known ones before void,
        longer ones first."""
        for at in filter(None, (self.index, self.behind)):
            found = Engine(at).class_members_recursive(owner).where(F.col("name") == name)
            unknown = F.coalesce(F.col("return_type") == "void", F.lit(True))
            hit = ordered.top(found, ["depth", unknown, F.length("return_type").desc_nulls_last(), "return_type"], 1).first()
            if hit and hit["return_type"]:
                return hit["return_type"]
        return None

    def _members(self, owner: str, prefix: str, within: str | None) -> DataFrame:
        m = self.class_members_recursive(owner).withColumn("kind", F.when(F.lower("type").contains("function"), 2).otherwise(5))
        inside = F.lit(bool(within) and self.is_subclass(within, owner)) if within else F.lit(False)
        seen = m.where(completion.accessible(F.col("access"), F.col("class_name") == F.lit(within or ""), inside))
        items = completion.member_items(seen.select("class_name", "depth", "name", "kind", F.coalesce("detail", F.lit("")).alias("detail")), prefix)
        own = items.select(F.col("name").alias("label"), "kind", "sort_text", (F.col("depth") * 1000 + F.col("place")).alias("ord"))
        stages = [own, completion.enum_items(self.index.enum_values.where(F.col("enum_name") == owner), prefix)]
        if self.behind is not None:  # what the class has, or inherits, in the index behind
            stages.append(Engine(self.behind)._members(owner, prefix, within))
            for parent in self._parents_behind(owner):
                stages.append(Engine(self.behind)._members(parent, prefix, within))
        return completion.merge_items(stages).drop("stage") if len(stages) > 1 else own

    def _parents_behind(self, owner: str) -> list[str]:
        """Names of parents in the chain of a class that only the index behind knows."""
        chain = graph.bfs(self._edges(), self._ids(owner)).select(F.col("node").alias("child_id"), "depth")
        late = self.index.inheritance.join(chain, "child_id").join(self.index.classes.select(F.col("name").alias("parent")).distinct(), "parent", "left_anti")
        return [r["parent"] for r in late.groupBy("parent").agg(F.min("depth").alias("depth")).orderBy("depth", "parent").collect()]

    # --- diagnostics ---------------------------------------------------------------------------------

    def diagnostics(self, path: str, text: str) -> DataFrame:
        """Reflection rules over a buffer, and, in headers, its unfinished declarations and
        those without an implementation."""
        spark = self.index.spark
        lines = spark.createDataFrame([(path, i, t) for i, t in enumerate(text.split("\n"))], "path string, line int, text string")
        rules = diagnostics.rule_diagnostics(lines)
        header = path.lower().endswith((".h", ".hpp", ".hh", ".hxx"))
        if header and (unfinished := cpp.incomplete_members(text)):
            rows = [(path, at - 1, "error", "UECPP002") for _, at in unfinished]
            rules = rules.unionByName(spark.createDataFrame(rows, "path string, line int, severity string, code string"))
        asked = [(path, f"{r[2]}::{r[1]}{r[5]}", r[8] - 1) for r in cpp.parse(text) if r[0] == "member" and "function" in r[3] and r[4] != "impl" and not self._has_body(text, r[8])]
        if not asked or not header:
            return rules
        declared = spark.createDataFrame(asked, "path string, signature string, line int")
        missing = links.without_definition(declared.select("path", "signature").distinct(), self.index.texts)
        more = declared.join(missing, ["path", "signature"], "left_semi").select("path", "line", F.lit("warning").alias("severity"), F.lit("UECPP001").alias("code"))
        return rules.unionByName(more)

    @staticmethod
    def _has_body(text: str, line: int) -> bool:
        rest = "\n".join(text.split("\n")[line - 1 : line + 7])
        stop = re.search(r"[;{]", rest)
        head = rest[: stop.end()] if stop else rest
        return head.endswith("{") or bool(re.search(r"=\s*(0|delete|default)\s*;|\b(inline|FORCEINLINE|friend)\b", head))

    def build_diagnostics(self, log: str) -> DataFrame:
        lines = self.index.spark.createDataFrame(list(enumerate(log.splitlines())), "line_no int, text string")
        return diagnostics.log_diagnostics(lines).orderBy("source", "line_no")

    # --- assets and configuration ------------------------------------------------------------------------

    def asset_list(self) -> DataFrame:
        if self.assets is None:
            return ordered.top(self.index.files.where(F.col("extension").isin("uasset", "umap")), ["path"], 1000).select(tx.asset_path("path").alias("asset"))
        return assets.all_assets(self.assets).orderBy("asset")

    def asset_usages(self, name: str) -> DataFrame:
        return assets.asset_usages(self.assets, name).orderBy("relation", "asset")

    def asset_dependencies(self, packages: DataFrame, asset: str) -> DataFrame:
        """Imports and parent of one asset of read packages."""
        hit = packages.where(tx.asset_path("path") == asset)
        return hit.select(F.explode(F.array_compact(F.concat("imports", F.array("parent")))).alias("dependency")).distinct().orderBy("dependency")

    def grep_assets(self, blobs: DataFrame, pattern: bytes) -> DataFrame:
        inside = tx.directory("path").contains("/Content/")
        return search.grep_bytes(blobs.where(inside), pattern).select("path").orderBy("path")

    def config(self, project: str, engine: str | None, platform: str | None, kind: str) -> DataFrame:
        items = fs.ini_items(self.index.texts.where(F.lower("path").endswith(".ini")))
        return fs.resolve_config(items, fs.config_stack(project, engine, platform, kind))

    def config_data(self, project: str, engine: str | None, kinds: Sequence[str] = ("Engine", "Game", "Input", "Editor")) -> dict[str, list]:
        """Resolved settings of every available platform, and of none; kept until
        `forget_config` says that a file has changed."""
        key = (project, engine, tuple(kinds))
        if key not in self._configured:
            found = [None, *(r["name"] for r in places.platforms(self.index.files, project, engine).orderBy("name").collect())]
            self._configured[key] = {
                p or "Default": [r for kind in kinds for r in self.config(project, engine, p, kind).orderBy("section", "key").collect()] for p in found
            }
        return self._configured[key]

    def forget_config(self) -> None:
        self._configured.clear()

    def status(self) -> dict[str, int]:
        """Row counts of the index."""
        return {"files": self.index.files.count(), "classes": self.index.classes.count()}

    def ready(self) -> bool:
        """Whether the index holds any file and class, without counting them."""
        return not self.index.files.isEmpty() and not self.index.classes.isEmpty()
