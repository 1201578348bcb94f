"""Every query against its SQL on the small tables, and properties of the operators."""

from __future__ import annotations

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import matching as mt
from tessera.functions import text as tx
from tessera.operators import catalog, graph, links, oplog, ordered, search, usage
from tessera.plans import engine_queries, registry  # noqa: F401
from tessera.streaming import changes

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == sorted(repr(r) for r in found.fetchall())


def test_full_fold_equals_python(spark):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{DATA}/events.parquet").to_pylist()
    ops = {}
    kinds = {"signup": "set", "error": "clear", "purchase": "remove"}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        ops.setdefault(r["user_id"], []).append((kinds.get(r["event_type"], "add"), str(r["event_id"] % 5)))
    got = {r.key: (r.value, r.history) for r in registry.QUERIES["config_fold_full"](spark, DATA).collect()}
    for key, log in ops.items():
        want = oplog.apply_ops(log)
        assert got[key] == (want[-1], "|".join(want))


@pytest.mark.parametrize(("log", "shown"), [
    ([("set", "a"), ("add", "b"), ("remove", "a"), ("remove", "b")], ["a", "[Array x2] b", "[Array x1] b", "nil"]),
    ([("set", "a"), ("remove", "a"), ("add", "c"), ("clear", "x")], ["a", "nil", "[Array x1] c", "nil"]),
    ([("set", "y" * 51)], ["y" * 47 + "..."]), ([("set", "y" * 50)], ["y" * 50]), ([("remove", "q"), ("set", "v"), ("remove", "w")], ["nil", "v", "v"]),
])
def test_fold_examples(spark, log, shown):
    df = spark.createDataFrame([("k", i, o, v) for i, (o, v) in enumerate(log)], "key string, i int, op string, value string")
    assert oplog.fold(df, ["key"], ["i"]).first().history == shown == oplog.apply_ops(log)


def rank_in_python(candidate, prefix):
    """Straight reading of the tiers that match_rank documents."""
    low, name, parts, words = prefix.lower(), candidate.lower(), mt.words_of(prefix), mt.words_of(candidate)
    if not prefix or name.startswith(low):
        return 0
    if words and "".join(words).startswith(low):
        return 1
    for i, w in enumerate(words):
        if w.startswith(low):
            return 2 + i
    anchored = len(parts) < 2 or bool(words and words[0].startswith(parts[0]))
    if words and anchored:
        for i in range(len(words)):
            if "".join(words[i:]).startswith(low):
                return 10 + i
        best = []
        for start in range(len(words)) if len(parts) > 1 else ():
            if words[start].startswith(parts[0]):
                at, gaps = start, 0
                for p in parts[1:]:
                    step = next((i for i in range(at + 1, len(words)) if words[i].startswith(p)), None)
                    if step is None:
                        break
                    gaps, at = gaps + step - at - 1, step
                else:
                    best.append(10 * start + gaps)
        if best:
            return 20 + min(best)
    if len(parts) > 1 and not anchored:
        return mt.NONE
    if low in name:
        return 40 + name.index(low)
    letters, short = "".join(c for c in name if c.isascii() and c.isalnum()), "".join(c for c in low if c.isascii() and c.isalnum())
    if short and short in letters:
        return 80 if letters.startswith(short) else 100 + letters.index(short)
    return mt.NONE


@pytest.mark.parametrize("prefix", ["", "get", "val", "GetHea", "hp_va", "max_hp", "MaxVal", "a2", "zz", "_x", "tHP", "get_x_y"])
def test_match_rank_equals_python(spark, prefix):
    r = random.Random(1)
    pool = ["GetHealth", "MyValue", "bIsDead", "MaxHP2Value_x", "get_max_hp", "HPMaxValue", "x", "_x", "aA2B", "GetXAndY", "", "éMax"]
    names = pool + ["".join(r.choice(["Max", "HP", "hp", "_", "Val", "get", "2", "x", " "]) for _ in range(5)) for _ in range(60)]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", mt.match_rank("n", prefix).alias("r")).collect()
    for row in got:
        assert row.r == rank_in_python(row.n, prefix), (row.n, prefix)


def test_identifier_words_and_sort_text(spark):
    row = spark.range(1).select(mt.identifier_words(F.lit("MaxHP2Value_x")).alias("w"), mt.sort_text(F.lit(12345), F.lit(2), F.lit("Ab")).alias("s")).first()
    assert row.w == ["max", "hp2", "value", "x"] and row.s == "12345_0002_ab"


@pytest.mark.parametrize(("line", "want"), [
    ("A::Foo(x)", [(3, "definition")]), ("Foo(1)", [(0, "call")]), ("Foo = 1", [(0, "write")]), ("Foo == 1", [(0, "write")]), ("return Foo;", [(7, "read")]),
    ("UPROPERTY() int Foo;", [(16, "declaration")]), ("x // Foo", []), ('"Foo"', []), (r'"a\"" Foo', [(6, "read")]), ("Foo_ xFoo Foo2 (Foo)", [(16, "read")]),
    ("Foo+Foo += Foo", [(0, "read"), (4, "write"), (11, "read")]), ("", []),
])
def test_usage_kinds(spark, line, want):
    df = spark.createDataFrame([("p", 1, line)], "path string, line int, text string")
    assert [(r.column, r.kind) for r in usage.usages(df, "Foo").collect()] == want


@pytest.mark.parametrize(("n", "stages"), [(49, {0, 1}), (50, {0})])
def test_second_stage_runs_only_below_the_threshold(spark, n, stages):
    rows = [(i, f"d{i}/hit{i}", f"hit{i}") for i in range(n)] + [(1000, "hit/other", "other")]
    df = spark.createDataFrame(rows, "file_id long, path string, filename string")
    assert {r.stage for r in catalog.search_files(df, "HIT").collect()} == stages


def test_lines_of_texts_with_one_path_have_an_order(spark):
    rows = [("p", "a longer TRACK(1)"), ("p", "track(3)"), ("p", "track(2)"), ("o", "track(9)")]
    for given in (rows, rows[::-1]):
        got = search.grep(spark.createDataFrame(given, "path string, text string"), "track(").orderBy("ord").collect()
        assert [(r.path, r.line, r.text) for r in got] == [("o", 1, "track(9)"), ("p", 1, "track(2)"), ("p", 1, "track(3)"), ("p", 1, "a longer TRACK(1)")]


def test_merge_first_wins(spark):
    first = spark.createDataFrame([("n", "p", 1)], "name string, path string, line int")
    second = spark.createDataFrame([("n", "p", 1), ("n", "p", 2)], "name string, path string, line int")
    got = ordered.merge_sources(first, second, ["name", "path", "line"], ["name", "path", "line"], 2)
    assert [(r.line, r.source) for r in got.orderBy("ord").collect()] == [(1, "project"), (2, "engine")]


def test_bfs_with_cycles_depths_and_late_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, None), (9, 9)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (9,)], "node long")
    assert {tuple(r) for r in graph.bfs(edges, seeds).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)}
    assert {tuple(r) for r in graph.bfs(edges, seeds, include_seeds=False).collect()} == {(1, 2, 1), (1, 3, 2), (1, 1, 3), (9, 9, 1)}
    assert {r.node for r in graph.bfs(edges, seeds, max_depth=1).collect()} == {1, 2, 9}
    long = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert graph.bfs(long, spark.createDataFrame([(0,)], "node long")).count() == 31


def test_reachable_equals_bfs(spark):
    r = random.Random(5)
    for n, links_ in ((40, 30), (40, 60), (300, 299)):
        pairs = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(links_)] if n < 300 else [(f"n{i}", f"n{i + 1}") for i in range(links_)]
        edges = spark.createDataFrame(pairs + [(None, "n1"), ("n2", None), pairs[0]], "src string, dst string")
        seeds = spark.createDataFrame([(pairs[0][0],), (pairs[3][0],), ("unknown",), (None,)], "node string")
        want = {x.node for x in graph.bfs(edges, seeds, include_seeds=False).collect()}
        got = [x.node for x in graph.reachable(edges, seeds).collect()]
        assert len(got) == len(set(got)) and set(got) == want == {x.node for x in graph.reachable(edges, seeds, walked=0).collect()}
    assert graph.reachable(edges.limit(0), seeds).isEmpty() and graph.reachable(edges, seeds.limit(0)).isEmpty()


def test_prefix_roots_and_bindings(spark):
    paths = spark.createDataFrame([("/a/b/c/x.h",), ("/a/bc/x.h",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/a/b",), ("/A/B/C",)], "root string")
    assert {r.path: r.root for r in links.longest_prefix(paths, roots).collect()} == {"/a/b/c/x.h": "/A/B/C", "/a/bc/x.h": "/a/b", "/z": None}
    targets = spark.createDataFrame([("X", 7), ("X", 3), ("Y", 5)], "name string, id long")
    edges = spark.createDataFrame([("X",), ("Y",), (None,)], "name string")
    assert {r.name: r.target_id for r in links.resolve_first(edges, targets).collect()} == {"X": 3, "Y": 5, None: None}
    assert {r.name: r.target_id for r in links.resolve_unique(edges, targets).collect()} == {"X": None, "Y": 5, None: None}


def test_recursive_paths(spark):
    def paths(rows):
        return [r.path for r in catalog.recursive_paths(spark, spark.createDataFrame(rows, "id long, parent_id long, name string")).orderBy("id").collect()]

    assert paths([(1, None, "/"), (2, 1, "home"), (3, 2, "me")]) == ["/", "/home", "/home/me"]
    assert paths([(1, None, "C:"), (2, 1, "/"), (3, 2, "P")]) == ["C:", "C:/", "C://P"]


def test_path_functions(spark):
    row = spark.range(1).select(
        tx.normalize_path(F.lit("a\\b///c"), "once").alias("once"), tx.normalize_path(F.lit("a\\b///c"), "all").alias("all"), tx.asset_path(F.lit("/x/Content/A/B.uasset")).alias("asset"),
        tx.join_path(F.lit("/"), F.lit("x")).alias("j"), tx.is_under(F.lit("/a/bc"), F.lit("/a/b")).alias("u"), tx.byte_column(F.lit("éa"), F.lit(1)).alias("b"),
        tx.text_lines(F.lit("a\r\nb\n")).alias("l"),
    ).first()
    assert (row.once, row["all"], row.asset, row.j, row.u, row.b, row.l) == ("a/b//c", "a/b/c", "/Game/A/B", "/x", False, 2, ["a", "b"])


def test_debounce_batch_and_stream(spark, tmp_path):
    times = [0, 30, 60, 100, 115]
    df = spark.createDataFrame([("k", t) for t in times] + [("other", 10)], "key string, t long")
    assert sorted(r.t for r in changes.debounced(df, "key", "t", [], 50).where("key = 'k'").collect()) == [0, 60, 115]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = changes.debounced_stream(stream, "key", "t", 50).writeStream.format("memory").queryName("accepted").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.t for r in spark.table("accepted").where("key = 'k'").collect()) == [0, 60, 115]


def test_stream_maintains_a_table(spark, tmp_path):
    spark.createDataFrame([("p1", "new"), ("p3", "add")], "path string, text string").write.parquet(f"{tmp_path}/in")
    old = spark.createDataFrame([("p1", "old"), ("p2", "keep")], "path string, text string")
    kept = {}

    def apply(batch, epoch):
        kept[epoch] = {r.path: r.text for r in links.upsert(old, batch, ["path"]).collect()}

    changes.maintain(spark.readStream.schema(old.schema).parquet(f"{tmp_path}/in"), apply, f"{tmp_path}/cp").awaitTermination(120)
    assert kept[0] == {"p1": "new", "p2": "keep", "p3": "add"}
    assert [len(b) for b in changes.batches(old, 1)] == [1, 1]


def test_entry_works_with_and_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["file_id", "filename", "path", "rank", "ord"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_debounce_of_null_and_large_keys(spark):
    rows = [(None, 0), (None, 1), (None, 150), (2**60, 0), (2**60 + 1, 1), (2**60, 50), (None, None)]
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "k long, id long, t long")
    assert sorted(r.id for r in changes.debounced(df, "k", "t", ["id"], 100).collect()) == [0, 2, 3, 4]
