from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from tessera import index as ix
from tessera.engine import Engine
from tessera.functions import text as tx
from tessera.operators import assets, places
from tessera.sources import cpp, packages
from tessera.sources import files as fs

FILES = {
    "Source/Game/Game.Build.cs": 'PublicDependencyModuleNames.AddRange(new string[] { "Core", "Engine" });\nPrivateDependencyModuleNames.Add("Slate");',
    "Source/Game/Public/Base.h": "#include <cstdint>\nclass UBase\n{\npublic:\n\tvoid ParentOnly();\n\tint Shared(int A, int B = 3) const;\nprotected:\n\tint Guarded;\n};\n",
    "Source/Game/Public/Actor.h": '#pragma once\n#include "Base.h"\n// Foo in a comment\nUCLASS()\nclass GAME_API AMyActor : public UBase\n{\n\tGENERATED_BODY()\npublic:\n\tUFUNCTION(BlueprintCallable)\n\tvoid LocalAction(const FString& Name);\n\tint Shared(int A) const;\n\tTObjectPtr<UBase> Held;\nprivate:\n\tfloat Secret = 1.0f;\n};\nenum class EMode { Idle, Walk = 4, Run };\n',
    "Source/Game/Private/Actor.cpp": '#include "Actor.h"\nvoid AMyActor::LocalAction(const FString& Name)\n{\n\tShared(1); // Shared(2)\n\tSecret = 2;\n\tLog("Shared");\n}\n',
    "Source/Game/Private/Loop.h": '#include "Loop2.h"\nstruct FLoop { int X; };\n',
    "Source/Game/Private/Loop2.h": '#include "Loop.h"\nstruct FLoop2 : FLoop { int Y; };\n',
    "Config/DefaultGame.ini": "[A]\nk=1\n+k=2\n; note\n-k=1\n-k=2\n[B]\nx=y=z\n!x=\n",
    "Intermediate/Skip.h": "class USkipped {};\n",
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    folder = str(tmp_path_factory.mktemp("index"))
    ix.build(spark, [str(root)]).save(folder)
    return Engine(ix.Index.load(spark, folder)), str(root)


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_files_and_modules(engine):
    e, root = engine
    assert e.status() == {"files": 7, "classes": 5}
    assert names(e.files_in_modules(["Game"], [".H"]), "filename") == ["Actor.h", "Base.h", "Loop.h", "Loop2.h"]
    assert names(e.search_files("actor"), "filename") == ["Actor.cpp", "Actor.h"]
    assert [r.deps for r in e.module_by_name("Game").collect()] == [["Core", "Engine", "Slate"]]
    assert e.search_files_in_modules(["Game"], "private", 2).count() == 2
    assert names(e.module_names()) == ["Game", "_Global"]


def test_symbols_and_members(engine):
    e, _ = engine
    assert names(e.search_classes_prefix("a_y", 5)) == ["AMyActor"]
    assert names(e.class_methods("AMyActor")) == ["LocalAction", "LocalAction", "Shared"]
    assert names(e.class_properties("AMyActor")) == ["Held", "Secret"]
    assert names(e.enum_values("NS::EMode")) == ["Idle", "Run", "Walk"]
    assert names(e.structs_only()) == ["FLoop", "FLoop2"]
    assert [r.name for r in e.search_symbols("amyactor").collect()][0] == "AMyActor"
    rows = {r.name: [m.name for m in r.members] for r in e.file_symbols("Base.h").collect()}
    assert rows == {"UBase": ["ParentOnly", "Shared", "Guarded"]}


def test_inheritance_and_includes(engine):
    e, root = engine
    assert names(e.recursive_parent_classes("AMyActor")) == ["UBase"]
    assert names(e.recursive_derived_classes("UBase")) == ["AMyActor"]
    assert [r.class_name for r in e.symbol_in_chain("AMyActor", "Shared").collect()] == ["AMyActor"]
    assert [r.class_name for r in e.symbol_in_chain("AMyActor", "ParentOnly").collect()] == ["UBase"]
    assert names(e.virtual_functions("AMyActor")) == ["Shared"]
    assert [p.rsplit("/", 1)[1] for p in names(e.depend_files(f"{root}/Source/Game/Private/Actor.cpp"), "path")] == ["Actor.h", "Base.h"]
    assert [p.rsplit("/", 1)[1] for p in names(e.depend_files("Loop.h"), "path")] == ["Loop.h", "Loop2.h"]
    assert e.depend_files("Unknown.h").count() == 0


def test_usages_navigation_and_help(engine):
    e, _ = engine
    hits = [(r.path.rsplit("/", 1)[1], r.line, r.kind) for r in e.symbol_usages("Shared").collect()]
    assert ("Actor.cpp", 4, "call") in hits and sum(f == "Actor.cpp" for f, *_ in hits) == 1
    text = "void F()\n{\n\tAMyActor* A = nullptr;\n\tA->\n}\n"
    assert [(r.how, r.line) for r in e.goto_definition(text, 4, "A").collect()] == [("local", 3)]
    hit = e.goto_definition(text, 4, "ParentOnly", qualifier="A").first()
    assert (hit.how, hit.path.endswith("Base.h")) == ("chain", True)
    assert e.goto_definition(text, 4, "AMyActor").first().how == "type"
    assert e.hover(text, 4, "Shared", qualifier="A").first().detail == "(int A)"
    help_ = e.signature_help("Shared", "1, ", "AMyActor").collect()
    assert [(r.label, r.active) for r in help_] == [("int Shared(int A)", 0), ("int Shared(int A, int B)", 1)]
    labels = [r.label for r in e.completions(text, 4, 4).orderBy("ord").collect()]
    assert {"LocalAction", "Shared", "ParentOnly", "Held"} <= set(labels) and "Secret" not in labels and "Guarded" not in labels
    assert "Base.h" in [r.label for r in e.completions('#include "Ba', 1, 12).collect()]


def test_config_and_text(engine):
    e, root = engine
    rows = {(r.section, r.key): (r.value, r.history) for r in e.config(root, None, None, "Game").collect()}
    assert rows[("A", "k")] == ("nil", ["1", "[Array x2] 2", "[Array x1] 2", "nil"])
    assert rows[("B", "x")] == ("nil", ["y=z", "nil"])
    assert [(r.line, r.text) for r in e.search_code_text("SHARED(1").collect()] == [(4, "Shared(1); // Shared(2)")]


def test_diagnostics(engine):
    e, _ = engine
    text = "UCLASS()\nstruct FBad\n{\n};\nclass X\n{\n\tUFUNCTION(BlueprintCallable)\n\tvoid F();\n\tUPROPERTY(EditAnywhere,\n\t\tBlueprintReadWrite)\n\tint P;\n};\n"
    found = {(r.code, r.line) for r in e.diagnostics("/p/Public/X.h", text).collect()}
    assert found == {("UHT001", 0), ("UHT002", 1), ("UEBP001", 6), ("UEBP002", 8), ("UECPP001", 7)}
    log = "C:\\P\\Thing.cpp(12,34): error C2065: 'Foo': undeclared identifier\nC:\\P\\A.h:7: Warning: odd\nBuilding"
    rows = [(r.line, r.column, r.severity, r.source) for r in e.build_diagnostics(log).collect()]
    assert rows == [(11, 33, "error", "MSVC"), (6, 0, "warning", "UHT")]


def test_update_replaces_rows_of_changed_files(engine, spark):
    e, root = engine
    path = f"{root}/Source/Game/Public/Base.h"
    new = ix.update(e.index, spark.createDataFrame([(path, "class UBase\n{\npublic:\n\tvoid Renamed();\n};\nclass UNew : public UBase {};\n")], "path string, text string"))
    after = Engine(new)
    assert names(after.class_members("UBase")) == ["Renamed"]
    assert names(after.recursive_derived_classes("UBase")) == ["AMyActor", "UNew"]
    assert new.files.count() == 7


def test_cpp_helpers():
    assert cpp.normalize_parameters("(const FObjectInitializer& ObjectInitializer = FObjectInitializer::Get())") == "(const FObjectInitializer& ObjectInitializer)"
    assert cpp.clean_type("const TObjectPtr<NS::UThing>&") == "UThing" and cpp.template_argument("TMap<FName, TArray<int>>") == "FName"
    text = "void A()\n{\n\tUAlpha* H;\n}\nvoid B()\n{\n\tUBeta* H;\n\tH->x();\n}\n"
    assert cpp.variable_type(text, "H", 8).type == "UBeta" and cpp.variable_type(text, "H", 3).type == "UAlpha" and cpp.variable_type(text, "Z", 3) is None
    assert cpp.in_member_context("class A {\n public:\n  ") and not cpp.in_member_context("class A { void f() {")
    assert cpp.include_line('#pragma once\n#include "a.h"\n#include "a.generated.h"\n') == 3
    assert cpp.generated_definitions("Server, WithValidation", "F") == ["F_Implementation", "F_Validate"]
    assert fs.config_stack("/p", "/e", "Mac", "Game")[0] == "/e/Config/Base.ini"


def package(names_, imports, exports):
    """A package of the layout that the reader knows."""
    string = lambda s: struct.pack("<i", len(s) + 1) + s.encode() + b"\0"
    blob = b"".join(string(n) + struct.pack("<I", 0) for n in names_)
    at = lambda n: struct.pack("<2i", names_.index(n), 0)
    imp = b"".join(at(names_[0]) + at(kind) + struct.pack("<i", outer) + at(name) for kind, outer, name in imports)
    exp = b"".join(struct.pack("<3i", *x[:3]) + at(x[3]) for x in exports)
    start = 32
    head = struct.pack("<I7i", packages.TAG, len(names_), start, len(imports), start + len(blob), len(exports), start + len(blob) + len(imp), 20)
    return head + blob + imp + exp


def test_packages_and_asset_graph(spark):
    data = package(
        ["CoreUObject", "Package", "Class", "Function", "/Script/Engine", "Actor", "Jump", "BP_Hero"],
        [("Package", 0, "/Script/Engine"), ("Class", -1, "Actor"), ("Function", -2, "Jump")], [(-2, -2, 0, "BP_Hero")],
    )
    files = spark.createDataFrame([("/p/Content/A/BP_Hero.uasset", data), ("/p/Content/bad.uasset", b"xx")], "path string, content binary")
    rows = {r.path: r for r in packages.read_packages(files).collect()}
    hero = rows["/p/Content/A/BP_Hero.uasset"]
    assert (hero.parent, hero.functions) == ("/Script/Engine.Actor", ["/Script/Engine.Actor:Jump"]) and "/Script/Engine.Actor" in hero.imports
    assert rows["/p/Content/bad.uasset"].error
    read = packages.read_packages(files).where("error is null").selectExpr("'/Game/A/BP_Hero' AS asset", "parent", "imports", "functions")
    graph = assets.postings(assets.graph_pairs(read))
    assert {(r.relation, r.asset) for r in assets.asset_usages(graph, "AActor").collect()} == {("derived", "/game/a/bp_hero"), ("references", "/game/a/bp_hero")}
    assert {r.relation for r in assets.asset_usages(graph, "Jump").collect()} == {"references"}


@pytest.mark.parametrize(
    ("before", "expected"),
    [
        ("\tA->", "A"), ("\tx = this->Get(1, F(2)).Items[3].", "this->Get(1, F(2)).Items[3]"), ("return Cast<UBase>(Thing)->", "Cast<UBase>(Thing)"),
        ("\tNS::UThing::", "NS::UThing"), ("\t(A)->", "(A)"), ("\tA", None), ("", None), ("\tf(B.", "B"),
    ],
)
def test_receiver_of_an_operator(before, expected):
    assert cpp.receiver(before) == expected


def test_hops_of_an_expression():
    got = [(h.name, h.argument, h.called, h.subscripts) for h in cpp.hops("(this->Make<UBase>(1))->Items[2][0].Size")]
    assert got == [("this", None, False, 0), ("Make", "UBase", True, 0), ("Items", None, False, 2), ("Size", None, False, 0)]
    assert cpp.hops("") == [] and cpp.element_type("TMap<FName, TArray<int>>") == "TArray<int>" and cpp.element_type("TArray<UBase*>") == "UBase"


def test_declarations_in_scope_only():
    text = "void A(int P)\n{\n\tUAlpha* H;\n\t{\n\t\tUInner* I;\n\t}\n\tint N = 0;\n}\nvoid B(int Q)\n{\n\tUBeta* H;\n\n}\n"
    assert {(d.name, d.type) for d in cpp.visible_declarations(text, 7)} == {("P", "int"), ("H", "UAlpha"), ("N", "int")}
    assert {(d.name, d.type) for d in cpp.visible_declarations(text, 12)} == {("Q", "int"), ("H", "UBeta")}
    assert cpp.visible_declarations("", 1) == []


def test_unfinished_declarations():
    text = "class X\n{\n\tGENERATED_BODY()\n\tX()\npublic:\n\tint A(int B) const\n\tvoid C();\n\tUFUNCTION()\n\tvoid D(int E = F(1)) { G(); }\n\tvoid H()\n};\nvoid Outside()\n"
    assert cpp.incomplete_members(text) == [("X", 4), ("A", 6), ("H", 10)]
    macros = "class X\n{\n\tGENERATED_BODY()\n\tDECLARE_IT(A, B)\n\tUPROPERTY(meta=(A=(1)))\n\tint B;\n\tUFUNCTION(Category=\"x\")\n\tvoid C()\n};"
    assert cpp.incomplete_members(macros) == [("C", 8)]
    assert cpp.incomplete_members("class X\n{\n\tX() = default;\n\tvoid A()\n\t\tconst;\n\tX(int a)\n\t\t: b(a) {}\n};") == []


def test_types_of_expressions(engine):
    e, _ = engine
    text = "void F()\n{\n\tAMyActor* A = nullptr;\n\tauto B = Cast<UBase>(A);\n\tTArray<UBase*> C;\n\t\n}\n"
    asked = {"A": "AMyActor", "B": "UBase", "C[0]": "UBase", "(A)": "AMyActor", "A->Shared(1)": "int", "this": "UBase", "GetWorld()": "UWorld", "A->Nothing": None}
    assert {x: e.expression_type(text, 6, x, "UBase") for x in asked} == asked


def test_completion_modes(engine):
    e, _ = engine
    at = lambda text, within=None: names(e.completions(text, text.count("\n") + 1, len(text.split("\n")[-1]), within), "label")
    assert at("#if") == ["if", "ifdef", "ifndef"]
    assert at("UPROPERTY(EditAnywhere, Blueprint") == ["BlueprintAssignable", "BlueprintCallable", "BlueprintReadOnly", "BlueprintReadWrite"]
    assert at("UPROPERTY(meta=(Clamp") == ["ClampMax", "ClampMin"]
    assert "nullptr" in at("void F()\n{\n\tnu") and "nullptr" not in at("void F()\n{\n\tNu")
    assert "ParentOnly" in at("void F()\n{\n\tAMyActor* A;\n\tCast<UBase>(A)->Par")
    assert "Local1" in at("void F()\n{\n\tint Local1 = 0;\n\tLoc") and "Local1" not in at("void F()\n{\n\tint Local1 = 0;\n}\nvoid G()\n{\n\tLoc")


def test_two_sources(engine):
    e, _ = engine
    both = Engine(e.index, e.index)
    own, merged = e.symbol_usages("Shared").collect(), both.references("Shared").collect()
    assert [(r.path, r.line, r.column) for r in merged] == [(r.path, r.line, r.column) for r in own] and {r.source for r in merged} == {"project"}
    assert both.signature_help("Shared", "1, ").count() == e.signature_help("Shared", "1, ").count() > 0
    found = {(r.code, r.line) for r in e.diagnostics("/p/Public/Y.h", "class Y\n{\n\tvoid F()\n};\n").collect()}
    assert ("UECPP002", 2) in found


def test_components_and_refresh_by_hash(spark, tmp_path):
    root = tmp_path / "G"
    for name, text in (FILES | {"G.uproject": '{"FileVersion": 3}', "Plugins/P/P.uplugin": '{"FriendlyName": "Pretty"}', "Plugins/P/Source/PM/PM.Build.cs": "// none"}).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    ix.save_version(ix.build(spark, [str(root)]), str(tmp_path / "index"), 0)
    index, _ = ix.load_latest(spark, str(tmp_path / "index"))
    e = Engine(index)
    assert {(r.name, r.display_name, r.type) for r in e.components().collect()} == {("G", "G", "Game"), ("P", "Pretty", "Plugin")}
    assert {(r.name, r.component) for r in index.modules.collect()} == {("Game", "G"), ("PM", "P"), ("_GameConfig", "G"), ("_Global", None)}
    assert e.component_data("P").first().name == "PM" and e.ready()
    (root / "Source/Game/Private/Loop.h").write_text("#include \"Loop2.h\"\nstruct FRenamed { int Z; };\n")
    (root / "Source/Game/Private/Loop2.h").unlink()
    again = ix.refresh(index, [str(root)])
    assert names(again.classes.where("path like '%Loop%'")) == ["FRenamed"]
    assert again.classes.count() == index.classes.count() - 1
    assert again.files.where("path like '%Loop.h' and file_hash is not null and mtime is not null").count() == 1

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"path": "/x/New.h", "text": "#include \\"a.h\\"\\nstruct FNew { int A; };", "deleted": false}\n')
    stream = spark.readStream.schema("path string, text string, deleted boolean").json(str(tmp_path / "in"))
    ix.follow(stream, str(tmp_path / "index"), str(tmp_path / "checkpoint")).awaitTermination()
    after, version = ix.load_latest(spark, str(tmp_path / "index"))
    assert version == 1 and names(after.classes.where("path = '/x/New.h'")) == ["FNew"]


def test_implementation_and_find_over_two_sources(engine):
    e, root = engine
    hit = e.goto_implementation("", 1, "LocalAction", enclosing="AMyActor").first()
    assert hit.path.endswith("Actor.cpp")
    assert e.goto_implementation("", 1, "ParentOnly", enclosing="AMyActor").first().path.endswith("Base.h")
    assert e.goto_implementation("", 1, "Nothing", enclosing="AMyActor").isEmpty() and e.goto_implementation("", 1, "LocalAction").isEmpty()
    both = Engine(e.index, e.index)
    assert {r.source for r in both.fast_find("Loop").collect()} == {"project"}
    assert {r.source for r in both.global_find("Loop", 500).collect()} == {"project", "engine"}
    assert [r.ord for r in both.global_find("Loop", 500).orderBy("ord").collect()] == list(range(both.global_find("Loop", 500).count()))
    assert Engine(e.index).fast_find("Loop", scope="engine").isEmpty()


def test_headers_without_a_marker_are_not_parsed(spark):
    rows = [("class A {};", False), ("#pragma once\nenum B { C };", False), ("#include <a>", True), ("UDELEGATE()", True), ("DECLARE_DELEGATE(F)", True), ("GENERATED_BODY()", True), ("", False)]
    df = spark.createDataFrame(rows, "text string, want boolean")
    assert df.where(fs.is_interesting_header("text") != F.col("want")).isEmpty()


def test_parameters_in_brackets_count_once(spark):
    from tessera.engine import parameter_count

    rows = [("()", 0), ("( )", 0), ("(int a)", 1), ("(TMap<int, FName> m)", 1), ("(TMap<int, FName> m, int (*f)(int, int)) const", 2), ("(int a = f(1, 2), b)", 2)]
    df = spark.createDataFrame(rows, "d string, n int")
    assert df.where(parameter_count("d") != F.col("n")).isEmpty()


def test_usage_scopes_and_member_usages(engine):
    e, root = engine
    text = FILES["Source/Game/Private/Actor.cpp"]
    assert e.usage_scope(text, 4, "Shared", None, "AMyActor") == ("member", "AMyActor")
    assert e.usage_scope(text, 4, "ParentOnly", "this", "AMyActor") == ("member", "UBase")
    assert e.usage_scope("void F()\n{\n\tint Local = 1;\n\tLocal++;\n}\n", 4, "Local")[0] == "local"
    assert e.usage_scope(text, 4, "Nowhere", None, "AMyActor") == ("global", None)
    rows = e.member_usages("Shared", "AMyActor").collect()
    assert rows[0].kind == "declaration" and rows[0].path.endswith("Actor.h")
    assert [(r.path.rsplit("/")[-1], r.line) for r in rows if r.kind == "call"] == [("Actor.cpp", 4)]
    assert e.header_of_type("UBase").first().line == 2 and e.header_of_type("AMyActor").isEmpty()


def test_caches_answer_again_until_forgotten(engine):
    e, root = engine
    text = "AMyActor* A;\nA->Lo"
    first = e.completion_list(text, 2, 5)
    assert first is e.completion_list(text, 2, 5) and [r.label for r in first][0] == "LocalAction"
    data = e.config_data(root, None)
    assert data is e.config_data(root, None) and "Default" in data
    e.forget_config()
    assert data is not e.config_data(root, None)
    assert e.buffer_parents(FILES["Source/Game/Public/Actor.h"])["AMyActor"] == ["UBase"]


def test_header_of_a_type_behind_many_that_only_name_it(spark):
    rows = [(f"G/Classes/Part12{i}.h", f"class UPart12;\nclass UPart12{i}\n{{\n  UPart12* Next;\n}};") for i in range(80)]
    rows += [("G/Public/MyPart12.h", "struct UPart12\n{\n};"), ("G/Public/Part12.h", "\nclass G_API\n  UPart12 final : public UBase\n{\n};")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("filename", tx.file_name("path"))
    assert [tuple(r) for r in places.header_of_type(files, files, "UPart12").collect()] == [("G/Public/Part12.h", 2)]


def test_files_of_a_deep_chain_take_few_jobs(engine, spark):
    from dataclasses import replace

    e, _ = engine
    n = F.col("id")
    name = lambda i: F.concat(F.lit("/c/F"), i, F.lit(".h"))
    made = spark.range(201).select(name(n).alias("path"), tx.file_name(name(n)).alias("filename"), (n + 1000).alias("file_id"), F.lit("/c").alias("directory"))
    files = e.index.files.limit(0).unionByName(made, allowMissingColumns=True)
    includes = e.index.includes.limit(0).unionByName(spark.range(200).select(name(n).alias("path"), name(n + 1).alias("resolved")), allowMissingColumns=True)
    spark.sparkContext.setJobGroup("deep", "deep")
    found = names(Engine(replace(e.index, files=files, includes=includes)).depend_files("/c/F0.h"), "path")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("deep")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == sorted(f"/c/F{i}.h" for i in range(1, 201)) and len(jobs) < 60
