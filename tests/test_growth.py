"""Tables that grow are neither broadcast nor left to one task."""

import re

import pytest

from gneiss.operators import constructs, graph, packages, parse, patterns, security, style
from gneiss.plans import catalogue, planted, projects  # noqa: F401  projects adds its queries

SF = "/root/testdata/sf0.001"


def broadcast_scans(df) -> list[str]:
    """Lines of the plan, as planned and as run, that read a file or parse one below a broadcast."""
    df.collect()
    below, out = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if below is not None and depth <= below:
            below = None
        if below is None and "BroadcastExchange" in line:
            below = depth
        if below is not None and ("FileScan" in line or "MapInArrow" in line):
            out.append(line.strip())
    return out


@pytest.mark.parametrize("name", ["suffix_rule_longest", "token_rule_specificity", "planted_algorithm_names", "planted_fingerprints", "contextual_algorithms", "planted_structure_names", "planted_structures_unproven", "planted_linked"])
def test_names_are_not_broadcast_to_meet_the_rules(spark, name):
    assert broadcast_scans(catalogue.QUERIES[name](spark, SF)) == []


def test_planted_files_are_dealt_by_their_number(spark, monkeypatch):
    """A table of few bytes is one split, however many files its rows become."""
    monkeypatch.setattr(planted.dealt, "__defaults__", (20,))
    files = planted.planted(spark, SF, [("a{k}", "{k}")])
    sizes = files.rdd.glom().map(len).collect()
    assert sum(sizes) == files.count() and max(sizes) < 60 and len(sizes) == -(-files.count() // 20)


def test_lines_are_looked_at_once(spark):
    """Hits and vetoes come from a table of the marked lines, not from one look at all lines each."""
    files = planted.planted(spark, SF, [x[:2] for x in planted.CHECKED])
    hits = security.line_hits(security.lines(files))
    assert not any("part.parquet" in f for f in hits.inputFiles()) and broadcast_scans(hits) == []


def test_scores_are_joined_before_projects_are_multiplied(spark):
    """The wide rows of features meet their sums once; a row per pattern is made after that."""
    plan = catalogue.QUERIES["pattern_scorecard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")


def test_planted_files_are_scanned_where_they_were_dealt(spark, monkeypatch):
    """The scan drops repeated paths without a second shuffle, which would merge the files into few tasks."""
    monkeypatch.setattr(planted.dealt, "__defaults__", (20,))
    scan = constructs.scanned(planted.planted(spark, SF, [("src/A{k}.swift", "let a = {k}")]))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_files_are_parsed_once_for_their_packages(spark):
    """Paths of the listing and folders come from the written rows, not from further parses."""
    plan = planted.placed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_a_scan_works_out_what_is_wanted_and_no_more(monkeypatch):
    monkeypatch.setattr(constructs, "fingerprint", None)
    assert constructs.scan_of("class A { }\nfunc f() { }", ("types", "stripped"))["types"][0]["name"] == "A"


def test_types_and_functions_come_from_one_scan(spark, monkeypatch):
    """A union of both would run the scan, the dearest step, once for each."""
    plans = []
    kept = constructs.cut
    monkeypatch.setattr(constructs, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    files = spark.createDataFrame([("a.swift", "class QuickSort { }\nfunc quickSort() { }")], "file_path string, text string")
    found = constructs.algorithms(constructs.scanned(files, "functions", "types")).select("symbol", "line").collect()
    assert sorted(found) == [("QuickSort", 1), ("quickSort", 2)] and [p.count("MapInArrow") for p in plans] == [1]


def test_names_of_imports_and_of_the_project_meet_in_one_aggregate(spark):
    """Joins of all imports with all files' names sorted each side in memory of its own."""
    files = spark.createDataFrame([("Own/A.swift", "Own", "Own"), ("Own/B.swift", "", "Part")], "file_path string, package_name string, module_name string")
    imports = spark.createDataFrame([("Own",), ("Part",), ("B",), ("UIKit",), ("Far",), ("Far",), (None,), ("",)], "name string")
    found = packages.classified(imports, files)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(found.collect()) == [("Far", "external"), ("Own", "local"), ("Part", "local"), ("UIKit", "apple")]


def test_headers_and_roots_come_from_one_look_at_the_paths(spark):
    """Files, their folders, manifests, and one table of headers and roots: four reads, not five."""
    plan = planted.placed(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 4


def test_imports_are_read_without_packages(spark):
    """What a file imports doesn't depend on the package it lies in, so it isn't joined with packages first."""
    plan = planted.planted_import_classes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 5


STYLED = [
    ("A.swift", 'protocol Able {\n}\n  extension Able {\n\n    func a() { say("some Able & B") }\n}\n// class No: Able {\nfinal class One: NSObject, Able {\n}'),
    ("B.swift", "class Two: One {\n    override func go() { }\n}\nstruct Lone {\n    var x: some Able\n}\nenum Way: Able {\n    case one(Int)\n    case .two(x)\n}\nstruct Both: Able, Far {"),
]


def test_style_looks_at_lines_once_and_orders_none(spark, monkeypatch):
    """Windows sorted every line, and each count read all lines again with patterns of its own."""
    plans = []
    kept = style.cut
    monkeypatch.setattr(style, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    files = spark.createDataFrame(STYLED, "file_path string, text string")
    got = style.count(security.lines(files), parse.declarations(parse.parsed(files, "declarations"))).first().asDict()
    assert sum("raw_lines" in p for p in plans) == 1 and not any("Window" in p for p in plans)
    wanted = {"classes": 2, "structs": 2, "protocols": 1, "enums": 1, "finals": 1, "overrides": 1, "root_objects": 1, "extensions": 1, "extended": 1, "enum_payloads": 1, "opaque": 1, "composed": 0,
              "conform_none": 2, "types_one": 1, "types_many": 1, "conform_one": 0, "conform_many": 1, "implemented": 1, "depth_sum": 2, "depth_count": 1}
    assert {k: got[k] for k in wanted} == wanted


def test_lines_work_out_what_is_wanted_and_no_more(spark):
    files = spark.createDataFrame([*STYLED, ("N.swift", None), ("Z.swift", "")], "file_path string, text string")
    brief, every = security.lines(files, *style.LOOKED_AT), security.lines(files)
    assert brief.columns == ["file_path", "raw", "code", "after5"]
    assert sorted(brief.collect()) == sorted(every.select(*brief.columns).collect())


def test_a_brief_parse_gives_the_same_and_no_more(spark, monkeypatch):
    files = spark.createDataFrame([*STYLED, ("C.m", "@interface C : NSObject"), ("N.swift", None)], "file_path string, text string")
    some = parse.parsed(files, "declarations", "imports")
    assert some.columns == ["file_path", "declarations", "imports"] and sorted(some.collect()) == sorted(parse.parsed(files).select(*some.columns).collect())
    monkeypatch.setattr(parse.Span, "feed", None)
    assert [d["name"] for d in parse.parse_swift("class A { }\nfunc f() { }", whole=False)["declarations"]] == ["A"]


DESIGNED = [
    ("A.swift", "class HostPool { func acquire() {} }\nprotocol ShapeFactory {}\nprotocol State {\n func go()\n}\nclass On: State {\n}"),
    ("B.swift", "class RoundFactory {}\nactor Two {\n\tpublic static let instance  \n}\nextension Two {}\nclass UploadTask { func execute() {} }\nclass DIContainer {}\nimport Swinject"),
    ("C.swift", "class Three {\nstatic let\nshared = 1\nlazy\nvar a = 1\n}\nclass LoneHandler {}"),
    ("src/Tests/D.swift", "class NoAdapter {}"),
    ("OwnScanner.swift", "class LastAdapter {}\nlazy var a = b"),
]


def test_patterns_come_from_one_pass_over_the_files(spark, monkeypatch):
    """Files were scanned and parsed apart, written, grouped by path and joined again; what is written now is the counts."""
    plans = []
    kept = patterns.cut
    monkeypatch.setattr(patterns, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    files = spark.createDataFrame(DESIGNED, "file_path string, text string")
    found = patterns.detect(constructs.scanned(files, "stripped", "declarations")).collect()
    assert [p.count("MapInArrow") for p in plans] == [1] and "Join" not in plans[0]
    wanted = {"Object Pool": 1, "Abstract Factory": 2, "Marker": 1, "State": 1, "Monitor Object": 1, "Singleton": 1, "Extension": 1, "Command": 1, "Dependency Injection": 1, "Adapter": 1}
    assert {r.name: r["count"] for r in found} == wanted
    assert {r.name: r.example_path for r in found}["Abstract Factory"] == "A.swift"


def test_patterns_are_the_same_with_declarations_from_elsewhere(spark):
    files = spark.createDataFrame([*DESIGNED, ("N.swift", None), ("Z.swift", "")], "file_path string, text string")
    apart = patterns.detect(constructs.scanned(files, "stripped"), parse.declarations(parse.parsed(files)))
    assert apart.collect() == patterns.detect(constructs.scanned(files, "stripped", "declarations")).collect()


def test_chains_are_followed_without_a_broadcast(spark):
    parents = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, 20)], "id string, parent string")
    found = graph.chain_depths(parents)
    assert broadcast_scans(found) == [] and {r.id: r.depth for r in found.collect()} == {f"c{i}": i for i in range(1, 20)}


def test_every_type_of_four_letters_is_named(spark):
    """The names of a document are its first identifiers; those of four to eight letters make nearly all edges."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    first = {(r.lang, r.doc_id, re.search("[A-Za-z_][A-Za-z0-9_]*", r.text or "")) for r in docs}
    named = [(lang, path, m.group()) for lang, path, m in first if m and len(m.group()) >= 4]
    words = [(r.lang, r.doc_id, set(re.findall("[A-Za-z_][A-Za-z0-9_]*", r.text or ""))) for r in docs]
    want = {(a, b) for lang, a, some in words for other, b, name in named if lang == other and a != b and name in some}
    got = [tuple(r) for r in catalogue.token_join_edges(spark, SF).collect()]
    assert len(got) == len(set(got)) > 100 and set(got) == want


def test_a_common_type_is_dealt_in_tiles(spark, monkeypatch):
    """One name that all files use is many tasks' work, and edges come once, also to files of several types or packages."""
    monkeypatch.setattr(graph, "TILE", 4)
    rows = [("p", f"f{i}", w) for i in range(30) for w in ("Same", f"Own{i}", "abc")] + [("q", "f1", "Same"), ("q", "f2", "Same"), ("p", "f1", "Same"), (None, "f1", "Same"), ("p", None, "Same")]
    types = [("p", f"f{i}", "Same") for i in range(20)] + [("p", f"f{i}", f"Own{i + 1}") for i in range(5)] + [("q", "f2", "Same"), ("p", "f3", "abc"), (None, "f2", "Same"), ("p", None, "Same"), ("p", "f9", None)]
    want = {(a, b) for p, a, w in rows for q, b, n in types if p and a and b and n and p == q and w == n and len(n) >= 4 and a != b}
    edges = graph.type_edges(spark.createDataFrame(rows, "package string, path string, token string"), spark.createDataFrame(types, "package string, path string, name string"))
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "package string, path string, token string")
    assert graph.type_edges(empty, empty.withColumnRenamed("token", "name")).collect() == []
