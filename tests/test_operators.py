"""History, graph, matching, text, lexer and sources."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.functions import text as T
from gneiss.functions.lexer import strip
from gneiss.functions.windows import chunks_of, frame, parity, previous, top_per
from gneiss.operators import graph, history, matching
from gneiss.plans.config import BadConfig, Config, Exists, NotAFolder, PathMissing, TooManyFiles
from gneiss.sources import files as sf
from gneiss.sources import history as sh
from gneiss.streaming import churn as streaming
from tests import corpus


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def ids(spark, text):
    return spark.createDataFrame([(c,) for c in text], "id string")


# graph


def ranks_by_hand(vertices, edges, rounds=20, d=0.85):
    n, out = len(vertices), {}
    for a, _ in edges:
        out[a] = out.get(a, 0) + 1
    r = {v: 1 / n for v in vertices}
    for _ in range(rounds):
        r = {v: (1 - d) / n + d * sum(r[a] / out[a] for a, b in edges if b == v) for v in vertices}
    return r


def test_pagerank(spark):
    pairs = [("A", "B"), ("A", "C"), ("B", "C"), ("D", "A")]
    got = {r.id: r.score for r in graph.pagerank(ids(spark, "ABCDE"), edges_of(spark, pairs)).collect()}
    want = ranks_by_hand("ABCDE", pairs)
    assert got == pytest.approx(want) and got["C"] > got["B"] > got["D"] and sum(got.values()) <= 1
    top = graph.hotspots(graph.pagerank(ids(spark, "ABCDE"), edges_of(spark, [("A", "E"), ("B", "E"), ("C", "E")])), 2)
    assert [r.id for r in top.collect()] == ["E", "A"]
    assert graph.pagerank(ids(spark, "").limit(0), edges_of(spark, [("A", "B")])).collect() == []


def test_edges_are_cleaned(spark):
    e = graph.clean(edges_of(spark, [("A", "A"), ("A", "B"), ("A", "B"), ("A", "X"), ("X", "B")]), ids(spark, "AB"))
    assert [tuple(r) for r in e.collect()] == [("A", "B")]


def test_orders_and_cycles(spark):
    e = edges_of(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("D", "C")])
    leveled = graph.levels(ids(spark, "ABCD"), e)
    order = graph.topological_order(leveled)
    assert {r.id: r.position for r in order.collect()} == {"A": 1, "D": 2, "B": 3, "C": 4}
    path = [(r.id, r.category) for r in graph.learning_path(ids(spark, "ABCD"), e).orderBy("place").collect()]
    assert path == [("C", "Fundamental"), ("B", "Core Logic"), ("D", "Entry Point"), ("A", "Entry Point")]
    cyclic = edges_of(spark, [("A", "B"), ("B", "A"), ("C", "A")])
    assert graph.has_cycle(graph.levels(ids(spark, "ABC"), cyclic)) and graph.topological_order(graph.levels(ids(spark, "ABC"), cyclic)) is None
    assert {r.category for r in graph.learning_path(ids(spark, "ABC"), cyclic).collect()} == {"Cycle Context"}


def test_chains_and_spread(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")], "id string, parent string")
    got = {r.id: r.depth for r in graph.chain_depths(parents).collect()}
    assert (got["b"], got["c"], got["d"]) == (1, 2, 3) and got["x"] == got["y"]
    e = edges_of(spark, [("B", "A"), ("C", "B"), ("D", "C")])
    assert {r.id: r.depth for r in graph.spread(ids(spark, "A"), e).collect()} == {"A": 0, "B": 1, "C": 2}


def test_interop_edges(spark):
    files = spark.createDataFrame([("p/App-Bridging-Header.h", "p"), ("p/Old.h", "p"), ("p/a.swift", "p"), ("p/b.m", "p"), ("p/App-Swift.h", "p")], "path string, package string")
    imports = spark.createDataFrame([("p/App-Bridging-Header.h", "Old.h"), ("p/b.m", "App-Swift.h")], "path string, name string")
    got = {tuple(r) for r in graph.interop_edges(files, imports).collect()}
    assert got == {("p/App-Bridging-Header.h", "p/Old.h"), ("p/a.swift", "p/App-Bridging-Header.h"), ("p/b.m", "p/App-Swift.h")}


def test_collapse_and_penetration(spark):
    groups = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y")], "id string, grp string")
    assert [tuple(r) for r in graph.collapsed(edges_of(spark, [("A", "B"), ("C", "A"), ("B", "C")]), groups).collect()] == [("x", "y", 2)]


# matching


def test_innermost(spark):
    pts = spark.createDataFrame([("f", 5), ("f", 20), ("g", 5)], "file string, line int")
    ext = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 4, 6, "inner")], "file string, s int, e int, name string")
    got = {(r.file, r.line): r.symbol for r in matching.innermost(pts, ext, ["file"], "line", "s", "e", "name").collect()}
    assert got == {("f", 5): "inner", ("f", 20): "(top level)", ("g", 5): "(top level)"}


def test_rules(spark):
    names = spark.createDataFrame([(1, "MyRedBlackTree"), (2, "tree"), (3, "UserQueue")], "k int, name string")
    rules = spark.createDataFrame([("Tree", "Tree"), ("BlackTree", "x"), ("RedBlackTree", "Red–Black Tree"), ("Queue", "Queue")], "suffix string, label string")
    assert {r.k: r.label for r in matching.longest_suffix(names, rules, ["k"]).collect()} == {1: "Red–Black Tree", 3: "Queue"}
    names = spark.createDataFrame([(1, "quickSortInts"), (2, "quicksort"), (3, "gcdQueue"), (4, "gcd"), (5, "yenPath"), (6, "formatYen")], "k int, name string")
    rules = spark.createDataFrame([(1, "Quicksort", ["quick", "sort"], [], []), (2, "GCD", ["gcd"], ["queue"], []), (3, "Yen", ["yen"], [], ["path"])], "ordinal int, label string, tokens array<string>, blockers array<string>, context array<string>")
    assert {r.k: r.label for r in matching.token_rules(names, rules, ["k"]).collect()} == {1: "Quicksort", 2: "Quicksort", 4: "GCD", 5: "Yen"}


# text


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(T.trim(lit("\t a b  "))) == "a b"
    assert one(T.name_tokens(lit("parseHTTPResponse2Json_x"))) == ["parse", "http", "response", "2", "json", "x"]
    assert one(T.identifiers(lit("let größe = abc123 + ab"))) == ["größe", "abc123"]
    assert one(T.module_of(lit("a/Sources/M/x/f.swift"), lit("p"))) == "M" and one(T.module_of(lit("a/f.swift"), lit("p"))) == "p"
    assert one(T.display_path(lit("a/b/c/d.swift"))) == "b/c/d.swift" and one(T.display_path(lit("d.swift"))) == "d.swift"
    assert one(T.snippet(lit("  " + "x" * 120))) == "x" * 100 + "…"
    assert one(T.file_size(lit(2560))) == "2 KB" and one(T.file_size(lit(5 * 2**30))) == "5120.0 MB" and one(T.big_o(lit(3), lit("time"))) == "O(n³)"
    assert one(T.encyclopedia_url(lit("Kadane (Max Subarray)"))) == "https://en.wikipedia.org/wiki/Kadane"
    assert one(T.source_link(lit("a.swift"), lit(3), "https://host/r/")) == "https://host/r/a.swift#L3"
    assert one(T.scene_group(lit("a/Scenes/Home/x.swift"))) == "Home" and one(T.scene_group(lit("a/x.swift"))) is None
    assert one(T.escape_html(lit('<a & "b">'))) == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(T.calls(lit("myfree(x)"), "free(")) is False and one(T.calls(lit("a = free(x)"), "free(")) is True
    assert one(T.line_count(lit("a\nb\n"), lit("swift"))) == 2 and one(T.line_count(lit("a\nb\n"), lit("m"))) == 3
    assert one(T.version_key(lit("v1.10.2"))) == [1, 10, 2] and one(T.stem(lit("a/b.tar.gz"))) == "b.tar"


def test_chunks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    array = lambda n: F.array(*map(F.lit, range(n)))
    assert one(chunks_of(array(5), 2)) == [[0, 1], [2, 3], [4]] and one(chunks_of(array(3), 3)) == [[0, 1, 2]]


def test_frames(spark):
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate("abcde")], "f string, n int, c string")
    got = [r.x for r in df.select("n", frame(F.col("c"), ["f"], "n", -1, 1).alias("x")).orderBy("n").collect()]
    assert got == ["a b", "a b c", "b c d", "c d e", "d e"]
    assert [r.x for r in df.select("n", previous(F.col("c"), ["f"], "n").alias("x")).orderBy("n").collect()] == [None, *"abcd"]
    assert [r.x for r in df.select("n", parity((F.col("c") != "c").cast("int"), ["f"], "n").alias("x")).orderBy("n").collect()] == [True, False, False, True, False]
    assert [r.c for r in top_per(df, ["f"], [F.col("n").desc()], 2).collect()] == ["e", "d"]


def by_letter(text):
    """The stripper as a plain state machine."""
    kept, literals, i, state, depth, now, line = [[]], {}, 0, "code", 0, "", 0
    while i < len(text):
        c, two, three = text[i], text[i : i + 2], text[i : i + 3]
        if c == "\n":
            kept.append([])
            line += 1
            state, now, i = ("code" if state in ("line", "text") else state), "", i + 1
        elif state == "code":
            if two == "//":
                state, i = "line", i + 2
            elif two == "/*":
                state, depth, i = "block", 1, i + 2
            elif three == '"""':
                state, i = "triple", i + 3
            elif c == '"':
                state, now, i = "text", "", i + 1
            else:
                kept[-1].append(c)
                i += 1
        elif state == "block":
            depth += (two == "/*") - (two == "*/")
            i += 2 if two in ("/*", "*/") else 1
            state = "code" if depth == 0 else state
        elif state == "text":
            if c == "\\" and text[i + 1 : i + 2] not in ("", "\n"):
                now, i = now + two, i + 2
            elif c == '"':
                literals.setdefault(line, []).append(now)
                state, i = "code", i + 1
            else:
                now, i = now + c, i + 1
        elif state == "triple":
            if c == "\\" and text[i + 1 : i + 2] not in ("", "\n"):
                i += 2
            elif three == '"""':
                state, i = "code", i + 3
            else:
                i += 1
        else:
            i += 1
    lines = ["".join(x) for x in kept]
    return lines, [literals.get(k, []) for k in range(len(lines))]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a"\\/*\n é', max_size=40))
def test_lexer_is_the_state_machine(text):
    got = strip(text)
    assert got == by_letter(text)
    assert len(got[0]) == text.count("\n") + 1


# history


def test_history(spark):
    c = spark.createDataFrame([("a@x", "A", 10, 5), ("a@x", "Ann", 30, 2), ("b@x", "B", 20, 0)], "author string, name string, ts long, added long")
    got = {r.author: (r.commits, r.first_ts, r.last_ts, r.name, r.loc_added) for r in history.author_stats(c).collect()}
    assert got == {"a@x": (2, 10, 30, "Ann", 7), "b@x": (1, 20, 20, "B", 0)}
    refs = spark.createDataFrame([("origin/a", "remote", 1), ("origin/HEAD", "remote", 1), ("a", "head", 1), ("x/y/z", "head", 5), ("v1.10.0", "tag", 1), ("v1.9.0", "tag", 2), ("v2.0", "tag", 2)], "name string, kind string, ts long")
    assert {r.name for r in history.ref_names(refs.filter("kind <> 'tag'")).collect()} == {"a", "x/y/z"}
    assert tuple(history.tags(refs).first()) == (3, 2, "v1.10.0")
    assert [r.name for r in history.stale(refs.filter("kind = 'head'"), F.lit(100 * 86400), 90).collect()] == ["a", "x/y/z"]
    b = history.branch_counts(refs, spark.createDataFrame([("a",), ("main",)], "name string")).first()
    assert (b.local_branches, b.remote_branches, b.max_depth, b.merged_branches) == (2, 2, 3, 1)


def test_branching_models(spark):
    def best(**given):
        row = {"main_commits": 100, "has_integration": False, "releases": 0, "hotfixes": 0, "dual_merges": False, "merge_ratio": 0.1, "lifetime_days": 0.5, "merges_per_day": 4.0, "env_branches": 0, "cascades": False} | given
        return history.branching_scores(spark.createDataFrame([row])).orderBy(F.col("score").desc()).collect()

    assert best()[0].model == "Trunk-Based"
    assert best(has_integration=True, releases=2, hotfixes=1, dual_merges=True, merge_ratio=0.8, lifetime_days=5.0, merges_per_day=0.2)[0].model == "Gitflow"
    assert best(env_branches=2, cascades=True, lifetime_days=2.0, merge_ratio=0.5, merges_per_day=2.0)[0].model == "GitLab Flow"
    assert sum(r.share for r in best()) == pytest.approx(1) and all(r.score >= 0 for r in best(has_integration=True))
    assert best(main_commits=5) == []


def test_reachability_and_sampling(spark):
    p = spark.createDataFrame([("b", "a"), ("c", "b"), ("f1", "b"), ("f2", "f1"), ("m", "c"), ("m", "f2")], "hash string, parent string")
    m = spark.createDataFrame([("m", "c", "f2")], "merge string, main_parent string, tip string")
    assert sorted(r.hash for r in history.feature_commits(p, m).collect()) == ["f1", "f2"]
    c = spark.createDataFrame([(f"h{t}", t) for t in (0, 9, 11, 21, 30)], "hash string, ts long")
    assert sorted(r.ts for r in history.sampled(c, 10).collect()) == [0, 9, 21, 30]
    assert sorted(r.ts for r in history.sampled(c, 10, 15).collect()) == [21, 30]


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor Ann\nfilename x\n\tcode\n{a} 2 2\n\tmore\n{b} 1 3 1\nauthor Bob\n\tauthor not me\n"
    assert list(sh.parse_blame(text.split("\n"))) == [(1, "Ann"), (2, "Ann"), (3, "Bob")]
    assert list(sh.intervals("x", [(7, "Ann"), (2, "Ann"), (1, "Ann"), (3, "Bob"), (8, "Ann")])) == [("x", 1, 2, "Ann"), ("x", 3, 3, "Bob"), ("x", 7, 8, "Ann")]


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = corpus.write(tmp_path_factory.mktemp("repo"))
    corpus.commit(root)
    return root


def test_git_source(spark, repo):
    blocks = sh.log_text(spark, repo)
    commits = sh.commits(blocks).collect()
    assert len(commits) == 4 and {r.author for r in commits} == {"ann@x.org", "bob@x.org"}
    files = sh.commit_files(blocks)
    assert files.filter("path = 'App/AuthHandler.swift'").count() == 2
    m = sh.merges(sh.commits(blocks))
    assert history.feature_commits(sh.parents(sh.commits(blocks)), m).count() == 1
    assert {r.name for r in sh.refs(spark, repo).filter("kind = 'tag'").collect()} == {"v1.10.0", "v1.9.0", "note"}
    times = history.merge_times(sh.commits(blocks), m, history.feature_commits(sh.parents(sh.commits(blocks)), m)).first()
    assert (times.lifetime_days, times.time_to_merge_days, times.delay_hours) == (0.0, 2.0, 48.0)
    assert sh.main_branch(repo) == "main" and sh.merged(spark, repo).count() == 2
    lines = spark.createDataFrame([("App/AuthHandler.swift", 1), ("App/AuthHandler.swift", 15), ("App/AuthHandler.swift", 0)], "path string, line int")
    assert {tuple(r)[1:] for r in sh.blame(lines, repo).collect()} == {(1, 1, "Ann"), (15, 15, "Bob")}
    tips = spark.createDataFrame([(sh.head(repo),), (sh.head(repo, "HEAD~1"),)], "hash string")
    assert sh.trees(tips, repo).filter("path = 'App/AuthHandler.swift'").count() == 2


def test_file_sources(spark, repo, tmp_path):
    listed = sf.listing(spark, repo)
    names = {r.rel_path for r in listed.collect()}
    assert "App/Info.plist" in names and "Pods/Skipped/Skipped.swift" in names
    texts = sf.sources(spark, repo, Config())
    assert {r.file_path for r in texts.collect()} == {p for p in corpus.FILES if p.endswith((".swift", ".m")) and not p.startswith("Pods")}
    with pytest.raises(TooManyFiles):
        sf.sources(spark, repo, Config(max_files=2))
    with pytest.raises(PathMissing):
        sf.listing(spark, repo + "/none")
    with pytest.raises(NotAFolder):
        sf.listing(spark, repo + "/App/Legacy.m")
    assert not sf.is_mixed(listed.filter("rel_path LIKE '%.h'")) and sf.is_mixed(listed)
    libs = spark.createDataFrame([("ZLIB",), ("lua",)], "name string")
    assert [(r.name, r.path, r.file_count) for r in sf.vendored(listed, libs).collect()] == [("zlib", "App/zlib", 2)]
    project = sf.project_texts(spark, repo, [])
    assert {r.file_path for r in project.collect()} >= {"App/.env", "App/Info.plist"}
    root_manifest = spark.createDataFrame([("Package.swift", corpus.FILES["Packages/Shop/Package.swift"]), ("X.xcodeproj/project.pbxproj", "MARKETING_VERSION = 2.5;")], "file_path string, text string")
    m = sf.metadata(root_manifest, texts).first()
    pbx = spark.createDataFrame([("X.xcodeproj/project.pbxproj", 'SWIFT_OBJC_BRIDGING_HEADER = "$(SRCROOT)/App/App-Bridging-Header.h";')], "file_path string, text string")
    assert sf.bridging_header(pbx).first().header == "App/App-Bridging-Header.h"
    assert (m.language_version, m.targets, m.app_version) == ("5.9", ["iOS 16", "macOS 13.1"], "2.5")
    from gneiss.operators import parse

    calls = []
    cache = str(tmp_path / "cache")
    first = sf.cached(listed, texts, lambda t: calls.append(t.count()) or parse.parsed(t), cache).count()
    again = sf.cached(listed, texts, lambda t: calls.append(t.count()) or parse.parsed(t), cache).count()
    assert first == again == texts.count() and calls == [first, 0]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"max_files": 7, "ai": {"enabled": True}}))
    c = Config.load(str(path))
    assert c.max_files == 7 and c.ai == {"enabled": True, "files": 10, "preview": 3000} and c.months == 6
    path.write_text(json.dumps({"nope": 1}))
    with pytest.raises(BadConfig):
        Config.load(str(path))
    Config().create(str(tmp_path / "new.json"))
    with pytest.raises(Exists):
        Config().create(str(tmp_path / "new.json"))


def test_streaming_churn(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("2024-01-01 10:00:00", "a", "x", 1), ("2024-01-01 11:00:00", "a", "x", 2), ("2024-01-03 09:00:00", "b", "y", 5), ("2024-01-20 00:00:00", "b", "z", 1)]
    spark.createDataFrame(rows, "ts string, author string, path string, added long").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, author string, path string, added long").parquet(src)
    q = streaming.daily_churn(stream).writeStream.outputMode("append").format("memory").queryName("churned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.path, r.changes, r.added) for r in spark.table("churned").collect()) == [("x", 2, 3), ("y", 1, 5)]
    assert streaming.sessions(spark.read.parquet(src)).count() == 3
