"""A whole analysis of a small repository with history."""

import subprocess

import pytest

from gneiss.operators import matching
from gneiss.plans import report
from gneiss.plans.analyze import analyze, evolution
from gneiss.plans.config import Config
from gneiss.sources import history
from tests import corpus


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = corpus.write(tmp_path_factory.mktemp("whole"))
    corpus.commit(root)
    return root


def test_analyze(spark, repo, tmp_path):
    tables = analyze(spark, repo, Config(), as_of=1_710_000_000)
    client = "Packages/Shop/Sources/Shop/ShopClient.swift"
    assert tables["hotspots"].first().id == client
    assert {(r.src, r.dst) for r in tables["edges"].collect()} >= {("Packages/Shop/Sources/Shop/CartViewModel.swift", client)}
    assert {r.author for r in tables["security_violations"].filter("line_no > 0").collect()} >= {"Ann"}
    assert [(r.author, r.commits) for r in tables["team"].collect()] == [("ann@x.org", 3), ("bob@x.org", 1)]
    assert {r.name for r in tables["stale"].collect()} == {"main", "feature/one"}
    assert tables["tags"].first().latest == "v1.10.0" and tables["reverts"].first().reverts == 1
    assert {r.path: r.changes for r in tables["churn"].collect()}[client] == 2
    assert tables["branching"].count() == 0 and tables["merge_timing"].first().time_to_merge_days == 2.0
    some = {k: tables[k] for k in ("layers", "hotspots", "ranks", "edges", "security_score", "team", "traffic")}
    report.page(some, str(tmp_path / "r.html"), "A <report>")
    text = (tmp_path / "r.html").read_text()
    assert "A &lt;report&gt;" in text and '"nodes":[' in text and "### team" in text


def test_evolution(spark, repo):
    snapshots, growth = evolution(spark, repo, Config(months=1, interval_days=1))
    got = snapshots.collect()
    assert [r.ts for r in got] == sorted(r.ts for r in got) and all(r.est_lines == 50 * r.files for r in got)
    assert report.evolution_lines(snapshots, growth)[-1] == "net growth 0.0 %"


def test_blame_of_every_line(spark, tmp_path):
    """More lines than the limit of old (5000), in one lot of files and in several."""
    root = tmp_path / "many"
    root.mkdir()
    for name in ("a", "z"):
        (root / f"{name}.swift").write_text("".join(f"let v{i} = {i}\n" for i in range(2700)))
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=Ann", "-c", "user.email=ann@x.org", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)
    want = {(f"{n}.swift", i, "Ann") for n in "az" for i in range(1, 2701)}
    lines = spark.createDataFrame([(p, i) for p, i, _ in want] + [("a.swift", 1)], "path string, line int")
    for partitions in (1, 3):
        got = history.blame(lines, str(root), partitions)
        assert sorted(tuple(r) for r in got.collect()) == [("a.swift", 1, 2700, "Ann"), ("z.swift", 1, 2700, "Ann")]
    assert {tuple(r) for r in matching.located(lines, got, ["path"], "line", "first", "last").collect()} == want
    assert history.blame(lines.limit(0), str(root)).collect() == []
    few = spark.createDataFrame([("a.swift", 3), ("a.swift", 4), ("a.swift", 9), ("new.swift", 1)], "path string, line int")
    (root / "new.swift").write_text("let n = 1\n")  # not committed: nobody's lines
    assert sorted(tuple(r) for r in history.blame(few, str(root)).collect()) == [("a.swift", 3, 4, "Ann"), ("a.swift", 9, 9, "Ann")]


def test_limits_are_of_compatible_runs_only():
    assert Config().limit("timed_merges") is None and Config(compat=True).limit("timed_merges") == 50
    assert Config(compat=True, timed_merges=7).limit("timed_merges") == 7 and Config(hits_per_file=3).limit("hits_per_file") == 3
