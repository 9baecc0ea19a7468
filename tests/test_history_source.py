"""The partitioned log: ranges give the whole, errors are raised, and a killed task is repeated to the same rows."""

import os
import subprocess
import sys

import pytest

from gneiss.sources import history


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("log")
    run = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", *args], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for i in range(23):
        (root / f"f{i % 4}.swift").write_text(f"let a = {i}\n" * (i + 1))
        run("add", "-A")
        run("commit", "-qm", f"change {i}\twith a tab")
        if i % 7 == 3:
            run("checkout", "-qb", f"side{i}")
            (root / f"side{i}.swift").write_text("let s = 1\n")
            run("add", "-A")
            run("commit", "-qm", "aside")
            run("checkout", "-q", "main")
            run("merge", "-q", "--no-ff", "-m", f"Merge {i}", f"side{i}")
    return str(root)


def test_ranges_give_the_whole_log(spark, repo):
    whole = history.log_text(spark, repo)
    parts = history.log_text(spark, repo, commits_per_partition=4)
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() == 8
    rows = sorted(tuple(r) for r in whole.collect())
    assert sorted(tuple(r) for r in parts.collect()) == rows and [r[0] for r in rows] == list(range(29))
    assert rows[-1][1].endswith("change 0\twith a tab\n1\t0\tf0.swift")
    assert history.log_text(spark, repo, commits_per_partition=4, most=6).count() == 6
    merges = history.commits(history.log_text(spark, repo, merges_only=True)).collect()
    assert [r.subject for r in sorted(merges, key=lambda r: r.ord)] == ["Merge 17", "Merge 10", "Merge 3"]
    assert history.commits(parts).filter("subject LIKE 'change%'").count() == 23


def test_failing_calls_raise(spark, repo, tmp_path):
    with pytest.raises(history.GitError):
        history.git(repo, "log", "no-such-branch")
    with pytest.raises(history.GitError):
        list(history.git_lines(repo, "log", "no-such-branch"))
    assert history.head(str(tmp_path)) is None and history.head(repo, "nothing") is None
    with pytest.raises(Exception, match="has no commit nothing"):
        history.log_text(spark, repo, "nothing").collect()
    gone = spark.createDataFrame([("0" * 40,)], "hash string")
    with pytest.raises(Exception, match="GitError"):
        history.trees(gone, repo).collect()


KILLED = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {here!r})
from gneiss.sources import history
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.python.worker.reuse", "false").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
rows = history.log_text(spark, {repo!r}, commits_per_partition=5).collect()
print("ROWS", hash(tuple(sorted((r.ord, r.block) for r in rows))), len(rows))
"""


def test_a_killed_partition_is_read_again(repo, tmp_path):
    """A git in front of the real one kills the worker that first asks for the second range."""
    real = subprocess.run(["which", "git"], capture_output=True, text=True, check=True).stdout.strip()
    mark, fake = tmp_path / "killed", tmp_path / "bin" / "git"
    fake.parent.mkdir()
    fake.write_text(f'#!/bin/sh\ncase "$*" in *--skip=5\\ *) if [ ! -e {mark} ]; then touch {mark}; kill -9 $PPID; exit 1; fi;; esac\nexec {real} "$@"\n')
    fake.chmod(0o755)
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = []
    for path in (f"{fake.parent}:{os.environ['PATH']}", os.environ["PATH"]):
        done = subprocess.run([sys.executable, "-c", KILLED.format(here=here, repo=repo)], env=os.environ | {"PATH": path, "PYTHONHASHSEED": "0"}, capture_output=True, text=True, timeout=200, check=True)
        out.append([x for x in done.stdout.splitlines() if x.startswith("ROWS")])
    assert mark.exists() and out[0] == out[1] and out[0][0].endswith(" 29")
