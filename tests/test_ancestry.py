"""Ancestry against brute force on random histories, and how its tables grow on long ones."""

import random

import pytest
from pyspark.sql import functions as F

from gneiss.functions.ranking import numbered
from gneiss.operators import ancestry, graph


def closure(parents, tips):
    up = {}
    for h, p, _ in parents:
        up.setdefault(h, []).append(p)
    out = {}
    for t in tips:
        seen, todo = {t}, [t]
        while todo:
            for p in up.get(todo.pop(), []):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[t] = seen
    return out


def history(rng, n, merge_share):
    """A random history: branches grow, merge into each other, and are left."""
    parents, heads = [], ["c0"]
    for i in range(1, n):
        at = rng.choice(heads[-4:])
        parents.append((f"c{i}", at, 0))
        if len(heads) > 1 and rng.random() < merge_share:
            other = rng.choice([h for h in heads[-5:] if h != at] or [at])
            if other != at:
                parents.append((f"c{i}", other, 1))
        if rng.random() < 0.7 and at in heads:
            heads.remove(at)
        heads.append(f"c{i}")
    return parents


@pytest.mark.parametrize(("seed", "n", "share", "order"), [(1, 40, 0.5, True), (3, 50, 0.9, False)])
def test_feature_commits_match_brute_force(spark, seed, n, share, order):
    rng = random.Random(seed)
    parents = history(rng, n, share) + [("x2", "x1", 0), ("x3", "x2", 0), ("x3", "x0", 1)]  # a second root
    table = spark.createDataFrame(parents, "hash string, parent string, nth int")
    both = {h: {} for h, _, _ in parents}
    for h, p, k in parents:
        both[h][k] = p
    merges = [(h, b[0], b[1]) for h, b in both.items() if len(b) == 2] + [("c5", "c7", "x3"), ("c9", "c9", "c3"), ("x", "nowhere", "c2")]
    of = closure(parents, {x for m in merges for x in m[1:]})
    want = sorted({(m, h) for m, a, b in merges for h in of[b] - of[a]})
    got = ancestry.feature_commits(table if order else table.select("hash", "parent"), spark.createDataFrame(merges, "merge string, main_parent string, tip string"))
    assert sorted(tuple(r) for r in got.collect()) == want
    tips = spark.createDataFrame([(t,) for t in of], "tip string")
    assert sorted(tuple(r) for r in ancestry.reachable(table, tips).collect()) == sorted((t, h) for t, hs in of.items() for h in hs)


def test_no_history_and_no_merges(spark):
    none = spark.createDataFrame([], "hash string, parent string")
    asked = spark.createDataFrame([("m", "a", "b")], "merge string, main_parent string, tip string")
    assert ancestry.feature_commits(none, asked).collect() == []
    line = spark.createDataFrame([("b", "a")], "hash string, parent string")
    assert ancestry.feature_commits(line, asked.limit(0)).collect() == []


def test_tables_stay_linear_on_a_long_line(spark, monkeypatch):
    n = 100_000
    largest = []

    def counted(df):
        out = kept(df)
        largest.append(out.count())
        return out

    kept = ancestry.cut
    monkeypatch.setattr(ancestry, "cut", counted)
    line = spark.range(1, n).select(F.concat(F.lit("m"), "id").alias("hash"), F.concat(F.lit("m"), F.col("id") - 1).alias("parent"))
    # a branch of three commits every thousand, merged four later
    every = spark.range(1000, n - 10, 1000)
    name = lambda p, k: F.concat(F.lit(p), k)
    side = every.select(F.explode(F.array(*(F.struct(name(f"s{i}_", F.col("id")).alias("hash"), (name("m", F.col("id")) if i == 1 else name(f"s{i - 1}_", F.col("id"))).alias("parent")) for i in (1, 2, 3)))).alias("e")).select("e.*")
    into = every.select(name("m", F.col("id") + 4).alias("hash"), name("s3_", F.col("id")).alias("parent"))
    merges = every.select(name("m", F.col("id") + 4).alias("merge"), name("m", F.col("id") + 3).alias("main_parent"), name("s3_", F.col("id")).alias("tip"))
    parents = line.union(side).union(into)
    assert ancestry.feature_commits(parents, merges).count() == 3 * every.count()
    assert max(largest) <= 1.01 * parents.count()


def components_by_hand(n, edges):
    reach = closure([(a, b, 0) for a, b in edges], range(n))
    return {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 24, 34), (2, 30, 30)])
def test_strong_components_match_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n - 1, n - 1), (0, n + 5)]
    want = components_by_hand(n, [(a, b) for a, b in edges if b < n])
    vertices, links = spark.range(n), spark.createDataFrame(edges, "src long, dst long")
    assert {r.id: r.component for r in graph.strong_components(vertices, links).collect()} == want
    if seed == 1:
        got = {r.id: r for r in graph.condensed(vertices, links).collect()}
        assert all(r.members == sum(c == r.component for c in want.values()) for r in got.values())
        assert all(got[a].level < got[b].level for a, b in edges if b < n and want[a] != want[b])


def test_strong_components_of_little(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(spark.range(0), none).collect() == []
    assert [tuple(r) for r in graph.condensed(spark.range(1), none).collect()] == [(0, 0, 1, 0)]


def test_a_long_ring_is_one_component_in_few_rounds(spark, monkeypatch):
    n, rounds = 128, []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or kept(df))
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    assert graph.strong_components(spark.range(n), ring).select("component").distinct().collect()[0].component == 0
    assert len(rounds) < 60


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int")
    got = numbered(rows, [F.col("k")], per_range=10).collect()
    assert sorted((r.k, r.position) for r in got) == [(k, k + 1) for k in range(101)]
    assert numbered(rows.limit(0), [F.col("k")]).collect() == []


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 40, 50), (2, 30, 25)])
def test_levels_match_brute_force(spark, seed, n, m):
    rng = random.Random(seed)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}
    edges |= {(n + i, n + i + 1) for i in range(9)}  # a line
    edges |= {(n + 20, n + 21), (n + 21, n + 22), (n + 22, n + 20)}  # a ring that nothing enters
    edges |= {(n + 30, n + 31), (n + 31, n + 32), (n + 32, n + 31), (n + 32, n + 33), (n + 33, n + 34)}  # a ring with an entry, and what is behind it
    want = {}
    for v in range(n + 40):
        before = [a for a, b in edges if b == v]
        want[v] = None if n + 20 <= v <= n + 22 or n + 31 <= v <= n + 34 else max((want[a] + 1 for a in before), default=0)
    got = graph.levels(spark.range(n + 40), spark.createDataFrame(list(edges), "src long, dst long"))
    assert {r.id: r.level for r in got.collect()} == want


def test_a_long_line_has_levels_in_few_rounds(spark, monkeypatch):
    n, rounds = 5000, []
    kept = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or kept(df))
    line = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.levels(spark.range(n), line).filter("id = level").count()
    assert got == n and len(rounds) < 25
