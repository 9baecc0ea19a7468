"""The pipeline's near-dedup compares what SimHash finds."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import jaccard, mixing, quality, simhash


def test_fingerprints_within_four_bits_are_compared(spark, monkeypatch):
    """Without any MinHash band: texts within four bits of each other link if their shingles are similar, and only then."""
    banded = jaccard.indexed
    monkeypatch.setattr(jaccard, "indexed", lambda docs, keep: banded(docs, keep).withColumn("keys", F.array().cast("array<long>")))
    words = [f"w{i}" for i in range(2000)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{i}" for i in range(2000)]}
    bits = {i: simhash.fingerprint(" ".join(w)) for i, w in texts.items()}
    assert (bits[1] ^ bits[2]).bit_count() <= 4
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_clusters_are_the_components(spark):
    """The cheaper labels part texts as op9's components do: linked ones share a root, all others have their own."""
    near = [0b1111, 0, -1, 1 << 40, (1 << 40) | (1 << 20) | 0b1, 0]
    slim = spark.createDataFrame(list(enumerate(near)), "doc_id long, fp long")
    parts = lambda df, c: {frozenset(r.ids) for r in df.groupBy(c).agg(F.collect_set("doc_id").alias("ids")).collect()}
    assert parts(simhash.clusters(slim), "root") == parts(simhash.label(slim), "component_id") == {frozenset({0, 1, 3, 4, 5}), frozenset({2})}


def test_quality_is_fitted_in_a_task(spark, monkeypatch):
    """The driver never holds the sample's features, only the weights, which are those of a fit beside it."""
    rows = [(i, ("good plain words of text number %d " if i % 2 else "buy cheap pills now %d ") % i * 20) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    here = quality.trained(*quality.sample_features(docs, labels), 150)
    monkeypatch.setattr(type(docs), "toArrow", lambda self: (_ for _ in ()).throw(AssertionError("the sample came to the driver")))
    there = quality.fit(docs, labels)
    assert (there.weights == here.weights).all() and (there.bias, there.slope, there.shift) == (here.bias, here.slope, here.shift)
    assert quality.fit(docs, labels.filter("quality > 5")).bias == 0.0


def planned(monkeypatch, module) -> list[str]:
    """Gets the plan of every table that the module writes, as planned with sizes taken from files."""
    plans, kept = [], module.write_shared
    monkeypatch.setattr(module, "write_shared", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    return plans


def test_keys_of_simhash_are_not_broadcast(spark, monkeypatch):
    """A small file of nodes is hundreds of times its rows as keys, which its size doesn't tell."""
    plans = planned(monkeypatch, simhash)
    texts = spark.createDataFrame([(i, f"some words of text {i // 2} in a row") for i in range(40)], "doc_id long, text string")
    found = simhash.components(texts)
    assert {r.component_id for r in found.collect()} == set(range(0, 40, 2))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_near_dedup_broadcasts_nothing(spark, monkeypatch):
    """Keys, sets and components grow with the documents, and their files tell little of their size as rows."""
    of_simhash, of_jaccard = planned(monkeypatch, simhash), planned(monkeypatch, jaccard)
    rng = random.Random(5)
    rows = []
    for base in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(10 * base + k, " ".join([*words[:-1], f"x{k}"])) for k in range(3)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    last = kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 60, 10))
    assert len(of_jaccard) >= 5 and not any("Broadcast" in p for p in [*of_simhash, *of_jaccard, last])


def test_documents_taken_are_not_broadcast(spark):
    """The mix's documents meet their texts by merging; only the table of sources is broadcast."""
    table = spark.createDataFrame([(i, f"text of some words {i}", "a" if i % 3 else "b") for i in range(30)], "doc_id long, text string, source string")
    assert "Broadcast" not in mixing.mixed(table)._jdf.queryExecution().executedPlan().toString()
