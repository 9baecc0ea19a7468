"""The pipeline's stages on the smallest tables, each against its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gneiss.llm import bpe, jaccard, pii, queries, quality, simhash
from gneiss.llm.common import read_table, write_shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = write_shared(read_table(spark, SF, "documents"), "in"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, docs := write_shared(stage(spark, docs, SF), name)))
    return {name: (a, b) for name, a, b in out}


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        assert stages[name][1].dtypes == stages[name][0].dtypes


def test_quality_stage_keeps_what_it_judges_good(spark, stages):
    before, after = stages["quality_rules"]
    model = quality.fit(before, read_table(spark, SF, "labels"))
    want = {r.doc_id for r in quality.judge(before, model, ["doc_id"]).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want and 0 < len(want) < before.count()


def test_dedup_stage_keeps_one_of_each_component(stages):
    before, after = stages["simhash_dedup"]
    rows = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    left = {r.doc_id: rows[r.doc_id] for r in after.collect()}
    assert all((a ^ b).bit_count() > 4 for i, a in left.items() for j, b in left.items() if i < j)
    assert left


def test_pii_stage_leaves_no_base_span(stages):
    before, after = stages["pii"]
    assert after.count() == before.count()
    assert pii.find(after).filter("size(spans) > 0").count() == 0
    assert after.filter("n_chars <> length(text)").count() == 0


def test_mix_stage_repeats_whole_documents(stages):
    before, after = stages["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    counts = {}
    for r in after.collect():
        assert texts[r.doc_id] == r.text
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert max(counts.values()) == 2
    words = lambda ids: sum(len(texts[i].encode().split()) for i in ids)
    assert words(d for d, n in counts.items() for _ in range(n)) == pytest.approx(1.5 * words(texts), rel=0.05)


def test_bpe_stage_round_trips(stages):
    before, after = stages["bpe"]
    coder = bpe.Bpe(open(queries.vocabulary_path(), encoding="utf-8").read())
    texts = {r.doc_id: r.text for r in before.collect()}
    assert after.count() == before.count()
    assert all(coder.decode(r.ids) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in after.collect())


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty, blank and long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i} mail{i}@x.org" for i in range(4000))
    plain = " ".join(f"plain{i}" for i in range(80))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (4, long, "en", "a", None), (5, plain, "en", "a", 9), (5, plain, "en", "a", 9), (6, plain, "de", "b", 9), (7, plain.upper(), "de", "b", 9), (None, plain + " more", "en", "c", 1)]
    odd = spark.createDataFrame([(*r, "x", 1.5, [1]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string, kept double, ids array<int>")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, SF)
            got = out.collect()
            if name != "bpe":
                assert out.dtypes == docs.dtypes
            assert len(got) <= 2 * len(rows)
        if name == "simhash_dedup":
            kept = [r.doc_id for r in stage(spark, odd, SF).collect()]
            assert sorted(kept, key=repr) == sorted(set(kept), key=repr) and {1, 4, 5} <= set(kept) and 6 not in kept and 7 not in kept
        if name == "bpe":
            assert len(stage(spark, odd, SF).collect()) == len(rows)


def test_dedup_stage_joins_every_pair_of_similarity_four_fifths(spark):
    """A few replaced words of 100: similar by five-word shingles, many bits apart by SimHash. Brute force decides."""
    rng, rows = random.Random(8), []
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((10 * base, " ".join(words)))
        for copy, changed in enumerate((1, 2, 3, 6), 1):
            other = list(words)
            for at in rng.sample(range(100), changed):
                other[at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * base + copy, " ".join(other)))
    split = {i: t.split() for i, t in rows}
    runs = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    root = {i: i for i in runs}
    for _ in range(5):
        for i, a in runs.items():
            for j in range(i // 10 * 10, i // 10 * 10 + 5):
                if 5 * len(a & runs[j]) >= 4 * len(a | runs[j]):
                    root[i] = root[j] = min(root[i], root[j])
    far = [(simhash.fingerprint(t) ^ simhash.fingerprint(dict(rows)[root[i]])).bit_count() for i, t in rows if root[i] != i]
    assert sum(d > 4 for d in far) > len(far) / 2
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, SF).collect()} == set(root.values())


def test_links_across_hubs_are_found(spark, monkeypatch):
    """One cluster whose texts mostly aren't linked with their keys' hubs, in several tiles: components by brute force."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        words = list(base if rng.random() < 0.4 or not texts else rng.choice(texts).split())
        for at in rng.sample(range(90), rng.randint(1, 6)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [frozenset(jaccard.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = {find(i) for i in range(len(texts))}
    assert 10 < len(want) < 140
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in jaccard.deduplicated(table).collect()} == want


def test_near_dedup_recall_on_the_tables(spark):
    """Every pair of documents at Jaccard 0.8 or more, found by comparing all of them, ends in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labelled = jaccard.label(docs.withColumn("_content", F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text"))))
    root = {r.doc_id: bytes(r.root) for r in labelled.collect()}
    assert len(root) == docs.count()
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    sets = {i: frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items()}
    having = {}
    for i, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(i)
    near = set()
    for i, s in sets.items():
        shared = Counter(j for x in s for j in having[x] if j > i)
        near |= {(i, j) for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)}
    assert len(near) > 10 and all(root[a] == root[b] for a, b in near)
