"""Every query of the subpackage on small tables: SQL where it can express it, else rows, types and digests."""

import hashlib

import duckdb
import pytest

import corpus_pipeline
from gneiss.llm import bpe, queries

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_substring": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op2_urls": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op4_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op10_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_tree": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op12_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13_infill": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert TYPES[name].items() <= dict(df.dtypes).items()
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name])
        assert shown(df.columns, [tuple(r) for r in rows]) == shown([d[0] for d in want.description], want.fetchall())
        return
    if name == "op11_tree":  # recall by a whole scan
        nearest = """SELECT a.vec_id AS query_id, b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 20"""
        want = set(duck.execute(nearest).fetchall())
        found = [(r.query_id, r.vec_id) for r in rows]
        assert len(set(found)) == len(found) == len(want) and len(want & set(found)) >= 0.9 * len(want)
        return
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op6_toxicity":
        assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    if name == "op7_bpe":
        coder = bpe.Bpe(open(queries.vocabulary_path(), encoding="utf-8").read())
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for r in rows:
            ids = coder.encode(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(coder.decode(ids)))
    if name == "op9_simhash":
        assert all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)


def test_names():
    assert set(queries.QUERIES) == set(TYPES) and set(queries.ORACLE_SQL) <= set(TYPES) and corpus_pipeline.ORACLE_SQL is None
