"""The corpus pipeline: quality rules, near-dedup, personal data, mixing, BPE coding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result under
the shared folder and reads it back as the next one's input, so a lost executor repeats one stage at most.
All stages but the last return the columns of documents, and further columns as they were, whatever their
names. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, jaccard, mixing, pii, quality, simhash
from gneiss.llm.common import read_table, write_shared
from gneiss.llm.queries import vocabulary_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the model learns from the labelled ones.

    A null or empty text has no words and goes; null ids, languages and sources don't matter; repeated rows
    are judged alike, and all stay or all go; ties in the fit's sample go by a hash of the id.
    """
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.passing(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one of the smallest id.

    SimHash fingerprints within four bits, by op9's operator, and MinHash bands say which documents are compared;
    an exact check of their five-word shingles, similar by 0.8 or more, decides which of these link.
    Texts without words, null or empty, are one component; a null id stays only where its component has no
    other; of rows that repeat the smallest id the one of the smallest content stays; repeated rows are one.
    """
    return simhash.survivors(docs, linked)


def linked(docs: DataFrame) -> DataFrame:
    """From doc_id, text, _content: doc_id, _content and ``root``, the same for all documents of a component."""
    slim = write_shared(simhash.fingerprints(docs, ["doc_id", "_content"]), "fingerprints")
    return jaccard.label(docs, met=simhash.clusters(slim).select("_content", F.xxhash64(F.lit("simhash"), "root").alias("key")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind; n_chars follows the text.

    A null text stays null, with n_chars null; an empty one stays empty; every row stays, repeated ones too.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, up to twice.

    Null is a source of its own; documents without words cost nothing and are taken while their turn is within
    the budget; repeated rows (id, source and text) are taken equally often; ties go by a hash of id and text.
    """
    return mixing.mixed(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of the text decoded from them.

    Only doc_id and source pass through. A null text counts as empty: no ids, and the digest of nothing; every
    row gives a row, repeated ones too.
    """
    coded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary_path(), decoded="decoded")
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: A trained model, hashed shingles and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table to token ids."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
