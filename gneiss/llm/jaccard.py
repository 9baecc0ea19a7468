"""Near-dedup by the Jaccard similarity of word shingles: MinHash bands give candidates, exact similarity decides.

A document is the set of hashes of its SHINGLE-word runs; equal sets are one node, so copies never meet in
a join. A node is indexed under BANDS keys, each a hash of ROWS minima; nodes that share a key are verified
on their whole sets. A pair of similarity J shares a key with probability 1 - (1 - J ** ROWS) ** BANDS:
0.99993 at 0.8, more above. That is the method's only loss.

Components need not all their links, so most pairs of a cluster of near copies are never made. First every
key's nodes are verified against one of them, a hub, in STARS rounds with different hubs: rows in proportion
to the keys, however large the groups. Nodes joined so far are one root, and then only pairs of one key whose
roots differ are left; all of these are made, the nodes outside a key's commonest root against all others.
Joins merge, as in ``simhash``: a set's hashes repeated under many keys are small in a file and large as rows.

Why not SimHash bits: at similarity 0.8 fingerprints differ in about ten of 64 bits and in up to 16 or so,
where the segments of ``simhash.segments`` are of seven or eight bits and select nothing.

Defined results: a null text counts as empty; all texts without words are one node; a text of fewer words
than a shingle is one shingle; case is ignored, as in ``simhash``.
"""

from __future__ import annotations

import functools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import map_text, write_shared
from gneiss.llm.simhash import SALTS, roots, survivors

SHINGLE, SEED, ROWS, BANDS, SIMILARITY = 5, 42, 5, 24, (4, 5)  # similarity as a fraction, so that it is compared in integers
#: Rounds of hubs before all remaining pairs are made.
STARS = 2
#: Nodes of a key that one task holds against those outside its commonest root.
TILE = 512


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's runs of words, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    runs = zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in runs], np.uint64).view(np.int64))


@functools.cache
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of n permutations of 64-bit values."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def keys(hashes: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> list[int]:
    """One key of each band: a hash of the minima of its rows' permutations. Nothing for an empty set."""
    if not len(hashes):
        return []
    factors, added = permutations(rows * bands)
    least = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
    values = hashes.view(np.uint64)
    for at in range(0, len(values), 2048):
        mixed = values[None, at : at + 2048] * factors[:, None] + added[:, None]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(1))
    return [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))]


def indexed(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, ``node`` (a 128-bit hash of the set), its size ``n`` and its ``keys``."""

    def make():
        def run(texts):
            each = [shingles(t) for t in texts]
            bands = [np.array(keys(h), np.uint64).view(np.int64) for h in each]
            return [[xxhash.xxh3_128_digest(h.tobytes()) for h in each], [len(h) for h in each], bands]

        return run

    return map_text(docs, text, keep, [("node", "binary"), ("n", "int"), ("keys", "array<long>")], make, rows=64)


def hubs(keyed: DataFrame, seed: int) -> DataFrame:
    """(a, b): each node (node, n, key) and the hub of each of its keys; hubs differ by seed."""
    order = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n")
    of_key = keyed.groupBy("key").agg(F.min(order).alias("hub"), F.count("*").alias("size")).filter("size > 1")
    spread = of_key.select("key", F.col("hub.node").alias("a"), F.col("hub.n").alias("na"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    return keyed.withColumn("salt", F.pmod(F.hash("node"), F.lit(SALTS))).join(spread.hint("merge"), ["key", "salt"]).select("a", "na", F.col("node").alias("b"), F.col("n").alias("nb"))


def crossing(keyed: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b): the links between nodes (node, n, key, root) that share a key but not a root.

    One of each pair is outside its key's commonest root, so a group costs its size times the number of
    these in comparisons, and nothing if it has one root. Pairs are judged where they meet: only links are
    rows. A large group is dealt in tiles of about TILE nodes.
    """
    per = keyed.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("size"), F.count("*").alias("different"))
    per = per.filter("different > 1").select("key", "main", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    mixed = write_shared(keyed.join(per.hint("merge"), "key").join(sets.hint("merge"), "node"), "mixed")
    of = lambda x: (F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"), F.col("hashes").alias(f"h{x}"))
    outside = mixed.filter("root <> main").select("key", *of("a"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    every = mixed.select("key", *of("b"), (F.col("root") != F.col("main")).alias("out"), F.pmod(F.hash("node"), F.col("tiles")).alias("tile"))
    once = (F.col("ra") != F.col("rb")) & (~F.col("out") | (F.col("a") < F.col("b")))
    meet = (outside["key"] == every["key"]) & (outside["tile"] == every["tile"])
    return outside.join(every.hint("merge"), meet & once & sized(similarity) & similar(similarity)).select("a", "b").distinct()


def sized(similarity: tuple[int, int]):
    """Whether sets of na and nb hashes can be so similar."""
    p, q = similarity
    return F.least("na", "nb") * q >= F.greatest("na", "nb") * p


def similar(similarity: tuple[int, int]):
    """Whether the sets ha and hb are so similar."""
    p, q = similarity
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return both * q >= (F.size("ha") + F.size("hb") - both) * p


def candidates(pairs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b), a < b: the different pairs of (a, na, b, nb), but for sizes too far apart to be so similar."""
    return pairs.filter(sized(similarity) & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) are at least so similar."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").filter(similar(similarity)).select("a", "b")


def label(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, met: DataFrame | None = None) -> DataFrame:
    """From doc_id, text, _content: doc_id, _content and ``root``, which is the same for all documents of a component.

    met: further keys (_content, key) under which texts are compared, beside those of the bands.
    """
    slim = write_shared(indexed(docs, ["doc_id", "_content"]), "shingles")
    nodes = slim.groupBy("node").agg(F.min_by(F.struct("n", "keys", "_content"), "_content").alias("of")).select("node", "of.*")
    keyed = nodes.select("node", "n", "_content", F.explode("keys").alias("key"))
    if met is not None:
        more = slim.select("_content", "node").join(met.hint("merge"), "_content").select("node", "key").distinct()
        keyed = keyed.union(nodes.select("node", "n", "_content").join(more.hint("merge"), "node").select("node", "n", "_content", "key"))
    # a key of one node links nothing; only nodes with another key are cut into sets again, one text a node: sets are larger than the texts
    shared = keyed.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    keyed = write_shared(keyed.join(shared.hint("merge"), "key"), "keys")
    wanted = keyed.select("node", "_content").distinct()
    make = lambda: lambda texts: [[shingles(t) for t in texts]]
    texts = docs.select("_content", "text").join(wanted.hint("merge"), "_content").dropDuplicates(["node"])
    sets = write_shared(map_text(texts, "text", ["node"], [("hashes", "array<long>")], make, rows=64), "sets")
    keyed, made = keyed.drop("_content"), []
    for seed in range(STARS):
        made.append(write_shared(links(candidates(hubs(keyed, seed), similarity), sets, similarity), "similar"))
    found = roots(functools.reduce(DataFrame.union, made))
    rooted = keyed.join(found.withColumnRenamed("root", "r").hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("r", "node").alias("root"))
    found = roots(functools.reduce(DataFrame.union, [crossing(rooted, sets, similarity), found.toDF("a", "b")]))
    return slim.select("doc_id", "_content", "node").join(found.hint("merge"), "node", "left").select("doc_id", "_content", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, and of the smallest content if rows repeat it."""
    return survivors(docs, lambda marked: label(marked, similarity))
