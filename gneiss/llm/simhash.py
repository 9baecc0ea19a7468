"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into segments so few that, of any two fingerprints that link, some segment differs
in at most one bit. Each segment is indexed under every variant with one bit as a wildcard; fingerprints
that share a variant are joined by equality and verified on all bits. Equal fingerprints are one node, so
copies never meet in a join. Components are found by alternating large and small stars, each round
written to the shared folder. Joins merge: Spark takes a table's size from its compressed file and doesn't
count the rows that ``explode`` makes of one, so it would broadcast hundreds of times what it expects.

Defined results: a null text counts as empty; a text without words has fingerprint zero, which links like
any other; repeated rows share a node; a null doc_id never names a component unless its component has no
other id; an empty table gives no rows; other columns are ignored by ``components``.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import discard, map_text, write_shared

SHINGLE, SEED, BITS, DISTANCE = 4, 42, 64, 4


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half of its shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    each = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(each), 1 << 16):
        ones += np.unpackbits(each[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(each), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``fp``, the fingerprint as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)]

    return map_text(docs, text, keep, [("fp", "long")], make)


def segments(distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, length) of the fewest segments of which one differs in at most one bit."""
    n = distance // 2 + 1
    cuts = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def signatures(distance: int = DISTANCE, refine: bool = True) -> list[tuple[int, int, list[int]]]:
    """(segment, mask, blocks passed over) of every variant: a segment's bits without a wildcard bit.

    Refined, each variant also has one of distance + 1 blocks of the other bits, of which one must be
    equal: the same links by five times as many keys, each hundreds of times as selective.
    """
    out = []
    for number, (first, length) in enumerate(segments(distance)):
        whole = (1 << length) - 1 << first
        rest = [i for i in range(BITS) if not whole >> i & 1]
        n = distance + 1
        blocks = [sum(1 << i for i in rest[len(rest) * b // n : len(rest) * (b + 1) // n]) for b in range(n)] if refine else [0]
        for wild in range(first, first + length):
            out += [(number, whole & ~(1 << wild) | block, blocks[:b]) for b, block in enumerate(blocks)]
    return out


def variants(fp: Column, distance: int = DISTANCE, refine: bool = True) -> Column:
    """All variants of a fingerprint: array<struct<place int, bits long>>."""
    return F.array(*(F.struct(F.lit(i).alias("place"), fp.bitwiseAND(F.lit(signed(mask))).alias("bits")) for i, (_, mask, _) in enumerate(signatures(distance, refine))))


def first_shared(x: Column, place: Column, distance: int = DISTANCE, refine: bool = True) -> Column:
    """Whether ``place`` is the first variant that two fingerprints of XOR ``x`` share, so each link is made once.

    That is in the first segment with at most one differing bit: its wildcard is the differing bit, or the
    segment's first bit if none differs; refined, with the first block that is equal.
    """
    differ = lambda mask: F.bit_count(x.bitwiseAND(F.lit(signed(mask))))
    sizes = [((1 << length) - 1) << first for first, length in segments(distance)]
    cases, at = None, 0
    for number, (first, length) in enumerate(segments(distance)):
        group = [s for s in signatures(distance, refine) if s[0] == number]
        per = len(group) // length
        inside = x.bitwiseAND(F.lit(signed(sizes[number])))
        bit = F.lit(first) + F.floor((place - at) / per).cast("int")
        fits = F.when(inside == 0, bit == first).otherwise(inside == F.call_function("shiftleft", F.lit(1).cast("long"), bit))
        for mask in sizes[:number]:
            fits = fits & (differ(mask) > 1)
        for b in range(1, per):
            passed = group[b][2]
            skip = (place - at) % per < b
            fits = fits & (skip | (differ(passed[b - 1]) > 0))
        upto = at + len(group)
        cases = F.when(place < upto, fits) if cases is None else cases.when(place < upto, fits)
        at = upto
    return cases


#: Tasks over which the neighbours of one node, or the members of one component, are dealt.
SALTS = 8


def links(nodes: DataFrame, distance: int = DISTANCE, refine: bool = True) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints in ``fp`` with at most ``distance`` differing bits, once each."""
    keyed = nodes.select(F.explode(variants(F.col("fp"), distance, refine)).alias("v"), F.col("fp")).select("v.place", "v.bits", "fp")
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(x) <= distance)
    return left.join(right.hint("merge"), ["place", "bits"]).filter(near & first_shared(x, F.col("place"), distance, refine)).select("a", "b")


def roots(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of the graph of edges (a, b), by alternating stars."""
    pairs = write_shared(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    while True:
        # large star: every larger neighbour of a node links to the least of the node and its neighbours
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        spread = both.filter("v > u").withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))  # a hub's neighbours are dealt over several tasks
        large = spread.join(least.hint("merge"), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours link to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        new = write_shared(small.filter("u <> v").distinct(), "stars")
        state = [df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for df in (pairs, new)]
        discard(pairs)
        pairs = new
        if state[0] == state[1]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def clusters(slim: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``slim`` (with fp) with ``root``, the same for all fingerprints of a component; for callers that need no component_id."""
    found = roots(links(write_shared(slim.select("fp").distinct(), "nodes"), distance)).toDF("fp", "root")
    return slim.join(found.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def label(slim: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``slim`` (with doc_id and fp) with ``root`` and ``component_id``, the smallest doc_id of the component."""
    nodes = write_shared(slim.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = roots(links(nodes, distance))
    # only linked nodes meet by root, dealt over several tasks: one component may hold most of them
    members = found.union(found.select("root", "root").distinct())
    linked = write_shared(nodes.join(members.toDF("fp", "root").hint("merge"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    least = least.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    dealt = linked.select("fp", "root", F.pmod(F.hash("fp"), F.lit(SALTS)).alias("salt"))
    named = dealt.join(least.hint("merge"), ["root", "salt"]).select("fp", "root", "component_id")
    of_all = nodes.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return slim.join(write_shared(of_all, "components").hint("merge"), "fp")


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp, root and component_id of every document."""
    return label(write_shared(fingerprints(docs, ["doc_id"]), "fingerprints"), distance)


def survivors(docs: DataFrame, labelled) -> DataFrame:
    """docs with one row of each root that ``labelled`` (doc_id, text, _content -> doc_id, _content, root) gives.

    Columns keep their names and values, whatever they are called: inside they go by position. Rows are told
    apart by a hash of all columns, so rows that repeat each other are one.
    """
    columns = docs.columns
    placed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    content = F.md5(F.to_json(F.struct(*(F.col(f"c{i}").cast("string").alias(f"c{i}") for i in range(len(columns))))))
    marked = placed.withColumn("_content", content)
    at = {c: F.col(f"c{columns.index(c)}").alias(c) for c in ("doc_id", "text")}
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("_content").alias("c"))
    stay = labelled(marked.select(*at.values(), "_content")).groupBy("root").agg(F.min(place).alias("p")).select(F.col("p.c").alias("_content"))
    # the content tells the id too, so texts are dealt by it once, for the join and for repeated rows
    return marked.join(stay.hint("merge"), "_content", "left_semi").dropDuplicates(["_content"]).drop("_content").toDF(*columns)


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, and of the smallest content if rows repeat it."""
    return survivors(docs, lambda marked: label(write_shared(fingerprints(marked, ["doc_id", "_content"]), "fingerprints"), distance))
