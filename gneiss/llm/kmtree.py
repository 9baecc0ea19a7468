"""Approximate nearest neighbours by a hierarchical k-means tree, searched best bin first.

A tree of centroids is fitted on a bounded sample; every row of the table goes down it to a leaf. A query
walks the tree through a priority queue, the most promising branch first: a branch promises its centroid's
inner product and a share of its spread. How many leaves a query visits is calibrated: exact neighbours of a
bounded sample of rows are found by a whole scan, and visits widen until the wanted recall is reached.

Leaves are numbered in the tree's order and rows stored by leaf in blocks of even size, so neighbouring
leaves share a block and a leaf of any size spreads over several. Queries that start in near leaves share a
block as well. Each block of queries meets each block of rows that one of them visits, once, in a task of its
own; a query is held only against rows of leaves it visits, and only its best rows of each block go on.

Scores are inner products in double precision, components added in order, so equal vectors score alike.

Defined results: a vector that is null or zero, or holds a null or non-finite component, takes no part, nor
does a null id; components that a shorter vector lacks count as 0; rows that repeat an id are all candidates
of other queries, none of its own, and the id is one query per row; ties go to the smaller id; a query visits
enough leaves to find all candidates where there are no more than asked for; a score beyond doubles is
infinite, one that isn't a number is no neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import write_shared

K = 20
#: Rows that the tree is fitted on at most, rows of a leaf aimed at, sampled rows of a leaf at least, branches of a node.
SAMPLE, LEAF_ROWS, LEAST_SAMPLE, BRANCHES = 32_768, 128, 8, 16
#: Rows of a block of the index, and queries of a block.
ROWS, QUERIES = 8192, 512
#: Recall that the calibration asks for, and the rows it is measured on at most.
RECALL, CALIBRATION = 0.95, 256
#: Share of a branch's spread that it promises beyond its centroid.
SPREAD = 0.3


@dataclass
class Tree:
    """Nodes in order of depth first; children of a node are ``first[node] : first[node] + n[node]`` of ``child``."""

    centroids: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, values: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centroid."""
        at = np.zeros(len(values), np.int64)
        out = np.zeros(len(values), np.int32)
        values = fitted(values, self.centroids.shape[1])
        open_nodes = [0] if len(values) else []
        while open_nodes:
            node = open_nodes.pop()
            rows = np.flatnonzero(at == node)
            if not self.children[node]:
                out[rows] = self.leaf[node]
            elif len(rows):
                at[rows] = np.array(self.children[node])[nearest(values[rows], self.centroids[self.children[node]])]
                open_nodes += self.children[node]
        return out

    def walk(self, query: np.ndarray):
        """Leaves in the order of best bin first."""
        query = fitted(query[None], self.centroids.shape[1])[0]
        heap = [(0.0, 0)]
        reach = SPREAD * np.sqrt(query @ query)
        while heap:
            _, node = heapq.heappop(heap)
            children = self.children[node]
            if not children:
                yield self.leaf[node]
                continue
            promise = self.centroids[children] @ query + reach * self.spread[children]
            for score, child in zip(promise.tolist(), children, strict=True):
                heapq.heappush(heap, (-score, child))


def fitted(values: np.ndarray, dims: int) -> np.ndarray:
    """Rows cut or filled with zeros to so many components."""
    out = np.zeros((len(values), dims))
    m = min(dims, values.shape[1])
    out[:, :m] = values[:, :m]
    return out


def nearest(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.argmin((centroids * centroids).sum(1) - 2 * (values @ centroids.T), axis=1)


def fit(sample: np.ndarray, leaf_rows: int, branches: int = BRANCHES, rounds: int = 10, seed: int = 7) -> Tree:
    """The tree of a sample: nodes split by k-means until they hold at most so many of its rows."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((0, 0)), np.zeros(0), [], [])
    centroids, spread = [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        node = len(centroids)
        values = sample[rows]
        center = values.mean(0) if len(rows) else np.zeros(sample.shape[1])
        centroids.append(center)
        spread.append(float(np.sqrt(((values - center) ** 2).sum(1).mean())) if len(rows) else 0.0)
        tree.children.append([])
        tree.leaf.append(-1)
        if len(rows) > leaf_rows:
            k = max(2, min(branches, -(-len(rows) // leaf_rows)))
            means = values[rng.choice(len(rows), k, False)]
            for _ in range(rounds):
                near = nearest(values, means)
                size = np.bincount(near, minlength=k)
                total = np.stack([np.bincount(near, values[:, d], k) for d in range(values.shape[1])], 1)
                means = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], means)
            near = nearest(values, means)
            parts = [rows[near == j] for j in range(k) if (near == j).any()]
            if len(parts) > 1:  # equal rows can't be split
                tree.children[node] = [grow(p) for p in parts]
        if not tree.children[node]:
            tree.leaf[node] = leaves
            leaves += 1
        return node

    with np.errstate(over="ignore", invalid="ignore"):
        grow(np.arange(len(sample)))
    tree.centroids, tree.spread = np.array(centroids), np.array(spread)
    return tree


def usable(embeddings: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col(f"`{embedding}`")
    whole = x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return embeddings.filter(whole).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def matrix(column) -> np.ndarray:
    """An Arrow column of lists as rows of one width, filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def placed(rows: DataFrame, by: str, per_block: int) -> tuple[DataFrame, int]:
    """rows with ``block``: blocks of even size in the order of a small number, big numbers over several by a hash."""
    counts = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}  # one row per leaf of the tree, at most
    total, before, start = max(1, sum(counts.values())), 0, []
    for x in sorted(counts):
        start.append((x, before, counts[x]))
        before += counts[x]
    blocks = -(-total // per_block)
    places = rows.sparkSession.createDataFrame(start, f"{by} int, start long, n long")
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) / float(1 << 30)
    block = F.least(F.floor((F.col("start") + share * F.col("n")) * blocks / total), F.lit(blocks - 1)).cast("int")
    return rows.join(F.broadcast(places), by).withColumn("block", block).drop("start", "n"), blocks


@dataclass
class Index:
    """blocks: block, leaves, ids and vectors of stored rows; visits: leaves that a query visits to reach the recall."""

    blocks: DataFrame
    tree: Tree
    leaf_rows: np.ndarray
    visits: int
    repeats: int


def build(
    embeddings: DataFrame, k: int = K, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, rows_per_block: int = ROWS,
    calibration: int = CALIBRATION,
) -> Index:
    """The index over every usable row. Only the sample, one count per leaf and the calibration's hits reach the driver."""
    import pyarrow as pa

    rows = usable(embeddings, vec_id, embedding)
    n = rows.count()
    chance = F.pmod(F.xxhash64(F.lit("sample"), "vec_id", "embedding"), F.lit(1 << 30))
    some = rows.filter(chance < int(min(1.0, sample / max(n, 1)) * (1 << 30))).limit(sample).select("embedding").toArrow()
    values = matrix(some.column("embedding").combine_chunks()) if some.num_rows else np.zeros((0, 1))
    # rows sorted, so the fit is the same in whatever order they come
    values = values[np.lexsort(values.T[::-1])]
    tree = fit(values, max(LEAST_SAMPLE, leaf_rows * len(values) // max(n, 1)))

    def assigned(batches):
        for batch in batches:
            leaf = tree.assign(matrix(batch.column("embedding")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(leaf, pa.int32())], names=["vec_id", "embedding", "leaf"])

    at_leaf = write_shared(rows.mapInArrow(assigned, "vec_id long, embedding array<double>, leaf int"), "leaves")
    dealt, _ = placed(at_leaf, "leaf", rows_per_block)

    def gather(table: pa.Table) -> pa.Table:
        leaf, ids = table.column("leaf").to_numpy(), table.column("vec_id").to_numpy()
        order = np.lexsort((ids, leaf))
        x = matrix(table.column("embedding").combine_chunks())[order]
        return pa.table({"block": table.column("block")[:1], "leaves": pa.array([leaf[order]], pa.list_(pa.int32())), "ids": pa.array([ids[order]], pa.list_(pa.int64())), "vectors": pa.array([x.tobytes()], pa.binary())})

    blocks = write_shared(dealt.groupBy("block").applyInArrow(gather, "block int, leaves array<int>, ids array<long>, vectors binary"), "tree-blocks")
    per_leaf = np.zeros(tree.leaves, np.int64)
    for r in at_leaf.groupBy("leaf").count().collect():
        per_leaf[r["leaf"]] = r["count"]
    repeats = at_leaf.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    index = Index(blocks, tree, per_leaf, tree.leaves, repeats)
    index.visits = calibrated(index, at_leaf, n, k, recall, calibration)
    return index


def calibrated(index: Index, at_leaf: DataFrame, n: int, k: int, recall: float, calibration: int) -> int:
    """Leaves to visit: widened until that share of the exact neighbours of sampled rows lies in visited leaves."""
    import pyarrow as pa

    chance = F.pmod(F.xxhash64(F.lit("calibration"), "vec_id", "embedding"), F.lit(1 << 30))
    asked = at_leaf.filter(chance < int(min(1.0, calibration / max(n, 1)) * (1 << 30))).limit(calibration).select("vec_id", "embedding").toArrow()
    if not asked.num_rows:
        return index.tree.leaves
    own, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding").combine_chunks())

    def exact(batches):
        for batch in batches:
            for leaves, ids, vectors in zip(*(batch.column(c) for c in ("leaves", "ids", "vectors")), strict=True):
                leaf, ids, x = stored(leaves, ids, vectors)
                number, row, score = best(queries, own, x, ids, None, k)
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(ids[row], pa.int64()), pa.array(score), pa.array(leaf[row], pa.int32())], names=["number", "vec_id", "score", "leaf"])

    hits = index.blocks.mapInArrow(exact, "number int, vec_id long, score double, leaf int")
    nth = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), "vec_id"))
    wanted: dict[int, list[int]] = {}
    for r in hits.withColumn("rank", nth).filter(F.col("rank") <= k).select("number", "leaf").collect():  # k rows of each sampled row
        wanted.setdefault(r["number"], []).append(r["leaf"])
    turn = []
    for number, found in wanted.items():
        order = {leaf: i for i, leaf in enumerate(index.tree.walk(queries[number]))}
        turn += [order[x] for x in found]
    turn = np.array(turn)
    visits = 1
    while visits < index.tree.leaves and (turn < visits).mean() < recall:
        visits += max(1, visits // 16)
    return min(visits, index.tree.leaves)


def stored(leaves, ids, vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    leaf, ids = leaves.values.to_numpy(), ids.values.to_numpy()
    return leaf, ids, np.frombuffer(vectors.as_buffer(), "<f8").reshape(len(ids), -1)


def best(queries: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, visited: tuple[np.ndarray, np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, in order; rows of its own id never, those of leaves it doesn't visit neither.

    visited: the rows' leaves and, of each query, the sorted leaves that it visits.
    """
    dims = max(queries.shape[1], x.shape[1])
    queries, x = fitted(queries, dims) if queries.shape[1] < dims else queries, fitted(x, dims) if x.shape[1] < dims else x
    with np.errstate(over="ignore", invalid="ignore"):
        if visited is None:
            rough = queries @ x.T
        else:
            leaf, sees = visited
            rough = np.full((len(queries), len(x)), np.nan)
            starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else []
            for a, b in zip(starts, [*starts[1:], len(leaf)], strict=True):
                who = np.flatnonzero(sees[:, leaf[a]])
                rough[who, a:b] = queries[who] @ x[a:b].T
        order = np.argsort(ids, kind="stable")
        first, last = np.searchsorted(ids, own, "left", order), np.searchsorted(ids, own, "right", order)
        for q in np.flatnonzero(first < last):
            rough[q, order[first[q] : last[q]]] = np.nan
        seen = ~np.isnan(rough)
        rough[~seen] = -np.inf
        if len(x) > k:
            edge = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
            # products differ by rounding from the sums in order below, by no more than this
            slack = 4 * dims * 2.0**-53 * np.sqrt((queries * queries).sum(1)) * np.sqrt((x * x).sum(1).max())
            edge = np.where(np.isfinite(edge - slack), edge - slack, edge)
            number, row = np.nonzero(seen & (rough >= edge[:, None]))
        else:
            number, row = np.nonzero(seen)
        score = np.zeros(len(row))
        for d in range(dims):
            score += queries[number, d] * x[row, d]
        order = np.lexsort((ids[row], -score, number))
        number, row, score = number[order], row[order], score[order]
        place = np.arange(len(number)) - np.searchsorted(number, number, "left")
        keep = (place < k) & ~np.isnan(score)
    return number[keep], row[keep], score[keep]


def search(index: Index, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", queries_per_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows found for each query, from the leaves it visits."""
    import pyarrow as pa

    tree, visits, sizes, least = index.tree, index.visits, index.leaf_rows, k + index.repeats

    def leaves_of(query: np.ndarray) -> list[int]:
        out, rows = [], 0
        for leaf in tree.walk(query):
            if len(out) >= visits and rows >= least:
                break
            out.append(leaf)
            rows += int(sizes[leaf])
        return out

    def walked(batches):
        for batch in batches:
            x = matrix(batch.column("embedding"))
            seen = [leaves_of(q) for q in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("embedding"), pa.array([s[0] for s in seen], pa.int32()), pa.array(seen, pa.list_(pa.int32()))], names=["vec_id", "embedding", "near", "seen"]
            )

    asked = write_shared(usable(queries, vec_id, embedding).mapInArrow(walked, "vec_id long, embedding array<double>, near int, seen array<int>"), "tree-queries")
    dealt, _ = placed(asked, "near", queries_per_block)

    def gather(table: pa.Table) -> pa.Table:
        x = matrix(table.column("embedding").combine_chunks())
        sees = np.zeros((len(x), tree.leaves), bool)
        for i, s in enumerate(table.column("seen")):
            sees[i, s.values.to_numpy()] = True
        ids = table.column("vec_id").to_numpy()
        return pa.table({
            "query_block": table.column("block")[:1], "own": pa.array([ids], pa.list_(pa.int64())), "queries": pa.array([x.tobytes()], pa.binary()),
            "sees": pa.array([np.packbits(sees, axis=1).tobytes()], pa.binary()), "any": pa.array([np.flatnonzero(sees.any(0))], pa.list_(pa.int32())),
        })

    query_blocks = write_shared(dealt.groupBy("block").applyInArrow(gather, "query_block int, own array<long>, queries binary, sees binary, any array<int>"), "tree-query-blocks")
    # which block meets which: by the leaves that some query of the one visits and some row of the other lies in
    held = index.blocks.select("block", F.explode(F.array_distinct("leaves")).alias("leaf"))
    meet = query_blocks.select("query_block", F.explode("any").alias("leaf")).join(held, "leaf").select("query_block", "block").distinct()
    pairs = meet.join(query_blocks.drop("any"), "query_block").join(index.blocks, "block")
    n_pairs = index.blocks.count() * query_blocks.count()
    pairs = pairs.repartition(max(1, min(n_pairs, 100_000)), "block", "query_block")

    def run(batches):
        for batch in batches:
            for query_block, own, asked, sees, leaves, ids, vectors in zip(*(batch.column(c) for c in ("query_block", "own", "queries", "sees", "leaves", "ids", "vectors")), strict=True):
                leaf, ids, x = stored(leaves, ids, vectors)
                own = own.values.to_numpy()
                q = np.frombuffer(asked.as_buffer(), "<f8").reshape(len(own), -1)
                mask = np.unpackbits(np.frombuffer(sees.as_buffer(), np.uint8).reshape(len(own), -1), axis=1, count=tree.leaves).astype(bool)
                number, row, score = best(q, own, x, ids, (leaf, mask), k)
                block = np.full(len(number), query_block.as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(number, pa.int32()), pa.array(own[number], pa.int64()), pa.array(ids[row], pa.int64()), pa.array(score)],
                    names=["query_block", "number", "query_id", "vec_id", "score"],
                )

    found = pairs.mapInArrow(run, "query_block int, number int, query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_block", "number").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
