"""Exact top-k search by inner product over a bit-sliced index.

Vectors are quantised to whole numbers. The index keeps, for a block of rows and each component, one
bitmap per bit of the (offset) values. A query adds the components' slices, weighted by its own values,
with bitmap arithmetic: carry-save additions per bit of the query's values, then one ripple addition, so
the scores of all rows of a block stand in bit slices. The top rows are selected from the most
significant slice downward; the rows that tie at the boundary are resolved exactly, by id. Only each
block's few best rows leave it, and the best of those over all blocks are the result.

Blocks of queries meet every block of rows once: the queries are a stated subset, in blocks.

Defined results: a vector that is null or holds a null or non-finite component takes no part; so does a
null id; components that a shorter vector lacks count as 0; an empty vector scores 0; rows that repeat an
id are all candidates of other queries, none of its own, and the id is one query per row; an empty table
gives no rows; other columns are ignored. Components have no bound: where 64 bits don't hold them, slices are
cut from whole numbers of any size, and ranks are by exact scores; a score that a long can't hold is returned
as the nearest long.
"""

from __future__ import annotations

import math
import struct
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import write_shared

K, SCALE, ROWS, QUERIES = 5, 256, 32768, (64, 1024)
#: Tasks over which pairs of blocks are dealt, at most.
MOST_TASKS = 100_000


LONG = np.iinfo(np.int64)


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: as int64, or as whole numbers of any size where some are beyond 2**53."""
    values = values.astype(np.float64)
    if not len(values) or np.abs(values).max() < 2.0**53 / SCALE:
        return np.floor(SCALE * values).astype(np.int64)
    return np.array([math.floor(SCALE * Fraction(x)) for x in values.tolist()], object)


def whole_blob(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: how wide they are, then each, little-endian."""
    if values.dtype != object:
        return struct.pack("<q", 8) + values.astype("<i8").tobytes()
    width = 8 * (max((int(v).bit_length() for v in values.flat), default=0) // 64 + 1)
    return struct.pack("<q", width) + b"".join(int(v).to_bytes(width, "little", signed=True) for v in values.flat)


def from_whole_blob(blob: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """n numbers that whole_blob wrote at a place, and the place after them."""
    (width,) = struct.unpack_from("<q", blob, at)
    at, end = at + 8, at + 8 + n * width
    if width == 8:
        return np.frombuffer(blob, "<i8", n, at), end
    return np.array([int.from_bytes(blob[i : i + width], "little", signed=True) for i in range(at, end, width)], object), end


class Index:
    """Bit slices of a block: ids ascending, values as a matrix of whole numbers (rows x components)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.n, self.dims = values.shape
        self.words = -(-self.n // 64)
        self.low = values.min(axis=0) if self.n and self.dims else np.zeros(self.dims, values.dtype)
        over = values - self.low
        self.bits = [int(m).bit_length() for m in (over.max(axis=0) if self.n else self.low * 0)]
        self.slices = [np.stack([self.pack((over[:, d] >> b) & 1) for b in range(self.bits[d])]) if self.bits[d] else None for d in range(self.dims)]

    def to_blob(self) -> bytes:
        head = struct.pack("<qq", self.n, self.dims) + self.ids.astype("<i8").tobytes() + whole_blob(self.low) + np.array(self.bits, "<i8").tobytes()
        return head + b"".join(x.astype("<u8").tobytes() for x in self.slices if x is not None)

    @classmethod
    def from_blob(cls, blob: bytes) -> Index:
        self = cls.__new__(cls)
        self.n, self.dims = struct.unpack_from("<qq", blob)
        self.words, at = -(-self.n // 64), 16
        self.ids, at = np.frombuffer(blob, "<i8", self.n, at), at + 8 * self.n
        self.low, at = from_whole_blob(blob, self.dims, at)
        self.bits, at = np.frombuffer(blob, "<i8", self.dims, at).tolist(), at + 8 * self.dims
        self.slices = []
        for b in self.bits:
            self.slices.append(np.frombuffer(blob, "<u8", b * self.words, at).reshape(b, self.words) if b else None)
            at += 8 * b * self.words
        return self

    def pack(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def weighted(self, terms: list[tuple[int, int]], width: int) -> np.ndarray:
        """Slices of the sum of weight x component over (component, weight > 0), modulo 2**width."""
        total, carry = np.zeros((width, self.words), np.uint64), np.zeros((width, self.words), np.uint64)
        half, both = np.empty_like(total), np.empty_like(total)
        top = max((w.bit_length() for _, w in terms), default=0)
        bound, used = 0, 0  # the most that the sum can be so far, and the slices that it can set
        for bit in range(top - 1, -1, -1):
            if used:
                total[1:], carry[1:] = total[:-1].copy(), carry[:-1].copy()
                total[0], carry[0] = 0, 0
                bound *= 2
                used = min(width, bound.bit_length())
            for d, w in terms:
                if w >> bit & 1:
                    x, n = self.slices[d], self.bits[d]
                    # a full adder on the component's slices, a half adder on the rest
                    bound += (1 << n) - 1
                    m = min(width, max(used, n, bound.bit_length()))
                    h, c = half[:m], both[:m]
                    np.bitwise_xor(total[:m], carry[:m], out=h)
                    np.bitwise_and(total[:m], carry[:m], out=c)
                    c[:n] |= h[:n] & x
                    total[:m] = h
                    total[:n] ^= x
                    carry[1:m] = c[: m - 1]
                    carry[0] = 0
                    used = min(width, bound.bit_length())
        return self.ripple(total, carry, 0)

    @staticmethod
    def ripple(a: np.ndarray, b: np.ndarray, carry_in: int) -> np.ndarray:
        out = np.empty_like(a)
        carry = np.full(a.shape[1], 0xFFFFFFFFFFFFFFFF if carry_in else 0, np.uint64)
        for i in range(len(a)):
            half = a[i] ^ b[i]
            out[i] = half ^ carry
            carry = (a[i] & b[i]) | (half & carry)
        return out

    def scores(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the scores plus an offset that makes them non-negative, and that offset."""
        dims = min(self.dims, len(query))
        q = [int(x) for x in query[:dims]]
        up = [(d, q[d]) for d in range(dims) if q[d] > 0 and self.bits[d]]
        down = [(d, -q[d]) for d in range(dims) if q[d] < 0 and self.bits[d]]
        most_up = sum(w * ((1 << self.bits[d]) - 1) for d, w in up)
        most_down = sum(w * ((1 << self.bits[d]) - 1) for d, w in down)
        width = max(1, (most_up + most_down).bit_length() + 1)
        plus, minus = self.weighted(up, width), self.weighted(down, width)
        # plus - minus + most_down >= 0
        fixed = np.array([0xFFFFFFFFFFFFFFFF if most_down >> i & 1 else 0 for i in range(width)], np.uint64)
        lifted = self.ripple(plus, np.broadcast_to(fixed[:, None], plus.shape), 0)
        total = self.ripple(lifted, ~minus, 1)
        return total, most_down - sum(q[d] * int(self.low[d]) for d in range(dims))

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[list[int], list[int]]:
        """The k best rows but those of id ``own``: ids and exact scores, ties to the smaller id."""
        total, offset = self.scores(query)
        tied = self.pack(np.ones(self.n, np.uint8))
        for row in range(np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")):
            tied[row >> 6] &= ~np.uint64(1 << (row & 63))
        sure = np.zeros(self.words, np.uint64)
        for slice_ in total[::-1]:  # from the most significant slice downward
            hit = tied & slice_
            n = int(np.bitwise_count(sure).sum() + np.bitwise_count(hit).sum())
            if n > k:
                tied = hit
            elif n < k:
                sure, tied = sure | hit, tied & ~slice_
            else:
                sure, tied = sure | hit, np.zeros_like(tied)
                break
        rows = list(self.rows(sure))
        rows += list(self.rows(tied)[: k - len(rows)])  # all of one score; rows are in order of id
        scored = [(-(sum(int(total[b, r >> 6] >> np.uint64(r & 63) & np.uint64(1)) << b for b in range(len(total))) - offset), int(self.ids[r])) for r in map(int, rows)]
        scored.sort()
        return [i for _, i in scored], [-s for s, _ in scored]

    @staticmethod
    def rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def query_blob(ids: np.ndarray, values: np.ndarray) -> bytes:
    return struct.pack("<qq", *values.shape) + ids.astype("<i8").tobytes() + whole_blob(values)


def from_query_blob(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, dims = struct.unpack_from("<qq", blob)
    ids = np.frombuffer(blob, "<i8", n, 16)
    return ids, from_whole_blob(blob, n * dims, 16 + 8 * n)[0].reshape(n, dims)


def blocks(vectors: DataFrame, name: str, per_block: int, to_blob) -> DataFrame:
    """(block, blob) of about per_block vectors each, dealt out by a hash of the row, the same whenever it is run again."""
    import pyarrow as pa

    n = max(1, -(-vectors.count() // per_block))
    dealt = vectors.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int").alias("block"), "vec_id", "embedding")

    def gather(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        rows = table.column("embedding").combine_chunks()
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
        flat = quantised(rows.flatten().to_numpy(zero_copy_only=False))
        values = np.zeros((len(ids), int(sizes.max(initial=0))), flat.dtype)
        values[np.arange(values.shape[1]) < sizes[:, None]] = flat
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "blob": pa.array([to_blob(ids, values)], pa.binary())})

    return write_shared(dealt.groupBy("block").applyInArrow(gather, "block int, blob binary"), name)


def build(embeddings: DataFrame, rows_per_block: int = ROWS) -> DataFrame:
    """The index: (block, blob), each blob the bit slices of a block of rows, stored in the shared folder."""
    return blocks(usable(embeddings), "slices", rows_per_block, lambda ids, values: Index(ids, values).to_blob())


def usable(embeddings: DataFrame) -> DataFrame:
    whole = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def search(index: DataFrame, queries: DataFrame, k: int = K, queries_per_block: tuple[int, int] = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of the index.

    A task holds one block of rows and one of queries at a time. Blocks of queries have between
    ``queries_per_block`` queries, some 32 blocks if they can: each block of rows travels once per block.
    """
    import pyarrow as pa

    some, most = queries_per_block
    asked = usable(queries)
    query_blocks = blocks(asked, "queries", max(some, min(most, -(-asked.count() // 32))), query_blob)
    n_rows, n_queries = index.count(), query_blocks.count()
    last = index.agg(F.max("block")).first()[0] if n_rows else None
    every = F.sequence(F.lit(0), F.lit(last)) if n_rows else F.array().cast("array<int>")  # the blocks' numbers; one without rows joins nothing
    each = query_blocks.select(F.explode(every).alias("at"), F.col("block").alias("query_block"), F.col("blob").alias("query_blob"))
    pairs = each.join(index.select(F.col("block").alias("at"), "blob"), "at").repartition(max(1, min(n_rows * n_queries, MOST_TASKS)), "at", "query_block").select("query_block", "blob", "query_blob")

    def run(batches):
        for batch in batches:
            for query_block, blob, queries in zip(*batch.columns, strict=True):
                block = Index.from_blob(blob.as_py())
                ids, values = from_query_blob(queries.as_py())
                out: list[list[int]] = [[], [], [], [], []]
                for number, (own, query) in enumerate(zip(ids, values, strict=True)):
                    found, scores = block.top(query, int(own), k)
                    for column, some in zip(out, ([query_block.as_py()] * len(found), [number] * len(found), [int(own)] * len(found), found, [str(x) for x in scores]), strict=True):
                        column += some
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["query_block", "number", "query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_block long, number long, query_id long, vec_id long, score string")
    # as text in order of size: sign, number of digits, digits; exact whatever the size
    text = F.col("score")
    digits, below = F.ltrim(text, F.lit("-")), text.startswith("-")
    sign = F.when(below, -1).otherwise(1)
    order = Window.partitionBy("query_block", "number").orderBy(sign.desc(), (sign * F.length(digits)).desc(), F.when(~below, digits).desc(), digits, "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.coalesce(text.try_cast("long"), F.when(below, LONG.min).otherwise(LONG.max)).alias("score"))
