"""Byte-level BPE encoding and decoding.

Encoding splits a text at special tokens, cuts the rest with the byte-level pattern, and merges each
piece by a priority queue of merge ranks over a doubly linked list of symbols; an entry whose symbols
have changed since it was pushed is stale and skipped. Decoding concatenates vocabulary strings.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ''. Other columns
pass through; ``ids``/``decoded`` replace columns of those names. Rows are independent, so ties, repeated
rows and empty tables need no rule. Whole texts are encoded; a piece of any length takes O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokeniser's pattern (a fixed value); white space is spelt out as the Unicode property.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Most pieces kept per Python worker, and the longest that is kept.
CACHE_PIECES, CACHE_LENGTH = 120_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, as letter -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Piece -> its ids as little-endian 32-bit numbers, worked out on the first look-up.

    Bounded by two generations: when this one is full it becomes the old one, from which pieces that are
    met again come back; so frequent pieces stay.
    """

    def __init__(self, merge):
        super().__init__()
        self.merge = merge
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.merge(piece.encode())).tobytes()
            if len(piece) > CACHE_LENGTH:
                return ids
        if len(self) >= CACHE_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary given as the text of its JSON file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: raw(s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.byte_ids = [0] * 256
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[a], vocab[b]), rank)
            self.made.append(vocab[a + b])
        self.find = regex.compile(PIECE).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda s: [s]
        self.kept = Pieces(self.merge)

    def forget(self) -> None:
        """Let the pieces met so far go."""
        self.kept = Pieces(self.merge)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge one piece: lowest rank first, leftmost first among equals.

        A queue entry is rank and place in one number; it is stale if the pair at its place has another rank.
        """
        n = len(piece)
        if n == 1:
            return (self.byte_ids[piece[0]],)
        ids = [self.byte_ids[b] for b in piece]
        rank_of, made, push = self.ranks.get, self.made, heapq.heappush
        queue = [(r << 40) + i for i, r in enumerate(map(rank_of, zip(ids, ids[1:], strict=False))) if r is not None]
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if j == n or ids[i] < 0 or rank_of((ids[i], ids[j])) != entry >> 40:
                continue  # stale
            new = ids[i] = made[entry >> 40]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((new, ids[k]))) is not None:
                    push(queue, (r << 40) + i)
            h = before[i]
            if h >= 0 and (r := rank_of((ids[h], new))) is not None:
                push(queue, (r << 40) + h)
        return tuple([x for x in ids if x >= 0])

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for part in self.cut(text or ""):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += map(self.kept.__getitem__, self.find(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(spec) -> Bpe:
    """One coder per Python worker and vocabulary. spec: a broadcast of the JSON text."""
    text = spec.value
    key = hashlib.sha1(text.encode()).hexdigest() if len(_loaded) else ""
    if key not in _loaded:
        key = hashlib.sha1(text.encode()).hexdigest()
        if key not in _loaded:
            _loaded[key] = Bpe(text)
    return _loaded[key]


def share_vocabulary(spark: SparkSession, path: str):
    """Broadcast a vocabulary file read on the driver; its size is fixed by the file (1.5 MB), not by the data."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError("a vocabulary file of over 64 MB is not broadcast")
    return spark.sparkContext.broadcast(text)


def _map(df: DataFrame, added: list[tuple[str, T.DataType]], source: str, make) -> DataFrame:
    """df with columns computed from another in Arrow batches, a slice of rows at a time."""
    text = df.columns.index(source)
    kept = [i for i, c in enumerate(df.columns) if c not in {n for n, _ in added}]
    names = [*(df.columns[i] for i in kept), *(n for n, _ in added)]
    # inside, columns go by position, so that none of their names can clash
    inside = T.StructType([T.StructField(f"c{i}", df.schema.fields[i].dataType) for i in kept] + [T.StructField(f"a{i}", t) for i, (_, t) in enumerate(added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            one = make()
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *one(part.column(text))], names=inside.names)
        finally:
            for coder in _loaded.values():  # an idle worker holds vocabularies, which have a fixed size, and no pieces
                coder.forget()

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, inside).toDF(*names)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with ``ids`` array<int>: the whole text encoded with the vocabulary file at that path.

    With ``decoded``, a column of that name has the text decoded from the ids, in the same pass.
    """
    spec = share_vocabulary(df.sparkSession, vocabulary)

    def make():
        coder = loaded(spec)

        def one(col):
            packed = [coder.packed(x) for x in col.to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            if decoded:
                out.append(pa.array([coder.decode(array("i", p)) for p in packed], pa.string()))
            return out

        return one

    added = [(ids, T.ArrayType(T.IntegerType())), *([(decoded, T.StringType())] if decoded else [])]
    return _map(df, added, text, make)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with ``decoded`` string: the vocabulary strings of ``ids`` concatenated; null ids give ''."""
    spec = share_vocabulary(df.sparkSession, vocabulary)

    def make():
        coder = loaded(spec)

        def one(col):
            ends = col.offsets.to_numpy() - col.offsets[0].as_py()  # a slice's values start at its first offset
            flat = col.values.slice(col.offsets[0].as_py(), int(ends[-1])).to_numpy(zero_copy_only=False).tolist()
            return [pa.array([coder.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())]

        return one

    return _map(df, [(text, T.StringType())], ids, make)
