"""Quality rules: a logistic regression over hashed word and character n-grams, trained on labelled rows,
calibrated on rows it wasn't trained on, and scored in Arrow batches against a fixed threshold, beside
plain counts with fixed limits.

Features are the L1-normalised counts of hashed words, word pairs and byte 4-grams; a pair of equal words
has a bucket of its own. The fit uses at most ``sample`` labelled documents, those of the smallest hash of
their id, one row an id: a documented bound; a third of them calibrate (Platt), the rest train. Hashing bounds what a
text of any length adds to the fit: 3 x 2**BITS features, each a bucket and a share.

Defined results: a null text counts as empty and has no words, so it fails the base rule; repeated rows
are judged alike; labels of one class or none give every document that class's smoothed share; an empty
table gives no rows. Whole texts are scored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gneiss.llm.common import map_text

SAMPLE, BITS, THRESHOLD = 2000, 17, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
WORDS, PAIRS, CHARS = 0, 1, 2  # the feature blocks


@dataclass
class Model:
    weights: np.ndarray  # float32, a block of 2**BITS for each kind of feature
    bias: float
    slope: float
    shift: float

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Ids of the words in order of first appearance, and the distinct words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids, list(seen)


def hashed(data: bytes, ids: np.ndarray, distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed features of a text, block by block: words, pairs, byte 4-grams."""
    of = np.fromiter(map(zlib.crc32, distinct), np.uint64, len(distinct))
    mask = np.uint64((1 << BITS) - 1)
    w = of[ids] if len(ids) else np.zeros(0, np.uint64)
    p = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    p[w[:-1] == w[1:]] = 0
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    c = (a[:-3] | a[1:-2] << 8 | a[2:-1] << 16 | a[3:] << 24) if len(a) > 3 else np.zeros(0, np.uint32)
    c = (c * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return (w & mask).astype(np.int64), p.astype(np.int64), c.astype(np.int64)


def margin(model: Model, parts) -> float:
    total = model.bias
    for block, h in enumerate(parts):
        if len(h):
            total += float(model.weights[block << BITS :][: 1 << BITS].take(h).mean(dtype=np.float64))
    return total


def base_counts(text: str, data: bytes, words: list[bytes], ids: np.ndarray, n_distinct: int) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    n = len(words)
    chars = len(text) - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n >= 3:
        if n_distinct < 1 << 20:
            key = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
        else:
            _, pair = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)
            key = pair[:-1].astype(np.int64) * n_distinct + ids[2:]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = times[back] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeat = int(covered.sum())
    return chars, symbols, dup, repeat


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """place, quality, features and counts of each sampled document."""
    place = F.xxhash64("doc_id")
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.select("doc_id", "quality", place.alias("place")).orderBy("place", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = F.min_by(F.struct("place", "quality", "text"), F.struct(F.xxhash64("text"), "text"))
    texts = texts.groupBy("doc_id").agg(one.alias("one")).select("one.*")

    def make():
        def one(texts):
            out_h, out_n = [], []
            for text in texts:
                data = (text or "").encode()
                ids, distinct = word_ids(data.split())
                parts = hashed(data, ids, distinct)
                found = [np.unique(h + (block << BITS), return_counts=True) for block, h in enumerate(parts)]
                out_h.append(np.concatenate([f[0] for f in found]).astype(np.int32))
                out_n.append(np.concatenate([f[1] / max(1, len(h)) for f, h in zip(found, parts, strict=True)]).astype(np.float32))
            return out_h, out_n

        return one

    return map_text(texts, "text", ["place", "quality"], [("features", "array<int>"), ("counts", "array<float>")], make, 64)


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Quality and number of features of each document, in order of place, and all features and counts end to end."""
    table = table.append_column("n", pc.list_value_length(table["features"])).sort_by([("place", "ascending"), ("n", "ascending")]).combine_chunks()
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy()
    return table["quality"].to_numpy(), table["n"].to_numpy(), flat("features"), flat("counts")


def sample_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return unpacked(sampled(docs, labels, sample).toArrow())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 150) -> Model:
    """Train on two of three sampled documents, calibrate on the third, in one task: the driver gets the weights only."""
    some = sampled(docs, labels, sample)
    kinds = to_arrow_schema(some.schema)

    def run(batches):
        batches = list(batches)  # at most ``sample`` rows
        model = trained(*unpacked(pa.Table.from_batches(batches) if batches else kinds.empty_table()), rounds)
        yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "slope": model.slope, "shift": model.shift}])

    one = some.repartition(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").first()
    if one is None:  # no document is labelled
        return trained(*unpacked(kinds.empty_table()), rounds)
    return Model(np.frombuffer(one.weights, np.float32), one.bias, one.slope, one.shift)


def trained(quality: np.ndarray, n: np.ndarray, features: np.ndarray, counts: np.ndarray, rounds: int) -> Model:
    size = 3 << BITS
    good = int(quality.sum())
    if good in (0, len(quality)):
        share = (good + 1) / (len(quality) + 2) if len(quality) else 0.9
        return Model(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    train = np.arange(len(quality)) % 3 > 0

    def matrix(some):
        mask = np.repeat(some, n)
        return features[mask], counts[mask] * np.float32(30), np.repeat(np.arange(some.sum(), dtype=np.int32), n[some]), quality[some].astype(np.float64)

    cols, vals, row, y = matrix(train)
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, rounds + 1):  # Adam on the balanced logistic loss
        z = np.bincount(row, w.astype(np.float32)[cols] * vals, len(y)) + bias
        g = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        gw, gb = np.bincount(cols, g.astype(np.float32)[row] * vals, size) + 1e-6 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.05 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.05 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    cols, vals, row, y = matrix(~train)
    z = np.bincount(row, w[cols] * vals, len(y)) + bias
    slope, shift = platt(z, y)
    return Model((w * 30).astype(np.float32), float(bias), slope, shift)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated log-odds, by Newton steps with smoothed aims."""
    n1, n0 = y.sum(), (1 - y).sum()
    aim = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.std(z)))
    x, theta = np.stack([z / scale, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (p - aim) + 1e-3 * theta
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(theta[0], 1e-3) / scale), float(theta[1])


def verdict(text: str | None, model: Model, threshold: float = THRESHOLD) -> tuple:
    """n_words, the base counts, base_failed, probability and kept of a text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    ids, distinct = word_ids(words)
    counts = base_counts(text, data, words, ids, len(distinct))
    failed = len(words) < MIN_WORDS or 100 * counts[3] > MAX_REPEAT_PERCENT * len(words)
    good = model.probability(margin(model, hashed(data, ids, distinct)))
    return len(words), *counts, failed, good, not failed and good >= threshold


def judge(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns with n_words, the base counts, base_failed, probability and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats a block, whatever the data

    def make():
        model = shared.value
        return lambda texts: list(zip(*(verdict(t, model, threshold) for t in texts), strict=True)) if texts else [[]] * 8

    fields = [(c, "long") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return map_text(docs, "text", keep, [*fields, ("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")], make)


def passing(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, all columns as they are, whatever their names."""
    shared, at_text, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns
    placed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))

    def run(batches):
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([verdict(t, model, threshold)[-1] for t in part.column(at_text).to_pylist()], pa.bool_()))

    return placed.mapInArrow(run, placed.schema).toDF(*columns)
