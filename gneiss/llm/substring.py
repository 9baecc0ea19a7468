"""Substring dedup: suffix automata of reference shards, documents streamed for matching statistics.

Every word that a window of ``span`` words covers is removed if the window's words also start in a
document with a smaller id; windows are judged on the input. The reference is the corpus itself, so its
automata aren't broadcast: they would grow with the data. Instead, both sides are dealt to shards by
content, so that equal windows always meet:

1. Documents are dealt to blocks of some MB. A window's anchor is the least hash among its 7-grams, so
   equal windows have equal anchors. Each block sends its different anchors (8 bytes each, one in four
   words) to shards, which answer with those that other blocks or documents also have.
2. Blocks send the runs of windows around such anchors, each different run once with its smallest id and a
   number.
   In its shard, the runs of an anchor are a reference shard: streamed in order of id through a suffix
   automaton of words, whose states know the first document they occurred in, each gets its matching
   statistics; where ``span`` or more words match, the first document of the window is known. A run
   that isn't wholly matched extends the automaton.
3. Blocks get the first documents of numbered runs back and remove the maximal spans they cover.

Anchors of more than ``hot`` blocks or documents are dealt by whole windows instead of by anchor, so a
passage that a third of all documents share is one entry per block and its surroundings spread evenly.
Nothing is capped or sampled. Hashes only decide what meets where: runs of a block are one where all their
words are equal, runs of a shard where their texts are, and the automaton's steps are whole words.

Defined results: a null text has no words; a null id neither loses words nor takes any from others, so such
rows are only counted and joined, wherever they lie; rows that repeat an id don't take from each other; a text shorter than a window loses nothing; an empty table
gives no rows; other columns are ignored. Whole texts are processed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import WORD

SPAN, GRAM, BLOCK_BYTES, SHARD_BYTES, HOT = 13, 7, 2 << 20, 4 << 20, 200
#: Words that are compared at once.
WORDS = 1 << 17
NONE = np.iinfo(np.int64).max
P, Q, R = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * Q
    x = x ^ (x >> np.uint64(29))
    x = x * P
    return x ^ (x >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        grow = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)])
        have = _powers[int(base)] = grow(base), grow(inverse)
    return have[0][:n], have[1][:n]


def range_hashes(values: np.ndarray, base: np.uint64, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of values[first:after] for each range, the same wherever the range stands."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[after] - sums[first]) * down[first] + (after - first).astype(np.uint64))


def numbered(values: list[bytes]) -> dict[bytes, int]:
    """A number for each different value."""
    different = dict.fromkeys(values)
    return dict(zip(different, range(len(different)), strict=True))


def is_in(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted s."""
    return s[np.minimum(np.searchsorted(s, x), len(s) - 1)] == x if len(s) else np.zeros(len(x), bool)


def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of these sizes end to end: the range that each element is of, and its place in it."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Block:
    """The words of a block's documents end to end, the windows inside documents, and their runs by anchor."""

    def __init__(self, ids: list[int | None], texts: list[str | None], span: int = SPAN):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids, self.span = [ids[i] for i in order], span
        raw = [(texts[i] or "").encode() for i in order]
        self.data = b"\n".join(raw)
        a = np.frombuffer(self.data, np.uint8)
        word = ~SEPARATOR[a]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.n = len(self.start)
        opened = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1] if raw else np.zeros(0, np.int64)
        self.doc = np.searchsorted(opened, self.start, "right") - 1  # of each word
        self.doc_ids = np.array([NONE if i is None else i for i in self.ids], np.int64)
        self.bytes = a
        self.words = range_hashes(a.astype(np.uint64) + np.uint64(1), P, self.start, self.end)
        self.runs()

    def runs(self) -> None:
        span, gram = self.span, min(GRAM, self.span)
        n = self.n - span + 1
        if n <= 0:
            self.first = self.last = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.uint64)
            return
        at = np.arange(self.n - gram + 1)
        grams = range_hashes(self.words, R, at, at + gram)
        least = grams[:n].copy()
        for k in range(1, span - gram + 1):
            np.minimum(least, grams[k : n + k], out=least)
        inside = (self.doc[:n] == self.doc[span - 1 :]) & (self.doc_ids[self.doc[:n]] != NONE)
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (self.doc[1:n] != self.doc[: n - 1]) | ~inside[:-1]])
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [n]])
        # a run ends where its windows leave the document
        whole = np.concatenate([[0], np.cumsum(inside)])
        tails = heads + (whole[tails] - whole[heads])
        some = tails > heads
        self.first, self.last = heads[some], tails[some]  # windows first <= i < last
        self.anchor = least[self.first]
        self.hash = range_hashes(self.words, R, self.first, self.last + span - 1)

    def differing(self, first: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of those pairs of ranges of so many words whose words differ, letter by letter."""
        pair, step = spread(size)
        a, b = first[pair] + step, other[pair] + step
        length = self.end[a] - self.start[a]
        differ = length != self.end[b] - self.start[b]
        pair_of, a, b, length = pair[~differ], self.start[a[~differ]], self.start[b[~differ]], length[~differ]
        word, letter = spread(length)
        unlike = self.bytes[a[word] + letter] != self.bytes[b[word] + letter]
        return np.unique(np.concatenate([pair[differ], pair_of[word[unlike]]]))

    def classes(self, first: np.ndarray, after: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """For each range of words the place of the first range with the same words; hashes only bring them together."""
        size = after - first
        order = np.lexsort((size, hashes))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (size[order][1:] != size[order][:-1])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
        out = np.empty(len(order), np.int64)
        out[order] = head
        other = np.flatnonzero(out != np.arange(len(out)))
        upto = np.cumsum(size[other])
        cuts = np.searchsorted(upto, np.arange(0, int(upto[-1]) + WORDS, WORDS)) if len(other) else [0]
        wrong = np.concatenate([np.zeros(0, np.int64), *(at + self.differing(first[other[at:to]], first[out[other[at:to]]], size[other[at:to]]) for at, to in zip(cuts, [*cuts[1:], len(other)], strict=True) if to > at)])
        if len(wrong):  # ranges that share a hash but not their words
            clash = np.isin(out, np.unique(out[other[wrong]]))
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(clash).tolist():
                out[i] = seen.setdefault(self.text(first[i], after[i]), i)
        return out

    def exploded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows of the chosen runs as (window, hash)."""
        size = (self.last - self.first)[which]
        begin = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(which) else np.zeros(0, np.int64)
        windows = begin + np.arange(int(size.sum()))
        return windows, range_hashes(self.words, R, windows, windows + self.span) if len(windows) else np.zeros(0, np.uint64)

    def text(self, first: int, after: int) -> bytes:
        """Words first <= i < after, joined by one space."""
        return b" ".join(self.data[self.start[first] : self.end[after - 1]].split())


class Automaton:
    """A suffix automaton of several word sequences; each state knows the first document it occurred in."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [NONE]

    def firsts(self, words: list[bytes], span: int) -> tuple[list[int], bool]:
        """For each window the first document it occurs in (NONE: none), and whether all words match as one."""
        state, length, out = 0, 0, []
        nxt, link, lengths = self.next, self.link, self.length
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                length = lengths[state]
            if w in nxt[state]:
                state, length = nxt[state][w], length + 1
            if i >= span - 1:
                if length < span:
                    out.append(NONE)
                else:
                    s = state
                    while lengths[link[s]] >= span:
                        s = link[s]
                    out.append(self.first[s])
        return out, length == len(words)

    def state(self, length: int, link: int, follow: dict[bytes, int], doc: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(doc)
        return len(self.link) - 1

    def split(self, p: int, w: bytes, q: int) -> int:
        """The state of the strings of q that p reaches by w."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                last = self.split(last, w, self.next[last][w])
                continue
            new, p = self.state(self.length[last] + 1, 0, {}, doc), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self.split(p, w, self.next[p][w])
            last = new


def as_rows(shards: np.ndarray, columns: dict[str, np.ndarray]) -> dict[int, dict[str, bytes]]:
    """The columns' values of each shard that has any, packed; so rows never outnumber values."""
    order = np.argsort(shards, kind="stable")
    some, first = np.unique(shards[order], return_index=True)
    cuts = [*first.tolist(), len(order)]
    return {s: {k: v[order[cuts[i] : cuts[i + 1]]].tobytes() for k, v in columns.items()} for i, s in enumerate(some.tolist())}


def unpack(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and the row each is from."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.repeat(np.arange(len(parts)), sizes)


def _block_of(table: pa.Table, span: int) -> Block:
    return Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), span)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every document."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("b")).first()["b"]
    n_blocks = max(1, -(-total // block_bytes))
    n_shards = max(16, -(-total // SHARD_BYTES))
    block = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n_blocks)).cast("int")
    base = docs.filter(F.col(doc_id).isNotNull()).select(block.alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def anchors(table: pa.Table) -> pa.Table:
        """Each shard's anchors of a block, with the number of its documents that have each (at most 255)."""
        b = _block_of(table, span)
        pair = np.unique(np.stack([b.anchor, b.doc[b.first].astype(np.uint64)], 1), axis=0) if len(b.first) else np.zeros((0, 2), np.uint64)
        found, times = np.unique(pair[:, 0], return_counts=True)
        rows = as_rows((found % np.uint64(n_shards)).astype(np.int64), {"anchors": found, "times": np.minimum(times, 255).astype(np.uint8)})
        return pa.table({"shard": pa.array(list(rows), pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()), "anchors": pa.array([r["anchors"] for r in rows.values()], pa.binary()), "times": pa.array([r["times"] for r in rows.values()], pa.binary())})

    def shared(table: pa.Table) -> pa.Table:
        """For each block, which of its anchors more than one document has, and which are hot."""
        value, row = unpack(table.column("anchors"), np.uint64)
        times, _ = unpack(table.column("times"), np.uint8)
        _, back = np.unique(value, return_inverse=True)
        docs_with = np.bincount(back, times)
        keep, heat = docs_with[back] > 1, docs_with[back] > hot
        cold, warm = keep & ~heat, keep & heat
        cut = lambda mask: [value[mask][a:b].tobytes() for a, b in zip(*(np.searchsorted(row[mask], np.arange(table.num_rows) + k) for k in (0, 1)), strict=True)]
        return pa.table({"block": table.column("block"), "cold": pa.array(cut(cold), pa.binary()), "hot": pa.array(cut(warm), pa.binary())})

    def runs(table: pa.Table, answer: pa.Table) -> pa.Table:
        """Each shard's runs of a block around shared anchors: every different run once."""
        b = _block_of(table, span)
        cold, warm = (np.sort(unpack(answer.column(c), np.uint64)[0]) for c in ("cold", "hot"))
        which = np.flatnonzero(is_in(b.anchor, cold))
        windows, hashes = b.exploded(np.flatnonzero(is_in(b.anchor, warm)))
        first = np.concatenate([b.first[which], windows])
        after = np.concatenate([b.last[which], windows + 1]) + span - 1
        key, h = np.concatenate([b.anchor[which], hashes]), np.concatenate([b.hash[which], hashes])
        number = np.concatenate([which, len(b.first) + windows])  # of a run, or of a window beyond all runs
        docs_of = b.doc_ids[b.doc[first]]
        same = b.classes(first, after, h)
        low, high = docs_of.copy(), docs_of.copy()
        np.minimum.at(low, same, docs_of)
        np.maximum.at(high, same, docs_of)
        head = np.unique(same)
        first, after, key, number, low, high = (x[head] for x in (first, after, key, number, low, high))
        shard = (key % np.uint64(n_shards)).astype(np.int64)
        rows = as_rows(shard, {"key": key, "number": number.astype(np.int32), "low": low, "high": high, "words": (after - first).astype(np.int32)})
        order = np.argsort(shard, kind="stable")
        texts: dict[int, list[bytes]] = {s: [] for s in rows}
        for s, i in zip(shard[order].tolist(), order.tolist(), strict=True):
            texts[s].append(b.text(first[i], after[i]))
        columns = {c: pa.array([r[c] for r in rows.values()], pa.binary()) for c in ("key", "number", "low", "high", "words")}
        return pa.table({"shard": pa.array(list(rows), pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * len(rows), pa.int32()), **columns, "texts": pa.array([zstandard.compress(b"\n".join(t), 1) for t in texts.values()], pa.binary())})

    def matched(table: pa.Table) -> pa.Table:
        """The first document of every window of every run that some document of its block loses words to."""
        key, row = unpack(table.column("key"), np.uint64)
        number, _ = unpack(table.column("number"), np.int32)
        low, _ = unpack(table.column("low"), np.int64)
        high, _ = unpack(table.column("high"), np.int64)
        n_windows = unpack(table.column("words"), np.int32)[0].astype(np.int64) - span + 1
        texts = [t for x in table.column("texts") for t in zstandard.decompress(x.as_py()).split(b"\n")] if len(key) else []
        order = np.lexsort((low, key))
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        firsts: list[np.ndarray | None] = [None] * len(key)
        # an anchor with one run: its smallest id is the first document of all its windows
        numbers = numbered(texts)
        text = np.fromiter(map(numbers.__getitem__, texts), np.int64, len(texts))[order]
        inner = np.concatenate([[0], (text[1:] != text[:-1]) & (key[order][1:] == key[order][:-1])]) if len(key) else np.zeros(0)
        different = np.add.reduceat(inner, cuts[:-1]) if len(key) else inner
        for g in range(len(cuts) - 1):
            group = order[cuts[g] : cuts[g + 1]].tolist()
            if not different[g]:
                for i in group:
                    firsts[i] = np.full(n_windows[i], low[group[0]], np.int64)
                continue
            automaton, at = Automaton(), 0
            while at < len(group):  # all runs of a document are matched before any of them is added
                doc, upto, new = low[group[at]], at, []
                while upto < len(group) and low[group[upto]] == doc:
                    words = texts[group[upto]].split(b" ")
                    found, whole = automaton.firsts(words, span)
                    firsts[group[upto]] = np.minimum(np.array(found, np.int64), doc)
                    if not whole:
                        new.append(words)
                    upto += 1
                for words in new:
                    automaton.add(words, int(doc))
                at = upto
        lost = np.fromiter((f is not None and f.min() < high[i] for i, f in enumerate(firsts)), bool, len(key))
        blocks, out_h, out_n, out_f = [], [], [], []
        for r in range(table.num_rows):
            a, z = np.searchsorted(row, [r, r + 1])
            mine = a + np.flatnonzero(lost[a:z])
            if len(mine):
                blocks.append(table.column("block")[r].as_py())
                out_h.append(number[mine].tobytes())
                out_n.append(n_windows[mine].tobytes())
                out_f.append(np.concatenate([firsts[i] for i in mine.tolist()]).tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), "number": pa.array(out_h, pa.binary()), "n": pa.array(out_n, pa.binary()), "firsts": pa.array(out_f, pa.binary())})

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        """The documents of a block without the spans that occur in smaller documents."""
        b = _block_of(table, span)
        gone = np.zeros(b.n + 1, np.int64)
        if answer.num_rows:
            number, n, firsts = (unpack(answer.column(c), k)[0] for c, k in (("number", np.int32), ("n", np.int64), ("firsts", np.int64)))
            begin = np.cumsum(n) - n

            def remove(first: np.ndarray, size: np.ndarray, hashes: np.ndarray, told: np.ndarray, places: np.ndarray) -> None:
                """Mark the windows whose first document is smaller than their own, in the ranges equal to those at ``places``."""
                some = np.flatnonzero(is_in(hashes, np.sort(hashes[places])))
                first, size = first[some], size[some]
                same = b.classes(first, first + size + span - 1, hashes[some])
                of = np.full(len(first), -1, np.int64)
                of[same[np.searchsorted(some, places)]] = told
                hit = np.flatnonzero(of[same] >= 0)
                found, size = begin[of[same[hit]]], size[hit]
                shift = np.cumsum(size) - size
                each = np.arange(int(size.sum()))
                windows = np.repeat(first[hit] - shift, size) + each
                lost = firsts[np.repeat(found - shift, size) + each] < b.doc_ids[b.doc[windows]]
                np.add.at(gone, windows[lost], 1)
                np.add.at(gone, windows[lost] + span, -1)

            whole = number < len(b.first)
            remove(b.first, b.last - b.first, b.hash, np.flatnonzero(whole), number[whole])
            if not whole.all():
                windows, hashes = b.exploded(np.arange(len(b.first)))
                remove(windows, np.ones(len(windows), np.int64), hashes, np.flatnonzero(~whole), np.searchsorted(windows, number[~whole] - len(b.first)))
        covered = np.cumsum(gone)[: b.n] > 0
        edges = np.searchsorted(b.doc, np.arange(len(b.ids) + 1))
        n_words, n_removed = np.diff(edges), np.diff(np.concatenate([[0], np.cumsum(covered)])[edges])
        kept = []
        for d in range(len(b.ids)):
            a, z = edges[d], edges[d + 1]
            if a == z:
                kept.append("")
            elif not n_removed[d]:
                kept.append(b.text(a, z).decode())
            else:
                words = b.data[b.start[a] : b.end[z - 1]].split()
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~covered[a:z]).tolist()]).decode())
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    by_block = base.groupBy("block")
    sent = by_block.applyInArrow(anchors, "shard int, block int, anchors binary, times binary")
    answers = sent.groupBy("shard").applyInArrow(shared, "block int, cold binary, hot binary")
    found = by_block.cogroup(answers.groupBy("block")).applyInArrow(runs, "shard int, block int, key binary, number binary, low binary, high binary, words binary, texts binary")
    firsts = found.groupBy("shard").applyInArrow(matched, "block int, number binary, n binary, firsts binary")
    found = by_block.cogroup(firsts.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    unnamed = docs.filter(F.col(doc_id).isNull()).select(words.alias("w")).select(F.lit(None).cast("long").alias("doc_id"), F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("w", " ").alias("kept_text"))
    return found.unionByName(unnamed)
