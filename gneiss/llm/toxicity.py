"""Toxicity: a lexicon trie learnt from labelled rows, intersected with Levenshtein automata to catch
misspelled terms; windows around the hits separate quotation from abuse.

Learning counts, for every prefix of a word in a bounded sample of labelled documents, how many toxic
and clean documents have it. A prefix that is nearly always toxic is followed down the trie while nearly
all its documents agree on the next letter: where they agree to the end it is a term, else a stem that
matches any word it begins. A logistic regression on the hit counts of the same sample gives the score.

Matching runs one automaton: its states are sets of (trie node, errors), determinised as they are met,
so a word costs a dictionary look-up per letter, and most words leave the automaton early.

Defined results: a null or empty text has no hits and scores the model's floor; repeated rows score
alike; no labels, or labels of one class, give an empty lexicon and a score below 0.5; an empty table
gives no rows. Whole texts are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import map_text, write_shared

#: At most so many labelled documents are learnt from; a prefix needs LEAST toxic ones, and SHARE of all of them.
SAMPLE, LEAST, SHARE = 6000, 3, 0.02
#: Letters of the longest stem that fit() learns, a parameter: a word of n letters has n stems. Whole words are learnt at any length.
DEPTH = 64
TOKEN = re.compile(r"[^\W_]+")
LEET = str.maketrans("013457", "oieast")
QUOTES = "\"'“”„«»‘’`"
REPORTING = frozenset((
    "said", "says", "called", "quote", "quoted", "quotes", "word", "term", "wrote", "writes", "insult", "slur",
    "sagt", "sagte", "nannte", "zitat", "zitiert", "wort", "begriff", "schrieb", "beleidigung",
    "dit", "disait", "citation", "cite", "mot", "terme", "insulte",
    "dice", "dijo", "cita", "citado", "palabra", "término", "escribió", "insulto",
))
WINDOW_CHARS, WINDOW_WORDS = 48, 5


def errors_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Lexicon:
    """Terms (whole words) and stems (beginnings of words), as a trie with a determinised fuzzy matcher."""

    terms: list[tuple[str, bool]]  # (letters, is a stem)
    child: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[tuple[int, bool] | None] = field(default_factory=lambda: [None])
    reach: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for letters, stem in self.terms:
            node, most = 0, errors_allowed(len(letters))
            self.reach[0] = max(self.reach[0], most)
            for c in letters:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                    self.reach.append(0)
                node = self.child[node][c]
                self.reach[node] = max(self.reach[node], most)
            self.ends[node] = (most, stem or bool(self.ends[node] and self.ends[node][1]))
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.stem_at: list[int] = []
        self.word_at: list[int] = []
        self.moves: list[dict[str, int]] = []
        self.dead = self.state({})
        self.start = self.state({0: 0})

    def state(self, found: dict[int, int]) -> int:
        """The number of a state: the fewest errors at each node, closed over skipped letters of the lexicon."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if found.get(node, 9) < e:
                continue
            for nxt in self.child[node].values():
                if e + 1 <= self.reach[nxt] and e + 1 < found.get(nxt, 9):
                    found[nxt] = e + 1
                    todo.append((nxt, e + 1))
        key = frozenset(found.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(found)
            best = {True: 9, False: 9}
            for node, e in found.items():
                end = self.ends[node]
                if end and e <= end[0]:
                    best[end[1]] = min(best[end[1]], e)
            self.stem_at.append(best[True])
            self.word_at.append(min(best.values()))
            self.moves.append({})
        return self.states[key]

    def move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, e in self.sets[state].items():
            steps = [(n, e if x == c else e + 1) for x, n in self.child[node].items()]
            for nxt, errors in [*steps, (node, e + 1)]:
                if errors <= self.reach[nxt] and errors < found.get(nxt, 9):
                    found[nxt] = errors
        to = self.moves[state][c] = self.state(found)
        return to

    def match(self, word: str) -> int:
        """Fewest errors by which the word is a term or begins with a stem; 9 if none."""
        state, best, moves = self.start, 9, self.moves
        for c in word:
            nxt = moves[state].get(c)
            state = self.move(state, c) if nxt is None else nxt
            if state == self.dead:
                return best
            if self.stem_at[state] < best:
                best = self.stem_at[state]
                if best == 0:
                    return 0
        return min(best, self.word_at[state])


def tokens(text: str):
    return TOKEN.finditer(text.lower())


def plain(word: str) -> str:
    return word.translate(LEET) if not word.isalpha() and not word.isdigit() else word


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands in quotation marks, or after a word of reporting, within the window."""
    before, after = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
    opened = any(before.count(q) % 2 for q in QUOTES) and any(q in after for q in QUOTES)
    return opened or any(w.lower() in REPORTING for w in TOKEN.findall(before)[-WINDOW_WORDS:])


def features(text: str, lexicon: Lexicon, known: dict[str, int]) -> list[float]:
    """exact, near and quoted hits (log counts), hits per hundred words, and whether two hits are exact.

    One hit may be a chance likeness; two of them seldom are.
    """
    low, hits, n = text.lower(), Counter(), 0
    words = TOKEN.findall(low)
    suspects = {}
    for w in set(words):
        e = known.get(w)
        if e is None:
            e = lexicon.match(plain(w))
            if len(known) > 500_000:
                known.clear()
            known[w] = e
        if e < 9:
            suspects[w] = e
    if suspects:
        for m in TOKEN.finditer(low):
            if m[0] in suspects:
                n += 1
                hits["quoted" if quoted(low, *m.span()) else "near" if suspects[m[0]] else "exact"] += 1
    return [np.log1p(hits["exact"]), np.log1p(hits["near"]), np.log1p(hits["quoted"]), min(3.0, 100 * (hits["exact"] + hits["near"]) / max(1, len(words))), float(hits["exact"] > 1)]


@dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]
    bias: float

    def score(self, x: list[float]) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.weights, x, strict=True))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: the CRC-32 of its id as text is divisible by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_terms(sample: DataFrame, depth: int = DEPTH) -> list[tuple[str, bool]]:
    """Terms of any length, and stems of up to ``depth`` letters, from a bounded sample (toxic, text)."""

    def count(batches):
        import pyarrow as pa

        toxic, clean, seen = Counter(), Counter(), [0, 0]
        for batch in batches:
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                some = set()
                for w in {plain(m[0]) for m in tokens(text or "")}:
                    if w.isalpha():
                        some.update(w[:k] for k in range(3, min(len(w), depth) + 1))
                        some.add(w + "$")
                seen[t] += 1
                (toxic if t else clean).update(some)
        keys = ["", *(toxic.keys() | clean.keys())]
        toxic[""], clean[""] = seen[1], seen[0]
        for at in range(0, len(keys), 10_000):
            part = keys[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], names=["prefix", "toxic", "clean"])

    counts = sample.select("toxic", "text").mapInArrow(count, "prefix string, toxic long, clean long").groupBy("prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = write_shared(counts, "prefixes")
    seen = counts.filter("prefix = ''").first()
    n_toxic, n_clean = (seen["toxic"], seen["clean"]) if seen else (0, 0)
    # only prefixes that can be chosen, or name one that is, reach the driver: each is in SHARE of the toxic sample, so few are
    least = max(LEAST, 0.95 * SHARE * n_toxic)
    likely = counts.filter(f"prefix <> '' AND toxic >= {least} AND clean * 4 <= toxic").collect()
    of = {r["prefix"]: (r["toxic"], r["clean"]) for r in likely}
    if not n_toxic or not n_clean:
        return []
    return choose_terms(of, n_toxic, n_clean)


def choose_terms(of: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """From prefix -> (toxic, clean) documents, the terms and stems that tell most.

    A prefix tells by its likelihood ratio against the overall share. The best is taken, what lies above
    and below it in the trie is not, and so on; of prefixes with the same documents the longest is best.
    """
    share, least = n_toxic / (n_toxic + n_clean), max(LEAST, SHARE * n_toxic)

    def tells(p: str) -> float:
        t, c = of[p]
        rate = t / (t + c)
        if t < least or rate < 2 * share or rate < 0.5:
            return 0.0
        return t * np.log(rate / share) + (c * np.log((1 - rate) / (1 - share)) if c else 0.0)

    scored = sorted(((tells(p), len(p), p) for p in of), key=lambda x: (-round(x[0], 6), -x[1], x[2]))
    found: list[tuple[str, bool]] = []
    above: set[str] = set()
    chosen: set[str] = set()
    for value, _, p in scored:
        if value < 6:
            break
        if p in above or any(p[:k] in chosen for k in range(3, len(p) + 1)):
            continue
        best = max((q for q in of if q != p and q.startswith(p) and of[q][0] >= 0.95 * of[p][0] and of[q][1] <= of[p][1]), key=lambda q: (len(q), q), default=p)
        chosen.add(p)
        above.update(p[:k] for k in range(3, len(p)))
        found.append((best.rstrip("$"), best[-1] != "$"))
    return sorted(set(found))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 400, depth: int = DEPTH) -> Model:
    """Learn from at most ``sample`` labelled documents that aren't held out, those of the smallest hash; one row an id."""
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    some = write_shared(some.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text"), F.struct(F.xxhash64("text"), "text")).alias("one")).select("one.*"), "toxic-sample")
    terms = learn_terms(some, depth)
    rows = map_text(some, "text", ["toxic"], [("x", "array<double>")], _scorer(terms)).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["toxic"], r["x"]))
    y = np.array([r["toxic"] for r in rows], float)
    if not terms or y.sum() in (0, len(y)):
        return Model(terms, [0.0] * 5, -2.0)
    x = np.array([r["x"] for r in rows])
    w, aim = np.zeros(x.shape[1] + 1), y
    x1 = np.c_[x, np.ones(len(x))]
    weight = np.full(len(y), 1 / len(y))
    for _ in range(rounds):  # damped Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (weight * (p - aim)) + 1e-4 * w
        hess = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return Model(terms, [float(a) for a in w[:-1]], float(w[-1]))


def _scorer(terms):
    def make():
        lexicon, known = Lexicon(terms), {}
        return lambda texts: [[features(t or "", lexicon, known) for t in texts]]

    return make


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns with score and the numbers of exact, near and quoted hits as ``hits``.

    A kept column of one of these names gives way to the new one.
    """
    keep = [c for c in keep if c not in ("score", "hits")]

    def make():
        lexicon, known = Lexicon(model.terms), {}

        def one(texts):
            x = [features(t or "", lexicon, known) for t in texts]
            return [[model.score(v) for v in x], x]

        return one

    return map_text(docs, "text", keep, [("score", "double"), ("hits", "array<double>")], make)
