"""Fill-in-middle transformation: documents become prefix, suffix and middle around markers.

A document is cut at two ranks, counted in units; a unit ends wherever a predicate holds for two adjacent
characters. The text is taken in chunks that overlap by one character, so each pair of neighbours stands in
one chunk and chunks are counted by themselves, whatever the others hold. Prefix sums of the counts give the
number of units and route either cut to the chunk that owns it; only that chunk is scanned again for the
place. All of it happens within the row: nothing is shuffled, a document's chunks are an array of counts.

Which documents are cut, where and in which form follows from a hash of seed and id, so reruns agree.

Defined results: a null text counts as empty; an empty text, one that holds a marker already, and one the
rate leaves out stay plain; a null id hashes as the word null; rows that repeat an id and a text give equal
rows; an id with several texts is cut at ranks that each text's length decides; an empty table gives no
rows; of other columns only the kept ones pass through, named as they are, and new ones never overwrite them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle; percent of documents that are cut; percent of those in suffix-prefix-middle form.
MARKERS, RATE, SPM_RATE, SEED = ("<P>", "<S>", "<M>"), 90, 20, 1
#: Characters of a chunk, without the one that overlaps.
CHUNK = 1 << 12

#: Whether a unit ends between two adjacent characters, given as arrays of code points.
Predicate = Callable[[np.ndarray, np.ndarray], np.ndarray]


def every_character(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Units are code points."""
    return np.ones(len(left), bool)


def word_starts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Units are words with the blanks after them; blanks are the space and the controls 9 to 13."""
    blank = lambda c: (c == 32) | ((c >= 9) & (c <= 13))
    return blank(left) & ~blank(right)


def line_starts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Units are lines with their newline."""
    return left == 10


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def chunk_sums(text: str, ends: Predicate, chunk: int) -> list[int]:
    """0, then how many units end up to each chunk's end; the last unit, which the text's end closes, isn't counted."""
    # a chunk of characters a..b has the boundaries after a..b-1, so it overlaps with the next one by one character
    each = [np.count_nonzero(ends(c[:-1], c[1:])) for c in (codes(text[a : a + chunk + 1]) for a in range(0, len(text), chunk))]
    return [0, *np.cumsum(each, dtype=np.int64).tolist()]


def place_in(piece: str, rank: int, ends: Predicate) -> int:
    """Characters up to the rank-th unit's end in one chunk."""
    c = codes(piece)
    return int(np.flatnonzero(ends(c[:-1], c[1:]))[rank - 1]) + 1


def summed(text: Column, ends: Predicate, chunk: int) -> Column:
    """array<long>: prefix sums of the counts of a text's chunks."""

    @F.pandas_udf("array<long>")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_sums(t, ends, chunk) for t in texts], dtype=object)

    return count(text)


def placed(piece: Column, rank: Column, ends: Predicate) -> Column:
    """long: characters up to the rank-th unit's end in the owning chunk; null where there is no chunk."""

    @F.pandas_udf("long")
    def place(pieces: pd.Series, ranks: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else place_in(p, int(r), ends) for p, r in zip(pieces, ranks, strict=True)], dtype="Int64")

    return place(piece, rank)


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers must be told apart wherever they meet text: none may begin with what another one, or itself, ends with."""
    for i, a in enumerate(markers):
        for j, b in enumerate(markers):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"markers {a!r} and {b!r} can't be told apart")


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), ends: Predicate = every_character, markers: tuple[str, str, str] = MARKERS,
    rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED, chunk: int = CHUNK,
) -> DataFrame:
    """The kept columns, then n (units), form (plain, psm or spm), prefix_units, middle_units, prefix_chars, middle_chars and output.

    Counts of units and characters are null for plain rows. Kept columns must not have the names of new ones.
    """
    check_markers(markers)
    new = {"n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"}
    if clash := new & set(keep):
        raise ValueError(f"kept columns clash with new ones: {sorted(clash)}")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), *(x.alias(f"h{i + 1}") for i, x in enumerate(h)))
    plain = (F.col("t") == "") | F.contains(F.col("t"), F.lit(markers[0])) | F.contains(F.col("t"), F.lit(markers[1])) | F.contains(F.col("t"), F.lit(markers[2])) | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    rows = rows.withColumn("sums", summed(F.col("t"), ends, chunk))
    rows = rows.withColumn("n", F.element_at("sums", -1) + (F.col("t") != "").cast("long"))
    cuts = [F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)]
    cut = F.col("form") != "plain"
    rows = rows.withColumns({"low": F.when(cut, F.least(*cuts)), "high": F.when(cut, F.greatest(*cuts))})
    for name in ("low", "high"):
        # the owner is the first chunk up to whose end the rank is reached; ranks 0 and n need none
        rank = F.col(name)
        owner = F.size(F.filter("sums", lambda s: s < rank)) - 1  # noqa: B023  called at once
        rows = rows.withColumn(f"{name}_owner", F.when((rank > 0) & (rank < F.col("n")), owner))
    found = {}
    for name in ("low", "high"):
        owner = F.col(f"{name}_owner")
        piece = F.substring("t", owner * chunk + 1, F.lit(chunk + 1))
        inside = owner.cast("long") * chunk + placed(piece, F.coalesce(F.col(name) - F.get("sums", owner), F.lit(0)), ends)
        found[f"{name}_at"] = F.when(F.col(name) == 0, F.lit(0).cast("long")).when(F.col(name) == F.col("n"), F.length("t").cast("long")).otherwise(inside)
    rows = rows.withColumns(found)
    part = {
        "prefix": F.substring("t", F.lit(1), F.col("low_at").cast("int")),
        "middle": F.substring("t", F.col("low_at").cast("int") + 1, (F.col("high_at") - F.col("low_at")).cast("int")),
        "suffix": F.substring("t", F.col("high_at").cast("int") + 1, F.length("t")),
    }
    p, s, m = map(F.lit, markers)
    output = F.when(~cut, F.col("t")).when(F.col("form") == "psm", F.concat(p, part["prefix"], s, part["suffix"], m, part["middle"])).otherwise(F.concat(s, part["suffix"], p, part["prefix"], m, part["middle"]))
    made = [
        F.col("n"), F.col("form"), F.col("low").alias("prefix_units"), (F.col("high") - F.col("low")).alias("middle_units"),
        F.col("low_at").alias("prefix_chars"), (F.col("high_at") - F.col("low_at")).alias("middle_chars"), output.alias("output"),
    ]
    return rows.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *made)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text, from output and form alone: what lies between the markers, put back in order."""
    at = lambda marker: F.locate(marker, output) - 1  # noqa: E731  characters before the first place
    size = {x: len(x) for x in markers}
    p, s, m = markers
    between = lambda a, b: F.substring(output, at(a) + size[a] + 1, at(b) - at(a) - size[a])
    middle = F.substring(output, at(m) + size[m] + 1, F.length(output))
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
