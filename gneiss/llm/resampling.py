"""Target-distribution importance resampling over a position table of words.

Texts are exploded to a table of positions; for orders above one, lead() over each document concatenates the
words that follow. Runs are hashed to buckets and counted over all documents and over the target; a bucket's
gain is the logarithm of its smoothed share in the target over that in the documents. Gains are joined back
to the positions and summed per document, noise by the Gumbel method is added, and the best scores are drawn,
which samples without replacement by importance.

Nothing but one row per document and per bucket is shuffled where the order is one. The ranking is a range
sort: rows are counted per range, ranks follow from the ranges before.

Defined results: a null text has no words; a document without runs has weight 0; of several rows with one id
and text each is ranked, next to the others; equal scores go by id, nulls last, then by number of runs and a
hash of the text; a null id hashes as the word null; an empty table gives no rows, an empty target gains from
smoothing alone; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import write_shared

#: Runs of at most so many words; buckets; words that a drawn document has at least; percent drawn; scale of logarithms.
ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SCALE, SEED = 1, 10_000, 20, 10, 1000, 2024
#: Letters, digits and all beyond ASCII; words of the text as it is, A-Z are lower-cased in each word.
FEATURE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Buckets up to which their table is broadcast; beyond, positions are joined by shuffling.
BROADCAST_BUCKETS = 1_000_000
#: Documents of one range of the ranking, about.
RANGE_ROWS = 20_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def positions(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """The key, pos and word of every word; one row with null for a text without words."""
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(FEATURE_WORD), F.lit(0))
    table = docs.select(*key, F.posexplode_outer(found).alias("pos", "word"))
    # lower() knows all alphabets, so it is for words of ASCII alone; translate() is slow
    ascii_only = F.octet_length("word") == F.length("word")
    return table.withColumn("word", F.when(ascii_only, F.lower("word")).otherwise(F.translate("word", UPPER, LOWER)))


def runs(table: DataFrame, key: list[str], orders: int = ORDERS) -> DataFrame:
    """The position table with ``run``: every run of 1 to ``orders`` words that starts at a position, joined by one space."""
    if orders == 1:
        return table.withColumn("run", F.col("word"))
    after = Window.partitionBy(*key).orderBy("pos")
    ahead = [F.lead("word", k).over(after).alias(f"w{k}") for k in range(1, orders)]
    wide = table.select("*", *ahead)
    # a run that the text's end cuts short is null
    each = [F.col("word"), *(F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", "word", *(f"w{i}" for i in range(1, k + 1)))) for k in range(1, orders))]
    return wide.select(*table.columns, F.explode(F.array(*each)).alias("run"))


def bucket(run: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def counts(table: DataFrame, buckets: int, name: str) -> DataFrame:
    """bucket and how many runs fall into it, in all copies, for every bucket with one."""
    times = F.sum("copies") if "copies" in table.columns else F.count("*")
    return table.filter("run is not null").groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(times.alias(name))


def keyed(rows: DataFrame, key: list[str], orders: int) -> tuple[DataFrame, list[str]]:
    """Rows of a key and ``text``, and the key that tells them apart for lead(): for orders above one, equal rows are one with ``copies``."""
    if orders == 1:
        return rows, key
    return rows.groupBy(*key, "text").agg(F.count("*").alias("copies")), [*key, "copies"]


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket and gain of every bucket, seen or not, from tables of runs."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = write_shared(every.join(counts(raw, buckets, "s"), "bucket", "left").join(counts(target, buckets, "t"), "bucket", "left").fillna(0), "resampling-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()  # two numbers
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    share = ((t + 1) * F.lit(float(all_s + buckets))) / ((s + 1) * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(scale * F.log(share)).cast("long").alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """doc_id, content (a hash of the text), copies, n_words, n_features and weight of every different (id, text)."""
    content = lambda column: F.md5(F.coalesce(F.col(f"`{column}`"), F.lit("")))
    slim, key = keyed(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), content(text).alias("content"), F.col(f"`{text}`").alias("text")), ["doc_id", "content"], orders)
    wanted, item = keyed(target.select(content(target_text).alias("content"), F.col(f"`{target_text}`").alias("text")), ["content"], orders)
    raw = runs(positions(slim, key, "text"), key, orders)
    gain = gains(raw, runs(positions(wanted, item, "text"), item, orders), buckets, scale)
    at_bucket = raw.withColumn("bucket", bucket(F.col("run"), buckets))
    joined = at_bucket.join(F.broadcast(gain) if buckets <= BROADCAST_BUCKETS else gain, "bucket", "left")
    first_run = F.lit(True) if orders == 1 else F.col("run") == F.col("word")
    of_word = F.count(F.when(F.col("word").isNotNull() & first_run, 1))
    sums = [of_word.alias("n_words"), F.count("run").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")]
    if orders > 1:
        return joined.groupBy(*key).agg(*sums)
    # one pass: copies of a row fall into one group, and each has one first position
    heads = F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1)).alias("copies")
    per = joined.groupBy(*key).agg(heads, *sums)
    return per.select(*key, "copies", *(F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")))


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise from a hash of seed and id, scaled and floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], upto: int, per_range: int = RANGE_ROWS) -> DataFrame:
    """rows (with ``copies``) and ``before``: how many come before each in the order; null from ``upto`` on.

    A range sort: ranges are written with their number, counted, and summed up; a window runs inside a range only.
    """
    parts = max(1, -(-rows.count() // per_range))
    dealt = write_shared(rows.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "resampling-ranges")
    ranges = dealt.groupBy("range").agg(F.sum("copies").alias("n"))
    starts = ranges.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, "range").withColumn("before", F.col("start") + F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    return placed.withColumn("before", F.when(F.col("before") < upto, F.col("before"))).drop("range", "start")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every document."""
    per = weighed(docs, target, doc_id, text, target_text, orders, buckets, scale)
    scored = write_shared(per.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed, scale)), "resampling-scores")
    able = F.col("n_words") >= least_words
    n = scored.filter(able).agg(F.sum("copies")).first()[0] or 0
    drawn = percent * n // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("content")]
    both = ranked(scored.filter(able), order, drawn).unionByName(scored.filter(~able).withColumn("before", F.lit(None).cast("long")))
    # copies follow each other; arrays stay short however many there are
    step = 4096
    again = both.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / step).cast("int"))))
    again = again.withColumn("copy", F.explode(F.sequence(F.col("at").cast("long") * step + 1, F.least(F.col("copies"), (F.col("at").cast("long") + 1) * step))))
    rank = F.col("before") + F.col("copy")
    return again.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
