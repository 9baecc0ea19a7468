"""Mixing sources to target weights by weighted fair queueing, DataFrame functions only.

Every source is a queue of its documents in a shuffled order (by a hash of id and text), offered up to
``passes`` times. A document's virtual finish time is the source's cumulative words divided by the
source's weight; all queues are merged by finish time and cut at the total budget, ``share`` of all
words. A queue that runs dry leaves its share to the others, so what each source gets is its target:
the weighted share of the budget, stopped at ``passes`` times the source's size.

Cumulative sums never gather a source in one task: each source is cut into hash buckets of about
``bucket_rows`` documents, bucket sums are added up first, and a window runs inside each bucket only.
The cut is found the same way, from a histogram of finish times and the exact order in the one bin
where the budget ends.

Defined results: a null text has size 0; an empty document takes 0; null is a source of its own, last;
a table without words has targets of 0; repeated rows (same id, source and text) are queued together
and taken equally often; other columns don't matter to the mix and pass through ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import n_words, write_shared

WEIGHTS, SHARE, PASSES, BUCKET_ROWS, BINS = (5.0, 2.0, 1.0), 1.5, 2, 2000, 4096
#: Offers that one task puts in order at the cut; a bin with more is cut finer.
FEW_OFFERS = 20_000
#: Sources up to which their table is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 5000


def order_key(doc_id: str, text: str) -> Column:
    """The shuffled order of documents: a hash of id and text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.md5(F.col(text)), F.lit("null"))))


def targets(items: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """From (source, size, copies): source, source_size, n_items, weight and target of each source."""
    per = items.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_items"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("source_rank", rank)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * passes).cast("double")
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    low = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("ratio", "source_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(all_rows) * share
    level = (budget - F.coalesce(F.sum("cap").over(low), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(low), F.lit(0.0)))
    per = per.withColumn("budget", budget).withColumn("level", level).withColumn("capped", F.col("ratio") <= F.col("level"))
    # the water level is that of the first queue that doesn't run dry
    water = F.min(F.when(~F.col("capped"), F.struct("ratio", "source_rank", "level"))).over(all_rows)["level"]
    per = per.withColumn("water", water)
    return per.select("source", "source_size", "n_items", "source_rank", "weight", "budget", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight")).alias("target"))


def queue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per different (doc_id, source, text): copies, size, source_size, target, taken (of each copy) and passes."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), order_key(doc_id, text).alias("h"))
    items = write_shared(slim.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")), "mix-items")
    src = write_shared(targets(items, weights, share, passes), "mix-sources")
    few = src.count() <= BROADCAST_SOURCES
    same = src.withColumnRenamed("source", "_s")
    joined = items.join(F.broadcast(same) if few else same, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    buckets = F.ceil(F.col("n_items") / BUCKET_ROWS)
    place = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32
    joined = joined.withColumn("bucket", F.floor(place * buckets))
    words = F.col("size") * F.col("copies")
    sums = joined.groupBy("source_rank", "bucket").agg(F.sum(words).alias("bucket_words"))
    before = F.sum("bucket_words").over(Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source_rank", "bucket", F.coalesce(before, F.lit(0)).alias("words_before"))
    inside = F.sum(words).over(Window.partitionBy("source_rank", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    queued = joined.join(sums, ["source_rank", "bucket"]).withColumn("cum", F.col("words_before") + inside)
    offers = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    offers = offers.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("cum")) / F.col("weight"))
    offers = write_shared(offers.select("doc_id", "source", "size", "h", "copies", "source_rank", "source_size", "target", "budget", "pass", "finish"), "mix-offers")
    cut = cut_point(offers)
    if cut is None:
        taken = F.lit(True)
    else:
        here = F.struct("finish", "h", "source_rank", "pass")
        taken = here <= F.struct(F.lit(cut[0]), F.lit(cut[1]), F.lit(cut[2]), F.lit(cut[3]))
    each = offers.groupBy("source_rank", "h").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "copies", "source_size", "target")), F.count(F.when(taken, 1)).alias("passes")
    )
    return each.withColumn("taken", F.col("size") * F.col("passes"))


def cut_point(offers: DataFrame):
    """The last offer within the budget in order of finish time, as (finish, h, source_rank, pass); None if all fit.

    Only one histogram of BINS rows and one bin's last row reach the driver.
    """
    words = F.col("size") * F.col("copies")
    top = offers.agg(F.max("finish").alias("top"), F.max("budget").alias("budget"), F.sum(words).alias("all")).first()
    if not top["top"] or top["all"] <= top["budget"]:
        return None
    some, before = offers, 0
    # first by finish time, then, among equal ones, by the order of the hash; bins get narrower until one holds few offers
    for value in (F.col("finish"), place_of("h", 1), place_of("h", 9)):
        ends = some.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n")).first()
        low, high, n = ends["low"], ends["high"], ends["n"]
        while n > FEW_OFFERS and low < high:
            bin_of = F.least(F.floor((value - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            inside = some.filter((value >= low) & (value <= high))
            rows = inside.groupBy(bin_of.alias("bin")).agg(F.sum(words).alias("words"), F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).orderBy("bin").collect()
            for r in rows:
                if before + r["words"] > top["budget"]:
                    break
                before += r["words"]
            low, high, n = r["least"], r["most"], r["n"]
        some = some.filter((value >= low) & (value <= high))
        if n <= FEW_OFFERS:
            break
    place = F.struct("finish", "h", "source_rank", "pass")
    run = F.sum(words).over(Window.orderBy("finish", "h", "source_rank", "pass").rowsBetween(Window.unboundedPreceding, 0))
    last = some.select(place.alias("place"), run.alias("run")).filter(F.col("run") + before <= top["budget"]).agg(F.max("place").alias("place")).first()["place"]
    if last is None:  # the first offer is already beyond: the cut lies just before it
        first = some.agg(F.min(place).alias("place")).first()["place"]
        return (first["finish"], first["h"], first["source_rank"], first["pass"] - 1)
    return tuple(last)


def place_of(h: str, at: int) -> Column:
    """Eight digits of a hash as a number, exact in a double."""
    return F.conv(F.substring(h, at, 8), 16, 10).cast("double")


def repeated(rows: DataFrame, times) -> DataFrame:
    """Each row so many times; no array is longer than 4096, however often."""
    step = 4096
    few = rows.withColumn("again", times.cast("long")).filter("again > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("again") - 1) / step).cast("int"))))
    return few.withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.lit(step), F.col("again") - F.col("at") * step).cast("int")))).drop("again", "at")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: docs with each row as often as its document is taken, all columns kept, whatever their names."""
    at = {c: f"c{docs.columns.index(c)}" for c in (doc_id, text, source)}
    placed = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    took = queue(placed, at[doc_id], at[text], at[source], **how).filter("passes > 0").select(F.col("h").alias("took_h"), F.col("source").alias("took_source"), F.col("passes").alias("took"))
    keyed = placed.select("*", order_key(at[doc_id], at[text]).alias("key"))
    # as many rows as documents, so not broadcast
    out = keyed.join(took.hint("merge"), (F.col("key") == F.col("took_h")) & F.col(at[source]).eqNullSafe(F.col("took_source")))
    return repeated(out.select(*placed.columns, "took"), F.col("took")).select(*placed.columns).toDF(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken words."""
    q = queue(docs, doc_id, text, source, **how)
    return repeated(q.select("doc_id", "size", "source_size", "target", "taken", "copies"), F.col("copies")).select("doc_id", "size", "source_size", "target", "taken")
