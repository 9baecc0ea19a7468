"""Positions in a total order of any number of rows, by a range sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut

RANGE_ROWS = 100_000


def numbered(df: DataFrame, order: list[Column], name: str = "position", per_range: int = RANGE_ROWS) -> DataFrame:
    """df with its rows numbered from 1 in the order, which must be total.

    Rows are dealt to ranges and written with their range's number; ranges are counted and summed up, and a
    window runs inside each range only, so no task holds more than about ``per_range`` rows.
    """
    parts = max(1, -(-df.count() // per_range))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    starts = ranges.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(starts, "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")
