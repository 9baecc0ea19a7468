"""Context windows over ordered lines or turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame(value: Column, keys: list[str], order: str, first: int, last: int, separator: str = " ") -> Column:
    """The values of rows first..last around each row, joined."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    return F.array_join(F.collect_list(value).over(w), separator)


def around(rows: Column, at: Column, first: int, last: int, separator: str = " ") -> Column:
    """The items first..last around one of an array, joined: a frame inside a row; ``at`` counts from 0."""
    begin = F.greatest(at + first, F.lit(0))
    return F.array_join(F.slice(rows, begin + 1, at + last - begin + 1), separator)


def previous(value: Column, keys: list[str], order: str) -> Column:
    return F.lag(value).over(Window.partitionBy(*keys).orderBy(order))


def running(value: Column, keys: list[str], order: str) -> Column:
    """The sum of the values up to and with each row."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def parity(count: Column, keys: list[str], order: str) -> Column:
    """Whether the number of marks up to and with each row is odd."""
    return running(count, keys, order) % 2 == 1


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; the order must be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def examples_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """keys, count and ``name``: the first k rows of each key as an array; the order must be total.

    Each task keeps its first k rows of a key before anything is shuffled, so no array and no task holds more
    than some k rows of a key, however many there are.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k)
    rest = [c for c in df.columns if c not in keys]
    rows = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*rest).alias("row")))), lambda x: x["row"]).alias(name))
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    return counts.join(rows, keys)


def chunked(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """df with the number of the chunk of ``size`` rows that each row falls in; for bounded lists."""
    return df.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))


def chunks_of(array: Column, size: int) -> Column:
    """An array cut into arrays of ``size``."""
    n = F.size(array)
    starts = F.sequence(F.lit(1), n, F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(array, i, F.lit(size)))).otherwise(F.array())
