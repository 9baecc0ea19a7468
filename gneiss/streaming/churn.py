"""Churn over a stream of commits: tumbling days with a watermark, late commits dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_churn(commits: DataFrame, delay: str = "2 days", window: str = "1 day") -> DataFrame:
    """start, path, changes and added lines of each window; commits (ts timestamp, path, added) may be a stream."""
    per = commits.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "path").agg(F.count("*").alias("changes"), F.sum("added").alias("added"))
    return per.select(F.col("w.start").alias("start"), "path", "changes", "added")


def sessions(commits: DataFrame, gap: str = "2 hours", delay: str = "1 day") -> DataFrame:
    """author, start, end and commits of working sessions: commits no further apart than the gap."""
    per = commits.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "author").agg(F.count("*").alias("commits"))
    return per.select("author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "commits")
