"""An extension: commit counts over a stream of commits, in sliding windows, with late commits up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_commits(commits: DataFrame, lookback: str = "90 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """commits(uri, ts), batch or stream: window_end, uri, commits for every sliding window."""
    counted = commits.withWatermark("ts", late).groupBy(F.window("ts", lookback, slide), "uri").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.end").alias("window_end"), "uri", "commits")
