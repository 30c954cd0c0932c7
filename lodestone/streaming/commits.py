"""Commits as a stream (beyond what the surveyed engine has): touches of each path by day, late commits up to a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def touches(commits: DataFrame, late: str = "7 days", window: str = "1 day") -> DataFrame:
    """path, day, frequency of a streaming (or plain) DataFrame of sha, ts, path; each (sha, path) counts once.

    With a stream, state is kept for `late`: repeated rows within it are dropped, later ones ignored."""
    once = commits.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha", "path"]) if commits.isStreaming else commits.dropDuplicates(["sha", "path"])
    counted = once.groupBy("path", F.window("ts", window).alias("w")).agg(F.count("*").alias("frequency"))
    return counted.select("path", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "frequency")
