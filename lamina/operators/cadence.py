"""Timestamp cadence: intervals between neighbouring presentation times and their histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(frames: DataFrame, by: list[str], order: list[str], pts: str) -> DataFrame:
    """Adds interval: the absolute difference to the row before in its stream; null on the first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    return frames.withColumn("interval", F.abs(F.col(pts) - F.lag(pts).over(w)))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """How often each value occurs: by, value, n. Null values do not count."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def inverted_histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The values of each frequency, ascending: by, n, vals."""
    return histogram(rows, by, value).groupBy(*by, "n").agg(F.sort_array(F.collect_list(value)).alias("vals"))


def is_consistent(interval_count: Column) -> Column:
    """One or two distinct intervals make a regular cadence."""
    return interval_count.isin(1, 2)


def validate(frames: DataFrame, by: list[str], order: list[str], pts: str) -> DataFrame:
    """interval_count and consistent per stream; streams with fewer than two rows have no result row."""
    h = histogram(intervals(frames, by, order, pts), by, "interval")
    out = h.groupBy(*by).agg(F.count("*").alias("interval_count"))
    return out.withColumn("consistent", is_consistent(F.col("interval_count")))
