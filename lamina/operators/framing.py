"""Ordered operators: indices, lengths, zero-based times, limits, reordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_index(rows: DataFrame, by: list[str], order: list, name: str = "frame_index") -> DataFrame:
    """Numbers rows from 0 in each stream."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def with_lengths(rows: DataFrame, by: list[str], offset: str, total: str, order: list[str] | None = None) -> DataFrame:
    """length: up to the next offset, or for the last row to the total."""
    w = Window.partitionBy(*by).orderBy(offset, *(order or ()))
    return rows.withColumn("length", F.coalesce(F.lead(offset).over(w), F.col(total)) - F.col(offset))


def zero_based(rows: DataFrame, by: list[str], order: list[str], pts: str, time_base: float) -> DataFrame:
    """seconds since the stream's first row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("seconds", (F.col(pts) - F.first(pts).over(w)) * F.lit(time_base))


def with_monotonic_flag(rows: DataFrame, by: list[str], order: list[str], pts: str) -> DataFrame:
    """is_late: the row's time does not exceed that of the row before it. Late rows stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("is_late", F.coalesce(F.col(pts) <= F.lag(pts).over(w), F.lit(False)))


def in_presentation_order(rows: DataFrame, by: list[str], pts: str, tie: str) -> DataFrame:
    """presentation_index: what a reorder buffer of enough depth releases, in batch."""
    return with_index(rows, by, [pts, tie], "presentation_index")


def in_decode_order(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    """release_index, and blocked: an index before it is missing, so a strict release would wait for it."""
    out = with_index(rows, by, [index], "release_index")
    return out.withColumn("blocked", F.col("release_index") != F.col(index))


def first_frames(rows: DataFrame, n: int, index: str = "frame_index") -> DataFrame:
    """The first n frames of every stream; all if n is 0."""
    return rows.filter(F.col(index) < n) if n else rows


def carried_forward(rows: DataFrame, by: list[str], order: list[str], value, name: str) -> DataFrame:
    """The latest non-null value so far: how a configuration holds until the next one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
