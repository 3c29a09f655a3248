"""Sizes of layers and the stream summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bytes_by_dts(packets: DataFrame, by: list[str], size: str, name: str = "total") -> DataFrame:
    return packets.groupBy(*by).agg(F.sum(size).alias(name))


def remaining_by_dts(packets: DataFrame, enh: DataFrame, by: list[str], size: str, enh_size: str) -> DataFrame:
    """total bytes of a DTS, those of enhancement frames, and what remains; failed where that is negative."""
    e = enh.groupBy(*by).agg(F.sum(enh_size).alias("enh"))
    out = bytes_by_dts(packets, by, size).join(e, by, "left").withColumn("enh", F.coalesce("enh", F.lit(0)))
    return out.withColumn("remaining", F.col("total") - F.col("enh")).withColumn("failed", F.col("remaining") < 0)


def frame_sizes(payload: Column, wire: Column, remaining: Column, total: Column, countable: Column) -> Column:
    """enh, base and combined bytes of a frame. The wire size counts if known, else the payload; the base is what
    remains of the DTS, else total less wire where packets can be counted, else nothing."""
    enh = F.coalesce(F.when(wire > 0, wire), payload)
    base = F.when(F.coalesce(remaining, F.lit(0)) > 0, remaining).when(countable, F.coalesce(total, F.lit(0)) - enh).otherwise(0)
    return F.struct(enh.alias("enh"), base.alias("base"), (enh + base).alias("combined"), (base < 0).alias("failed"))


def sublayer_bytes(layers: DataFrame, by: list[str], sublayer: str, size: str) -> DataFrame:
    """level_1_size, level_2_size and temporal_size."""
    part = lambda k, name: F.coalesce(F.sum(F.when(F.col(sublayer) == k, F.col(size))), F.lit(0)).alias(name)
    return layers.groupBy(*by).agg(part("SUBLAYER_1", "level_1_size"), part("SUBLAYER_2", "level_2_size"), part("TEMPORAL", "temporal_size"))


def base_presence(frames: DataFrame, by: list[str], has_base: Column) -> DataFrame:
    """has_base where all frames agree, null where they do not; mixed tells which."""
    b = F.coalesce(has_base, F.lit(False))
    out = frames.groupBy(*by).agg(F.min(b).alias("lo"), F.max(b).alias("hi"))
    return out.select(*by, F.when(F.col("lo") == F.col("hi"), F.col("hi")).alias("has_base"), (F.col("lo") != F.col("hi")).alias("mixed"))


def reorder_depth(delay: Column) -> Column:
    """Depth of in-band frames: 16, or the container's delay if that is more."""
    return F.greatest(F.lit(16), F.max(delay))


def summary(totals: DataFrame, fps: Column, total: Column, enh: Column, n_enh: Column, n_base: Column, container_seconds: Column | None = None) -> DataFrame:
    """Adds the summary of a stream: base bytes, durations, bitrates and the ratio of enhancement to base. What lacks
    its divisor is null; the enhancement's duration falls back to the container's."""
    base = F.greatest(total - enh, F.lit(0))
    seconds = F.try_divide(n_enh.cast("double"), F.when(fps > 0, fps))
    seconds = seconds if container_seconds is None else F.coalesce(seconds, container_seconds)
    base_seconds = F.try_divide(n_base.cast("double"), F.when(fps > 0, fps))
    rate = lambda b, s: F.try_divide(b.cast("double") * F.lit(8.0).cast("double"), s)
    return totals.select(
        "*",
        base.alias("base_size"),
        seconds.alias("enh_seconds"),
        rate(enh, seconds).alias("enh_bitrate"),
        F.when(base > 0, rate(base, base_seconds)).alias("base_bitrate"),
        F.try_divide(enh.cast("double"), base.cast("double")).alias("enh_base_ratio"),
    )
