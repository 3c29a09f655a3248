"""Joins of enhancement frames with base frames, sizes and streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.workers import attach


def pair_by_pts(enh: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """All frames of both sides with status matched, base_only or enh_only."""
    e, b = enh.withColumn("__e", F.lit(True)), base.withColumn("__b", F.lit(True))
    status = F.when(F.col("__e") & F.col("__b"), "matched").when(F.col("__b"), "base_only").otherwise("enh_only")
    return e.join(b, on, "full_outer").withColumn("status", status).drop("__e", "__b")


def without_base(enh: DataFrame, base_columns: dict[str, str]) -> DataFrame:
    """Frames of a stream that has no base: base columns are null."""
    return enh.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in base_columns.items()])


def true_pts(enh: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """Enhancement frames with the PTS of the base frame of their decode index, and differs where theirs was another."""
    b = base.select(*on, F.col("pts").alias("base_pts"))
    return enh.join(b, on).withColumn("differs", F.col("pts") != F.col("base_pts"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def completeness(enh: DataFrame, base: DataFrame, by: list[str]) -> DataFrame:
    """Frames of each side per stream, and whether they are as many."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = n(enh, "n_enh").join(n(base, "n_base"), by, "full_outer").fillna(0, ["n_enh", "n_base"])
    return both.withColumn("complete", F.col("n_enh") == F.col("n_base"))


def merge_replay(enh: list[tuple[int, int]], base: list[tuple[int, int]], depth: int) -> Iterator[tuple[int, int | None]]:
    """Exact replay of the merge: frames (pts, id) leave a heap once it holds depth of them; each takes the base frame at
    the head of the queue. A base frame of another time is thrown away, and the release waits for the next arrival."""
    heap: list[tuple[int, int]] = []
    queue = sorted(base)
    at = 0

    def release(at_end: bool) -> Iterator[tuple[int, int | None]]:
        nonlocal at
        while heap and (at_end or len(heap) >= depth):
            if at == len(queue):
                return
            if queue[at][0] != heap[0][0]:
                at += 1
                if at_end:
                    continue
                return
            pts, e = heapq.heappop(heap)
            yield e, queue[at][1]
            at += 1

    for frame in enh:
        heapq.heappush(heap, frame)
        yield from release(False)
    yield from release(True)


def replayed(enh: DataFrame, base: DataFrame, depth: int = 16) -> DataFrame:
    """Pairs that the strict merge makes: stream_id, enh_id, base_id. Both sides have stream_id, pts, id and, for enh,
    decode_index; one stream is replayed in one task."""

    attach(enh.sparkSession)

    def run(key: tuple, e: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        e = e.sort_values("decode_index")
        stream = (key or (None,))[0]
        made = list(merge_replay(list(zip(e["pts"], e["id"], strict=True)), list(zip(b["pts"], b["id"], strict=True)), depth))
        return pd.DataFrame([(stream, *m) for m in made], columns=["stream_id", "enh_id", "base_id"])

    return enh.groupBy("stream_id").cogroup(base.groupBy("stream_id")).applyInPandas(run, "stream_id string, enh_id long, base_id long")


def check_config(frames: DataFrame, config: DataFrame, profile: str = "profile", level: str = "level") -> DataFrame:
    """Frames whose profile or level differs from the container's configuration, one row a stream at most."""
    c = config.select("stream_id", F.col(profile).alias("container_profile"), F.col(level).alias("container_level"))
    return frames.join(c, "stream_id").filter((F.col(profile) != F.col("container_profile")) | (F.col(level) != F.col("container_level")))
