"""The count-bounded reorder buffer as a stateful streaming operator.

Frames of a stream are held until more than depth - 1 of them wait; then the earliest by PTS is released. A frame that is
earlier than what was released already is marked late and still released. A watermark bounds disorder by time, not by
count, so the buffer is state of its own."""

from __future__ import annotations

import heapq
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lamina.workers import attach

OUT = "stream_id string, decode_index long, pts long, presentation_index long, is_late boolean, is_duplicate boolean"
NAMES = ["stream_id", "decode_index", "pts", "presentation_index", "is_late", "is_duplicate"]


def push(state: dict, frames: list[tuple[int, int, int]], flush: bool) -> list[tuple[int, int, bool, bool]]:
    """Adds (pts, decode index, depth) in arrival order; returns decode index, pts, place, lateness and whether a frame of
    its PTS was released just before, of the released. The depth of the latest frame tells how many may wait."""
    heap, out = [tuple(x) for x in state["heap"]], []

    def pop() -> None:
        pts, index = heapq.heappop(heap)
        last = state["last"]
        out.append((index, pts, state["n"], last is not None and pts <= last, pts == last))
        state["n"] += 1
        state["last"] = pts if last is None else max(pts, last)

    for pts, index, depth in frames:
        heapq.heappush(heap, (pts, index))
        while len(heap) >= depth:
            pop()
    while flush and heap:
        pop()
    state["heap"] = heap
    return out


def reorder(frames: DataFrame, depth: int, flush_after: str | None = None) -> DataFrame:
    """frames: a streaming DataFrame of stream_id, decode_index, pts, and depth if it can change; a row without
    decode_index marks the end of its stream. flush_after: the idle time after which what is held is released."""
    attach(frames.sparkSession)
    own = "depth" in frames.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"heap": [], "n": 0, "last": None}
        rows, ended = [], state.hasTimedOut
        if not state.hasTimedOut:
            for b in batches:
                there = b[b["decode_index"].notna()]
                ended |= len(there) < len(b)
                depths = there["depth"].fillna(depth) if own else [depth] * len(there)
                rows += [(int(i), int(p), int(d)) for i, p, d in zip(there["decode_index"], there["pts"], depths, strict=True)]
        out = push(held, [(p, i, d) for i, p, d in sorted(rows)], ended)
        state.update((json.dumps(held),))
        if flush_after and held["heap"]:
            state.setTimeoutDuration(flush_after)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=NAMES)

    kind = GroupStateTimeout.ProcessingTimeTimeout if flush_after else GroupStateTimeout.NoTimeout
    return frames.groupBy("stream_id").applyInPandasWithState(step, OUT, "held string", "append", kind)


def reorder_batch(frames: DataFrame, depth: int) -> DataFrame:
    """The same release order for frames at rest: each stream in decode order through the same buffer, then flushed."""
    attach(frames.sparkSession)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("decode_index")
        depths = rows["depth"].tolist() if "depth" in rows else [depth] * len(rows)
        out = push({"heap": [], "n": 0, "last": None}, list(zip(rows["pts"].tolist(), rows["decode_index"].tolist(), depths, strict=True)), True)
        return pd.DataFrame([(key[0], *o) for o in out], columns=NAMES)

    return frames.groupBy("stream_id").applyInPandas(run, OUT)


def run_files(spark: SparkSession, folder: str, schema: StructType | str, depth: int, checkpoint: str | None = None, frames: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs the streaming operator over the Parquet files of a folder, one a micro-batch, to its end: a second run from
    the same checkpoint reads a mark of the end for each stream, which releases what is held. frames makes frames of the
    files' rows. Released frames are written beside the checkpoint, in a folder that all executors share."""
    base = checkpoint or f"{(spark.conf.get('spark.checkpoint.dir', None) or 'file://' + tempfile.gettempdir()).rstrip('/')}/reorder-{uuid.uuid4().hex}"
    frames = frames or (lambda df: df)
    read = lambda source: source.schema(schema).option("maxFilesPerTrigger", 1)
    marks = "stream_id string, decode_index long, pts long"
    spark.createDataFrame([], marks).write.mode("ignore").parquet(f"{base}/ends")

    def run() -> None:
        stream = frames(read(spark.readStream).parquet(folder)).select("stream_id", "decode_index", "pts")
        ends = spark.readStream.schema(marks).parquet(f"{base}/ends")
        q = reorder(stream.unionByName(ends), depth).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    none = F.lit(None).cast("long")
    frames(spark.read.schema(schema).parquet(folder)).select("stream_id").distinct().select("stream_id", none.alias("decode_index"), none.alias("pts")).write.mode("append").parquet(f"{base}/ends")
    run()
    return spark.read.schema(OUT).parquet(f"{base}/out")
