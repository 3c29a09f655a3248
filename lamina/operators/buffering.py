"""Receive-buffer simulation: a leaky bucket that fills at a constant rate and releases at most one frame a step.

The step at which frame k leaves is k + max over j <= k of (need_j - j), need_j being the first step whose time reaches
the frame's release time; its level is the bytes filled so far less the sizes of the frames released with or before it.
So the simulation is a running maximum and a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_count(step: float, total: float) -> int | None:
    """Steps, with the one at 0, that cover total seconds; None for a step outside (0, total]."""
    if step <= 0 or total < 0 or step > total:
        return None
    return -int(-total // step) + 1


def fill_per_step(step: float, bitrate: float) -> float | None:
    return bitrate * step / 8 if step > 0 and bitrate > 0 else None


def initial_delay(size: Column, initial_fill: Column, bitrate: Column) -> Column:
    """Seconds until the buffer holds its initial fill."""
    return F.try_divide(size * initial_fill * 8, bitrate)


def first_step(release: Column, step: Column) -> Column:
    """The first step whose time reaches release; checked against the products, which a bare ceiling can miss."""
    guess = F.greatest(F.ceil(F.try_divide(release, step)), F.lit(0)).cast("long")
    return F.when((guess > 0) & ((guess - 1) * step >= release), guess - 1).when(guess * step < release, guess + 1).otherwise(guess)


def released(frames: DataFrame, by: list[str], order: list[str], need: Column, size: Column, fill: Column, n_steps: Column | None = None) -> DataFrame:
    """Adds k, release_step and frame_level; where n_steps is given, released, and null levels for frames that are not."""
    w = Window.partitionBy(*by).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = frames.withColumn("k", (F.row_number().over(w) - 1).cast("long")).withColumn("__need", need)
    out = out.withColumn("release_step", F.col("k") + F.max(F.col("__need") - F.col("k")).over(past))
    level = F.col("release_step") * fill - F.sum(size).over(past)
    if n_steps is not None:
        out = out.withColumn("released", F.col("release_step") < n_steps)
        level = F.when(F.col("released"), level)
    return out.withColumn("frame_level", level).drop("__need")


#: Steps that one array holds.
ARRAY = 4096


def step_levels(runs: DataFrame, frames: DataFrame, by: list[str], size: str, fill: Column) -> DataFrame:
    """Level before each step's events: what was filled less the frames released before. runs: a row for each stream,
    with n_steps; frames have release_step. Between releases a level only grows, so windows see releases, not steps, and
    steps are made last, in arrays of ARRAY at most."""
    whole = frames.schema[size].dataType.simpleString()
    gone = frames.groupBy(*by, F.col("release_step").alias("step")).agg(F.sum(size).alias("gone"))
    start = runs.select(*by, F.lit(-1).cast("long").alias("step"), F.lit(0).cast(whole).alias("gone"))
    w = Window.partitionBy(*by).orderBy("step")
    spans = start.unionByName(gone).select(*by, (F.col("step") + 1).alias("low"), F.lead("step").over(w).alias("high"), F.sum("gone").over(w).alias("before"))
    spans = spans.join(runs, by).withColumn("high", F.least(F.coalesce("high", F.col("n_steps") - 1), F.col("n_steps") - 1)).filter("low <= high")
    parts = spans.withColumn("part", F.explode(F.expr(f"sequence(low div {ARRAY}, high div {ARRAY})")))
    steps = parts.withColumn("step", F.explode(F.expr(f"sequence(greatest(low, part * {ARRAY}), least(high, part * {ARRAY} + {ARRAY - 1}))")))
    return steps.withColumn("level", F.col("step") * fill - F.col("before")).drop("low", "high", "before", "part")


def sawtooth(levels: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """Plot points: the level at each step, and after each release the level it leaves; by, step, kind, level."""
    points = levels.select(*by, "step", F.lit(0).alias("kind"), F.col("level"))
    drops = frames.filter("frame_level is not null").select(*by, F.col("release_step").alias("step"), F.lit(1).alias("kind"), F.col("frame_level").alias("level"))
    return points.unionByName(drops)


def with_flags(frames: DataFrame, level: str, size: Column) -> DataFrame:
    """fill_percent of the buffer, and X where it under- or overflows; levels are not clamped."""
    percent = F.try_divide(F.col(level) * 100, size)
    return frames.withColumn("fill_percent", percent).withColumn("flag", F.when((percent < 0) | (percent > 100), "X").otherwise(""))


def simulate(frames: DataFrame, models: DataFrame, time_base: float | Column, step: float) -> dict[str, DataFrame]:
    """frames: stream_id, frame_index, pts and bytes of each buffer (combined, base, enhancement); models: buffer,
    fill_bitrate, size, initial_fill; time_base: seconds of a tick of pts, which can differ by stream. The release of all
    three buffers is timed by the combined one.
    Returns frames, levels and plot."""
    combined = models.filter("buffer = 'combined'").select(initial_delay(F.col("size"), F.col("initial_fill"), F.col("fill_bitrate")).alias("first_release"))
    valid = (F.col("size") > 0) & (F.col("fill_bitrate") > 0) & (F.col("initial_fill") > 0)
    m = models.select("buffer", F.col("size").alias("buffer_size"), (F.col("fill_bitrate") * step / 8).alias("fill"), valid.alias("valid")).filter("valid").drop("valid")
    w = Window.partitionBy("stream_id").orderBy("frame_index")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    timed = frames.crossJoin(F.broadcast(combined)).withColumn("release", F.col("first_release") + (F.col("pts") - F.first("pts").over(w)) * (time_base if isinstance(time_base, Column) else F.lit(time_base)))
    timed = timed.withColumn("n_steps", F.ceil(F.last("release").over(whole) / F.lit(step)).cast("long") + 1)
    parts = F.explode(F.array(*[F.struct(F.lit(b).alias("buffer"), F.col(b).alias("bytes")) for b in ("combined", "base", "enhancement")])).alias("part")
    long = timed.select("stream_id", "frame_index", "release", "n_steps", parts).select("stream_id", "frame_index", "release", "n_steps", "part.*")
    long = long.join(F.broadcast(m), "buffer")  # one row a buffer
    by = ["stream_id", "buffer"]
    out = released(long, by, ["frame_index"], first_step(F.col("release"), F.lit(step)), F.col("bytes"), F.col("fill"), F.col("n_steps"))
    out = with_flags(out, "frame_level", F.col("buffer_size"))
    runs = out.groupBy(*by).agg(F.max("n_steps").alias("n_steps"), F.max("fill").alias("fill"))
    levels = step_levels(runs, out.filter("released"), by, "bytes", F.col("fill")).withColumn("time", F.col("step") * F.lit(step))
    plot = sawtooth(levels, out, by).withColumn("time", F.col("step") * F.lit(step))
    return {"frames": out, "levels": levels, "plot": plot}


def simulation_json(result: dict[str, DataFrame], models: DataFrame, step: float) -> DataFrame:
    """What simulate() returned as a JSON document for each stream: timing, and of each buffer its model, the levels that
    frames leave and the plot's points. One stream is one row."""
    listed = lambda c, *order: F.sort_array(F.collect_list(F.struct(*order, c)))
    values = lambda c, name: F.transform(c, lambda x: x[name])
    model = models.select("buffer", F.struct(F.col("fill_bitrate").alias("fillBitRate"), "size", F.col("initial_fill").alias("initialFill")).alias("model"))
    left = result["frames"].groupBy("stream_id", "buffer").agg(listed("frame_level", "frame_index").alias("left"), listed("release", "frame_index").alias("release"), F.max("n_steps").alias("samples"))
    plot = result["plot"].groupBy("stream_id", "buffer").agg(F.sort_array(F.collect_list(F.struct("step", "kind", "time", F.col("level").cast("double").alias("level")))).alias("plot"))
    one = left.join(plot, ["stream_id", "buffer"]).join(model, "buffer")
    body = F.struct("model", values(F.col("left"), "frame_level").alias("level"), values(F.col("plot"), "time").alias("plotTimes"), values(F.col("plot"), "level").alias("plotValues"))
    part = lambda b: F.max(F.when(F.col("buffer") == b, F.struct("body"))).getField("body").alias(b)
    timing = F.struct(F.lit(step).alias("stepDuration"), F.max("samples").alias("samples"), F.max(values(F.col("release"), "release")).alias("frameRelease")).alias("timing")
    whole = one.withColumn("body", body).groupBy("stream_id").agg(timing, *map(part, ("combined", "base", "enhancement")))
    return whole.select("stream_id", F.to_json(F.struct("timing", "combined", "base", "enhancement")).alias("json"))
