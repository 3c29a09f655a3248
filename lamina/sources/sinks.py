"""Sinks: extracted frames in decode order, and access units of their own.

A stream is one file, written by one task from its sorted rows, a frame at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import bits
from lamina.sources import containers
from lamina.workers import attach

FORMATS = ("BIN", "RAW", "DELIMITED")
SUFFIX_FORMATS = {".bin": "BIN", ".lvc": "RAW", ".lcevc": "RAW"}


def record(fmt: str, index: int, pts: int, data: bytes, byte_order: str = "little") -> bytes:
    """One frame in a sink's format."""
    if fmt == "BIN":
        return containers.bin_block(index, pts, data)
    return data if fmt == "RAW" else len(data).to_bytes(4, byte_order) + data


def write_frames(frames: DataFrame, folder: str, fmt: str = "BIN", byte_order: str = "little") -> DataFrame:
    """Writes a file for each stream; returns stream_id, file, frames and bytes. Failures fail the job."""
    if fmt not in FORMATS:
        raise ValueError(f"the format is one of {FORMATS}, not {fmt!r}")
    attach(frames.sparkSession)
    suffix = {"BIN": "bin", "RAW": "lvc", "DELIMITED": "dat"}[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, str, int, int]] = []
        now = out = None
        for b in batches:
            for stream, name, index, pts, data in zip(*(b[c].to_pylist() for c in ("stream_id", "name", "decode_index", "pts", "data")), strict=True):
                if stream != now:
                    if out:
                        out.close()
                    now, out = stream, system.open_output_stream(f"{root}/{name}.{suffix}")
                    done.append((stream, f"{name}.{suffix}", 0, 0))
                    if fmt == "BIN":
                        out.write(containers.bin_header())
                part = record(fmt, index, pts, data, byte_order)
                out.write(part)
                s, f, n, size = done[-1]
                done[-1] = (s, f, n + 1, size + len(part))
        if out:
            out.close()
        if done:
            columns = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["stream_id", "file", "frames", "bytes"])

    named = frames.withColumn("name", F.concat_ws("-", F.regexp_extract("stream_id", r"([^/]*?)(\.[^./]*)?$", 1), F.substring(F.md5("stream_id"), 1, 8)))
    ordered = named.select("stream_id", "name", "decode_index", "pts", "data").repartition("stream_id").sortWithinPartitions("stream_id", "decode_index")
    return ordered.mapInArrow(run, "stream_id string, file string, frames long, bytes long")


def dump_units(packets: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each packet, named by stream, track, decode index, PTS and DTS; returns their names and sizes."""
    attach(packets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            names = b["name"].to_pylist()
            data = b["data"].to_pylist()
            for name, d in zip(names, data, strict=True):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(d)
            yield pa.RecordBatch.from_arrays([b["stream_id"], b["name"], pa.array([len(d) for d in data], pa.int64())], names=["stream_id", "file", "bytes"])

    name = F.format_string("%s_t%d_%08d_pts%s_dts%s.bin", F.substring(F.md5("stream_id"), 1, 8), "track", "decode_index", F.coalesce(F.col("pts").cast("string"), F.lit("none")), F.coalesce(F.col("dts").cast("string"), F.lit("none")))
    return packets.select("stream_id", name.alias("name"), "data").mapInArrow(run, "stream_id string, file string, bytes long")


def read_delimited(data: bytes, byte_order: str = "little") -> list[bytes]:
    """Frames of a length-delimited file."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], byte_order)
        if at + 4 + n > len(data):
            raise bits.StreamError("the file ends inside a frame")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out
