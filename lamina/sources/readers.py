"""Sources: files of every input type as packets and enhancement frames.

All read through Spark's binaryFile source, so any file system that Spark reads will do; each file is one stream
(stream_id is its path). Parsers run in Arrow batches, a file in one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import bits, enums
from lamina.sources import containers
from lamina.workers import attach

ENH_FRAMES = "stream_id string, decode_index long, pts long, dts long, depth int, wire_size long, data binary"
PACKETS = "stream_id string, track int, codec string, decode_index long, pts long, dts long, tick double, pos long, size long, data binary"
PROBE_BYTES, MAX_CODES, MAX_NALS, MAX_PREFIXED = 4096, 32, 8, 4
#: Reorder depth of frames whose order is not known better, and of in-band ones at least.
DEPTH, IN_BAND_DEPTH = 32, 16


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("stream_id"), "length", "content")


def from_bytes(spark: SparkSession, named: dict[str, bytes]) -> DataFrame:
    """Files given as bytes, as files() returns them."""
    return spark.createDataFrame([(k, len(v), bytearray(v)) for k, v in named.items()], "stream_id string, length long, content binary")


def _each(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, *columns: str) -> DataFrame:
    """Runs a generator over the given columns of every row; what it yields follows the row's stream_id."""
    attach(df.sparkSession)
    kind = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("stream_id", *columns)), strict=True):
                out = [(row[0], *x) for x in rows(*row[1:])]
                for lo in range(0, len(out), 4096):
                    part = list(zip(*out[lo : lo + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, arrow, strict=True)], schema=arrow)

    return df.select("stream_id", *columns).mapInArrow(run, schema)


# Probing


def magic(content: Column, length: Column) -> Column:
    """Input type by magic bytes: BIN, MP4, TS or WEBM; null if none fits."""
    hexed = F.hex(F.substring(content, 1, PROBE_BYTES))
    size = F.least(length, F.lit(PROBE_BYTES))
    at = lambda k, n=1: F.substring(hexed, 2 * k + 1, 2 * n)
    box = F.conv(at(0, 4), 16, 10).cast("long")
    return (
        F.when(at(0, 8) == containers.BIN_MAGIC.hex().upper(), "BIN")
        .when((size >= 12) & (at(4, 4) == "66747970") & (box >= 8) & (box <= size + 16), "MP4")
        .when((size >= 564) & (at(0) == "47") & (at(188) == "47") & (at(376) == "47"), "TS")
        .when(at(0, 4) == "1A45DFA3", "WEBM")
    )


CODECS = ("H264", "HEVC", "VVC", "LCEVC")


def evidence(nal: bytes) -> dict[str, int]:
    """A point for each codec whose header fits, three if it is of a telling type."""
    out = {}
    for codec in CODECS:
        found = bits.annexb_header(nal, codec) or bits.bare_header(nal, codec)
        if found:
            out[codec] = 3 if found.nal_type in bits.PARAMETER_SETS[codec] else 1
    return out


def codec_of(nals: list[dict[str, int]]) -> str:
    """The codec of most points; of equals the first in CODECS."""
    total = {c: sum(n.get(c, 0) for n in nals) for c in CODECS}
    best = max(CODECS, key=total.__getitem__)
    return best if total[best] else "UNKNOWN"


def looks_length_prefixed(data: bytes) -> tuple[bool, list[dict[str, int]]]:
    if len(data) < 8:
        return False, []
    nals, at = [], 0
    while at + 4 <= len(data) and len(nals) < MAX_PREFIXED:
        n = int.from_bytes(data[at : at + 4], "big")
        if not n or n > len(data) - at - 4:
            return False, nals
        found = evidence(data[at + 4 : at + 4 + n])
        if not found:
            return False, nals
        nals.append(found)
        at += 4 + n
    return len(nals) >= (2 if len(data) >= 32 else 1), nals


def looks_annexb(data: bytes) -> tuple[bool, list[dict[str, int]]]:
    codes = bits.start_codes(data, MAX_CODES)
    nals: list[dict[str, int]] = []
    for (at, _), (end, _) in zip(codes, [*codes[1:], (len(data), 0)], strict=False):
        if found := evidence(data[at:end]):
            nals.append(found)
        if len(nals) == MAX_NALS:
            break
    return bool(nals), nals


def elementary(data: bytes) -> tuple[str, str, bool, bool]:
    """Input type, base type, and whether NALs have start codes or lengths."""
    prefixed, by_length = looks_length_prefixed(data)
    annexb, by_code = (False, []) if prefixed else looks_annexb(data)
    codec = codec_of(by_length if prefixed else by_code) if prefixed or annexb else "UNKNOWN"
    if codec == "LCEVC":
        return "LCEVC", "UNKNOWN", annexb, prefixed
    if codec != "UNKNOWN":
        return "ES", codec, annexb, prefixed
    return ("ES" if annexb or prefixed else "UNKNOWN"), "UNKNOWN", annexb, prefixed


def probe(df: DataFrame) -> DataFrame:
    """input_type, base_type, annexb and avcc of each file, from its first 4096 bytes."""
    head = df.select("stream_id", "length", F.substring("content", 1, PROBE_BYTES).alias("head"))
    head = head.withColumn("magic", magic(F.col("head"), F.col("length")))
    sure = head.filter("magic is not null").select("stream_id", F.col("magic").alias("input_type"), F.lit("UNKNOWN").alias("base_type"), F.lit(False).alias("annexb"), F.lit(False).alias("avcc"))
    guessed = _each(head.filter("magic is null"), lambda d: iter([elementary(d)]), "stream_id string, input_type string, base_type string, annexb boolean, avcc boolean", "head")
    return sure.unionByName(guessed)


def type_by_suffix(path: Column) -> Column:
    """input_type and base_type by file suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    kind, base = ({k: v[i] for k, v in enums.SUFFIXES.items()} for i in (0, 1))
    return F.struct(enums.name_of(kind, suffix).alias("input_type"), enums.name_of(base, suffix).alias("base_type"))


# Sources


def bin_frames(df: DataFrame) -> DataFrame:
    """Frames of BIN files, which must be Annex B."""

    def rows(content: bytes) -> Iterator[tuple]:
        for decode, presentation, data in containers.bin_blocks(content):
            if not bits.start_code(data):
                raise bits.StreamError(f"frame {decode} does not begin with a start code")
            yield decode, presentation, decode, DEPTH, len(data), data

    return _each(df, rows, ENH_FRAMES, "content")


def raw_frames(df: DataFrame) -> DataFrame:
    """Frames of raw enhancement files: a NAL each, with four-byte start codes, times counted."""

    def rows(content: bytes) -> Iterator[tuple]:
        for k, (_, n, data) in enumerate(bits.annexb_nals(content)):
            data = data if n == 4 else b"\0" + data
            yield k, k, k, 1, len(data), data

    return _each(df, rows, ENH_FRAMES, "content")


def ts_packets(df: DataFrame, pid: int = -1) -> DataFrame:
    """Packets of the video streams of transport streams; of one PID if given."""

    def rows(content: bytes) -> Iterator[tuple]:
        n: dict[int, int] = {}
        for track, codec, pts, dts, pos, data in containers.ts_packets(content):
            if pid in (-1, track):
                n[track] = n.get(track, -1) + 1
                yield track, codec, n[track], pts, dts, 1 / 90_000, pos, len(data), data

    return _each(df, rows, PACKETS, "content")


def mp4_packets(df: DataFrame) -> DataFrame:
    """Packets of the video tracks of MP4 files."""

    def rows(content: bytes) -> Iterator[tuple]:
        n: dict[int, int] = {}
        for track, codec, pts, dts, tick, pos, data in containers.mp4_packets(content):
            n[track] = n.get(track, -1) + 1
            yield track, codec, n[track], pts, dts, tick, pos, len(data), data

    return _each(df, rows, PACKETS, "content")


#: NAL types that begin an access unit when a slice came before: parameter sets, SEI and delimiters.
BEFORE_SLICES = {"H264": {6, 7, 8, 9}, "HEVC": {32, 33, 34, 35, 39}, "VVC": {14, 15, 16, 17, 20, 23}}
SLICES = {"H264": set(range(1, 6)), "HEVC": set(range(32)), "VVC": set(range(12))}


def _is_first_slice(nal: bytes, codec: str, head: bits.NalHeader) -> bool:
    """The first bit after the header tells the first slice of a picture: first_mb 0, or the first-slice flag."""
    return len(nal) > head.header_size and nal[head.header_size] >> 7 == 1


def es_packets(df: DataFrame, codec: str, fps: float = 25.0) -> DataFrame:
    """Access units of elementary streams; without times of its own, a stream's DTS and PTS count frames."""

    def rows(content: bytes) -> Iterator[tuple]:
        unit: list[bytes] = []
        start, sliced, n = 0, False, 0
        for at, _, nal in bits.annexb_nals(content):
            head = bits.annexb_header(nal, codec)
            if head and unit and sliced and (head.nal_type in BEFORE_SLICES[codec] or head.nal_type in SLICES[codec] and _is_first_slice(nal, codec, head)):
                data = b"".join(unit)
                yield 0, codec, n, n, n, 1 / fps, start, len(data), data
                unit, start, sliced, n = [], at, False, n + 1
            unit.append(nal)
            sliced |= bool(head) and head.nal_type in SLICES[codec]
        if unit:
            data = b"".join(unit)
            yield 0, codec, n, n, n, 1 / fps, start, len(data), data

    return _each(df, rows, PACKETS, "content")


def nals(packets: DataFrame) -> DataFrame:
    """NALs of packets, with start codes or four-byte lengths: number, offset, length, header fields, name and flags."""

    def rows(codec: str, index: int, data: bytes) -> Iterator[tuple]:
        if bits.start_code(data):
            found = [(at, len(nal), n, nal, bits.annexb_header(nal, codec)) for at, n, nal in bits.annexb_nals(data)]
        else:
            found = [(at - 4, len(nal) + 4, 0, nal, bits.bare_header(nal, codec)) for at, nal in containers.length_prefixed(data)]
        for k, (at, size, n, nal, head) in enumerate(found):
            enh = bits.annexb_header(nal, "LCEVC") if n else bits.bare_header(nal, "LCEVC")
            kind = head.nal_type if head else None
            messages, marked = 0, 0
            if head and kind in bits.SEI_TYPES.get(codec, ()):
                for t, _, _, body in bits.sei_payloads(bits.unescaped(nal[head.header_size :])[0]):
                    messages += 1
                    marked += t == 4 and len(body) >= 4 and body[:4] == enums.T35_HEADER
            yield index, codec, k, at, size, n, kind, head.layer_id if head else None, head.temporal_id_plus1 if head else None, enums.nal_name(codec, kind) if head else None, bool(enh and enh.nal_type in enums.ENH_FRAME_TYPE), messages, marked

    schema = "stream_id string, decode_index long, codec string, nal int, offset long, length long, start_code int, nal_type int, layer_id int, temporal_id_plus1 int, name string, is_enhancement boolean, sei_messages int, enhancement_sei int"
    return _each(packets.select("stream_id", "codec", "decode_index", "data"), rows, schema, "codec", "decode_index", "data")


def sei_frames(codec: str, data: bytes) -> Iterator[tuple[bytes, int]]:
    """Enhancement payload and wire size of each registered-user-data SEI of a packet."""
    units = [(n, nal) for _, n, nal in bits.annexb_nals(data)] if bits.start_code(data) else [(0, nal) for _, nal in containers.length_prefixed(data)]
    for n, nal in units:
        head = bits.annexb_header(nal, codec) if n else bits.bare_header(nal, codec)
        if head and head.nal_type in bits.SEI_TYPES.get(codec, ()):
            for kind, _, size, body in bits.sei_payloads(bits.unescaped(nal[head.header_size :])[0]):
                if kind == 4 and size >= 4 and body[:4] == enums.T35_HEADER:
                    yield body[4:], len(nal)


def in_band_frames(packets: DataFrame) -> DataFrame:
    """Enhancement frames inside the packets of a base stream: a NAL of their own, or inside an SEI message. The first
    one of a packet counts."""

    def rows(codec: str, index: int, pts: int, dts: int, data: bytes) -> Iterator[tuple]:
        annexb = bits.start_code(data)
        units = [nal for _, _, nal in bits.annexb_nals(data)] if annexb else [nal for _, nal in containers.length_prefixed(data)]
        for nal in units:
            head = bits.annexb_header(nal, "LCEVC") if annexb else bits.bare_header(nal, "LCEVC")
            if head and head.nal_type in enums.ENH_FRAME_TYPE:
                yield index, pts, dts, IN_BAND_DEPTH, len(nal), nal
                return
        for payload, wire in sei_frames(codec, data):
            yield index, pts, dts, IN_BAND_DEPTH, wire, payload
            return

    base = packets.filter(F.col("codec") != "LCEVC")
    return _each(base, rows, ENH_FRAMES, "codec", "decode_index", "pts", "dts", "data")


def separate_frames(packets: DataFrame, is_mp4: bool) -> DataFrame:
    """Enhancement frames of a track of their own: a packet each, with a PTS; in MP4 not Annex B."""
    own = packets.filter(F.col("codec") == "LCEVC")
    valid = F.when(F.col("pts").isNull(), F.raise_error(F.lit("an enhancement packet has no PTS"))).otherwise(F.col("data"))
    if is_mp4:
        coded = F.hex(F.substring("data", 1, 4)) == "00000001"
        valid = F.when(coded, F.raise_error(F.lit("an MP4 enhancement track is Annex B"))).otherwise(valid)
    return own.select("stream_id", "decode_index", "pts", F.coalesce("dts", "pts").alias("dts"), F.lit(DEPTH).alias("depth"), F.col("size").alias("wire_size"), valid.alias("data"))


def container_frames(packets: DataFrame, is_mp4: bool) -> DataFrame:
    return in_band_frames(packets).unionByName(separate_frames(packets, is_mp4))


def streams(packets: DataFrame) -> DataFrame:
    """The streams dimension: codec, role, seconds a tick and frame rate by the commonest step."""
    w = Window.partitionBy("stream_id", "track").orderBy("pts")
    steps = packets.withColumn("step", F.col("pts") - F.lag("pts").over(w))
    out = steps.groupBy("stream_id", "track", "codec", "tick").agg(F.mode("step").alias("step"), F.count("*").alias("n_packets"))
    role = F.when(F.col("codec") == "LCEVC", "enhancement").otherwise("base")
    return out.withColumn("role", role).withColumn("fps", F.try_divide(F.lit(1.0), F.col("step") * F.col("tick"))).drop("step")


def enh_config(df: DataFrame) -> DataFrame:
    """The enhancement decoder configuration of MP4 files as JSON; NALs in hex."""

    def rows(content: bytes) -> Iterator[tuple]:
        for lo, hi in containers.sample_boxes(content, b"lvcC"):
            yield (json.dumps(containers.enh_config(content[lo:hi]), default=bytes.hex),)

    return _each(df, rows, "stream_id string, config string", "content")


def open_frames(df: DataFrame, input_type: str, base_type: str = "UNKNOWN", pid: int = -1, fps: float = 25.0) -> tuple[DataFrame | None, DataFrame]:
    """Packets (None where the input has none of a base stream) and enhancement frames of files of one input type."""
    readers = {"TS": partial(ts_packets, pid=pid), "MP4": mp4_packets, "ES": partial(es_packets, codec=base_type, fps=fps)}
    if input_type == "BIN":
        return None, bin_frames(df)
    if input_type == "LCEVC":
        return None, raw_frames(df)
    if input_type == "WEBM":
        raise ValueError("WebM input is disabled")
    if input_type not in readers:
        raise ValueError(f"input type {input_type} is not supported")
    if input_type == "ES" and base_type not in ("H264", "HEVC", "VVC"):
        raise ValueError("an elementary stream needs a base type of H264, HEVC or VVC")
    packets = readers[input_type](df)
    return packets, container_frames(packets, input_type == "MP4")
