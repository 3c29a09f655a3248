"""The user's four commands as functions over DataFrames: analyze, extract, simulate_buffer and dump_au."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import __version__
from lamina.functions import bits, blocks, columns, enums
from lamina.operators import buffering, cadence, framing, pairing, sizes
from lamina.sources import readers, sinks
from lamina.workers import attach

LAYERS = "array<struct<plane:int,sublayer:string,coefficient_group:int,tile:int,rle_only_flag:boolean,size:long>>"
BLOCKS = f"stream_id string, frame_index long, block_index int, type string, size_type string, size long, fields string, layers {LAYERS}, error string"


def frame_payloads(frames: DataFrame) -> DataFrame:
    """Adds to frames with frame_index: nal_type, raw_size and the split blocks. A frame without a stop byte has none
    and rbsp_ok false; what cannot be split has an error."""

    attach(frames.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("kind", pa.int32()), ("size_type", pa.int32()), ("body", pa.binary())])
        for b in batches:
            kinds, sizes_, oks, found, errors = [], [], [], [], []
            for data in b["data"].to_pylist():
                start, payload, ok, parts, error = bits.enhancement_start(data), b"", False, [], None
                if start is None:
                    error = "it is no enhancement NAL"
                else:
                    payload, ok = bits.unescaped(data[start[1] :])
                    try:
                        parts = [{"kind": k, "size_type": t, "body": body} for k, t, _, body in blocks.split(payload)]
                    except bits.StreamError as e:
                        error = str(e)
                kinds.append(start and start[0])
                sizes_.append(len(payload))
                oks.append(ok)
                found.append(parts)
                errors.append(error)
            made = [pa.array(kinds, pa.string()), pa.array(sizes_, pa.int64()), pa.array(oks, pa.bool_()), pa.array(found, pa.list_(block)), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([b["stream_id"], b["frame_index"], pa.array([len(d) for d in b["data"].to_pylist()], pa.int64()), *made], names=["stream_id", "frame_index", "payload_size", "nal_type", "raw_size", "rbsp_ok", "blocks", "error"])

    schema = "stream_id string, frame_index long, payload_size long, nal_type string, raw_size long, rbsp_ok boolean, blocks array<struct<kind:int,size_type:int,body:binary>>, error string"
    return frames.select("stream_id", F.col("frame_index").cast("long").alias("frame_index"), "data").mapInArrow(run, schema)


def decode_blocks(frames: DataFrame, spec_tile_order: bool = False) -> DataFrame:
    """A row for each syntax block of frames (stream_id, frame_index in presentation order, data).

    Blocks say their own size, so frames are split in parallel; windows carry the latest global and picture blocks and
    the dithering flag forward; then all blocks are decoded in parallel."""
    split = frame_payloads(frames)
    failed = split.filter("error is not null").select("stream_id", "frame_index", F.lit(None).cast("int").alias("block_index"), *[F.lit(None).cast("string").alias(c) for c in ("type", "size_type")], F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("fields"), F.lit(None).cast(LAYERS).alias("layers"), "error")
    rows = split.select("stream_id", "frame_index", (F.col("nal_type") == "IDR").alias("is_idr"), F.posexplode("blocks").alias("block_index", "b")).select("*", "b.*").drop("b")
    by, order = ["stream_id"], ["frame_index", "block_index"]
    is_picture = F.col("kind") == 2
    plain = columns.byte_at(F.col("body"), F.lit(0)).bitwiseAND(128) != 0
    own = F.when(~plain, columns.byte_at(F.col("body"), F.lit(2)).bitwiseAND(1) == 1).when(F.col("is_idr"), F.lit(False))
    rows = framing.carried_forward(rows, by, order, F.when(F.col("kind") == 1, F.col("body")), "global_body")
    rows = framing.carried_forward(rows, by, order, F.when(is_picture, own), "dither")
    rows = rows.withColumn("dither", F.coalesce("dither", F.lit(False)))
    picture = F.when(is_picture, F.struct("body", "is_idr", "dither"))
    rows = framing.carried_forward(rows, by, order, picture, "picture")
    rows = rows.select("stream_id", "frame_index", "block_index", "kind", "size_type", "body", "is_idr", "dither", "global_body", "picture.body", F.col("picture.is_idr").alias("picture_is_idr"), F.col("picture.dither").alias("picture_dither")).toDF(
        "stream_id", "frame_index", "block_index", "kind", "size_type", "body", "is_idr", "dither", "global_body", "picture_body", "picture_is_idr", "picture_dither"
    )
    attach(rows.sparkSession)
    decoded = rows.mapInArrow(partial(_decode, spec_tile_order=spec_tile_order), BLOCKS)
    return decoded.unionByName(failed)


def _decode(batches: Iterator[pa.RecordBatch], spec_tile_order: bool) -> Iterator[pa.RecordBatch]:
    layer = pa.struct([("plane", pa.int32()), ("sublayer", pa.string()), ("coefficient_group", pa.int32()), ("tile", pa.int32()), ("rle_only_flag", pa.bool_()), ("size", pa.int64())])
    for b in batches:
        fields, layers, errors = [], [], []
        for r in b.to_pylist():
            try:
                out = blocks.decode(r["kind"], r["body"], r["global_body"], r["picture_body"], r["is_idr"], r["dither"], bool(r["picture_is_idr"]), bool(r["picture_dither"]), spec_tile_order)
                layers.append(out.get("layers"))
                fields.append(json.dumps(out))
                errors.append(None)
            except bits.StreamError as e:
                fields.append(None)
                layers.append(None)
                errors.append(str(e))
        names = pa.array([enums.BLOCK_TYPE[k] for k in b["kind"].to_pylist()])
        kinds = pa.array([enums.PAYLOAD_SIZE_TYPE.get(k) for k in b["size_type"].to_pylist()])
        size = pa.array([len(x) for x in b["body"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["stream_id"], b["frame_index"], b["block_index"], names, kinds, size, pa.array(fields, pa.string()), pa.array(layers, pa.list_(layer)), pa.array(errors, pa.string())], names=["stream_id", "frame_index", "block_index", "type", "size_type", "size", "fields", "layers", "error"])


def parse(frames: DataFrame, packets: DataFrame | None = None, base_frames: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """Frames in presentation order with sizes and their base frame.

    frames: enhancement frames of a source; packets: those of the container, for base sizes; base_frames: stream_id,
    pts, dts, type, width, height of decoded base frames, if there is a decoder's table of them. Without one, base
    packets stand for base frames of unknown type."""
    ordered = framing.in_presentation_order(frames, ["stream_id"], "pts", "decode_index").withColumnRenamed("presentation_index", "frame_index")
    ordered = framing.first_frames(ordered, limit)
    if base_frames is None and packets is not None:
        base = packets.filter("codec <> 'LCEVC'").select("stream_id", "pts", F.lit(" ? ").alias("base_type"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    elif base_frames is not None:
        base = base_frames.select("stream_id", "pts", F.col("type").alias("base_type"), "width", "height")
    else:
        base = None
    if packets is not None:
        by = sizes.remaining_by_dts(packets, frames, ["stream_id", "dts"], "size", "wire_size").select("stream_id", "dts", "total", "remaining")
        ordered = ordered.join(by, ["stream_id", "dts"], "left")
    else:
        ordered = ordered.withColumns({"total": F.col("wire_size"), "remaining": F.lit(0).cast("long")})
    if base is not None:
        ordered = pairing.pair_by_pts(ordered, base, ["stream_id", "pts"])
    else:
        ordered = pairing.without_base(ordered, {"base_type": "string", "width": "int", "height": "int"}).withColumn("status", F.lit("enh_only"))
    size = sizes.frame_sizes(F.octet_length("data").cast("long"), F.col("wire_size"), F.col("remaining"), F.col("total"), F.lit(packets is not None))
    return ordered.withColumn("sizes", size)


def limited(parsed: DataFrame, packets: DataFrame | None, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """What is read up to the last of the first frames: base frames and packets of later times are not."""
    if limit <= 0:
        return parsed, packets
    last = parsed.filter("status <> 'base_only'").groupBy("stream_id").agg(F.max("pts").alias("last_pts"))
    until = lambda df: df.join(last, "stream_id").filter(F.col("pts") <= F.col("last_pts")).drop("last_pts")
    return until(parsed), None if packets is None else until(packets)


def rates(packets: DataFrame | None, fps: float | None) -> DataFrame | None:
    """stream_id and fps of the base stream by its commonest step, where no rate is given."""
    if fps is not None or packets is None:
        return None
    return readers.streams(packets).filter("role = 'base'").groupBy("stream_id").agg(F.max("fps").alias("guessed_fps"))


def summarise(parsed: DataFrame, decoded: DataFrame, packets: DataFrame | None, fps: float | None, frames: DataFrame, guessed: DataFrame | None = None) -> DataFrame:
    """A row for each stream: counts, sizes, bitrates, and the cadence of its presentation times. The frame rate is the
    given one, else what the container's times tell."""
    enh = parsed.filter("status <> 'base_only'")
    n_base = F.count_if(F.col("status") != "enh_only")
    totals = parsed.groupBy("stream_id").agg(F.count_if(F.col("status") != "base_only").alias("frame_count"), n_base.alias("base_count"), F.sum(F.octet_length("data").cast("long")).alias("layer_size"))
    whole = (packets if packets is not None else frames.withColumnRenamed("wire_size", "size")).groupBy("stream_id").agg(F.sum("size").alias("total_size"))
    layers = decoded.filter("layers is not null").select("stream_id", F.explode("layers").alias("l")).select("stream_id", "l.sublayer", "l.size")
    levels = sizes.sublayer_bytes(layers, ["stream_id"], "sublayer", "size")
    pts = cadence.validate(enh, ["stream_id"], ["frame_index"], "pts")
    t = totals.join(whole, "stream_id", "left").join(levels, "stream_id", "left").join(pts, "stream_id", "left")
    if guessed is not None:
        t = t.join(guessed, "stream_id", "left")
    rate = columns.normalised_fps(F.lit(fps).cast("double") if guessed is None else F.col("guessed_fps"))
    out = sizes.summary(t, rate, F.coalesce("total_size", F.lit(0)), F.coalesce("layer_size", F.lit(0)), F.col("frame_count"), F.greatest("base_count", "frame_count"))
    return out.withColumn("framerate", rate).drop("guessed_fps").withColumn("synthetic_base", F.col("base_count") == 0)


def report(summary: DataFrame, parsed: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """The JSON report of each stream: version, summary and frames; blocks if decoded is given. base.index counts from 1,
    as in reports, while frame_index counts from 0."""
    whole = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    lcevc = F.struct("frame_count", "layer_size", "level_1_size", "level_2_size", "temporal_size", F.col("enh_bitrate").alias("layer_bitrate"))
    base = F.when(F.col("base_size") > 0, F.struct(F.col("base_count").alias("frame_count"), F.col("base_size").alias("layer_size"), F.col("enh_base_ratio").alias("lcevc_base_ratio"), F.col("base_bitrate").alias("layer_bitrate")))
    head = summary.select("stream_id", F.struct("framerate", lcevc.alias("lcevc"), base.alias("base"), F.struct("consistent", "interval_count").alias("pts")).alias("summary"))
    f = parsed.filter("status <> 'base_only'").join(frame_payloads(parsed.filter("data is not null")).select("stream_id", "frame_index", "nal_type", "raw_size", "payload_size"), ["stream_id", "frame_index"])
    base_frame = F.when(F.col("status") == "matched", F.struct((F.col("frame_index") + 1).alias("index"), F.col("base_type").alias("frame_type"), "dts", "pts", "height", "width", F.col("sizes.base").alias("base_size"), F.col("sizes.combined").alias("combined_size")))
    enh = [F.col("nal_type").alias("frame_type"), F.col("payload_size"), F.col("raw_size"), F.col("wire_size")]
    if decoded is not None:
        item = F.struct("block_index", F.concat(F.lit("{"), F.concat_ws(", ", F.concat(F.lit('"type": '), whole(F.array("type"))), F.concat(F.lit('"size": '), F.col("size").cast("string"))), F.lit(", "), F.substring(F.coalesce("fields", F.lit("{}")), F.lit(2), F.length(F.coalesce("fields", F.lit("{}"))))).alias("json"))
        lists = decoded.groupBy("stream_id", "frame_index").agg(F.sort_array(F.collect_list(item)).alias("items"))
        f = f.join(lists.select("stream_id", "frame_index", F.transform("items", lambda x: x["json"]).alias("blocks")), ["stream_id", "frame_index"], "left")
        enh.append(F.col("blocks"))
    frames = f.select("stream_id", "frame_index", F.struct(base_frame.alias("base"), F.struct(*enh).alias("lcevc")).alias("frame"))
    lists = frames.groupBy("stream_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "frame"))), lambda x: x["frame"]).alias("frames"))
    version = F.array(*[F.lit(int(v)) for v in __version__.split(".")])
    return head.join(lists, "stream_id", "left").select("stream_id", whole(F.struct(version.alias("version"), "summary", "frames")).alias("report"))


def summary_text(summary: DataFrame) -> DataFrame:
    """The summary of each stream as lines of name and value; what is not known is N/A."""
    said = lambda form, c: F.coalesce(F.format_string(form, c), F.lit("N/A"))
    known = lambda c, x: F.when(F.col(c).isNotNull(), x)
    has_base = F.col("base_size") > 0
    size = lambda c: said("%.0f kb", known(c, F.col(c) / 1000.0))
    bitrate = lambda c, also=F.lit(True): F.when(also & F.col(c).isNotNull(), F.format_string("%.0f kbps", F.col(c) / 1000.0)).otherwise("N/A")
    when_base = lambda x: F.when(has_base, x).otherwise("N/A")
    # Names of the lines, their order and units.
    lines = {
        "base_frame_count": when_base(F.col("base_count").cast("string")),
        "base_layer_framerate": F.when(F.col("framerate").isNotNull(), F.format_string("%.5f fps", "framerate")).otherwise("N/A"),
        "base_layer_bitrate": bitrate("base_bitrate", has_base),
        "base_layer_size": when_base(size("base_size")),
        "lcevc_frame_count": F.col("frame_count").cast("string"),
        "lcevc_layer_size": size("layer_size"),
        "  level_1_size": size("level_1_size"),
        "  level_2_size": size("level_2_size"),
        "  temporal_size": size("temporal_size"),
        "lcevc_bitrate": bitrate("enh_bitrate"),
        "lcevc_base_ratio": F.when(has_base & F.col("enh_base_ratio").isNotNull(), F.format_string("%.3f", "enh_base_ratio")).otherwise("N/A"),
        "pts_consistency": F.when(F.coalesce("consistent", F.lit(False)), "OK").otherwise("FAILED"),
        "pts_interval_count": F.coalesce(F.col("interval_count").cast("string"), F.lit("0")),
    }
    return summary.select("stream_id", F.concat_ws("\n", F.lit("stream_summary"), *[F.concat(F.lit(f"  {k:<24}"), v) for k, v in lines.items()]).alias("text"))


def frame_log(parsed: DataFrame) -> DataFrame:
    """A line of text for each frame."""
    f = parsed.filter("status <> 'base_only'")
    line = F.format_string("frame %d type %s pts %s dts %s enhancement %d base %d combined %d", F.col("frame_index"), F.coalesce("base_type", F.lit("-")), F.col("pts").cast("string"), F.col("dts").cast("string"), F.col("sizes.enh"), F.col("sizes.base"), F.col("sizes.combined"))
    return f.select("stream_id", "frame_index", line.alias("line"))


def open_path(spark: SparkSession, path: str, input_type: str | None = None, base_type: str | None = None, pid: int = -1, fps: float | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Packets and enhancement frames of files of one type: the given one, else by the path's suffix, else by probing."""
    files = readers.files(spark, path)
    suffix = "." + path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    kind, base = enums.SUFFIXES.get(suffix, (None, None))
    if input_type is None and kind is None or (input_type or kind) == "ES" and base_type is None and base not in enums.NAL_NAMES:
        found = readers.probe(files).select("input_type", "base_type").distinct().limit(2).collect()
        if len(found) != 1:
            raise ValueError("the files are not of one type; give it, or open them apart")
        kind, base = found[0]
    return readers.open_frames(files, (input_type or kind).upper(), (base_type or base or "UNKNOWN").upper(), pid, fps or 25.0)


def analyze(spark: SparkSession, path: str, verbose: bool = False, fps: float | None = None, frames: int = 0, base_frames: DataFrame | None = None, spec_tile_order: bool = False, **source) -> dict[str, DataFrame]:
    """packets (if any), frames, blocks, summary, log and report of the streams at path."""
    packets, enh = open_path(spark, path, fps=fps, **source)
    return analyze_frames(enh, packets, verbose, fps, frames, base_frames, spec_tile_order)


def analyze_frames(enh: DataFrame, packets: DataFrame | None = None, verbose: bool = False, fps: float | None = None, frames: int = 0, base_frames: DataFrame | None = None, spec_tile_order: bool = False) -> dict[str, DataFrame]:
    guessed = rates(packets, fps)
    parsed, packets = limited(parse(enh, packets, base_frames, frames), packets, frames)
    decoded = decode_blocks(parsed.filter("status <> 'base_only'"), spec_tile_order)
    summary = summarise(parsed, decoded, packets, fps, parsed.filter("data is not null") if frames > 0 else enh, guessed)
    out = {"frames": parsed, "blocks": decoded, "summary": summary, "text": summary_text(summary), "log": frame_log(parsed), "report": report(summary, parsed, decoded if verbose else None)}
    return out | ({"packets": packets} if packets is not None else {})


def config_mismatches(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """Profile and level of sequence blocks that differ from what MP4 files declare, once for each stream and pair."""
    declared = readers.enh_config(files)
    named = lambda names, key: enums.name_of(names, F.get_json_object("config", f"$.{key}").cast("int")).alias(key)
    coded = blocks.filter("type = 'SEQUENCE_CONFIG'").select("stream_id", *[F.get_json_object("fields", f"$.{key}_idc").alias(key) for key in ("profile", "level")])
    return pairing.check_config(coded.distinct(), declared.select("stream_id", named(enums.PROFILE, "profile"), named(enums.LEVEL, "level")))


def extract(spark: SparkSession, path: str, output: str, fmt: str | None = None, **source) -> DataFrame:
    """Writes the enhancement frames of each stream to a file in a folder, in decode order. Without a format the folder's
    suffix tells it (out.bin, out.lvc), else it is BIN."""
    _, enh = open_path(spark, path, **source)
    suffix = "." + output.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return sinks.write_frames(enh, output, fmt or sinks.SUFFIX_FORMATS.get(suffix, "BIN"))


def simulate_buffer(spark: SparkSession, path: str, model: str | DataFrame, sample_interval: float = 0.005, time_base: float | None = None, fps: float | None = None, **source) -> dict[str, DataFrame]:
    """Frames, levels and plot points of the buffers, and all as JSON; model is a JSON file or a table of buffer, fill_bitrate, size and
    initial_fill. Buffers without a valid model are left out."""
    packets, enh = open_path(spark, path, fps=fps, **source)
    parsed = parse(enh, packets).filter("status <> 'base_only'")
    f = parsed.select("stream_id", "frame_index", "pts", F.col("sizes.combined").alias("combined"), F.col("sizes.base").alias("base"), F.col("sizes.enh").alias("enhancement"))
    models = read_model(spark, model) if isinstance(model, str) else model
    seconds = F.lit(time_base or 1 / (fps or 25.0))
    if packets is None:
        models = models.filter("buffer <> 'base'")
    elif time_base is None:  # times are in the container's ticks; only raw streams count frames
        f = f.join(packets.groupBy("stream_id").agg(F.min("tick").alias("tick")), "stream_id", "left")
        seconds = columns.time_base(F.lit(fps or 25.0), F.col("tick"))
    out = buffering.simulate(f, models, seconds, sample_interval)
    return out | {"json": buffering.simulation_json(out, models, sample_interval)}


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """The buffer model of a JSON file; what it lacks is 0."""
    one = "struct<fillBitRate:double,size:double,initialFill:double>"
    m = spark.read.schema(f"combined {one}, base {one}, enhancement {one}").option("multiLine", True).json(path)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = [F.struct(F.lit(b).alias("buffer"), zero(F.col(f"{b}.fillBitRate")).alias("fill_bitrate"), zero(F.col(f"{b}.size")).alias("size"), zero(F.col(f"{b}.initialFill")).alias("initial_fill")) for b in ("combined", "base", "enhancement")]
    return m.select(F.explode(F.array(*parts)).alias("m")).select("m.*")


def dump_au(spark: SparkSession, path: str, output: str, **source) -> dict[str, DataFrame]:
    """Writes every packet to a file of its own; returns files, nals, and sizes: packets whose NALs do not add up."""
    packets, _ = open_path(spark, path, **source)
    if packets is None:
        raise ValueError("this input has no packets of a base stream")
    found = readers.nals(packets)
    added = found.groupBy("stream_id", "decode_index").agg(F.sum("length").alias("added"))
    wrong = packets.select("stream_id", "decode_index", "size").join(added, ["stream_id", "decode_index"], "left").filter(~F.col("size").eqNullSafe(F.col("added")))
    return {"files": sinks.dump_units(packets, output), "nals": found, "sizes": wrong}
