"""Sources and sinks over made files; joins, reordering and simulation against plain loops."""

import json
import os
import random

import pytest
from lamina.functions import bits, columns
from lamina.operators import buffering, framing, pairing, sizes
from lamina.plans import analyze, fixtures
from lamina.sources import containers, readers, sinks
from lamina.streaming import reorder
from pyspark.sql import functions as F

H = bytes.fromhex
T35 = H("B4005000")


def sei_nal(codec, payload):
    """An SEI NAL with one registered-user-data message."""
    head = {"H264": H("06"), "HEVC": H("4E01"), "VVC": H("00B9")}[codec]
    body = T35 + payload
    size = b"\xff" * (len(body) // 255) + bytes([len(body) % 255])
    return head + fixtures.escaped(b"\x04" + size + body)


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def u32(*xs):
    return b"".join((x & 0xFFFFFFFF).to_bytes(4, "big") for x in xs)


LVCC = H("010104" + "4A" + "C0") + u32(1920, 1080) + H("A0") + H("01") + H("1B") + H("0001") + H("0003AABBCC")


def mp4_file(samples, codec=b"avc1", shift=None):
    """One track of one chunk."""
    ftyp = box(b"ftyp", b"isom", u32(512), b"isomavc1")
    shift = shift or [0] * len(samples)
    at = len(ftyp) + 8
    stbl = box(
        b"stbl",
        box(b"stsd", u32(0, 1), box(codec, bytes(78), box(b"lvcC", LVCC))),
        box(b"stts", u32(0, 1, len(samples), 512)),
        box(b"ctts", u32(0, len(samples)), *[u32(1, s) for s in shift]),
        box(b"stsc", u32(0, 1, 1, len(samples), 1)),
        box(b"stsz", u32(0, 0, len(samples), *map(len, samples))),
        box(b"stco", u32(0, 1, at)),
    )
    trak = box(b"trak", box(b"mdia", box(b"mdhd", u32(0, 0, 0, 12800, 0, 0)), box(b"minf", stbl)))
    return ftyp + box(b"mdat", *samples) + box(b"moov", trak)


def ts_file(units, stream_type=0x1B, pid=256):
    """Packets of PAT, PMT and one PES a unit of (pts, dts, data)."""

    def packet(pid, body, start, n):
        room = 184 - len(body)
        head = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255])
        if not room:
            return head + bytes([0x10 | n % 16]) + body
        stuffing = bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
        return head + bytes([0x30 | n % 16]) + stuffing + body

    def section(table, body):
        whole = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + H("0001C10000") + body + bytes(4)
        return b"\0" + whole + b"\xff" * (183 - len(whole))

    def stamp(mark, t):
        return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])

    out = packet(0, section(0, H("0001") + (0xE000 | 4096).to_bytes(2, "big")), True, 0)
    out += packet(4096, section(2, (0xE000 | pid).to_bytes(2, "big") + H("F000") + bytes([stream_type]) + (0xE000 | pid).to_bytes(2, "big") + H("F000")), True, 0)
    n = 0
    for pts, dts, data in units:
        pes = b"\0\0\1\xe0\0\0" + H("80C00A") + stamp(3, pts) + stamp(1, dts) + data
        for k in range(0, len(pes), 184):
            out += packet(pid, pes[k : k + 184], k == 0, n)
            n += 1
    return out


BASE = {"H264": (b"\0\0\0\1" + H("6764"), b"\0\0\0\1" + H("6588AA"), b"\0\0\0\1" + H("4188BB")), "HEVC": (b"\0\0\0\1" + H("4001"), b"\0\0\0\1" + H("2601AF"), b"\0\0\0\1" + H("0201D0"))}


@pytest.mark.parametrize("codec", ["H264", "HEVC"])
def test_elementary_stream(spark, codec):
    sets, idr, inter = BASE[codec]
    enh = [fixtures.nal(b"\x40" + bytes([k, 0x77]))[4:] for k in range(3)]
    data = b"".join((sets if k == 0 else b"") + b"\0\0\0\1" + sei_nal(codec, enh[k]) + (idr if k == 0 else inter) for k in range(3))
    packets, frames = readers.open_frames(readers.from_bytes(spark, {"x": data}), "ES", codec)
    p = packets.orderBy("decode_index").collect()
    assert len(p) == 3 and b"".join(r["data"] for r in p) == data
    f = frames.orderBy("decode_index").collect()
    assert [bytes(r["data"]) for r in f] == enh and [r["pts"] for r in f] == [0, 1, 2]
    n = readers.nals(packets).filter("enhancement_sei > 0").collect()
    assert len(n) == 3 and {r["sei_messages"] for r in n} == {1}
    assert readers.nals(packets).agg(F.sum("length")).first()[0] == len(data)
    with pytest.raises(ValueError):
        readers.open_frames(packets, "ES", "VP8")
    with pytest.raises(ValueError):
        readers.open_frames(packets, "WEBM")


def test_mp4(spark):
    enh = [fixtures.nal(b"\x40" + bytes([k, 0x77]))[4:] for k in range(4)]
    samples = [u32(3) + H("6588AA") + u32(len(e)) + e for e in enh]
    df = readers.from_bytes(spark, {"a.mp4": mp4_file(samples, shift=[512, 1536, 0, 512])})
    packets, frames = readers.open_frames(df, "MP4")
    assert [r["pts"] for r in packets.orderBy("decode_index").collect()] == [512, 2048, 1024, 2048]
    assert [bytes(r["data"]) for r in frames.orderBy("decode_index").collect()] == enh
    s = readers.streams(packets).first()
    assert s["role"] == "base" and s["n_packets"] == 4
    config = json.loads(readers.enh_config(df).first()["config"])
    assert config["width"] == 1920 and config["bit_depth_luma"] == 9 and config["length_size"] == 4 and config["arrays"] == [{"nal_type": 27, "nals": ["aabbcc"]}]
    assert (config["sc_in_stream"], config["gc_in_stream"], config["ai_in_stream"]) == (True, False, True)
    own = readers.open_frames(readers.from_bytes(spark, {"b.mp4": mp4_file([u32(len(e)) + e for e in enh], b"lvc1")}), "MP4")[1]
    assert own.count() == 4 and {r["depth"] for r in own.collect()} == {32}
    bad = readers.open_frames(readers.from_bytes(spark, {"b.mp4": mp4_file([b"\0\0\0\1" + e for e in enh], b"lvc1")}), "MP4")[1]
    with pytest.raises(Exception, match="Annex B"):
        bad.collect()


def test_ts(spark):
    units = [(90000 + 3600 * (k ^ 1), 90000 + 3600 * k, b"\0\0\0\1" + H("6588") + bytes([k + 1]) * 300 + b"\0\0\0\1" + sei_nal("H264", H("7BFF40AA80"))) for k in range(4)]
    df = readers.from_bytes(spark, {"a.ts": ts_file(units)})
    assert readers.probe(df).first()["input_type"] == "TS"
    packets = readers.ts_packets(df)
    assert [(r["pts"], r["dts"], bytes(r["data"])) for r in packets.orderBy("decode_index").collect()] == units
    assert readers.ts_packets(df, 256).count() == 4 and readers.ts_packets(df, 257).count() == 0
    assert readers.container_frames(packets, False).count() == 4
    own = readers.ts_packets(readers.from_bytes(spark, {"b.ts": ts_file(units, 0x36)}))
    assert readers.separate_frames(own, False).count() == 4


def test_config_mismatches(spark):
    enh = [fixtures.nal(fixtures.SEQUENCE + fixtures.GLOBAL + fixtures.PICTURE + fixtures.encoded({1: b"\xaa"}, 32))[4:]]
    df = readers.from_bytes(spark, {"a.mp4": mp4_file([u32(3) + H("6588AA") + u32(len(e)) + e for e in enh])})
    packets, frames = readers.open_frames(df, "MP4")
    blocks = analyze.analyze_frames(frames, packets)["blocks"]
    row = analyze.config_mismatches(df, blocks).first()  # the box says profile 1, level 4
    assert (row["container_profile"], row["container_level"]) == ("MAIN_444", "LEVEL_4") and row["profile"] == "MAIN"


def test_small_columns(spark):
    df = spark.createDataFrame([("YUV", "TRANSFORM_4X4", 9), ("Y", "TRANSFORM_2X2", 20)], "p string, t string, d int")
    got = df.select(columns.plane_count(F.col("p")), columns.group_count(F.col("t")), columns.tu_size(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(3, 16, 4), (1, 4, 2)]
    assert df.agg(sizes.reorder_depth(F.col("d"))).first()[0] == 20 and df.filter("d < 10").agg(sizes.reorder_depth(F.col("d"))).first()[0] == 16
    big = (1 << 60) + 1
    assert spark.range(1).select(columns.ceil_div(F.lit(big), F.lit(2))).first()[0] == (big + 1) // 2


def test_ts_with_losses(spark):
    """A map that reaches over two packets, and bytes lost in the middle of the file."""
    units = [(9000 * k, 9000 * k, BASE["H264"][1] + bytes([k + 1]) * 20) for k in range(6)]
    whole = ts_file(units)
    stream = b"".join(bytes([0x06]) + (0xE000 | 300 + k).to_bytes(2, "big") + H("F000") for k in range(40)) + bytes([0x1B]) + (0xE000 | 256).to_bytes(2, "big") + H("F000")
    body = (0xE000 | 256).to_bytes(2, "big") + H("F000") + stream
    section = b"\0" + bytes([2]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + H("0001C10000") + body + bytes(4)
    maps = b""
    for k in range(0, len(section), 184):
        maps += bytes([0x47, (0x40 if k == 0 else 0) | 0x10, 0, 0x10 | k // 184]) + section[k : k + 184].ljust(184, b"\xff")
    assert len(maps) == 376
    long = whole[:188] + maps + whole[376:]
    assert [p[-1] for p in containers.ts_packets(long)] == [u[2] for u in units]
    lost = long[: 188 * 5 + 40] + long[188 * 5 + 43 :]
    got = [p[2] for p in containers.ts_packets(lost)]
    assert set(got) >= {0, 9000, 36000, 45000} and len(got) >= 4


def test_raw_and_commands(spark, tmp_path):
    nals = [fixtures.frame(k) for k in range(6)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.lvc").write_bytes(nals[0] + b"".join(n[1:] for n in nals[1:]))
    path, uri = f"file://{tmp_path}/in/a.lvc", f"file://{tmp_path}/out"
    for fmt in sinks.FORMATS:
        done = analyze.extract(spark, path, f"{uri}-{fmt}", fmt).collect()
        data = (tmp_path / f"out-{fmt}" / done[0]["file"]).read_bytes()
        assert done[0]["frames"] == 6 and done[0]["bytes"] + (12 if fmt == "BIN" else 0) == len(data)
        if fmt == "BIN":
            assert [d for _, _, d in containers.bin_blocks(data)] == nals
        elif fmt == "RAW":
            assert data == b"".join(nals)
        else:
            assert sinks.read_delimited(data) == nals
    out = analyze.analyze(spark, path, fps=25, frames=4)
    assert out["frames"].count() == 4 and out["blocks"].filter("error is not null").count() == 0
    (tmp_path / "m.json").write_text(json.dumps({b: {"fillBitRate": 8000.0, "size": 500.0, "initialFill": 0.5} for b in ("combined", "base", "enhancement")}))
    sim = analyze.simulate_buffer(spark, path, f"file://{tmp_path}/m.json", fps=25)
    assert {r["buffer"] for r in sim["frames"].select("buffer").distinct().collect()} == {"combined", "enhancement"}
    ts = tmp_path / "in" / "b.ts"
    ts.write_bytes(ts_file([(9000 * k, 9000 * k, BASE["H264"][1]) for k in range(3)]))
    dumped = analyze.dump_au(spark, f"file://{ts}", f"file://{tmp_path}/au")
    assert dumped["files"].count() == 3 and dumped["sizes"].count() == 0 and len(os.listdir(tmp_path / "au")) == 3
    assert dumped["nals"].first()["name"] == "IDR_SLICE"


def test_container_times(spark, tmp_path):
    """A transport stream of 25 frames a second: times, rate and limit follow the container."""
    units = [(90000 + 3600 * k, 90000 + 3600 * k, b"\0\0\0\1" + H("6588") + bytes([k + 1]) * 300 + b"\0\0\0\1" + sei_nal("H264", H("7BFF40AA80"))) for k in range(6)]
    (tmp_path / "c.ts").write_bytes(ts_file(units))
    path = f"file://{tmp_path}/c.ts"
    whole = analyze.analyze(spark, path)
    row = whole["summary"].first()
    assert row["framerate"] == pytest.approx(25) and row["enh_bitrate"] > 0 and row["base_bitrate"] > 0 and row["frame_count"] == row["base_count"] == 6
    text = whole["text"].first()["text"].split("\n")
    assert text[0] == "stream_summary" and [x.split()[1] for x in text if "count" in x] == ["6", "6", "1"] and any("25.00000 fps" in x for x in text)
    two = analyze.analyze(spark, path, frames=2)
    some = two["summary"].first()
    assert (some["frame_count"], some["base_count"], two["frames"].count(), two["packets"].count()) == (2, 2, 2, 2)
    assert some["total_size"] * 3 == row["total_size"] and some["framerate"] == pytest.approx(25)
    (tmp_path / "m.json").write_text(json.dumps({b: {"fillBitRate": 8000.0, "size": 500.0, "initialFill": 0.5} for b in ("combined", "base", "enhancement")}))
    sim = analyze.simulate_buffer(spark, path, f"file://{tmp_path}/m.json")
    times = sorted({r["release"] for r in sim["frames"].collect()})
    assert times == pytest.approx([0.25 + 0.04 * k for k in range(6)])
    said = json.loads(sim["json"].first()["json"])
    assert said["timing"]["stepDuration"] == 0.005 and said["timing"]["frameRelease"] == pytest.approx(times)
    assert said["base"]["model"] == {"fillBitRate": 8000.0, "size": 500.0, "initialFill": 0.5} and len(said["combined"]["level"]) == 6
    assert len(said["base"]["plotTimes"]) == len(said["base"]["plotValues"]) >= said["timing"]["samples"]


def test_remaining_and_sizes(spark):
    p = spark.createDataFrame([("s", 0, 100), ("s", 0, 50), ("s", 1, 70), ("s", 2, 5)], "stream_id string, dts long, size long")
    e = spark.createDataFrame([("s", 0, 30), ("s", 2, 9)], "stream_id string, dts long, wire_size long")
    out = {r["dts"]: (r["total"], r["remaining"], r["failed"]) for r in sizes.remaining_by_dts(p, e, ["stream_id", "dts"], "size", "wire_size").collect()}
    assert out == {0: (150, 120, False), 1: (70, 70, False), 2: (5, -4, True)}


def test_pairing(spark):
    enh = spark.createDataFrame([("s", 0, 10, 0), ("s", 2, 30, 2), ("s", 3, 40, 3)], "stream_id string, decode_index long, pts long, id long")
    base = spark.createDataFrame([("s", 10, 0), ("s", 20, 1), ("s", 30, 2), ("s", 50, 9)], "stream_id string, pts long, base_id long")
    status = {r["pts"]: r["status"] for r in pairing.pair_by_pts(enh, base, ["stream_id", "pts"]).collect()}
    assert status == {10: "matched", 20: "base_only", 30: "matched", 40: "enh_only", 50: "base_only"}
    got = pairing.replayed(enh, base.withColumnRenamed("base_id", "id"), 1).collect()
    assert {(r["enh_id"], r["base_id"]) for r in got} >= {(0, 0)}
    same = [(10 * (k ^ 1), k) for k in range(8)]
    assert list(pairing.merge_replay(same, [(p, i) for p, i in same], 3)) == [(i, i) for _, i in sorted(same)]
    assert pairing.duplicates(enh.union(enh), ["stream_id", "pts"]).count() == 3


def loop(release, size, fill, step, n_steps):
    """The simulation step by step."""
    level, k, left, levels = 0.0, 0, [None] * len(size), []
    for s in range(n_steps):
        levels.append(level)
        if k < len(size) and release[k] <= s * step:
            level -= size[k]
            left[k] = level
            k += 1
        level += fill
    return left, levels


def test_simulation(spark):
    r = random.Random(2)
    frames = [("a", k, 5 * k + r.randint(0, 4), r.randint(1, 300)) for k in range(40)] + [("b", k, k, r.randint(1, 90)) for k in range(25)]
    df = spark.createDataFrame([(s, k, p, c, c // 2, c - c // 2) for s, k, p, c in frames], "stream_id string, frame_index long, pts long, combined long, base long, enhancement long")
    models = spark.createDataFrame([("combined", 8000.0, 900.0, 0.5), ("base", 4000.0, 400.0, 0.2), ("enhancement", 2000.0, 300.0, 0.1)], "buffer string, fill_bitrate double, size double, initial_fill double")
    out = buffering.simulate(df, models, 0.04, 0.005)
    rows = {k: v.collect() for k, v in out.items()}
    for s in "ab":
        mine = [f for f in frames if f[0] == s]
        release = [900 * 0.5 * 8 / 8000 + (f[2] - mine[0][2]) * 0.04 for f in mine]
        n = -int(-release[-1] // 0.005) + 1
        for buffer, rate, share in (("combined", 8000, lambda c: c), ("base", 4000, lambda c: c // 2), ("enhancement", 2000, lambda c: c - c // 2)):
            left, levels = loop(release, [share(f[3]) for f in mine], rate * 0.005 / 8, 0.005, n)
            got = sorted((x for x in rows["frames"] if (x["stream_id"], x["buffer"]) == (s, buffer)), key=lambda x: x["frame_index"])
            assert [x["frame_level"] for x in got] == pytest.approx(left, abs=1e-6)
            steps = sorted((x for x in rows["levels"] if (x["stream_id"], x["buffer"]) == (s, buffer)), key=lambda x: x["step"])
            assert [x["level"] for x in steps] == pytest.approx(levels, abs=1e-6)
    assert len(rows["plot"]) == len(rows["levels"]) + sum(x["released"] for x in rows["frames"])


def test_scalar_steps():
    assert [buffering.step_count(*x) for x in ((0, 1), (0.5, -1), (1, 0.5), (0.4, 1))] == [None, None, None, 4]
    assert [buffering.fill_per_step(*x) for x in ((0, 1000), (0.1, 0), (0.25, 8000))] == [None, None, 250]


def test_made_simulation(spark):
    """Three frames, of which the last is not released in time: one leaves a step."""
    df = spark.createDataFrame([("s", k, n, s) for k, (n, s) in enumerate([(2, 100), (3, 150), (3, 50)])], "s string, k0 long, need long, size long")
    out = buffering.released(df, ["s"], ["k0"], F.col("need"), F.col("size"), F.lit(250), F.lit(4)).orderBy("k0").collect()
    assert [r["frame_level"] for r in out] == [400, 500, None]
    levels = buffering.step_levels(spark.createDataFrame([("s", 4)], "s string, n_steps long"), spark.createDataFrame([("s", 2, 100), ("s", 3, 150)], "s string, release_step long, size long"), ["s"], "size", F.lit(250))
    assert [r["level"] for r in levels.orderBy("step").collect()] == [0, 250, 500, 650]


def test_streaming_reorder(spark, tmp_path):
    r = random.Random(4)
    frames = [(s, k, 10 * (k + r.randint(-3, 3)) + r.randint(0, 3)) for s in ("a", "b") for k in range(60)]
    schema = "stream_id string, decode_index long, pts long"
    for n in range(0, 60, 20):
        spark.createDataFrame([f for f in frames if n <= f[1] < n + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # one file a batch, in order
    got = reorder.run_files(spark, f"{tmp_path}/in", schema, 8, f"file://{tmp_path}/cp").collect()
    batch = reorder.reorder_batch(spark.createDataFrame(frames, schema), 8).collect()
    assert len(batch) == len(got) == 120
    for s in "ab":
        order = lambda rows: [x["decode_index"] for x in sorted((x for x in rows if x["stream_id"] == s), key=lambda x: x["presentation_index"])]
        assert order(got) == order(batch)[: len(order(got))]
    late = framing.with_monotonic_flag(spark.createDataFrame(frames, schema), ["stream_id"], ["decode_index"], "pts")
    assert late.filter("is_late").count() > 0
    assert bits.sei_payloads(b"\x04\x05ab") == [(4, 2, 5, b"ab")]
