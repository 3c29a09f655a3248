"""Block decoders against an encoder, and the two-pass plan against serial decoding."""

import json

import pytest
from lamina.functions import bits, blocks
from lamina.functions.bits import Reader, StreamError
from lamina.plans import analyze, fixtures
from lamina.plans.fixtures import BitWriter, block, varint
from lamina.sources import containers, readers
from pyspark.sql import functions as F

H = bytes.fromhex
PAYLOAD = H("4002008135404880620200C8E30C800000000000000003AABBCC")
WIRE = H("000000017BFF4002008135404880620200C8E30C800000030000030000030003AABBCC80")


def test_the_made_frame():
    assert fixtures.nal(PAYLOAD) == WIRE
    kind, at = bits.enhancement_start(WIRE)
    assert (kind, bits.unescaped(WIRE[at:])) == ("IDR", (PAYLOAD, True))
    parts = blocks.split(PAYLOAD)
    assert [p[0] for p in parts] == [0, 1, 2, 3]
    seq, glob, pic, enc = (p[3] for p in parts)
    assert blocks.decode(0, seq, None, None, True, False)["level_idc"] == "LEVEL_2"
    g = blocks.decode(1, glob, None, None, True, False)
    assert (g["transform_type"], g["_resolution"], g["chroma_sampling_type"], g["upsample_type"], g["temporal_enabled_flag"], g["scaling_mode_level2"], g["planes_type"]) == ("TRANSFORM_4X4", [1920, 1080], "CHROMA_420", "LINEAR", True, "SCALING_2D", "Y")
    p = blocks.decode(2, pic, glob, None, True, False)
    assert p["temporal_refresh_bit_flag"] and p["step_width_sublayer2"] == 100 and not p["temporal_signalling_present_flag"]
    e = blocks.decode(3, enc, glob, pic, True, False, True, False)
    assert e["layers"] == [{"plane": 0, "sublayer": "SUBLAYER_1", "coefficient_group": 0, "rle_only_flag": False, "entropy_enabled_flag": True, "size": 3}]
    assert e["_surface_header_bytes"] == 8
    with pytest.raises(StreamError):
        blocks.decode(3, enc, None, pic, True, False)
    with pytest.raises(StreamError):
        blocks.split(H("C0"))


def test_sequence_options():
    out = blocks.sequence(Reader(H("FF20") + H("A6") + varint(1) + varint(300) + varint(2) + varint(70000)))
    assert out["extended"] == {"extended_profile_idc": 5, "extended_level_idc": 3}
    assert out["conf_win"] == {"conf_win_left_offset": 1, "conf_win_right_offset": 300, "conf_win_top_offset": 2, "conf_win_bottom_offset": 70000}


def test_global_options():
    w = BitWriter()
    for v, n in ((1, 1), (63, 6), (0, 1), (1, 2), (0, 2), (1, 2), (1, 1), (0, 1), (0, 1), (1, 1), (4, 3), (1, 1), (2, 2), (1, 2), (3, 2), (2, 2), (1, 1), (1, 1)):
        w.put(v, n)
    for v, n in ((1, 4), (0, 4), (9, 8), (1, 16), (2, 16), (3, 16), (4, 16), (5, 4), (6, 4), (128, 16), (64, 16), (0, 5), (1, 1), (2, 2), (1000, 16), (600, 16), (77, 8)):
        w.put(v, n)
    g = blocks.global_(Reader(w.bytes()))
    assert g["planes_type"] == "YUV" and g["temporal_step_width_modifier"] == 9 and g["adaptive_cubic_kernel_coeffs"] == [1, 2, 3, 4]
    assert g["level1_filtering"] == [5, 6] and g["custom_tile"] == [128, 64] and g["_resolution"] == [1000, 600] and g["chroma_step_width_multiplier"] == 77
    assert g["compression_type"] == {"compression_type_entropy_enabled_per_tile_flag": "RUN_LENGTH_ENCODING", "compression_type_size_per_tile": "PREFIX_CODING_ON_DIFFERENCES"}
    assert blocks.tile_totals(g) == (8 * 10, 4 * 10)


def test_picture_options():
    g = {"transform_type": "TRANSFORM_2X2", "temporal_enabled_flag": True}
    body = BitWriter().put(0, 1).put(5, 3).put(1, 1).put(1, 1).put(0, 1).put(1, 1).put(300, 15).put(1, 1).put(1, 1).put(0, 7).put(50, 15).put(1, 1).bytes() + bytes(range(8)) + H("85") + H("47")
    p = blocks.picture(Reader(body), g, False, False)
    assert p["field_type_bit_flag"] == "BOTTOM" and p["step_width_sublayer1"] == {"step_width_sublayer1": 50, "level1_filtering_enabled_flag": True}
    assert p["qm_coefficient_0"] == [0, 1, 2, 3] and p["qm_coefficient_1"] == [4, 5, 6, 7] and p["temporal_signalling_present_flag"]
    assert p["dequant_offset"] == {"dequant_offset_mode_flag": True, "dequant_offset": 5} and p["dithering"] == {"dithering_type": "UNIFORM", "dithering_strength": 7}
    plain = lambda idr, last: blocks.picture(Reader(H("8100")), g, idr, last)["dithering_control_flag"]
    assert (plain(True, True), plain(False, True), plain(False, False)) == (False, True, False)


def prefix_sizes(sizes, differences):
    """An encoder of sizes: all 256 symbols in both tables, eight bits each, numbered by rising symbol."""
    w = BitWriter()
    for _ in range(2):
        w.put(8, 5).put(8, 5).put(1, 1)
        for _ in range(256):
            w.put(1, 1)
    last = 0
    for s in sizes:
        v, last = (s - last, s) if differences else (s, s)
        if differences and -64 <= v < 64 or not differences and v < 128:
            w.put((v & 127) << 1, 8)
        else:
            v &= 0x7FFF
            w.put((v & 127) << 1 | 1, 8).put(v >> 7, 8)
    return w.bytes()


@pytest.mark.parametrize("differences", [False, True])
def test_packed_sizes(differences):
    sizes = [3, 200, 5, 5, 16000, 10]
    r = Reader(prefix_sizes(sizes, differences) + b"rest")
    assert blocks.packed_sizes(r, len(sizes), differences) == sizes and r.take(4) == b"rest"


def test_prefix_table_of_unequal_lengths():
    """Three symbols: the longest codes count up from 0 by symbol, the short one goes on above them."""
    w = BitWriter().put(1, 5).put(2, 5).put(0, 1).put(3, 5)
    for symbol, length in ((7, 1), (4, 2), (9, 2)):
        w.put(symbol, 8).put(length - 1, 1)
    r = Reader(w.put(1, 1).put(0, 2).put(1, 2).bytes())
    t = blocks.PrefixTable(r)
    assert [t.read(r) for _ in range(3)] == [7, 4, 9]
    assert blocks.PrefixTable(Reader(BitWriter().put(0, 5).put(0, 5).put(42, 8).bytes())).read(Reader(b"")) == 42


@pytest.mark.parametrize("mode", ["NONE", "PREFIX_CODING", "PREFIX_CODING_ON_DIFFERENCES"])
@pytest.mark.parametrize("runs", [False, True])
@pytest.mark.parametrize("spec", [False, True])
def test_tiled(mode, runs, spec):
    g = {"transform_type": "TRANSFORM_2X2", "planes_type": "Y", "tile_dimensions_type": "TILE_512X256", "custom_tile": None, "_resolution": [1920, 1080], "scaling_mode_level2": "SCALING_2D"}
    g["compression_type"] = {"compression_type_entropy_enabled_per_tile_flag": "RUN_LENGTH_ENCODING" if runs else "DISABLED", "compression_type_size_per_tile": mode}
    pic = {"no_enhancement_bit_flag": False, "temporal_signalling_present_flag": True}
    tiles = {1: 6, 2: 20, 3: 20} if spec else {1: 20, 2: 6, 3: 20}
    todo = blocks.chunks(g, pic)
    on = {(c, t): 1 + (7 * c + t) % 40 for c, (_, sub, _) in enumerate(todo) for t in range(tiles[sub]) if (c + t) % 3 == 0}
    flags = [int((c, t) in on) for c, (_, sub, _) in enumerate(todo) for t in range(tiles[sub])]
    body = BitWriter()
    for _ in todo:
        body.put(1, 1)
    data = body.bytes()
    if runs:
        data += bytes([flags[0]])
        k = 0
        while k < len(flags):
            n = next((i for i in range(k, len(flags)) if flags[i] != flags[k]), len(flags)) - k
            data += varint(n)
            k += n
    else:
        w = BitWriter()
        for f in flags:
            w.put(f, 1)
        data += w.bytes()
    for c, (_, sub, _) in enumerate(todo):
        sizes = [on[c, t] for t in range(tiles[sub]) if (c, t) in on]
        if mode != "NONE" and sizes:
            data += prefix_sizes(sizes, mode.endswith("DIFFERENCES"))
        data += b"".join((varint(s) if mode == "NONE" else b"") + bytes(s) for s in sizes)
    r = Reader(data)
    out = blocks.tiled(r, g, pic, spec)
    assert not len(r) and (out["_level2_tile_count"], out["_level1_tile_count"]) == (20, 6)
    assert [(x["tile"], x["size"]) for x in out["layers"]] == [(t, s) for (_, t), s in on.items()] and all(x["rle_only_flag"] for x in out["layers"])


def test_additional_info():
    a = lambda data: blocks.decode(5, data, None, None, False, False)
    assert a(H("1743"))["s_filter"] == {"mode": "OUT_OF_LOOP", "corrected_strength": 3}
    assert a(H("18FFFFFFFFFFFFFFFF"))["base_hash"] == 2**64 - 1
    m = a(H("0001") + b"".join(k.to_bytes(2, "big") for k in range(1, 9)) + (5).to_bytes(4, "big") + (6).to_bytes(4, "big"))["sei"]["mastering_display_colour_volume"]
    assert m["display_primaries_x"] == [1, 3, 5] and m["display_primaries_y"] == [2, 4, 6] and (m["white_point_x"], m["min_display_mastering_luminance"]) == (7, 6)
    assert a(H("000200100020"))["sei"]["content_light_level_info"] == {"max_content_light_level": 16, "max_pic_average_light_level": 32}
    assert a(H("0004B400500002"))["sei"]["user_data_registered"]["payload"] == {"bitstream_version": 2}
    assert a(H("0004B5010203"))["sei"]["user_data_registered"]["t35_country_code"] == 0xB5
    with pytest.raises(StreamError):
        a(H("0004B400500003"))
    assert "sei_error" in a(H("0009"))["sei"] and a(H("07AABB"))["unhandled_info_type"] == 7
    v = BitWriter().put(1, 1).put(255, 8).put(4, 16).put(3, 16).put(1, 1).put(1, 1).put(1, 1).put(5, 3).put(0, 1).put(1, 1).put(1, 8).put(2, 8).put(3, 8).put(1, 1).put(1, 1).put(0b010, 3)
    vui = a(b"\x01" + v.bytes())["vui"]
    assert (vui["sar_width"], vui["video_format"], vui["matrix_coefficients"], vui["chroma_sample_loc_type_top_field"], vui["chroma_sample_loc_type_bottom_field"]) == (4, 5, 3, 0, 1)
    hdr = a(b"\x19" + BitWriter().put(1, 1).put(31, 5).put(0, 1).put(1, 1).put(200, 8).put(9, 4).put(1, 1).put(0, 3).bytes())["hdr"]
    assert hdr["tone_mapper_type_extended"] == 200 and hdr["deinterlacer_type"] == 9 and hdr["top_field_first"]
    assert blocks.decode(6, b"skip", None, None, False, False) == {}


def serial(frames):
    """Decodes (nal) frames one after the other with carried state."""
    out, g, pic, dither = [], None, None, False
    for k, data in enumerate(frames):
        kind, at = bits.enhancement_start(data)
        for n, (t, _, _, body) in enumerate(blocks.split(bits.unescaped(data[at:])[0])):
            g = body if t == 1 else g
            idr = kind == "IDR"
            if t == 2:
                before, now = dither, blocks.decode(2, body, g, None, idr, dither)
                dither = now["dithering_control_flag"]
                pic = (body, idr, before)
            got = blocks.decode(t, body, g, pic and pic[0], idr, pic[2] if t == 2 else dither, pic and pic[1], pic and pic[2])
            out.append((k, n, json.dumps(got)))
    return out


def test_two_passes_match_serial_decoding(spark):
    """Config changes, carried dithering and plain pictures."""
    P, dithered = fixtures.PLAIN_PICTURE, block(2, H("0200C9") + H("45"))
    payloads = [fixtures.SEQUENCE + fixtures.GLOBAL + dithered + fixtures.encoded({0: b"ab"}, 32), block(2, H("80") + H("41")) + block(3, b""), fixtures.PICTURE + fixtures.encoded({3: b"xyz"}, 32), P + block(3, b""), fixtures.GLOBAL + dithered + block(5, H("1743")) + block(6, b"fill"), P]
    nals = [fixtures.nal(p, k in (0, 5)) for k, p in enumerate(payloads)]
    df = spark.createDataFrame([("s", k, bytearray(d)) for k, d in enumerate(nals)], "stream_id string, frame_index long, data binary")
    rows = analyze.decode_blocks(df).orderBy("frame_index", "block_index").collect()
    assert all(r["error"] is None for r in rows)
    assert [(r["frame_index"], r["block_index"], r["fields"]) for r in rows] == serial(nals)


def test_bad_frames_are_told(spark):
    bad = [b"\0\0\0\1\x7b\xff" + H("C080"), b"no nal at all", b"\0\0\0\1\x7b\xff" + H("63AABB8180"), fixtures.nal(fixtures.PICTURE)]
    df = spark.createDataFrame([("s", k, bytearray(d)) for k, d in enumerate(bad)], "stream_id string, frame_index long, data binary")
    assert all(r["error"] for r in analyze.decode_blocks(df).collect())
    assert [r["rbsp_ok"] for r in analyze.frame_payloads(spark.createDataFrame([("s", 0, bytearray(H("000000017BFF4002")))], "stream_id string, frame_index long, data binary")).collect()] == [False]


def test_bin_errors():
    head = containers.bin_header()
    with pytest.raises(StreamError):
        list(containers.bin_blocks(b"nonsense1234"))
    with pytest.raises(StreamError):
        list(containers.bin_blocks(head + b"\0\0" + (16).to_bytes(4, "big") + bytes(16)))
    one = head + containers.bin_block(0, 0, WIRE)
    assert one.hex().upper() == "6C6365766362696E00000001" + "000000000034" + "00" * 16 + WIRE.hex().upper()
    assert list(containers.bin_blocks(one)) == [(0, 0, WIRE)]


def test_report(spark):
    out = analyze.analyze_frames(readers.bin_frames(fixtures.files(spark)), verbose=True, fps=25)
    reports = {r["stream_id"]: json.loads(r["report"]) for r in out["report"].collect()}
    r = reports["made-a.bin"]
    assert r["summary"]["lcevc"]["frame_count"] == 12 and r["summary"]["lcevc"]["level_1_size"] + r["summary"]["lcevc"]["level_2_size"] == sum(3 + k for k in range(12))
    assert r["summary"]["pts"] == {"consistent": True, "interval_count": 1}
    assert [len(f["lcevc"]["blocks"]) for f in r["frames"]][:3] == [4, 4, 2]
    assert out["log"].count() == 19 and out["summary"].filter(F.col("synthetic_base")).count() == 2
