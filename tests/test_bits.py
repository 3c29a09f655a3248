"""Bit readers, headers, probing and scalar functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from lamina.functions import bits, columns, enums
from lamina.functions.bits import Reader, StreamError
from lamina.plans.fixtures import BitWriter, escaped, varint
from lamina.sources import readers
from pyspark.sql import functions as F

H = bytes.fromhex


def test_bit_reader():
    assert [Reader(H("B0")).bits(8)] == [0xB0]
    r = Reader(H("B0"))
    assert [r.bits(1) for _ in range(8)] == [1, 0, 1, 1, 0, 0, 0, 0]
    r = Reader(H("0102BEEF"))
    assert r.uint(2) == 0x0102 and r.take(2) == H("BEEF")
    r = Reader(H("D670"))
    assert (r.bits(12), r.bits(4)) == (0xD67, 0)
    r = Reader(H("A640"))
    assert [r.exp_golomb() for _ in range(4)] == [0, 1, 2, 3]
    r = Reader(H("E00F"))
    assert [r.bits(1) for _ in range(3)] == [1, 1, 1] and r.at == 1
    r.align()
    assert r.bits(1) == 0 and r.at == 2
    with pytest.raises(StreamError):
        Reader(b"a").take(2)


@pytest.mark.parametrize(("data", "value"), [("7F", 127), ("8100", 128), ("817F", 255), ("818080808000", None)])
def test_varint(spark, data, value):
    if value is None:
        with pytest.raises(StreamError):
            Reader(H(data)).varint()
    else:
        assert Reader(H(data)).varint() == value
    assert spark.createDataFrame([(bytearray(H(data)),)], "d binary").select(columns.varint(F.col("d"))).first()[0] == value


@given(st.integers(0, 2**28 - 1))
def test_varint_round_trip(x):
    assert Reader(varint(x)).varint() == x


@given(st.binary(max_size=60).map(lambda b: bytes(x % 5 for x in b)))
def test_escape_round_trip(data):
    assert bits.unescaped(escaped(data)) == (data, True)


def test_unescape_odd():
    assert bits.unescaped(H("0102")) == (b"", False)
    assert bits.unescaped(H("00000003AA80")) == (H("00000003AA"), True)  # three after three zeros stays
    assert bits.unescaped(H("0000030000038000")) == (H("00000000"), True)


@pytest.mark.parametrize(
    ("prefix", "codec", "head", "want"),
    [
        (3, "H264", "65", (4, 5, 0, 0, 3)),
        (3, "LCEVC", "6BFF", (5, 21, 0, 0, 0)),
        (3, "LCEVC", "2B00", None),
        (0, "LCEVC", "6BFF", (2, 21, 0, 0, 0)),
        (3, "HEVC", "", None),
        (4, "H264", "06", (5, 6, 0, 0, 0)),
        (4, "HEVC", "4E01", (6, 39, 0, 1, 0)),
        (4, "VVC", "00B9", (6, 23, 0, 1, 0)),
        (4, "VVC", "11BE", (6, 23, 17, 6, 0)),
        (4, "H264", "E5", None),
    ],
)
def test_headers(prefix, codec, head, want):
    data = {0: b"", 3: b"\0\0\1", 4: b"\0\0\0\1"}[prefix] + H(head)
    found = bits.annexb_header(data, codec) if prefix else bits.bare_header(data, codec)
    assert (found and (found.header_size, found.nal_type, found.layer_id, found.temporal_id_plus1, found.ref_idc)) == want


def test_start_codes():
    assert [bits.start_code(H(x)) for x in ("0000000111", "00000167", "112233")] == [4, 3, 0]
    assert bits.start_codes(H("00000001AA000001BB0000000001")) == [(0, 4), (5, 3), (10, 4)]
    assert enums.nal_name("HEVC", 39) == "PREFIX_SEI" and enums.nal_name("H264", 25) == "DATA" and enums.nal_name("VVC", 28) == "*UNSPECIFIED*"


TS = bytes(0x47 if k in (0, 188, 376) else 0xFF for k in range(564))
PROBES = {
    "bin": (H("6C6365766362696E"), "BIN", "UNKNOWN", False, False),
    "mp4": (H("00000018") + b"ftypisom" + H("00000200") + b"isomavc1", "MP4", "UNKNOWN", False, False),
    "ts": (TS, "TS", "UNKNOWN", False, False),
    "webm": (H("1A45DFA300"), "WEBM", "UNKNOWN", False, False),
    "h264": (H("00000001670000"), "ES", "H264", True, False),
    "hevc": (H("00000001420101"), "ES", "HEVC", True, False),
    "vvc": (H("000000010079"), "ES", "VVC", True, False),
    "enh": (H("000000017BFF"), "LCEVC", "UNKNOWN", True, False),
    "avcc": (H("0000000467000000"), "ES", "H264", False, True),
    "none": (b"plain text", "UNKNOWN", "UNKNOWN", False, False),
}


def test_probe(spark):
    df = readers.from_bytes(spark, {k: v[0] for k, v in PROBES.items()})
    found = {r["stream_id"]: tuple(r)[1:] for r in readers.probe(df).collect()}
    assert found == {k: v[1:] for k, v in PROBES.items()}


def test_suffix(spark):
    df = spark.createDataFrame([("a/b.H265",), ("x.bin",), ("y",)], "p string").select(readers.type_by_suffix(F.col("p")).alias("t")).select("t.*")
    assert [tuple(r) for r in df.collect()] == [("ES", "HEVC"), ("BIN", "UNKNOWN"), (None, None)]


def test_scalars(spark):
    r = spark.range(1).select(
        columns.uint64_be(F.unhex(F.lit("FFFFFFFFFFFFFFFF"))).alias("big"),
        columns.normalised_fps(F.lit(29.975)).alias("fps"),
        columns.tile_dimensions(F.lit("CUSTOM"), F.lit(6), F.lit(8), F.lit(4)).alias("bad"),
        columns.tile_counts(F.lit(1920), F.lit(1080), F.lit(512), F.lit(256), F.lit("SCALING_2D")).alias("t"),
        enums.code_of(enums.PLANES, F.lit("yuv")).alias("code"),
        columns.frame_type(F.lit("I"), F.lit("VP9"), F.lit(True)).alias("ft"),
        columns.base_of_codec_name(F.lit("hevc")).alias("base"),
    ).first()
    assert str(r["big"]) == str(2**64 - 1) and abs(r["fps"] - 30000 / 1001) < 1e-9 and r["bad"] is None
    assert tuple(r["t"]) == (20, 6) and (r["code"], r["ft"], r["base"]) == (1, "KEY", "HEVC")


@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 2**16 - 1)), max_size=20))
def test_bits_round_trip(parts):
    w = BitWriter()
    for n, v in parts:
        w.put(v & (1 << n) - 1, n)
    r = Reader(w.bytes())
    assert [r.bits(n) for n, _ in parts] == [v & (1 << n) - 1 for n, v in parts]
