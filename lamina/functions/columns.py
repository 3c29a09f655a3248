"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.enums import RESOLUTIONS, name_of


def uint_be(data: Column, at: int, n: int) -> Column:
    """The big-endian unsigned integer in n bytes (up to 7) from offset at."""
    return F.conv(F.hex(F.substring(data, at + 1, n)), 16, 10).cast("long")


def uint64_be(data: Column, at: int = 0) -> Column:
    """Eight bytes as a decimal, which holds all 64-bit values."""
    return F.conv(F.hex(F.substring(data, at + 1, 8)), 16, 10).cast("decimal(20,0)")


def byte_at(data: Column, at: Column) -> Column:
    """The byte at an offset, as a number."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def start_code_size(data: Column) -> Column:
    """4, 3 or 0 bytes of start code at the beginning."""
    return F.when(F.hex(F.substring(data, 1, 4)) == "00000001", 4).when(F.hex(F.substring(data, 1, 3)) == "000001", 3).otherwise(0)


def h264_header(a: Column) -> Column:
    """Fields of the one header byte."""
    return F.struct(F.shiftright(a, 7).alias("forbidden"), F.shiftright(a, 5).bitwiseAND(3).alias("ref_idc"), a.bitwiseAND(31).alias("nal_type"))


def hevc_header(word: Column) -> Column:
    """Fields of the two header bytes, taken as one number."""
    return F.struct(
        F.shiftright(word, 15).alias("forbidden"),
        F.shiftright(word, 9).bitwiseAND(63).alias("nal_type"),
        F.shiftright(word, 3).bitwiseAND(63).alias("layer_id"),
        word.bitwiseAND(7).alias("temporal_id_plus1"),
    )


def vvc_header(word: Column) -> Column:
    return F.struct(
        F.shiftright(word, 15).alias("forbidden"),
        F.shiftright(word, 3).bitwiseAND(31).alias("nal_type"),
        F.shiftright(word, 8).bitwiseAND(63).alias("layer_id"),
        word.bitwiseAND(7).alias("temporal_id_plus1"),
    )


def enh_header(word: Column) -> Column:
    """nal_type and valid: a zero, a one, the type, and nine ones."""
    valid = (F.shiftright(word, 14) == 1) & (word.bitwiseAND(0x1FF) == 0x1FF)
    return F.struct(valid.alias("valid"), F.shiftright(word, 9).bitwiseAND(31).alias("nal_type"))


def varint(data: Column) -> Column:
    """A variable-length integer from its bytes (at most five); null where its end is missing or it exceeds 32 bits.
    The bytes are taken from one number, without lambdas, so that the expression compiles."""
    n = F.octet_length(data)
    word = F.conv(F.rpad(F.hex(F.substring(data, 1, 5)), 10, "0"), 16, 10).cast("long")
    value, out = F.lit(0).cast("long"), F.when(F.lit(False), F.lit(None).cast("long"))
    for i in range(5):
        byte = F.shiftright(word, 8 * (4 - i)).bitwiseAND(255)
        value = value * 128 + byte.bitwiseAND(127)
        last = (byte < 128) & (n > i)
        out = out.when(last & (byte < 16) if i == 4 else last, value).when(n <= i + 1, F.lit(None).cast("long"))
    return out


def ceil_div(a: Column, b: Column) -> Column:
    """In whole numbers, exact up to 64 bits."""
    return F.call_function("div", a + b - 1, b)


def approx_equal(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) < tolerance


def normalised_fps(fps: Column) -> Column:
    """Rates within a hundredth of 23.976, 29.97 and 59.94 become the exact fractions."""
    out = F.when(F.lit(False), fps)
    for near, exact in ((23.976, 24000 / 1001), (29.97, 30000 / 1001), (59.94, 60000 / 1001)):
        out = out.when(approx_equal(fps, F.lit(near), 0.01), F.lit(exact))
    return out.otherwise(fps)


def time_base(fps: Column, container: Column | None = None) -> Column:
    """Seconds a tick: the container's, or of raw streams one frame."""
    raw = F.try_divide(F.lit(1.0), fps)
    return raw if container is None else F.coalesce(container, raw)


def resolution(index: Column, custom_width: Column | None = None, custom_height: Column | None = None) -> Column:
    """width and height by resolution index; null where it has none."""
    custom = index == 63
    w = name_of({k: w for k, (w, _) in enumerate(RESOLUTIONS, 1)}, index)
    h = name_of({k: h for k, (_, h) in enumerate(RESOLUTIONS, 1)}, index)
    if custom_width is not None:
        w, h = F.when(custom, custom_width).otherwise(w), F.when(custom, custom_height).otherwise(h)
    return F.struct(w.alias("width"), h.alias("height"))


def plane_count(planes: Column) -> Column:
    return F.when(planes == "YUV", 3).when(planes == "Y", 1)


def group_count(transform: Column) -> Column:
    return F.when(transform == "TRANSFORM_4X4", 16).when(transform == "TRANSFORM_2X2", 4)


def tu_size(transform: Column) -> Column:
    return F.when(transform == "TRANSFORM_4X4", 4).when(transform == "TRANSFORM_2X2", 2)


def tile_dimensions(mode: Column, custom_width: Column, custom_height: Column, tu: Column) -> Column:
    """Tile width and height; null where one is zero or no multiple of the transform unit."""
    w = F.when(mode == "TILE_512X256", 512).when(mode == "TILE_1024X512", 1024).when(mode == "CUSTOM", custom_width)
    h = F.when(mode == "TILE_512X256", 256).when(mode == "TILE_1024X512", 512).when(mode == "CUSTOM", custom_height)
    return F.when((w > 0) & (h > 0) & (w % tu == 0) & (h % tu == 0), F.struct(w.alias("width"), h.alias("height")))


def tile_counts(width: Column, height: Column, tile_width: Column, tile_height: Column, scaling: Column) -> Column:
    """Tiles of level 2 and of level 1, whose picture is halved by 1D scaling in width, by 2D in both."""
    two = F.lit(2)
    w = F.when(scaling.isin("SCALING_1D", "SCALING_2D"), ceil_div(width, two)).otherwise(width)
    h = F.when(scaling == "SCALING_2D", ceil_div(height, two)).otherwise(height)
    count = lambda w, h: ceil_div(w, tile_width) * ceil_div(h, tile_height)
    return F.struct(count(width, height).alias("level2"), count(w, h).alias("level1"))


def codec_of_base(base: Column) -> Column:
    """Base types with NAL units are codecs; the others have none."""
    return F.when(F.upper(base).isin("H264", "HEVC", "VVC"), F.upper(base)).otherwise("UNKNOWN")


def base_of_codec_name(name: Column) -> Column:
    """Base type of a decoder's codec name."""
    return F.coalesce(name_of({"h264": "H264", "hevc": "HEVC", "h265": "HEVC", "vvc": "VVC", "h266": "VVC", "vp8": "VP8", "vp9": "VP9", "av1": "AV1", "vc6": "VC6"}, F.lower(name)), F.lit("UNKNOWN"))


def frame_type(picture: Column, base: Column, is_key: Column) -> Column:
    """Printed frame type: of the key and inter codecs by the key flag, of the others by picture type."""
    keyed = F.upper(base).isin("VP8", "VP9", "AV1")
    return F.when(keyed, F.when(is_key, "KEY").otherwise("INT")).when(picture.isin("I", "P", "B"), picture).otherwise(" ? ")
