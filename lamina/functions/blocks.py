"""Decoders of the enhancement layer's syntax blocks.

A block says its own size, so a payload is split first and its blocks are decoded apart: sequence, global and
additional-info blocks on their own, picture blocks with the latest global one, data blocks with both.
Reserved bits do not matter. Codes without a name are None.
"""

from __future__ import annotations

from functools import lru_cache

from lamina.functions import enums as E
from lamina.functions.bits import Reader, StreamError

CUSTOM_SIZE = 7
SUPPORTED_VERSION = 2


def split(payload: bytes) -> list[tuple[int, int, int, bytes]]:
    """Type code, size type, size and body of each block."""
    r, out = Reader(payload), []
    while len(r):
        head = r.uint()
        size_type = head >> 5
        if size_type == 6:
            raise StreamError("the block's size type is reserved")
        size = r.varint() if size_type == CUSTOM_SIZE else size_type
        kind = head & 0x1F
        if kind not in E.BLOCK_TYPE:
            raise StreamError(f"blocks of type {kind} are unknown")
        out.append((kind, size_type, size, r.take(size)))
    return out


def fields(value: int, *widths: int) -> list[int]:
    """Splits the low bits of value into fields of the given widths, the highest first."""
    out = []
    at = sum(widths)
    for w in widths:
        at -= w
        out.append(value >> at & (1 << w) - 1)
    return out


def sequence(r: Reader) -> dict:
    profile, level = fields(r.uint(), 4, 4)
    sublevel, window = fields(r.uint(), 2, 1, 5)[:2]
    out = {"profile_idc": E.PROFILE.get(profile), "level_idc": E.LEVEL.get(level), "sublevel_idc": E.SUBLEVEL.get(sublevel, "SUBLEVEL_0"), "conformance_window_flag": bool(window)}
    out |= {"extended": None, "conf_win": None}
    if 15 in (profile, level):
        out["extended"] = dict(zip(("extended_profile_idc", "extended_level_idc"), fields(r.uint(), 3, 4, 1), strict=False))
    if window:
        out["conf_win"] = {f"conf_win_{side}_offset": r.varint() for side in ("left", "right", "top", "bottom")}
    return out


def global_(r: Reader) -> dict:
    planes, resolution, transform = fields(r.uint(), 1, 6, 1)
    chroma, base_depth, depth, step_mod, predicted = fields(r.uint(), 2, 2, 2, 1, 1)
    tile_intra, temporal, upsample, filtered, scale1 = fields(r.uint(), 1, 1, 3, 1, 2)
    scale2, tile, user_data, level1_depth, chroma_step = fields(r.uint(), 2, 2, 2, 1, 1)
    out = {
        "processed_planes_type_flag": bool(planes),
        "resolution_type": resolution,
        "transform_type": E.TRANSFORM[transform],
        "chroma_sampling_type": E.CHROMA_SAMPLING[chroma],
        "base_depth_type": E.BIT_DEPTH[base_depth],
        "enhancement_depth_type": E.BIT_DEPTH[depth],
        "temporal_step_width_modifier_signalled_flag": bool(step_mod),
        "predicted_residual_mode_flag": bool(predicted),
        "temporal_tile_intra_signalling_enabled_flag": bool(tile_intra),
        "temporal_enabled_flag": bool(temporal),
        "upsample_type": E.UPSAMPLE.get(upsample),
        "level1_filtering_signalled_flag": bool(filtered),
        "scaling_mode_level1": E.SCALING.get(scale1),
        "scaling_mode_level2": E.SCALING.get(scale2),
        "tile_dimensions_type": E.TILING[tile],
        "user_data_enabled": E.USER_DATA.get(user_data),
        "level1_depth_flag": bool(level1_depth),
        "chroma_step_width_flag": bool(chroma_step),
        "planes_type": "Y",
        "temporal_step_width_modifier": 48,
        "adaptive_cubic_kernel_coeffs": None,
        "level1_filtering": None,
        "custom_tile": None,
        "compression_type": None,
        "custom_resolution": None,
        "chroma_step_width_multiplier": 64,
        "_resolution": [0, 0],
    }
    if planes:
        out["planes_type"] = E.PLANES.get(r.uint() >> 4)
    if step_mod:
        out["temporal_step_width_modifier"] = r.uint()
    if out["upsample_type"] == "ADAPTIVE_CUBIC":
        out["adaptive_cubic_kernel_coeffs"] = [r.uint(2) for _ in range(4)]
    if filtered:
        out["level1_filtering"] = fields(r.uint(), 4, 4)
    if tile:
        if out["tile_dimensions_type"] == "CUSTOM":
            out["custom_tile"] = [r.uint(2), r.uint(2)]
        entropy, sizes = fields(r.uint(), 5, 1, 2)[1:]
        out["compression_type"] = {"compression_type_entropy_enabled_per_tile_flag": E.ENTROPY_PER_TILE[entropy], "compression_type_size_per_tile": E.SIZE_COMPRESSION.get(sizes)}
    if resolution == E.CUSTOM_RESOLUTION:
        out["custom_resolution"] = out["_resolution"] = [r.uint(2), r.uint(2)]
    elif 0 < resolution <= len(E.RESOLUTIONS):
        out["_resolution"] = list(E.RESOLUTIONS[resolution - 1])
    if chroma_step:
        out["chroma_step_width_multiplier"] = r.uint()
    return out


def groups(config: dict) -> int:
    return 16 if config["transform_type"] == "TRANSFORM_4X4" else 4


def plane_total(config: dict) -> int:
    return {"Y": 1, "YUV": 3}.get(config["planes_type"], 0)


def picture(r: Reader, config: dict, is_idr: bool, dither_before: bool) -> dict:
    """config: the latest global block; dither_before: the dithering flag of the picture before, in presentation order."""
    plain, matrix, dequant, kind, refresh, last = fields(r.uint(), 1, 3, 1, 1, 1, 1)
    out = {"no_enhancement_bit_flag": bool(plain), "quant_matrix_mode": E.QUANT_MATRIX.get(matrix), "dequant_offset_signalled_flag": bool(dequant), "picture_type_bit_flag": E.PICTURE[kind], "temporal_refresh_bit_flag": bool(refresh), "step_width_sublayer1_enabled_flag": bool(last)}
    if plain:
        out |= {"quant_matrix_mode": "USE_PREVIOUS", "dequant_offset_signalled_flag": False, "step_width_sublayer1_enabled_flag": False, "step_width_sublayer2": None}
        out |= {"dithering_control_flag": not is_idr and dither_before, "temporal_signalling_present_flag": bool(last)}
    else:
        step, dither = fields(r.uint(2), 15, 1)
        out |= {"step_width_sublayer2": step, "dithering_control_flag": bool(dither), "temporal_signalling_present_flag": config["temporal_enabled_flag"] and not refresh}
    mode = out["quant_matrix_mode"]
    out["field_type_bit_flag"] = E.FIELD[r.uint() >> 7] if kind else None
    out["step_width_sublayer1"] = None
    if out["step_width_sublayer1_enabled_flag"]:
        step, filtering = fields(r.uint(2), 15, 1)
        out["step_width_sublayer1"] = {"step_width_sublayer1": step, "level1_filtering_enabled_flag": bool(filtering)}
    out["qm_coefficient_0"] = [r.uint() for _ in range(groups(config))] if mode in ("CUSTOM_BOTH", "CUSTOM_SUBLAYER_2", "CUSTOM_BOTH_UNIQUE") else None
    out["qm_coefficient_1"] = [r.uint() for _ in range(groups(config))] if mode in ("CUSTOM_SUBLAYER_1", "CUSTOM_BOTH_UNIQUE") else None
    out["dequant_offset"] = out["dithering"] = None
    if out["dequant_offset_signalled_flag"]:
        m, offset = fields(r.uint(), 1, 7)
        out["dequant_offset"] = {"dequant_offset_mode_flag": bool(m), "dequant_offset": offset}
    if out["dithering_control_flag"]:
        kind, _, strength = fields(r.uint(), 2, 1, 5)
        name = E.DITHER.get(kind)
        out["dithering"] = {"dithering_type": name, "dithering_strength": None if name == "NONE" else strength}
    return out


def chunks(config: dict, pic: dict) -> list[tuple[int, int, int]]:
    """Plane, sublayer and coefficient group of each chunk of a frame, in stream order; group 0 of temporal ones."""
    out = []
    for plane in range(plane_total(config)):
        if not pic["no_enhancement_bit_flag"]:
            out += [(plane, sub, g) for sub in (1, 2) for g in range(groups(config))]
        if pic["temporal_signalling_present_flag"]:
            out.append((plane, 3, 0))
    return out


def layer(plane: int, sub: int, group: int, rle: int, size: int, tile: int | None = None) -> dict:
    place = {"plane": plane, "sublayer": E.SUBLAYER[sub], "coefficient_group": group}
    return place | ({} if tile is None else {"tile": tile}) | {"rle_only_flag": bool(rle), "entropy_enabled_flag": True, "size": size}


def encoded(r: Reader, config: dict, pic: dict) -> dict:
    todo = chunks(config, pic)
    head = Reader(r.take((2 * len(todo) + 7) // 8))
    layers = []
    for plane, sub, group in todo:
        enabled, rle = head.bits(1), head.bits(1)
        if enabled:
            size = r.varint()
            r.take(size)
            layers.append(layer(plane, sub, group, rle, size))
    return {"_plane_count": plane_total(config), "_coefficient_group_count": groups(config), "_surface_header_bytes": len(head.data), "layers": layers}


def tile_size(config: dict) -> tuple[int, int]:
    w, h = {"TILE_512X256": (512, 256), "TILE_1024X512": (1024, 512), "CUSTOM": tuple(config["custom_tile"] or (0, 0))}.get(config["tile_dimensions_type"], (0, 0))
    unit = 4 if config["transform_type"] == "TRANSFORM_4X4" else 2
    if not w or not h or w % unit or h % unit:
        raise StreamError(f"tiles of {w} x {h} are invalid")
    return w, h


def tile_totals(config: dict) -> tuple[int, int]:
    """Tiles of level 2 and of level 1."""
    (w, h), (tw, th), mode = config["_resolution"], tile_size(config), config["scaling_mode_level2"]
    count = lambda w, h: -(-w // tw) * -(-h // th)
    if mode is None:
        raise StreamError("the scaling mode is unknown")
    return count(w, h), count(w if mode == "SCALING_0D" else -(-w // 2), -(-h // 2) if mode == "SCALING_2D" else h)


def run_lengths(r: Reader, total: int) -> list[int]:
    """Flags as alternating runs after a first symbol."""
    symbol = r.uint()
    if symbol > 1:
        raise StreamError("the first symbol is neither 0 nor 1")
    out: list[int] = []
    while len(out) < total:
        n = r.varint()
        if len(out) + n > total:
            raise StreamError("a run exceeds the flags")
        out += [symbol] * n
        symbol = 1 - symbol
    return out


class PrefixTable:
    """Canonical prefix codes: the longest codes count up from zero by falling symbol rank, shorter ones go on from there."""

    def __init__(self, r: Reader):
        low, high = r.bits(5), r.bits(5)
        self.single, self.codes = 0, {}
        if low == high == 31:
            return
        if low == high == 0:
            self.single = r.bits(8)
            return
        width = max(0, high - low).bit_length()
        if r.bits(1):
            lengths = {s: r.bits(width) + low for s in range(256) if r.bits(1)}
        else:
            lengths = {}
            for _ in range(r.bits(5)):
                s = r.bits(8)
                lengths[s] = r.bits(width) + low
        value, length = 0, high
        for s in sorted(lengths, key=lambda s: (-lengths[s], s)):
            value >>= length - lengths[s]
            length = lengths[s]
            self.codes[length, value] = s
            value += 1

    def read(self, r: Reader) -> int:
        if not self.codes:
            return self.single
        value = 0
        for length in range(max(n for n, _ in self.codes) + 1):
            if (length, value) in self.codes:
                return self.codes[length, value]
            value = value << 1 | r.bits(1)
        raise StreamError("no prefix code matches")


def packed_sizes(r: Reader, n: int, differences: bool) -> list[int]:
    """Sizes by prefix codes of their low and high bytes, as they are or as running differences."""
    if not n:
        return []
    r.align()
    low, high = PrefixTable(r), PrefixTable(r)
    out, total = [], 0
    for _ in range(n):
        byte = low.read(r)
        value, width = byte >> 1, 7
        if byte & 1:
            value, width = value + (high.read(r) << 7), 15
        if not differences:
            out.append(value)
            continue
        total += value - (1 << width) if value >> width - 1 else value
        if not 0 <= total < 1 << 32:
            raise StreamError("a difference leads to an invalid size")
        out.append(total)
    r.align()
    return out


def tiled(r: Reader, config: dict, pic: dict, spec_tile_order: bool = False) -> dict:
    """spec_tile_order: sublayer 1 has the tiles of level 1 and sublayer 2 those of level 2, not the other way round."""
    compression = config["compression_type"] or {}
    sizes_by = compression.get("compression_type_size_per_tile", "NONE")
    level2, level1 = tile_totals(config)
    tiles = {1: level1, 2: level2, 3: level2} if spec_tile_order else {1: level2, 2: level1, 3: level2}
    todo = chunks(config, pic)
    rle = Reader(r.take((len(todo) + 7) // 8))
    total = sum(tiles[sub] for _, sub, _ in todo)
    if compression.get("compression_type_entropy_enabled_per_tile_flag") == "RUN_LENGTH_ENCODING":
        enabled = run_lengths(r, total)
    else:
        flags = Reader(r.take((total + 7) // 8))
        enabled = [flags.bits(1) for _ in range(total)]
    layers, at = [], 0
    for plane, sub, group in todo:
        rle_only, n = rle.bits(1), tiles[sub]
        on = [t for t in range(n) if enabled[at + t]]
        at += n
        packed = None if sizes_by == "NONE" else iter(packed_sizes(r, len(on), sizes_by == "PREFIX_CODING_ON_DIFFERENCES"))
        for t in on:
            size = r.varint() if packed is None else next(packed)
            r.take(size)
            layers.append(layer(plane, sub, group, rle_only, size, t))
    return {"_tile_dimensions": list(tile_size(config)), "_level1_tile_count": level1, "_level2_tile_count": level2, "_plane_count": plane_total(config), "_coefficient_group_count": groups(config), "_surface_header_bytes": 0, "layers": layers}


def sei(r: Reader) -> dict:
    kind = E.SEI_PAYLOAD.get(r.uint())
    out: dict = {"sei_payload_type": kind}
    if kind == "MASTERING_DISPLAY_COLOUR_VOLUME":
        xy = [r.uint(2) for _ in range(6)]
        out["mastering_display_colour_volume"] = {"display_primaries_x": xy[::2], "display_primaries_y": xy[1::2], "white_point_x": r.uint(2), "white_point_y": r.uint(2), "max_display_mastering_luminance": r.uint(4), "min_display_mastering_luminance": r.uint(4)}
    elif kind == "CONTENT_LIGHT_LEVEL_INFO":
        out["content_light_level_info"] = {"max_content_light_level": r.uint(2), "max_pic_average_light_level": r.uint(2)}
    elif kind == "USER_DATA_REGISTERED":
        code = r.uint()
        user = out["user_data_registered"] = {"t35_country_code": code, "t35_remaining_code": None, "payload": None}
        if code == E.T35_HEADER[0]:
            user["t35_remaining_code"] = list(r.take(3))
        if bytes([code, *(user["t35_remaining_code"] or ())]) == E.T35_HEADER:
            version = r.uint()
            if version != SUPPORTED_VERSION:
                raise StreamError(f"bitstream version {version} is not supported")
            user["payload"] = {"bitstream_version": version}
        else:
            r.take(len(r))  # registered data of others fills the rest of the block
    else:
        out["sei_error"] = "the SEI payload type is not known"
    return out


def vui(r: Reader) -> dict:
    out: dict = {"aspect_ratio_info_present": r.flag()}
    if out["aspect_ratio_info_present"]:
        out["aspect_ratio_idc"] = r.bits(8)
        if out["aspect_ratio_idc"] == 255:
            out |= {"sar_width": r.bits(16), "sar_height": r.bits(16)}
    out["overscan_info_present"] = r.flag()
    if out["overscan_info_present"]:
        out["overscan_appropriate_flag"] = r.flag()
    out["video_signal_type_present"] = r.flag()
    if out["video_signal_type_present"]:
        out |= {"video_format": r.bits(3), "video_full_range": r.flag(), "colour_description_present": r.flag()}
        if out["colour_description_present"]:
            out |= {"colour_primaries": r.bits(8), "transfer_characteristics": r.bits(8), "matrix_coefficients": r.bits(8)}
    out["chroma_loc_info_present"] = r.flag()
    if out["chroma_loc_info_present"]:
        out |= {"chroma_sample_loc_type_top_field": r.exp_golomb(), "chroma_sample_loc_type_bottom_field": r.exp_golomb()}
    r.align()
    return out


def hdr(r: Reader) -> dict:
    out: dict = {"tone_mapper_location": r.flag(), "tone_mapper_type": r.bits(5), "tone_mapper_data_present": r.flag(), "deinterlacer_enabled": r.flag()}
    if out["tone_mapper_type"] == 31:
        out["tone_mapper_type_extended"] = r.bits(8)
    if out["deinterlacer_enabled"]:
        out |= {"deinterlacer_type": r.bits(4), "top_field_first": r.flag()}
        r.bits(3)
    return out


def additional(r: Reader) -> dict:
    code = r.uint()
    kind = E.ADDITIONAL_INFO.get(code)
    out: dict = {"info_type": kind}
    if kind == "S_FILTER":
        mode, strength = fields(r.uint(), 3, 5)
        out["s_filter"] = {"mode": E.S_FILTER.get(mode), "corrected_strength": strength}
    elif kind == "BASE_HASH":
        out["base_hash"] = r.uint(8)
    elif kind == "SEI_PAYLOAD":
        out["sei"] = sei(r)
    elif kind == "VUI_PARAMETERS":
        out["vui"] = vui(r)
    elif kind == "HDR":
        out["hdr"] = hdr(r)
    else:
        out["unhandled_info_type"] = code
        r.take(len(r))
    return out


@lru_cache(512)
def _global_of(body: bytes) -> dict:
    return global_(Reader(body))


def decode(kind: int, body: bytes, global_body: bytes | None, picture_body: bytes | None, is_idr: bool, dither_before: bool, picture_is_idr: bool = False, picture_dither_before: bool = False, spec_tile_order: bool = False) -> dict:
    """The fields of one block. The bodies of the latest global and picture blocks, and for the latter the frame it came
    with, are what a serial decoder would carry along."""
    r = Reader(body)
    if kind in (2, 3, 4) and global_body is None:
        raise StreamError("it comes before a global config")
    if kind in (3, 4) and picture_body is None:
        raise StreamError("it comes before a picture config")
    if kind == 0:
        out = sequence(r)
    elif kind == 1:
        out = global_(r)
    elif kind == 2:
        out = picture(r, _global_of(global_body), is_idr, dither_before)
    elif kind in (3, 4):
        pic = picture(Reader(picture_body), _global_of(global_body), picture_is_idr, picture_dither_before)
        out = encoded(r, _global_of(global_body), pic) if kind == 3 else tiled(r, _global_of(global_body), pic, spec_tile_order)
    elif kind == 5:
        out = additional(r)
    else:
        r.take(len(r))
        out = {}
    if len(r):
        raise StreamError(f"{len(r)} bytes of the block are left over")
    return out
