"""Names of coded values. The values and names are fixed by the stream format and the report format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCK_TYPE = {0: "SEQUENCE_CONFIG", 1: "GLOBAL_CONFIG", 2: "PICTURE_CONFIG", 3: "ENCODED_DATA", 4: "ENCODED_TILED_DATA", 5: "ADDITIONAL_INFO", 6: "FILLER"}
PAYLOAD_SIZE_TYPE = {0: "SIZE_0_BYTES", 1: "SIZE_1_BYTES", 2: "SIZE_2_BYTES", 3: "SIZE_3_BYTES", 4: "SIZE_4_BYTES", 5: "SIZE_5_BYTES", 7: "CUSTOM"}
CHROMA_SAMPLING = {0: "MONOCHROME", 1: "CHROMA_420", 2: "CHROMA_422", 3: "CHROMA_444"}
BIT_DEPTH = {0: "DEPTH_8", 1: "DEPTH_10", 2: "DEPTH_12", 3: "DEPTH_14"}
UPSAMPLE = {0: "NEAREST", 1: "LINEAR", 2: "CUBIC", 3: "MODIFIED_CUBIC", 4: "ADAPTIVE_CUBIC"}
SCALING = {0: "SCALING_0D", 1: "SCALING_1D", 2: "SCALING_2D"}
TILING = {0: "NONE", 1: "TILE_512X256", 2: "TILE_1024X512", 3: "CUSTOM"}
USER_DATA = {0: "DISABLED", 1: "WITH_2_BITS", 2: "WITH_6_BITS"}
PLANES = {0: "Y", 1: "YUV"}
TRANSFORM = {0: "TRANSFORM_2X2", 1: "TRANSFORM_4X4"}
SIZE_COMPRESSION = {0: "NONE", 1: "PREFIX_CODING", 2: "PREFIX_CODING_ON_DIFFERENCES"}
ENTROPY_PER_TILE = {0: "DISABLED", 1: "RUN_LENGTH_ENCODING"}
PICTURE = {0: "FRAME", 1: "FIELD"}
FIELD = {0: "TOP", 1: "BOTTOM"}
SUBLEVEL = {0: "SUBLEVEL_0", 1: "SUBLEVEL_1"}
DITHER = {0: "NONE", 1: "UNIFORM"}
QUANT_MATRIX = {0: "USE_PREVIOUS", 1: "USE_DEFAULT", 2: "CUSTOM_BOTH", 3: "CUSTOM_SUBLAYER_2", 4: "CUSTOM_SUBLAYER_1", 5: "CUSTOM_BOTH_UNIQUE"}
ADDITIONAL_INFO = {0: "SEI_PAYLOAD", 1: "VUI_PARAMETERS", 23: "S_FILTER", 24: "BASE_HASH", 25: "HDR"}
SEI_PAYLOAD = {1: "MASTERING_DISPLAY_COLOUR_VOLUME", 2: "CONTENT_LIGHT_LEVEL_INFO", 4: "USER_DATA_REGISTERED"}
S_FILTER = {0: "DISABLED", 1: "IN_LOOP", 2: "OUT_OF_LOOP"}
SUBLAYER = {1: "SUBLAYER_1", 2: "SUBLAYER_2", 3: "TEMPORAL"}
PROFILE = {0: "MAIN", 1: "MAIN_444", 15: "EXTENDED"}
LEVEL = {1: "LEVEL_1", 2: "LEVEL_2", 3: "LEVEL_3", 4: "LEVEL_4", 15: "EXTENDED"}
INPUT_TYPES = ("TS", "ES", "WEBM", "MP4", "BIN", "LCEVC", "UNKNOWN")
BASE_TYPE = {-2: "INVALID", -1: "UNKNOWN", 1: "H264", 2: "HEVC", 3: "VVC", 4: "VP8", 5: "VP9", 6: "AV1", 7: "VC6"}
FRAME_TYPE = {"Unknown": " ? ", "I": "I", "P": "P", "B": "B", "KeyFrame": "KEY", "InterFrame": "INT"}
ENH_FRAME_TYPE = {28: "NON", 29: "IDR"}
NAL_ENH = {25: "DATA", 27: "CONF"}
# Names of NAL types.
NAL_H264 = dict(enumerate("SLICE SLICE_DPA SLICE_DPB SLICE_DPC IDR_SLICE SEI SPS PPS AUD E_O_SEQ E_O_STRM FILLER SPS_EXT PFX_NAL SUB_SPS".split(), 1)) | {19: "AUX_SLICE", 20: "EXTN_SLICE"}
NAL_HEVC = (
    dict(enumerate("TRAIL_N TRAIL_R TSA_N TSA_R STSA_N STSA_R RADL_N RADL_R RASL_N RASL_R".split()))
    | dict(enumerate("BLA_W_LP BLA_W_RADL BLA_N_LP IDR_W_RADL IDR_N_LP CRA_NUT".split(), 16))
    | dict(enumerate("VPS_NUT SPS_NUT PPS_NUT AUD_NUT EOS_NUT EOB_NUT FD_NUT PREFIX_SEI SUFFIX_SEI".split(), 32))
)
NAL_VVC = (
    dict(enumerate("TRAIL STSA RADL RASL".split()))
    | dict(enumerate("IDR_W_RADL IDR_N_LP CRA GDR".split(), 7))
    | dict(enumerate("OPI DCI VPS SPS PPS PREFIX_APS SUFFIX_APS PH AUD EOS EOB PREFIX_SEI SUFFIX_SEI FD".split(), 12))
)
#: Types without a name that are left to applications; all other nameless ones are reserved.
UNSPECIFIED = {"H264": {16, 17, 18, 21, 22, 23}, "HEVC": set(range(48, 64)), "VVC": set(range(28, 32))}
NAL_NAMES = {"H264": NAL_H264, "HEVC": NAL_HEVC, "VVC": NAL_VVC}
#: Width and height by resolution index, from 1; 63 is a size of its own.
RESOLUTIONS = (
    (360, 200), (400, 240), (480, 320), (640, 360), (640, 480), (768, 480), (800, 600), (852, 480), (854, 480), (856, 480),
    (960, 540), (960, 640), (1024, 576), (1024, 600), (1024, 768), (1152, 864), (1280, 720), (1280, 800), (1280, 1024), (1360, 768),
    (1366, 768), (1400, 1050), (1440, 900), (1600, 1200), (1680, 1050), (1920, 1080), (1920, 1200), (2048, 1080), (2048, 1152), (2048, 1536),
    (2160, 1440), (2560, 1440), (2560, 1600), (2560, 2048), (3200, 1800), (3200, 2048), (3200, 2400), (3440, 1440), (3840, 1600), (3840, 2160),
    (3840, 2400), (4096, 2160), (4096, 3072), (5120, 2880), (5120, 3200), (5120, 4096), (6400, 4096), (6400, 4800), (7680, 4320), (7680, 4800),
)
CUSTOM_RESOLUTION = 63
#: Suffix to input type and base type.
SUFFIXES = {
    ".ts": ("TS", "INVALID"), ".es": ("ES", "INVALID"), ".264": ("ES", "H264"), ".h264": ("ES", "H264"), ".avc": ("ES", "H264"),
    ".265": ("ES", "HEVC"), ".h265": ("ES", "HEVC"), ".hevc": ("ES", "HEVC"), ".266": ("ES", "VVC"), ".h266": ("ES", "VVC"), ".vvc": ("ES", "VVC"),
    ".webm": ("WEBM", "UNKNOWN"), ".mp4": ("MP4", "UNKNOWN"), ".bin": ("BIN", "UNKNOWN"), ".lvc": ("LCEVC", "UNKNOWN"), ".lcevc": ("LCEVC", "UNKNOWN"),
}
#: Fixed value: header of registered user data that carries an enhancement payload.
T35_HEADER = bytes.fromhex("b4005000")


def name_of(table: dict, code: Column) -> Column:
    """The name of a code, null where it has none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), code)


def code_of(table: dict, name: Column) -> Column:
    """The code of a name in any case, null where there is none."""
    pairs = [F.lit(x) for code, n in table.items() for x in (n.upper(), code)]
    return F.try_element_at(F.create_map(*pairs), F.upper(name))


def nal_name(codec: str, nal_type: int) -> str:
    if nal_type in NAL_ENH:
        return NAL_ENH[nal_type]
    if codec not in NAL_NAMES:
        return "???"
    unnamed = "*UNSPECIFIED*" if nal_type in UNSPECIFIED[codec] else "*RESERVED*"
    return NAL_NAMES[codec].get(nal_type, unnamed)


def nal_name_column(codec: str, nal_type: Column) -> Column:
    top = 64 if codec == "HEVC" else 32
    return name_of({k: nal_name(codec, k) for k in range(top)}, nal_type)
