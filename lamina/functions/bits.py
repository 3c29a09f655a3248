"""Reading bytes and bits in sequence: what needs a cursor and so lies outside column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lamina.functions.enums import ENH_FRAME_TYPE


#: A three after exactly two zeros.
ESCAPE = re.compile(rb"(?<!\x00)\x00\x00\x03")


class StreamError(ValueError):
    """The bytes do not follow the format."""


class Reader:
    """A cursor over bytes: big-endian integers, bit fields (most significant bit first), variable-length integers."""

    def __init__(self, data: bytes):
        self.data, self.at, self._byte, self._left = data, 0, 0, 0

    def __len__(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n > len(self):
            raise StreamError(f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int = 1) -> int:
        return int.from_bytes(self.take(n), "big")

    def bits(self, n: int) -> int:
        value = 0
        for _ in range(n):
            if not self._left:
                self._byte, self._left = self.uint(), 8
            self._left -= 1
            value = value << 1 | self._byte >> self._left & 1
        return value

    def flag(self) -> bool:
        return bool(self.bits(1))

    def align(self) -> None:
        """Drops what is left of the current byte."""
        self._left = 0

    def varint(self) -> int:
        """Groups of seven bits, most significant first, while the top bit is set; 32 bits at most."""
        value = 0
        for n in range(5):
            byte = self.uint()
            if n == 4 and byte & 0x70:
                break
            value = value << 7 | byte & 0x7F
            if not byte & 0x80:
                return value
        raise StreamError("a variable-length integer exceeds 32 bits")

    def exp_golomb(self) -> int:
        zeros = 0
        while not self.bits(1):
            zeros += 1
            if zeros > 32:
                raise StreamError("an Exp-Golomb code exceeds 32 bits")
        return (1 << zeros) - 1 + self.bits(zeros)


@dataclass(frozen=True)
class NalHeader:
    codec: str
    start_code: int
    forbidden: int
    nal_type: int
    layer_id: int
    temporal_id_plus1: int
    ref_idc: int
    header_size: int


def start_code(data: bytes, at: int = 0) -> int:
    """Bytes of the start code there: 4, 3, or 0 if there is none."""
    if data[at : at + 4] == b"\0\0\0\1":
        return 4
    return 3 if data[at : at + 3] == b"\0\0\1" else 0


def bare_header(data: bytes, codec: str, prefix: int = 0) -> NalHeader | None:
    """The header after prefix bytes; None if it is cut off or breaks the codec's rules."""
    need = 1 if codec == "H264" else 2
    if len(data) < prefix + need:
        return None
    a, b = data[prefix], data[prefix + need - 1]
    forbidden = a >> 7
    if codec == "H264":
        found = NalHeader(codec, prefix, forbidden, a & 0x1F, 0, 0, a >> 5 & 3, prefix + 1)
    elif codec == "HEVC":
        found = NalHeader(codec, prefix, forbidden, a >> 1 & 0x3F, (a & 1) << 5 | b >> 3, b & 7, 0, prefix + 2)
    elif codec == "VVC":
        found = NalHeader(codec, prefix, forbidden, b >> 3, a & 0x3F, b & 7, 0, prefix + 2)
    elif codec == "LCEVC":
        if not a >> 6 & 1 or (a & 1) << 8 | b != 0x1FF:
            return None
        found = NalHeader(codec, prefix, forbidden, a >> 1 & 0x1F, 0, 0, 0, prefix + 2)
    else:
        return None
    return None if forbidden else found


def annexb_header(data: bytes, codec: str) -> NalHeader | None:
    n = start_code(data)
    return bare_header(data, codec, n) if n else None


PARAMETER_SETS = {"H264": {6, 7, 8, 9}, "HEVC": {32, 33, 34, 35, 39, 40}, "VVC": {14, 15, 16, 20, 23, 24}, "LCEVC": {28, 29}}
SEI_TYPES = {"H264": {6}, "HEVC": {39, 40}, "VVC": {23, 24}}


def enhancement_start(data: bytes) -> tuple[str, int] | None:
    """Frame type and payload offset of an enhancement NAL: after a start code, a four-byte length, or bare."""
    if len(data) < 5:
        return None
    found = annexb_header(data, "LCEVC")
    if not found and len(data) >= 6 and 0 < int.from_bytes(data[:4], "big") <= len(data) - 4:
        found = bare_header(data, "LCEVC", 4)
    found = found or bare_header(data, "LCEVC")
    return (ENH_FRAME_TYPE[found.nal_type], found.header_size) if found and found.nal_type in ENH_FRAME_TYPE else None


def unescaped(data: bytes) -> tuple[bytes, bool]:
    """Payload without emulation prevention, trailing zeros and stop byte; False, and nothing, if there is no stop byte."""
    body = data.rstrip(b"\0")
    if not body or body[-1] != 0x80:
        return b"", False
    return ESCAPE.sub(b"\0\0", body[:-1]), True


def start_codes(data: bytes, most: int | None = None) -> list[tuple[int, int]]:
    """Offset and size of each start code."""
    out, at = [], 0
    while (hit := data.find(b"\0\0\1", at)) >= 0 and (most is None or len(out) < most):
        out.append((hit - 1, 4) if hit > at and data[hit - 1] == 0 else (hit, 3))
        at = hit + 3
    return out


def annexb_nals(data: bytes) -> list[tuple[int, int, bytes]]:
    """Offset, start code size and bytes (with the start code) of each NAL."""
    codes = start_codes(data)
    ends = [at for at, _ in codes[1:]] + [len(data)]
    return [(at, n, data[at:end]) for (at, n), end in zip(codes, ends, strict=True)]


def sei_payloads(body: bytes) -> list[tuple[int, int, int, bytes]]:
    """Type, offset, size and bytes of the messages of an SEI payload (headers and escapes removed)."""
    out, r = [], Reader(body)
    try:
        while len(r):
            kind = size = 0
            while (byte := r.uint()) == 0xFF:
                kind += 255
            kind += byte
            while (byte := r.uint()) == 0xFF:
                size += 255
            size += byte
            out.append((kind, r.at, size, r.take(min(size, len(r)))))
    except StreamError:
        pass
    return out
