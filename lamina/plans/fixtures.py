"""Made streams: an encoder of syntax blocks and a small BIN file, since no sample media is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.sources import containers, readers

IDR_HEADER, NON_IDR_HEADER = bytes.fromhex("7bff"), bytes.fromhex("79ff")


def varint(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def block(kind: int, body: bytes) -> bytes:
    """A block with the shortest size that fits."""
    if len(body) <= 5:
        return bytes([len(body) << 5 | kind]) + body
    return bytes([7 << 5 | kind]) + varint(len(body)) + body


def escaped(payload: bytes) -> bytes:
    """Payload with emulation prevention and the stop byte."""
    out, zeros = bytearray(), 0
    for b in payload:
        if zeros == 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out) + b"\x80"


def nal(payload: bytes, idr: bool = True) -> bytes:
    return b"\0\0\0\1" + (IDR_HEADER if idr else NON_IDR_HEADER) + escaped(payload)


class BitWriter:
    def __init__(self):
        self.out: list[int] = []

    def put(self, value: int, n: int) -> BitWriter:
        self.out += [value >> k & 1 for k in reversed(range(n))]
        return self

    def bytes(self) -> bytes:
        bits = self.out + [0] * (-len(self.out) % 8)
        return bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8))


SEQUENCE = block(0, bytes.fromhex("0200"))
GLOBAL = block(1, bytes.fromhex("35404880"))
PICTURE = block(2, bytes.fromhex("0200c8"))
PLAIN_PICTURE = block(2, bytes.fromhex("80"))


def encoded(layers: dict[int, bytes], total: int) -> bytes:
    """An encoded-data block of so many chunks, of which those in layers are enabled."""
    head, data = BitWriter(), b""
    for k in range(total):
        head.put(int(k in layers), 1).put(0, 1)
        if k in layers:
            data += varint(len(layers[k])) + layers[k]
    return block(3, head.bytes() + data)


def frame(k: int) -> bytes:
    """A NAL: two in five are configured, the others have picture and data only; one chunk of growing size."""
    payload = (SEQUENCE + GLOBAL if k % 5 < 2 else b"") + PICTURE + encoded({k % 32: bytes([0xAA]) * (3 + k)}, 32)
    return nal(payload, k % 5 < 2)


def bin_file(n: int = 12) -> bytes:
    """n frames in decode order whose presentation times swap in pairs."""
    return containers.bin_header() + b"".join(containers.bin_block(k, k ^ 1, frame(k)) for k in range(n))


#: Made streams and their frames.
MADE = {"made-a": 12, "made-b": 7}


def files(spark: SparkSession) -> DataFrame:
    return readers.from_bytes(spark, {f"{name}.bin": bin_file(n) for name, n in MADE.items()})
