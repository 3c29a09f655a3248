"""Parsers of container bytes. Each yields plain tuples; readers.py runs them over files."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from lamina.functions.bits import Reader, StreamError, start_code
from lamina.functions.blocks import fields

BIN_MAGIC = b"lcevcbin"
BIN_VERSION = 1
TS_PACKET = 188
#: Fixed stream type codes of transport streams.
TS_CODECS = {0x1B: "H264", 0x24: "HEVC", 0x33: "VVC", 0x36: "LCEVC"}
TS_OTHER = {0x01, 0x02, 0x03, 0x04, 0x0F, 0x11, 0x81, 0x87}
#: Fixed sample entry codes of MP4 video tracks.
MP4_CODECS = {b"avc1": "H264", b"avc3": "H264", b"hvc1": "HEVC", b"hev1": "HEVC", b"vvc1": "VVC", b"vvi1": "VVC", b"lvc1": "LCEVC", b"vp08": "VP8", b"vp09": "VP9", b"av01": "AV1"}


def bin_blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Decode index, presentation index and payload of each block of a BIN file."""
    r = Reader(data)
    if r.take(8) != BIN_MAGIC:
        raise StreamError("the file does not begin with the BIN magic")
    if (version := r.uint(4)) > BIN_VERSION:
        raise StreamError(f"BIN version {version} is not supported")
    while len(r):
        kind, size = r.uint(2), r.uint(4)
        if kind:
            raise StreamError(f"BIN blocks of type {kind} are unknown")
        if size <= 16:
            raise StreamError("a BIN payload has no data")
        body = r.take(size)
        yield int.from_bytes(body[:8], "big", signed=True), int.from_bytes(body[8:16], "big", signed=True), body[16:]


def bin_block(decode: int, presentation: int, data: bytes) -> bytes:
    """One block, as bin_blocks reads it; data that is not Annex B gets a start code over its first four bytes."""
    if not start_code(data):
        data = b"\0\0\0\1" + data[4:]
    body = decode.to_bytes(8, "big", signed=True) + presentation.to_bytes(8, "big", signed=True) + data
    return b"\0\0" + len(body).to_bytes(4, "big") + body


def bin_header() -> bytes:
    return BIN_MAGIC + BIN_VERSION.to_bytes(4, "big")


def length_prefixed(data: bytes, width: int = 4) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of NALs after big-endian lengths."""
    r = Reader(data)
    while len(r) >= width:
        n = r.uint(width)
        if not n or n > len(r):
            raise StreamError(f"a length of {n} at {r.at - width} leads out of the sample")
        yield r.at, r.take(n)


def _pes(data: bytes) -> tuple[int | None, int | None, bytes]:
    """PTS, DTS and payload of an elementary stream packet."""
    if data[:3] != b"\0\0\1" or len(data) < 9:
        raise StreamError("a packet does not begin with its start code")
    flags, size = data[7] >> 6, data[8]

    def stamp(at: int) -> int:
        b = data[at : at + 5]
        return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1

    pts = stamp(9) if flags & 2 else None
    dts = stamp(14) if flags == 3 else pts
    length = int.from_bytes(data[4:6], "big")
    return pts, dts, data[9 + size : 6 + length if length else None]


def ts_packets(data: bytes) -> Iterator[tuple[int, str, int | None, int | None, int, bytes]]:
    """PID, codec, PTS, DTS, file position and data of each packet of the video streams. Where the sync byte is lost, it
    goes on at the next place from which two packets in a row have one; packets that were open there are dropped."""
    maps: set[int] = set()
    sections: dict[int, bytes] = {}
    codecs: dict[int, str] = {}
    parts: dict[int, list[bytes]] = defaultdict(list)
    began: dict[int, int] = {}

    def flush(pid: int) -> Iterator[tuple]:
        whole = b"".join(parts.pop(pid, ()))
        if whole:
            pts, dts, body = _pes(whole)
            yield pid, codecs[pid], pts, dts, began[pid], body

    def table(pid: int, section: bytes) -> None:
        """The PIDs of maps, or the codecs of a map's streams, of a whole section without its checksum."""
        if pid == 0:
            maps.update((section[k + 2] & 0x1F) << 8 | section[k + 3] for k in range(8, len(section) - 3, 4) if section[k : k + 2] != b"\0\0")
            return
        k = 12 + ((section[10] & 0x0F) << 8 | section[11])
        while k + 5 <= len(section):
            if section[k] in TS_CODECS:
                codecs[(section[k + 1] & 0x1F) << 8 | section[k + 2]] = TS_CODECS[section[k]]
            k += 5 + ((section[k + 3] & 0x0F) << 8 | section[k + 4])

    def add(pid: int, part: bytes) -> None:
        """Puts a section together, which can reach over packets."""
        whole = sections.pop(pid, b"") + part
        size = 3 + ((whole[1] & 0x0F) << 8 | whole[2]) if len(whole) > 2 else None
        if size is None or len(whole) < size:
            sections[pid] = whole
        elif size > 12:
            table(pid, whole[: size - 4])

    at = -TS_PACKET
    while (at := at + TS_PACKET) + TS_PACKET <= len(data):
        if data[at] != 0x47:
            last = len(data) - TS_PACKET
            at = next((k for k in range(at + 1, last + 1) if data[k] == 0x47 and (k == last or k + TS_PACKET > last or data[k + TS_PACKET] == 0x47)), len(data))
            parts.clear()  # what was open holds the damage
            if at == len(data):
                break
        p = data[at : at + TS_PACKET]
        pid, starts, control = (p[1] & 0x1F) << 8 | p[2], p[1] & 0x40, p[3] >> 4 & 3
        body = p[4:] if control == 1 else p[5 + p[4] :] if control == 3 else b""
        if not body:
            continue
        if pid == 0 or pid in maps:
            if starts:
                if pid in sections:
                    add(pid, body[1 : 1 + body[0]])
                sections.pop(pid, None)
                add(pid, body[1 + body[0] :])
            elif pid in sections:
                add(pid, body)
        elif pid in codecs:
            if starts:
                yield from flush(pid)
                began[pid] = at
            if starts or pid in parts:
                parts[pid].append(body)
    for pid in list(parts):
        yield from flush(pid)


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of each MP4 box."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head or at + size > end:
            raise StreamError(f"the box at {at} leads out of the file")
        yield kind, at + head, at + size
        at += size


def find_box(data: bytes, path: list[bytes], at: int = 0, end: int | None = None) -> tuple[int, int] | None:
    for kind, lo, hi in boxes(data, at, end):
        if kind == path[0]:
            return (lo, hi) if len(path) == 1 else find_box(data, path[1:], lo, hi)
    return None


def sample_boxes(data: bytes, wanted: bytes) -> Iterator[tuple[int, int]]:
    """Start and end of the boxes of a kind inside the video sample entries of all tracks."""
    moov = find_box(data, [b"moov"])
    for kind, lo, hi in boxes(data, *moov) if moov else ():
        entries = find_box(data, [b"mdia", b"minf", b"stbl", b"stsd"], lo, hi) if kind == b"trak" else None
        for _, start, end in boxes(data, entries[0] + 8, entries[1]) if entries else ():
            yield from ((x, y) for k, x, y in boxes(data, start + 78, end) if k == wanted)


def _table(data: bytes, at: int, widths: tuple[int, ...]) -> list[tuple[int, ...]]:
    r = Reader(data[at + 4 :])
    return [tuple(r.uint(w) for w in widths) for _ in range(r.uint(4))]


def mp4_packets(data: bytes) -> Iterator[tuple[int, str, int, int, float, int, bytes]]:
    """Track, codec, PTS, DTS, seconds a tick, file position and data of each sample of the video tracks."""
    moov = find_box(data, [b"moov"])
    if not moov:
        raise StreamError("the file has no movie box, or is fragmented")
    track = 0
    for kind, lo, hi in boxes(data, *moov):
        if kind != b"trak":
            continue
        track += 1
        stbl, mdhd = find_box(data, [b"mdia", b"minf", b"stbl"], lo, hi), find_box(data, [b"mdia", b"mdhd"], lo, hi)
        if not stbl or not mdhd:
            continue
        inside = {k: (a, b) for k, a, b in boxes(data, *stbl)}
        codec = MP4_CODECS.get(data[inside[b"stsd"][0] + 12 : inside[b"stsd"][0] + 16])
        if not codec:
            continue
        at = mdhd[0] + (20 if data[mdhd[0]] == 1 else 12)
        tick = 1 / int.from_bytes(data[at : at + 4], "big")
        z = inside[b"stsz"][0]
        fixed, n = int.from_bytes(data[z + 4 : z + 8], "big"), int.from_bytes(data[z + 8 : z + 12], "big")
        sizes = [fixed] * n if fixed else [int.from_bytes(data[z + 12 + 4 * k : z + 16 + 4 * k], "big") for k in range(n)]
        dts, steps = [], 0
        for count, step in _table(data, inside[b"stts"][0], (4, 4)):
            for _ in range(count):
                dts.append(steps)
                steps += step
        shift = [0] * n
        if b"ctts" in inside:
            shift = [o - (1 << 32) if o >> 31 else o for c, o in _table(data, inside[b"ctts"][0], (4, 4)) for _ in range(c)]
        offsets = [o for (o,) in (_table(data, inside[b"co64"][0], (8,)) if b"co64" in inside else _table(data, inside[b"stco"][0], (4,)))]
        runs = _table(data, inside[b"stsc"][0], (4, 4, 4))
        k = 0
        for i, (first, per, _) in enumerate(runs):
            last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
            for chunk in range(first - 1, last):
                at = offsets[chunk]
                for _ in range(per):
                    if k < n:
                        yield track, codec, dts[k] + shift[k], dts[k], tick, at, data[at : at + sizes[k]]
                        at += sizes[k]
                        k += 1


def enh_config(body: bytes) -> dict:
    """The enhancement decoder configuration (content of an lvcC box)."""
    r = Reader(body)
    out = {"configuration_version": r.uint(), "profile": r.uint(), "level": r.uint()}
    chroma, luma_depth, chroma_depth = fields(r.uint(), 2, 3, 3)
    out |= {"chroma_format_idc": chroma, "bit_depth_luma": luma_depth + 8, "bit_depth_chroma": chroma_depth + 8}
    out |= {"length_size": (r.uint() >> 6) + 1, "width": r.uint(4), "height": r.uint(4)}
    out |= dict(zip(("sc_in_stream", "gc_in_stream", "ai_in_stream"), map(bool, fields(r.uint(), 1, 1, 1, 5)), strict=False))
    arrays = []
    for _ in range(r.uint()):
        kind, n = r.uint() & 0x3F, r.uint(2)
        arrays.append({"nal_type": kind, "nals": [r.take(r.uint(2)) for _ in range(n)]})
    return out | {"arrays": arrays}
