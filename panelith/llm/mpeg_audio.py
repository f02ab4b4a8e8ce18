"""MPEG audio as a column: write, resynchronise, parse tags and variable-bitrate tables, check, time and seek."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelith.llm._common import ship, table

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer) and index, Hz by version bits and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE = 32000
SIDE = 17  # side information of a mono frame of version 1, layer III
HEAD = 4 + 2 + SIDE
SIZES = tuple(144 * k * 1000 // RATE for k in KBITS[True, 3])  # no padding is needed at 32 kHz
LAME = b"PANELITH1"
CLOSING = 3  # bitrate of the closing frame, whose silence is longer than an ID3v1 tag and the footer of an APEv2 tag


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbits: int
    hertz: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(4096)
def header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes, or None if they are none. Free-format frames aren't taken."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    v, layer, kind, rate = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if v == 1 or layer == 4 or kind in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    one, mono = v == 3, raw[3] >> 6 == 3
    kbits, hertz, pad = KBITS[one, layer][kind], HERTZ[v][rate], raw[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    side = ((17 if mono else 32) if one else (9 if mono else 17)) if layer == 3 else 0
    return Header({3: "1", 2: "2", 0: "2.5"}[v], layer, not raw[1] & 1, kbits, hertz, mono, size, samples, side)


@lru_cache(65536)
def frame_crc(covered: bytes) -> int:
    """CRC-16 of a protected frame: polynomial 0x8005, most significant bit first, from 0xFFFF."""
    crc = 0xFFFF
    for b in covered:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _bits_crc(crc: int, data: bytes, first: int, bits: int) -> int:
    """The CRC of frame_crc() carried on over some bits of data."""
    for i in range(first, first + bits):
        top = (crc >> 15 ^ data[i >> 3] >> (7 - (i & 7))) & 1
        crc = (crc << 1 ^ 0x8005 if top else crc << 1) & 0xFFFF
    return crc


# Fixed values of layer II: bits of allocation by subband as (bits, subbands) for each table, and which table holds.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def _allocation(h: Header) -> str:
    if h.version != "1":
        return "low"
    each = h.kbits // (1 if h.mono else 2)
    if each < 56:
        return "d" if h.hertz == 32000 else "c"
    return "a" if each <= 80 or h.hertz == 48000 else "b"


def checked_crc(frame: bytes, h: Header) -> int:
    """The CRC-16 that a protected frame should have: over half its header and, by layer, the side information, the bit allocation, or that and the scale factor selection."""
    if h.layer == 3:
        return frame_crc(frame[2:4] + frame[6 : 6 + h.side])
    crc, at, end = frame_crc(frame[2:4]), 48, 8 * len(frame)
    channels = 1 if h.mono else 2
    joint = frame[3] >> 6 == 1
    widths = [4] * 32 if h.layer == 1 else [w for w, n in ALLOCATION[_allocation(h)] for _ in range(n)]
    bound = min(4 * (1 + (frame[3] >> 4 & 3)), len(widths)) if joint else len(widths)
    used, p = 0, at
    for sb, width in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            if p + width > end:
                return -1
            value = int.from_bytes(frame[p >> 3 : (p >> 3) + 2].ljust(2, b"\0"), "big") >> (16 - (p & 7) - width) & ((1 << width) - 1)
            used += (channels if sb >= bound else 1) * (value > 0)
            p += width
    p += 2 * used if h.layer == 2 else 0
    return _bits_crc(crc, frame, at, p - at) if p <= end else -1


_BLOCK = 1024


@lru_cache(1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a byte adds by its distance from a block's end; what a whole block makes of the low and the high byte of a CRC."""
    byte = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ 0xA001, byte >> 1).astype(np.uint16)
    step = lambda c: c >> 8 ^ byte[c & 0xFF]
    by, low, high = np.empty((_BLOCK, 256), np.uint16), np.arange(256, dtype=np.uint16), np.arange(256, dtype=np.uint16) << 8
    c = byte
    for k in range(_BLOCK - 1, -1, -1):
        by[k], c, low, high = c, step(c), step(low), step(high)
    return by.ravel(), low, high


def music_crc(data: bytes) -> int:
    """CRC-16 as encoders store it of all audio data: polynomial 0x8005, least significant bit first, from 0."""
    by, low, high = _crc_tables()
    crc, base = 0, np.arange(_BLOCK, dtype=np.int32) * 256
    padded = bytes(-len(data) % _BLOCK) + data  # zeros in front don't count
    for at in range(0, len(padded), 1 << 20):
        part = np.frombuffer(padded, np.uint8, min(1 << 20, len(padded) - at), at).reshape(-1, _BLOCK)
        for own in np.bitwise_xor.reduce(by[base + part], axis=1).tolist():
            crc = int(low[crc & 0xFF]) ^ int(high[crc >> 8]) ^ own
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _txxx(name: str, value: str) -> bytes:
    body = b"\x03" + name.encode() + b"\0" + value.encode()
    return b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def write_audio(payload: bytes, n_bytes: int) -> bytes:
    """A variable-bitrate stream of silent frames of layer III whose ancillary data are the payload.

    An ID3v2.4 tag holds the lengths and a CRC-32, the first frame the table of the variable
    bitrate with the CRC of all audio data; each other frame is protected by its own CRC. The last frame holds
    no payload, so whatever the payload is, the stream doesn't end in bytes that read as a tag.
    """
    frames, offsets, at = [], [], 0
    top = len(SIZES) - 1
    while True:
        left = len(payload) - at
        kind = CLOSING if left <= 0 else top if left >= SIZES[top] - HEAD else next(i for i in range(1, top + 1) if SIZES[i] - HEAD >= left)
        room = SIZES[kind] - HEAD
        head = bytes((0xFF, 0xFA, kind << 4 | 2 << 2, 0xC0))
        frames.append(head + frame_crc(head[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE) + payload[at : at + room].ljust(room, b"\0"))
        offsets.append(len(frames[-1]))
        if left <= 0:
            break
        at += room
    audio = b"".join(frames)
    info = SIZES[2]
    ends = [info]
    for n in offsets:
        ends.append(ends[-1] + n)
    toc = bytes(min(255, 256 * ends[i * len(frames) // 100] // ends[-1]) for i in range(100))
    body = b"Xing" + struct.pack(">III", 15, len(frames), ends[-1]) + toc + struct.pack(">I", 0)
    body += LAME + bytes(1 + 1 + 8 + 1 + 1 + 3 + 1 + 1 + 2) + struct.pack(">IH", ends[-1], music_crc(audio))
    first = bytes((0xFF, 0xFB, 2 << 4 | 2 << 2, 0xC0)) + bytes(SIDE) + body
    first = (first + music_crc(first).to_bytes(2, "big")).ljust(info, b"\0")
    tags = _txxx("payload_bytes", str(len(payload))) + _txxx("n_bytes", str(n_bytes)) + _txxx("payload_crc32", f"{zlib.crc32(payload):08x}")
    return b"ID3\x04\0\0" + _syncsafe(len(tags)) + tags + first + audio


@dataclass
class Audio:
    """What a stream holds. Offsets are bytes from the start of the data."""

    version: str | None = None
    layer: int | None = None
    hertz: int | None = None
    tags: dict[str, str] = field(default_factory=dict)
    vbr: str | None = None
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    table: list[int] = field(default_factory=list)  # byte offsets of the seek table's points, evenly spaced in time
    delay: int = 0
    padding: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    skipped: int = 0  # bytes passed over to find a frame again
    crc_ok: int = 0
    crc_bad: int = 0
    music_ok: bool | None = None
    samples: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.hertz if self.hertz else 0.0


def _id3v2(data: bytes, out: dict[str, str]) -> int:
    """Bytes of the ID3v2 tags at the start."""
    at = 0
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and not any(b & 0x80 for b in data[at + 6 : at + 10]):
        major, flags = data[at + 3], data[at + 5]
        safe = lambda b: sum((x & 0x7F) << 7 * (len(b) - 1 - i) for i, x in enumerate(b))
        size = safe(data[at + 6 : at + 10])
        body = data[at + 10 : at + 10 + size]
        if flags & 0x80 and major < 4:
            body = body.replace(b"\xff\0", b"\xff")
        p = 0
        if flags & 0x40 and major > 2 and len(body) >= 4:
            p = safe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
        name_n, head_n = (3, 6) if major == 2 else (4, 10)
        while p + head_n <= len(body) and body[p]:
            name, raw = body[p : p + name_n].decode("latin-1"), body[p + name_n : p + name_n + (3 if major == 2 else 4)]
            n = safe(raw) if major == 4 else int.from_bytes(raw, "big")
            value = body[p + head_n : p + head_n + n]
            if flags & 0x80 and major == 4:
                value = value.replace(b"\xff\0", b"\xff")
            if name[:1] == "T" and value:
                text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
                key, _, rest = text.partition("\0")
                out.update({f"{name}:{key}": rest} if name in ("TXXX", "TXX") else {name: text})
            p += head_n + n
        at += 10 + size + 10 * bool(flags & 0x10)
    return min(at, len(data))


def _tail(data: bytes, out: dict[str, str], least: int) -> int:
    """Where the audio ends, before ID3v1 and APEv2 tags. What begins before `least` is no tag: a table says that audio is there."""
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= least + 128:
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out[f"id3v1:{name}"] = value
    if data[max(0, end - 32) : max(0, end - 24)] == b"APETAGEX" and end >= least + 32:
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        p = start = end - size
        if start - 32 * (flags >> 31) < least:
            return end
        for _ in range(count):
            if not 0 <= p < end - 32:
                break
            n = int.from_bytes(data[p : p + 4], "little")
            key, _, _ = data[p + 8 : end].partition(b"\0")
            p += 9 + len(key)
            out[f"ape:{key.decode('latin-1')}"] = data[p : p + n].decode("utf-8", "replace")
            p += n
        end = max(0, start - 32 * (flags >> 31))
    return end


def read_audio(data: bytes | None) -> Audio:
    """Parse a stream. A header counts if a like one (version, layer, rate) follows its frame, or the data end there.

    Null, empty or foreign data give no frames; what lies between frames counts as skipped; a last frame that is cut off isn't taken.
    """
    data, out = data or b"", Audio()
    at = _id3v2(data, out.tags)
    end = _tail(data, out.tags, _promised(data, at))
    start, first = at, None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        good = h is not None and at + h.size <= end and (first is None or (h.version, h.layer, h.hertz) == (first.version, first.layer, first.hertz))
        if good and (first is None or at != start):  # at the start or after a gap: the next header must agree, or a table be there
            good = _agrees(data, at, end, h) or first is None and _marked(data[at : at + h.size], h)
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            out.skipped += (nxt if nxt >= 0 else end) - at
            at, start = (nxt if nxt >= 0 else end), -1
            continue
        if first is None:
            first, out.version, out.layer, out.hertz = h, h.version, h.layer, h.hertz
            if _table(data[at : at + h.size], h, out, data[at + h.size : end], at):
                at = start = at + h.size
                continue
        if h.protected:
            ok = checked_crc(data[at : at + h.size], h) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_ok += ok
            out.crc_bad += not ok
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.heads.append(h)
        out.samples += h.samples
        at = start = at + h.size
    out.skipped += max(0, end - at)
    out.samples = max(0, out.samples - out.delay - out.padding)
    return out


def _agrees(data: bytes, at: int, end: int, h: Header) -> bool:
    if at + h.size == end:
        return True
    n = header(data[at + h.size : at + h.size + 4])
    return n is not None and (n.version, n.layer, n.hertz) == (h.version, h.layer, h.hertz)


def _marked(frame: bytes, h: Header) -> bool:
    p = 4 + 2 * h.protected + h.side
    return frame[p : p + 4] in (b"Xing", b"Info") or frame[36:40] == b"VBRI"


def _promised(data: bytes, at: int) -> int:
    """Where the audio ends by the byte count of a table in the frame at `at`; `at` if it has none, or one past the data."""
    h = header(data[at : at + 4])
    if h is None:
        return at
    found = Audio()
    _table(data[at : at + h.size], h, found, b"", at)
    end = at + (found.vbr_bytes or 0)
    return end if end <= len(data) else at


def _table(frame: bytes, h: Header, out: Audio, rest: bytes, at: int) -> bool:
    """Read the variable-bitrate table of a first frame, which is at `at`; False if it has none and so is audio."""
    p = 4 + 2 * h.protected + h.side
    if frame[p : p + 4] in (b"Xing", b"Info"):
        out.vbr = frame[p : p + 4].decode()
        flags = int.from_bytes(frame[p + 4 : p + 8], "big")
        q = p + 8
        if flags & 1:
            out.vbr_frames, q = int.from_bytes(frame[q : q + 4], "big"), q + 4
        if flags & 2:
            out.vbr_bytes, q = int.from_bytes(frame[q : q + 4], "big"), q + 4
        if flags & 4:
            out.table, q = [at + (out.vbr_bytes or 0) * b // 256 for b in frame[q : q + 100]], q + 100
        q += 4 * bool(flags & 8)
        if len(frame) >= q + 36 and any(frame[q : q + 9]):
            gap = int.from_bytes(frame[q + 21 : q + 24], "big")
            out.delay, out.padding = gap >> 12, gap & 0xFFF
            length, music, own = struct.unpack(">IHH", frame[q + 28 : q + 36])
            audio = rest[: max(0, length - len(frame))]
            out.music_ok = music_crc(frame[: q + 34]) == own and music_crc(audio) == music
        return True
    if frame[36:40] == b"VBRI":
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames, n, scale, width, _ = struct.unpack(">IIHHHH", frame[46:62].ljust(16, b"\0"))
        place = at + h.size
        if width:
            for k in range(62, min(62 + n * width, len(frame) - width + 1), width):
                out.table.append(place)
                place += int.from_bytes(frame[k : k + width], "big") * scale
        return True
    return False


def read_payload(data: bytes, a: Audio) -> bytes:
    """The ancillary data that write_audio() stored; raises ValueError if they don't match the tag."""
    size = a.tags.get("TXXX:payload_bytes", "")
    raw = b"".join(data[o + HEAD : o + n] for o, n in zip(a.offsets, a.sizes, strict=True))[: int(size) if size.isdecimal() else 0]
    if f"{zlib.crc32(raw):08x}" != a.tags.get("TXXX:payload_crc32") or not a.tags.get("TXXX:n_bytes", "").isdecimal():
        raise ValueError("the stored payload is damaged")
    return raw


def encode(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media): each text's payload as an MPEG stream. A null text counts as empty; equal texts give equal streams."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                media = [write_audio(payload_of(t), len((t or "").encode())) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], names=[key, "media"])

    rows = df.select(key, F.col(text).cast("string"))
    return rows.mapInArrow(run, f"{key} {rows.dtypes[0][1]}, media binary")


PROBED = {
    "frames": pa.int64(), "hertz": pa.int32(), "samples": pa.int64(), "seconds": pa.float64(), "vbr": pa.string(), "crc_ok": pa.int64(), "crc_bad": pa.int64(), "music_ok": pa.bool_(), "skipped": pa.int64(), "seek": pa.list_(pa.int64()),
    "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "payload_ok": pa.bool_(),
}
PROBED_DDL = "frames long, hertz int, samples long, seconds double, vbr string, crc_ok long, crc_bad long, music_ok boolean, skipped long, seek array<long>, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, payload_ok boolean"


def describe(data: bytes | None, every: int = 1) -> tuple:
    """A row of PROBED. seek: the byte offset of each `every`-th frame. payload_ok: null in streams that hold no payload, false in those whose payload is damaged; payload columns are null in both."""
    a = read_audio(data)
    data = data or b""
    raw, fine = None, None
    if "TXXX:payload_crc32" in a.tags:
        try:
            raw, fine = read_payload(data, a), True
        except ValueError:
            fine = False
    seek = a.offsets[::every]
    feature = f"mpeg{a.version}-layer{a.layer};hz={a.hertz};vbr={a.vbr};frames={len(a.offsets)};samples={a.samples};crc={a.crc_ok}/{a.crc_ok + a.crc_bad};music={a.music_ok};skipped={a.skipped};seek={zlib.crc32(np.array(seek, '<i8').tobytes()):08x}"
    own = (None,) * 4 if raw is None else (int(a.tags["TXXX:n_bytes"]), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]))
    return (len(a.offsets), a.hertz, a.samples, a.seconds, a.vbr, a.crc_ok, a.crc_bad, a.music_ok, a.skipped, seek, *own, len(data), hashlib.sha256(data).hexdigest(), feature, fine)


def probe(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, PROBED...): durations, seek offsets, checks and the stored payload's digests of each stream."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                cols = list(zip(*(describe(m) for m in part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, PROBED.values(), strict=True))], names=[key, *PROBED])

    rows = df.select(key, media)
    return rows.mapInArrow(run, f"{key} {rows.dtypes[0][1]}, {PROBED_DDL}")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = probe(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "seconds", "seek")
