"""Media columns: MPEG audio frames.

``parse`` reads a stream of layer I, II or III frames of MPEG 1, 2 or 2.5: it
skips and reads ID3v2 and ID3v1 tags, finds frame headers (and finds them again
after damage: a header counts if its frame ends at another header like it, or at the stream's
end), verifies the CRC-16 of each protected frame of any layer, reads a Xing, Info or VBRI table, and keeps
every frame's offset, so durations and seek points are exact rather than estimated.  A change of the
sample rate within a stream counts frame by frame.

``encode`` stores any bytes as a variable-bitrate layer III stream: silent frames, whose side
information claims no audio bits, carry the bytes in the room that is left (ancillary data); a tag
holds their number and CRC-32, and the first frame a Xing table.  An empty ID3v1 tag ends the stream,
so that payload in its last bytes is never taken for one.  ``decode`` gives them back.

Edge cases: null or empty media parse as a stream without frames; unreadable bytes are
skipped and counted; a damaged payload is null, with the reason in ``error``, and the other rows go on;
equal media give equal features; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import collections
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by rate index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

OWNER = b"payload\x00"
#: An ID3v1 tag without title, artist, album, year, comment or genre.
LAST = b"TAG" + bytes(124) + b"\xff"


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The header in a 32-bit word, or None if it isn't one (or has no fixed length)."""
    key = word >> 4
    if key in _headers:
        return _headers[key]
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    found = None
    if word >> 21 == 0x7FF and version and layer < 4 and 0 < index < 15 and rate < 3:
        kbps, hz, pad = BITRATES[(1 if version == 1 else 2, layer)][index], RATES[version][rate], word >> 9 & 1
        samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
        length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
        found = Header(version, layer, not word >> 16 & 1, kbps, hz, length, samples, word >> 6 & 3 == 3)
    if len(_headers) < 1 << 16:
        _headers[key] = found
    return found


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1
        out.append(c)
    return out


_CRC = _crc_table()
_crcs: dict[tuple[bytes, int], int] = {}


def crc16(data: bytes, bits: int | None = None) -> int:
    """CRC of a frame's last two header bytes and of what a layer protects after them, of which the first
    ``bits`` count (all of them by default)."""
    bits = 8 * len(data) if bits is None else bits
    key = (data[: -(-bits // 8)], bits)
    if key not in _crcs:
        c = 0xFFFF
        for b in data[: bits // 8]:
            c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
        for k in range(bits % 8):
            top = c >> 15 ^ data[bits // 8] >> (7 - k) & 1
            c = (c << 1 & 0xFFFF) ^ (0x8005 if top & 1 else 0)
        if len(_crcs) >= 1 << 16:
            _crcs.clear()
        _crcs[key] = c
    return _crcs[key]


# Fixed values of the same standards: bits of a layer II allocation, as (bits, subbands) from the lowest.
ALLOCATION = {
    "a": ((4, 11), (3, 12), (2, 4)),
    "b": ((4, 11), (3, 12), (2, 7)),
    "c": ((4, 2), (3, 6)),
    "d": ((4, 2), (3, 10)),
    "low": ((4, 4), (3, 7), (2, 19)),
}


def protected_bits(h: Header, mode: int, after: bytes) -> int:
    """How many bits after the CRC it covers.  ``mode`` is the header's last byte; ``after`` what follows the CRC."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    bound = 4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32  # joint stereo shares the subbands above
    if h.layer == 1:
        return 4 * (32 if h.mono else 2 * bound + 32 - bound)
    each = h.kbps // channels
    if h.version != 1:
        table = "low"
    elif each <= 48:
        table = "d" if h.rate == 32000 else "c"
    else:
        table = "a" if each <= 80 or h.rate == 48000 else "b"
    number, left = int.from_bytes(after, "big"), 8 * len(after)
    used, selections, subband = 0, 0, 0
    for bits, count in ALLOCATION[table]:
        for _ in range(count):
            for _ in range(channels if subband < bound else 1):
                used += bits
                if used > left:
                    return left
                if number >> (left - used) & (1 << bits) - 1:
                    selections += 2 * (1 if subband < bound else channels)  # two bits of scale factor selection
            subband += 1
    return used + selections


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of each frame
    headers: list[Header] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # first sample of each frame
    tags: dict[str, bytes] = field(default_factory=dict)
    table: dict = field(default_factory=dict)  # of the Xing, Info or VBRI header
    audio: list[int] = field(default_factory=list)  # numbers of the frames with sound
    checked: int = 0
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0
    samples: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exactly."""
        at = collections.Counter()
        for k in self.audio:
            at[self.headers[k].rate] += self.headers[k].samples
        return sum((Fraction(n, rate) for rate, n in at.items()), Fraction(0))

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample."""
        from bisect import bisect_right

        k = bisect_right(self.starts, sample) - 1
        return self.offsets[self.audio[max(0, k)]] if self.audio else 0


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _id3(data: bytes, at: int, out: Stream) -> int:
    """Reads an ID3v2 tag; returns where it ends."""
    major, size = data[at + 3], _syncsafe(data[at + 6 : at + 10])
    end = min(len(data), at + 10 + size)
    p = at + 10
    while p + 10 <= end and data[p] and major in (3, 4):
        n = _syncsafe(data[p + 4 : p + 8]) if major == 4 else int.from_bytes(data[p + 4 : p + 8], "big")
        out.tags.setdefault(data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + n)])
        p += 10 + n
    return end + (10 if data[at + 5] & 16 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict:
    base = at + 4 + 2 * h.protected + h.side
    kind = data[base : base + 4]
    if kind in (b"Xing", b"Info") and len(data) >= base + 8:
        flags, p, out = int.from_bytes(data[base + 4 : base + 8], "big"), base + 8, {"kind": kind.decode()}
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                part = data[p : p + n]
                out[name] = part if name == "toc" else int.from_bytes(part, "big")
                p += n
        return out
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        _, _, quality, total, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", data[at + 40 : at + 62])
        toc = [int.from_bytes(data[p : p + width], "big") * scale for p in range(at + 62, at + 62 + entries * width, max(1, width))]
        return {"kind": "VBRI", "frames": frames, "bytes": total, "quality": quality, "toc": toc, "per": per}
    return {}


def parse(data: bytes | None) -> Stream:
    out = Stream()
    data = data or b""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["TAG"] = data[end:]
    at, lost, like = 0, True, None
    while at + 4 <= end:
        if data[at : at + 3] == b"ID3" and at + 10 <= end:
            at = _id3(data, at, out)
            continue
        h = header(int.from_bytes(data[at : at + 4], "big"))
        ok = h is not None and at + h.length <= end
        if ok and lost:  # in step only if another frame, a tag or the end follows
            follows = at + h.length
            g = header(int.from_bytes(data[follows : follows + 4], "big")) if follows + 4 <= end else None
            ok = follows == end or data[follows : follows + 3] == b"ID3" or (g is not None and (g.version, g.layer, g.rate) == (h.version, h.layer, h.rate))
            ok = ok and (like is None or (h.version, h.layer, h.rate) == like)
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            tag = data.find(b"ID3", at + 1, end if nxt < 0 else nxt)
            nxt = tag if tag >= 0 else nxt
            nxt = end if nxt < 0 else nxt
            out.resyncs += not lost
            out.skipped += nxt - at
            at, lost = nxt, True
            continue
        lost, like = False, (h.version, h.layer, h.rate)
        if h.protected:
            out.checked += 1
            after = data[at + 6 : min(at + h.length, at + 6 + (h.side if h.layer == 3 else 64))]
            covered = min(8 * len(after), protected_bits(h, data[at + 3], after))
            if crc16(data[at + 2 : at + 4] + after, 16 + covered) != data[at + 4] << 8 | data[at + 5]:
                out.bad += 1
        first = not out.headers
        out.offsets.append(at)
        out.headers.append(h)
        if first:
            out.table = _vbr(data, at, h)
        if not (first and out.table):
            out.audio.append(len(out.offsets) - 1)
            out.starts.append(out.samples)
            out.samples += h.samples
        at += h.length
    out.skipped += max(0, end - at)
    return out


_MADE: list[tuple[int, bytes]] = []  # by bitrate: room, and all before the room


def _frames_made() -> list[tuple[int, bytes]]:
    if not _MADE:
        for index in range(1, 15):
            word = 0xFFE00000 | 3 << 19 | 1 << 17 | index << 12
            h, head = header(word), struct.pack(">I", word)
            _MADE.append((h.length - 38, head + struct.pack(">H", crc16(head[2:] + bytes(32))) + bytes(32)))
    return _MADE


def encode(payload: bytes) -> bytes:
    """``payload`` (not empty) as a stream; ``decode`` of it is the payload again."""
    made = _frames_made()
    room, head = made[-1]
    whole = len(payload) // room
    frames = [head + payload[i * room : (i + 1) * room] for i in range(whole)]
    rest = payload[whole * room :]
    if rest:
        room, head = next(x for x in made if x[0] >= len(rest))
        frames.append(head + rest + bytes(room - len(rest)))
    private = OWNER + struct.pack(">QI", len(payload), zlib.crc32(payload))
    size = len(private)
    body = b"PRIV" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127, 0, 0]) + private
    tag = b"ID3\x04\x00\x00" + bytes([0, 0, len(body) >> 7 & 127, len(body) & 127]) + body
    room, head = next(x for x in made if x[0] >= 120)
    total = sum(map(len, frames)) + len(head) + room
    n, at, toc = len(frames), 0, []
    ends = [len(head) + room]
    for f in frames:
        ends.append(ends[-1] + len(f))
    for k in range(100):
        at = k * n // 100
        toc.append(min(255, 256 * ends[at] // total))
    table = b"Xing" + struct.pack(">III", 15, n, total) + bytes(toc) + struct.pack(">I", 0)
    return b"".join([tag, head, table + bytes(room - len(table)), *frames, LAST])


def decode(data: bytes, stream: Stream | None = None) -> bytes:
    """The bytes that ``encode`` stored; an error if any are missing or changed."""
    stream = stream or parse(data)
    own = stream.tags.get("PRIV", b"")
    if not own.startswith(OWNER):
        raise ValueError("no payload tag")
    n, crc = struct.unpack(">QI", own[len(OWNER) : len(OWNER) + 12])
    parts = []
    for k in stream.audio:
        at, h = stream.offsets[k], stream.headers[k]
        parts.append(data[at + 4 + 2 * h.protected + h.side : at + h.length])
    payload = b"".join(parts)[:n]
    if len(payload) != n or zlib.crc32(payload) != crc:
        raise ValueError("payload damaged")
    return payload


def feature(s: Stream) -> str:
    """Counts, exact duration, bitrates and seek points, in one line."""
    rate = s.headers[0].rate if s.headers else 0
    kinds = ",".join(f"{k}x{sum(h.kbps == k for h in (s.headers[i] for i in s.audio))}" for k in sorted({s.headers[i].kbps for i in s.audio}))
    seek = ",".join(str(s.seek(s.samples * q // 4)) for q in range(4))
    table = f"{s.table['kind']}:{s.table.get('frames')}" if s.table else "none"
    return f"frames={len(s.audio)};samples={s.samples}/{rate};kbps={kinds};crc={s.checked - s.bad}/{s.checked};resync={s.resyncs};skipped={s.skipped};table={table};seek={seek}"


def padded(text: bytes) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def to_media(text: str | Column = "text") -> Column:
    """A text column as a media column; null as empty text."""

    @F.arrow_udf("binary")
    def store(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([encode(padded((x or "").encode("utf-8", "replace"))) for x in part.to_pylist()], pa.binary())

    return store(F.col(text) if isinstance(text, str) else text)


_READ = {
    "payload_bytes": ("bigint", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("bigint", pa.int64()), "media_bytes": ("bigint", pa.int64()), "media_sha256": ("string", pa.string()),
    "feature": ("string", pa.string()), "frames": ("bigint", pa.int64()), "samples": ("bigint", pa.int64()), "rate": ("bigint", pa.int64()), "duration": ("string", pa.string()),
    "offsets": ("array<bigint>", pa.list_(pa.int64())), "error": ("string", pa.string()),
}


def with_features(df: DataFrame, media: str | Column = "media") -> DataFrame:
    """Adds ``audio``: what is read from each media value, with the exact duration as a fraction of
    seconds and the offset of every audio frame to seek by."""
    kind = pa.struct([(name, arrow) for name, (_, arrow) in _READ.items()])

    @F.arrow_udf("struct<" + ",".join(f"{name}:{sql}" for name, (sql, _) in _READ.items()) + ">")
    def read(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            rows = []
            for m in part:
                m = m.as_py() or b""
                s = parse(m)
                row = {"media_bytes": len(m), "media_sha256": hashlib.sha256(m).hexdigest(), "feature": feature(s), "frames": len(s.audio), "samples": s.samples, "rate": s.headers[0].rate if s.headers else 0}
                row |= {"duration": str(s.duration), "offsets": [s.offsets[k] for k in s.audio]}
                if s.tags.get("PRIV", b"").startswith(OWNER):
                    try:
                        p = decode(m, s)
                        row |= {"payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:])}
                    except ValueError as e:
                        row["error"] = str(e)
                rows.append(row)
            yield pa.array(rows, kind)

    return df.withColumn("audio", read(F.col(media) if isinstance(media, str) else media))
