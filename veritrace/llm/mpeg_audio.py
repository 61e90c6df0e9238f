"""MPEG audio columns: frame headers, tags, variable-bitrate tables, checksums, durations and seek offsets.

read_stream() walks a byte string from frame to frame. Where no valid header stands it moves on to the next place at
which a header is followed by a second one of the same kind (or by the end of the data): junk is counted, never fatal.
write_stream() stores any bytes losslessly in the ancillary part of Layer III frames, which decoders skip.

Defined results: null or empty data has no frames and duration 0; a frame cut off by the end of the data is counted as
truncated and adds nothing to the duration; a checksum is verified for Layers I and III, counted as unchecked for II,
whose protected length depends on how bits were dealt to subbands. Tags of ID3v2.2 to 2.4 are read with extended
headers and unsynchronisation, ID3v1 fills in what they leave out; the first of two equal fields holds.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

# Fixed values of the format: kbit/s by (MPEG 1?, layer) and index, Hz by version bits and index.
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

JOINT, MONO = 1, 3
UNIT = 64  # payloads are padded to a multiple of so many bytes


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    checked: bool
    kbits: int
    hertz: int
    size: int
    samples: int
    side: int
    protected: int  # bytes after the checksum that it covers, -1 where the header alone does not tell


@lru_cache(maxsize=4096)
def parse_header(head: bytes) -> Header | None:
    """Four bytes as a frame header, or None where they are none (free format included: its size is not in the header)."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    rate, hz = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    first, mono = version == 3, head[3] >> 6 == MONO
    kbits, hertz, pad = KBITS[first, layer][rate], HERTZ[version][hz], head[2] >> 1 & 1
    if layer == 1:
        samples, size = 384, (12000 * kbits // hertz + pad) * 4
    else:
        samples = 1152 if layer == 2 or first else 576
        size = samples // 8 * 1000 * kbits // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    bound = 4 * (head[3] >> 4 & 3) + 4 if head[3] >> 6 == JOINT else 32
    protected = side if layer == 3 else -1 if layer == 2 else 16 if mono else 16 + bound // 2
    return Header(version, layer, not head[1] & 1, kbits, hertz, size, samples, side, protected)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table.append(value)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def frame_crc(data: bytes) -> int:
    """CRC-16 (polynomial 0x8005, start 0xFFFF) of the protected bytes of a frame."""
    value = 0xFFFF
    for byte in data:
        value = (value << 8 ^ _CRC[value >> 8 ^ byte]) & 0xFFFF
    return value


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    vbr: str = "none"
    vbr_frames: int = -1
    vbr_bytes: int = -1
    table_offsets: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    micros: int = 0
    bitrates: set[int] = field(default_factory=set)
    hertz: int = 0
    good: int = 0
    bad: int = 0
    unchecked: int = 0
    junk: int = 0
    resyncs: int = 0
    truncated: int = 0
    bodies: list[bytes] = field(default_factory=list)

    @property
    def payload(self) -> bytes:
        """The bytes that write_stream() stored."""
        return b"".join(self.bodies)[: int(self.tags.get("payload_bytes", 0))]


# Fixed values of the format: text fields of ID3v2.2 by their later names; encodings of text by their first byte.
OLD_NAMES = {"TT2": "TIT2", "TP1": "TPE1", "TAL": "TALB", "TYE": "TYER", "TRK": "TRCK", "TCO": "TCON", "TXX": "TXXX"}
CODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _synchronised(raw: bytes) -> bytes:
    """Without the zero bytes that keep a tag from looking like a frame."""
    return raw.replace(b"\xff\x00", b"\xff")


def _tag_frames(body: bytes, major: int, flags: int):
    """(name, content) of the frames of one ID3v2 tag."""
    if flags & 0x80 and major < 4:
        body = _synchronised(body)
    at, width = 0, 3 if major == 2 else 4
    if flags & 0x40 and major > 2 and len(body) >= 4:
        at = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4])
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at] != 0:
        name, raw = body[at : at + width].decode("latin-1"), body[at + width : at + 2 * width]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw)
        content = body[at + head : at + head + n]
        if major == 4:
            own = body[at + 9]
            content = content[4:] if own & 1 else content
            content = _synchronised(content) if own & 2 or flags & 0x80 else content
        yield OLD_NAMES.get(name, name), content
        at += head + n


def _read_tags(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Past the ID3v2 tags at `at`; their text frames go to tags."""
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
        for name, body in _tag_frames(data[at + 10 : at + 10 + size], major, flags) if major in (2, 3, 4) else ():
            if name[0] == "T" and body:
                text = body[1:].decode(CODINGS.get(body[0], "latin-1"), "replace")
                if name == "TXXX":
                    name, _, text = text.partition("\0")
                    text = text.lstrip("\ufeff")
                tags.setdefault(name, text.strip("\0"))
        at = min(at + 10 + size + (10 if flags & 0x10 else 0), len(data))
    return at


def _read_last_tag(raw: bytes, tags: dict[str, str]) -> None:
    """The 128 bytes of an ID3v1 tag."""
    said = lambda a, b: raw[a:b].split(b"\0")[0].decode("latin-1").rstrip()
    found = {"TIT2": said(3, 33), "TPE1": said(33, 63), "TALB": said(63, 93), "TYER": said(93, 97), "COMM": said(97, 127), "TCON": f"({raw[127]})" if raw[127] < 255 else ""}
    if raw[125] == 0 and raw[126]:
        found["TRCK"] = str(raw[126])
    for name, text in found.items():
        if text:
            tags.setdefault(name, text)


def _read_vbr(frame: bytes, h: Header, at: int, out: Stream) -> bool:
    """Whether the frame at place `at` is a Xing, Info or VBRI table rather than sound. Its seek points become places in
    the data."""
    i = 4 + 2 * h.checked + h.side
    mark = frame[i : i + 4]
    if mark in (b"Xing", b"Info"):
        flags, i, out.vbr = int.from_bytes(frame[i + 4 : i + 8]), i + 8, mark.decode()
        if flags & 1:
            out.vbr_frames, i = int.from_bytes(frame[i : i + 4]), i + 4
        if flags & 2:
            out.vbr_bytes, i = int.from_bytes(frame[i : i + 4]), i + 4
        if flags & 4 and out.vbr_bytes >= 0:
            out.table_offsets = [at + h.size + mark * out.vbr_bytes // 256 for mark in frame[i : i + 100]]
        return True
    if frame[36:40] == b"VBRI":
        number = lambda a, n: int.from_bytes(frame[a : a + n])
        out.vbr, out.vbr_bytes, out.vbr_frames = "VBRI", number(46, 4), number(50, 4)
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        place = at + h.size
        for k in range(min(entries, max(0, len(frame) - 62) // max(width, 1))):
            out.table_offsets.append(place)
            place += number(62 + k * width, width) * scale
        return True
    return False


def read_stream(data: bytes | None) -> Stream:
    """Everything that the stored bytes of one MPEG audio stream say."""
    out = Stream()
    data = data or b""
    at, end = _read_tags(data, 0, out.tags), len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        _read_last_tag(data[end:], out.tags)
    kind, first, lost = None, True, False
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        good = h is not None and kind in (None, (h.version, h.layer, h.hertz))
        if good and not _followed(data, at, h, end):
            # what follows is damaged: the frame counts if it stands in line and its checksum is right
            good = kind is not None and not lost and (_sound(data, at, h) if h.checked and h.protected >= 0 else not out.good)
        if not good:
            if not lost:
                lost, out.resyncs = True, out.resyncs + 1
            step = data.find(b"\xff", at + 1, end)
            step = step if step >= 0 else end
            out.junk, at = out.junk + step - at, step
            continue
        lost = False
        if at + h.size > end:
            out.truncated += 1
            at = end
            break
        kind = (h.version, h.layer, h.hertz)
        frame = data[at : at + h.size]
        out.hertz = h.hertz
        if not (first and _read_vbr(frame, h, at, out)):
            body = 4 + 2 * h.checked + h.side
            if h.checked and h.protected >= 0:
                right = _sound(frame, 0, h)
                out.good, out.bad = out.good + right, out.bad + (not right)
            else:
                out.unchecked += 1
            out.offsets.append(at)
            out.samples += h.samples
            out.bitrates.add(h.kbits)
            out.bodies.append(frame[body:])
        first = False
        at += h.size
    out.junk += end - at
    out.micros = out.samples * 1_000_000 // out.hertz if out.hertz else 0
    return out


def _sound(data: bytes, at: int, h: Header) -> bool:
    """Whether the checksum of a frame is right."""
    return frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.protected]) == int.from_bytes(data[at + 4 : at + 6])


def _followed(data: bytes, at: int, h: Header, end: int) -> bool:
    """A header counts as one if its frame ends the data or the next frame begins where it ends."""
    n = at + h.size
    if n >= end:
        return n == end
    g = parse_header(data[n : n + 4])
    return g is not None and (g.version, g.layer, g.hertz) == (h.version, h.layer, h.hertz)


def _head(rate: int, checked: bool) -> bytes:
    return bytes((0xFF, 0xFA if checked else 0xFB, rate << 4 | 2 << 2, MONO << 6))


_SIDE = 17
_SPACE = [(i, parse_header(_head(i, True)).size - 6 - _SIDE) for i in range(1, 15)]


def write_stream(payload: bytes) -> bytes:
    """Payload in MPEG-1 Layer III mono frames at 32 kHz: full frames, then the smallest that holds the rest.

    An ID3v2 tag names the payload's length, a Xing table the frames, bytes and a hundred seek points.
    """
    top, room = _SPACE[-1]
    frames = []
    for at in range(0, len(payload), room):
        part = payload[at : at + room]
        rate, space = (top, room) if len(part) == room else next(x for x in _SPACE if x[1] >= len(part))
        head = _head(rate, True)
        frames.append(head + frame_crc(head[2:4] + bytes(_SIDE)).to_bytes(2) + bytes(_SIDE) + part + bytes(space - len(part)))
    head = _head(5, False)
    total = sum(map(len, frames))
    ends, marks = 0, []
    for f in frames:
        marks.append(ends * 256 // max(total, 1))
        ends += len(f)
    toc = bytes(marks[i * len(marks) // 100] for i in range(100)) if marks else bytes(100)
    table = head + bytes(_SIDE) + b"Xing" + (7).to_bytes(4) + len(frames).to_bytes(4) + total.to_bytes(4) + toc
    table += bytes(parse_header(head).size - len(table))
    said = b"\0payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + len(said).to_bytes(4) + b"\0\0" + said
    n = len(tag)
    return b"ID3\3\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + tag + table + b"".join(frames)


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


FEATURES = T.StructType([
    T.StructField("n_frames", T.LongType()), T.StructField("duration_samples", T.LongType()), T.StructField("duration_us", T.LongType()), T.StructField("sample_rate", T.IntegerType()),
    T.StructField("vbr", T.StringType()), T.StructField("crc_good", T.LongType()), T.StructField("crc_bad", T.LongType()), T.StructField("junk_bytes", T.LongType()),
    T.StructField("seek_offsets", T.ArrayType(T.LongType(), False)), T.StructField("table_offsets", T.ArrayType(T.LongType(), False)),
])


def _facts(s: Stream) -> tuple:
    return len(s.offsets), s.samples, s.micros, s.hertz, s.vbr, s.good, s.bad, s.junk, s.offsets, s.table_offsets


def mpeg_columns(df: DataFrame, data_col: str = "data") -> DataFrame:
    """df with its binary column `data_col` replaced by the columns of FEATURES. One narrow pass, a stream at a time."""
    return arrow_map(df, lambda: lambda values: [_facts(read_stream(v)) for v in values], data_col, FEATURES)


STORED = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), *FEATURES.fields,
])


def _round_trip(raw: bytes | None) -> tuple:
    raw = raw or b""
    media = write_stream(padded(raw))
    s = read_stream(media)
    back = s.payload
    rates = "/".join(map(str, sorted(s.bitrates)))
    seek = hashlib.sha256(",".join(map(str, s.offsets)).encode()).hexdigest()[:16]
    said = f"mpeg1-layer3;hz={s.hertz};frames={len(s.offsets)};samples={s.samples};us={s.micros};kbps={rates};vbr={s.vbr}:{s.vbr_frames}:{s.vbr_bytes};crc={s.good}/{s.bad};junk={s.junk};seek={seek}"
    return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said, *_facts(s)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text (null: empty) stored as MPEG audio, read back and described: id and the columns of STORED."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, lambda: lambda values: [_round_trip(v) for v in values], "text", STORED, binary=True)
