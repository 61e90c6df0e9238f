import struct

from veritrace.llm import mpeg_audio as m


def frame(head, body=b""):
    h = m.parse_header(head)
    return head + body + bytes(h.size - 4 - len(body))


def test_tags_of_all_versions():
    text = lambda s: b"\0" + s
    old = b"TT2" + (6).to_bytes(3) + text(b"first") + b"TP1" + (4).to_bytes(3) + text(b"who")
    v22 = b"ID3\2\0\0" + bytes((0, 0, 0, len(old))) + old
    tags = {}
    assert m._read_tags(v22, 0, tags) == len(v22) and tags == {"TIT2": "first", "TPE1": "who"}
    body = b"TIT2" + (5).to_bytes(4) + b"\0\0" + text(b"\xff\x00ab")  # as stored: a zero keeps \xff from a frame's mark
    ext = (6).to_bytes(4) + bytes(6)
    v23 = b"ID3\3\0\xc0" + bytes((0, 0, 0, len(ext + body) + 0)) + ext + body
    tags = {}
    m._read_tags(v23.replace((5).to_bytes(4), (4).to_bytes(4)), 0, tags)
    assert tags == {"TIT2": "\xffab"}
    own = bytes((0, 0, 0, 4)) + text(b"\xff\x00b")
    body = b"TALB" + bytes((0, 0, 0, len(own))) + b"\0\3" + own
    ext = bytes((0, 0, 0, 6, 1, 0))
    v24 = b"ID3\4\0\x50" + bytes((0, 0, 0, len(ext + body))) + ext + body + b"3DI\4\0\x50" + bytes(4)
    tags = {}
    assert m._read_tags(v24, 0, tags) == len(v24) and tags == {"TALB": "\xffb"}
    last = b"TAG" + b"title".ljust(30, b"\0") + b"artist".ljust(30) + b"album".ljust(30, b"\0") + b"1999" + b"said".ljust(28, b"\0") + b"\0\7\x11"
    s = m.read_stream(m.write_stream(bytes(64)) + last)
    assert (s.tags["TIT2"], s.tags["TPE1"], s.tags["TALB"], s.tags["TYER"], s.tags["COMM"], s.tags["TRCK"], s.tags["TCON"]) == ("title", "artist", "album", "1999", "said", "7", "(17)")
    assert s.payload == bytes(64) and s.junk == 0


def test_seek_tables():
    media = m.write_stream(bytes(range(256)) * 200)
    s = m.read_stream(media)
    assert len(s.table_offsets) == 100 and s.table_offsets[0] == s.offsets[0]
    ends = [*s.offsets[1:], len(media)]
    for k, place in enumerate(s.table_offsets):  # each point is within a table's step of where it should be
        assert abs(place - s.offsets[k * len(s.offsets) // 100]) <= (ends[-1] - s.offsets[0]) // 256 + 1
    head = bytes((0xFF, 0xFB, 9 << 4, 3 << 6))
    sizes = [m.parse_header(head).size] * 6
    table = bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, sum(sizes), 6, 3, 2, 2, 2) + b"".join((2 * sizes[0] // 2).to_bytes(2) for _ in range(3))
    s = m.read_stream(frame(head, table) + b"".join(frame(head) for _ in sizes))
    assert s.vbr == "VBRI" and s.vbr_frames == 6 and s.table_offsets == s.offsets[::2]


def test_checksums_of_layer_one():
    for mode, ext, n in ((0, 0, 32), (3, 0, 16), (1, 0, 18), (1, 3, 24)):
        head = bytes((0xFF, 0xFE, 5 << 4, mode << 6 | ext << 4))
        body = bytes(range(1, n + 1))
        assert m.parse_header(head).layer == 1 and m.parse_header(head).protected == n
        whole = frame(head, m.frame_crc(head[2:4] + body).to_bytes(2) + body)
        flipped = bytearray(whole)
        flipped[7] ^= 4
        s = m.read_stream(whole * 2 + bytes(flipped) + whole)
        assert (s.good, s.bad, s.unchecked) == (3, 1, 0)
