"""Parsers and exporters of disks, programs, animations and fonts, on files that the tests build."""

import struct
import zlib

import numpy as np
import pytest

from dustlens.sources import codecs, export
from dustlens.sources.inspect import inspect_bytes


def nodes_of(data, name="x", type_id=None):
    nodes, failure = inspect_bytes(data, name, type_id)
    assert not failure, failure
    return nodes


def block(words):
    words = [w & 0xFFFFFFFF for w in words]
    words[5] = -sum(words) & 0xFFFFFFFF
    return struct.pack(">128I", *words)


def named(name):
    raw = bytes([len(name)]) + name.encode()
    return struct.unpack(">8I", raw.ljust(32, b"\0"))


def disk(fast, content):
    """A disk with the folder ``sub`` that holds ``a.txt``."""
    out = bytearray(901120)
    out[:4] = b"DOS" + bytes([fast])
    step = 512 if fast else 488
    parts = [content[i : i + step] for i in range(0, len(content), step)]
    root, folder, file = [0] * 128, [0] * 128, [0] * 128
    root[0], root[127], root[6], root[108:116] = 2, 1, 900, named("Vol")
    folder[0], folder[127], folder[10], folder[108:116] = 2, 2, 901, named("sub")
    file[0], file[127], file[2], file[81], file[108:116] = 2, -3, len(parts), len(content), named("a.txt")
    for i, part in enumerate(parts):
        at = 1000 + i
        file[77 - i] = at
        if fast:
            out[at * 512 : at * 512 + len(part)] = part
        else:
            body = part.ljust(488, b"\0")
            out[at * 512 : at * 512 + 512] = block([8, 901, i + 1, len(part), 0, 0, *struct.unpack(">122I", body)])
    for at, words in ((880, root), (900, folder), (901, file)):
        out[at * 512 : at * 512 + 512] = block(words)
    return bytes(out)


@pytest.mark.parametrize("fast", [0, 1])
def test_disk(fast):
    content = bytes(i * 7 & 255 for i in range(1500))
    found = {n.path: n for n in nodes_of(disk(fast, content))}
    assert list(found) == ["/disk", "/disk/sub", "/disk/sub/a.txt"]
    assert found["/disk/sub/a.txt"].data == content
    assert ("filesystem", "FFS" if fast else "OFS") in found["/disk"].metadata
    damaged = bytearray(disk(fast, content))
    damaged[880 * 512 + 100] ^= 1
    assert inspect_bytes(bytes(damaged), "x", "amiga.adf")[0] == []


def program(body=b"\x70\0\x4e\x75"):
    n = len(body) // 4
    return struct.pack(">6I", 0x3F3, 0, 1, 0, 0, n) + struct.pack(">II", 0x3E9, n) + body + struct.pack(">I", 0x3F2)


def member(label, body, method=b"-lh0-", plain=None):
    plain = body if plain is None else plain
    head = method + struct.pack("<IIIBBB", len(body), len(plain), 0, 0, 0, len(label)) + label + struct.pack("<H", codecs.crc16(plain))
    return bytes([len(head), sum(head) & 255]) + head + body


def test_program_and_archive_behind_it():
    assert [n.path for n in nodes_of(program())] == ["/executable", "/executable/0-code"]
    found = {n.path: n for n in nodes_of(program() + member(b"use", b"usage") + member(b"a", b"abc") + b"\0")}
    assert found["/sfx/usage"].data == b"usage" and found["/archive/a"].data == b"abc"


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}" if n else ""

    def done(self):
        return bytes(int(self.bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(self.bits), 8))


def test_lh5_of_literals_and_of_copies():
    w = Writer()  # a, b, a copy of four, a
    w.put(4, 16)
    w.put(5, 5)
    for n in (0, 0, 1):
        w.put(n, 3)
    w.put(0, 2)
    for n in (2, 2):
        w.put(n, 3)  # 2 -> '0', 3 -> '10', 4 -> '11'
    w.put(258, 9)
    for zeros, code, length in ((97, "11", 2), (0, "11", 2), (158, "10", 1)):
        if zeros:
            w.bits += "0"
            w.put(zeros - 20, 9)
        w.bits += code
    w.put(0, 4), w.put(1, 4)  # one place: 1, two back
    # lengths: 97 -> 2, 98 -> 2, 257 -> 1, so 257 '0', 97 '10', 98 '11'
    w.bits += "10" + "11" + "0" + "10"
    assert codecs.unpack_lh5(w.done(), 7) == b"abababa"
    assert nodes_of(member(b"t", w.done(), b"-lh5-", b"abababa") + b"\0")[-1].data == b"abababa"
    bad = nodes_of(member(b"t", w.done(), b"-lh5-", b"abababb") + b"\0")[-1]
    assert bad.data == b"" and dict(bad.metadata)["failure"]


def chunks(kind, *parts):
    body = b"".join(n + struct.pack(">I", len(v)) + v + b"\0" * (len(v) & 1) for n, v in parts)
    return b"FORM" + struct.pack(">I", len(body) + 4) + kind + body


def test_contiguous_chunky_and_deep_bitmaps():
    colours = bytes(range(24))
    head = lambda planes, packing: struct.pack(">HHhhBBBBHBB", 3, 2, 0, 0, planes, 0, packing, 0, 0, 1, 1)
    want = np.array([[0, 1, 2], [3, 2, 1]])
    planes = b"".join(bytes([int("".join(str(v >> p & 1) for v in row).ljust(8, "0"), 2), 0]) for p in (0, 1) for row in want.tolist())
    rgba = b"".join(colours[3 * v : 3 * v + 3] + b"\xff" for v in want.ravel())
    assert nodes_of(chunks(b"ACBM", (b"BMHD", head(2, 0)), (b"CMAP", colours), (b"ABIT", planes)))[0].raster.rgba == rgba
    rows = bytes([0, 1, 2, 9, 3, 2, 1, 9])
    for packing, body in ((0, rows), (1, codecs.pack_runs(rows))):
        assert nodes_of(chunks(b"PBM ", (b"BMHD", head(8, packing)), (b"CMAP", colours), (b"BODY", body)))[0].raster.rgba == rgba
    deep = chunks(b"DEEP", (b"DGBL", struct.pack(">HHHBB", 2, 1, 0, 1, 1)), (b"DPEL", struct.pack(">I6H", 3, 1, 8, 2, 8, 3, 8)), (b"DBOD", bytes(range(6))))
    assert nodes_of(deep)[0].raster.rgba == bytes([0, 1, 2, 255, 3, 4, 5, 255])


def test_icon_and_picture_bank():
    gadget = struct.pack(">IhhHHHHHIIIIIHI", 0, 0, 0, 16, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1)
    tail = struct.pack(">BBIIiiIII", 3, 0, 1, 1, 5, 6, 0, 0, 4096)
    picture = struct.pack(">hhHHHIBBI", 0, 0, 16, 1, 2, 1, 3, 0, 0) + b"\x80\0\xc0\0"
    text = lambda s: struct.pack(">I", len(s) + 1) + s + b"\0"
    icon = struct.pack(">HH", 0xE310, 1) + gadget + tail + picture + text(b"tool") + struct.pack(">I", 8) + text(b"A=1")
    group, raster = nodes_of(icon)
    assert dict(group.metadata)["default-tool"] == "tool" and dict(group.metadata)["tool-type.0"] == "A=1"
    assert raster.raster.rgba[:12] == bytes([102, 136, 187, 255, 255, 255, 255, 255, 170, 170, 170, 255])
    bank = b"AmSp" + struct.pack(">H", 1) + struct.pack(">HHHhh", 1, 1, 1, 2, 3) + b"\x80\0" + struct.pack(">32H", 0, 0xF00, *[0] * 30)
    assert [n.path for n in nodes_of(b"AmBs\0\1" + bank)] == ["/banks", "/banks/0/sprite", "/banks/0/sprite/0"]
    sprite = nodes_of(bank)[1]
    assert sprite.raster.rgba[:8] == bytes([255, 0, 0, 255, 0, 0, 0, 0]) and ("hotspot.x", 2) in sprite.metadata


def test_fonts():
    index = struct.pack(">HH", 0x0F00, 1) + b"f/8".ljust(256, b"\0") + struct.pack(">HBB", 8, 0, 0)
    assert dict(nodes_of(index)[1].metadata)["index.filename"] == "f/8"
    text = struct.pack(">HBBHHHHBBIHIII", 2, 0, 0, 8, 1, 1, 0, 65, 65, 110, 2, 114, 0, 0)
    body = b"\x70\xff\x4e\x75" + bytes(14) + b"\x0f\x80" + bytes(58) + text + b"\x80\0\x40\0" + struct.pack(">4H", 0, 3, 3, 2)
    font = nodes_of(program(body + bytes(-len(body) % 4)))[0]
    assert font.type_id == "amiga.bitmap-diskfont" and dict(font.metadata)["glyph.65"] == "0,3,8,0" and font.raster.rgba[:4] == b"\xff" * 4
    fzx = struct.pack("<BbB", 2, 1, 33) + struct.pack("<HB", 8 | 1 << 14, 0x03) + struct.pack("<HB", 6, 0x13) + struct.pack("<H", 4) + b"\x80\x40"
    nodes = nodes_of(fzx, "x.fzx")
    assert dict(nodes[0].metadata)["characters"] == 2
    out = export.bmfont("/font", 32, 2, [{"key": k, "value": str(v)} for k, v in nodes[0].metadata]).decode()
    assert "chars count=2" in out


def test_screens_and_layers():
    nodes = nodes_of(bytes([255] * 6144) + bytes([1] * 768) + bytes([2] * 768), "x.scr")
    assert [n.raster.rgba[:3] for n in nodes[1:]] == [bytes([0, 0, 215]), bytes([215, 0, 0]), bytes([107, 0, 107])]
    wide = nodes_of(bytes([255]) + bytes(49151), "x.nxi")[0].raster
    assert (wide.width, wide.height, wide.rgba[:8]) == (256, 192, bytes([255, 255, 255, 255, 0, 0, 0, 255]))
    tall = nodes_of(bytes([0, 255]) + bytes(81918), "x.nxi")[0].raster
    assert (tall.width, tall.height) == (320, 256) and tall.rgba[320 * 4 : 320 * 4 + 3] == b"\xff" * 3


def test_flic_with_runs_copies_and_deltas():
    part = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    frame = lambda *parts: struct.pack("<IHH8x", 16 + sum(map(len, parts)), 0xF1FA, len(parts)) + b"".join(parts)
    colours = part(4, struct.pack("<HBB", 1, 0, 2) + bytes([0, 0, 0, 9, 8, 7]))
    runs = part(15, bytes([1, 4, 1]) + bytes([1, 0xFC, 0, 1, 0, 1]))
    delta = part(7, struct.pack("<HH", 1, 0xFFFF) + struct.pack("<HBbH", 1, 2, 1, 0x0000))
    body = frame(colours, runs) + frame(delta) + frame()
    data = struct.pack("<IHHHHHHI", 128 + len(body), 0xAF12, 2, 4, 2, 8, 3, 40).ljust(128, b"\0") + body
    node = nodes_of(data)[0]
    show = lambda rgba: [int(v > 0) for v in rgba[::4]]
    assert [(ms, show(v)) for ms, v in node.frames] == [(40, [1, 1, 1, 1, 0, 1, 0, 1]), (40, [1, 1, 1, 1, 0, 1, 0, 0])]


def test_sprite_with_linked_cel():
    chunk = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    frame = lambda ms, *parts: struct.pack("<IHHH2xI", 16 + sum(map(len, parts)), 0xF1FA, len(parts), ms, len(parts)) + b"".join(parts)
    palette = chunk(0x2019, struct.pack("<III8x", 2, 0, 1) + struct.pack("<H4B", 0, 0, 0, 0, 255) + struct.pack("<H4B", 0, 1, 2, 3, 255))
    layer = chunk(0x2004, struct.pack("<HHHHHHB3xH", 1, 0, 0, 0, 0, 0, 255, 0))
    cel = chunk(0x2005, struct.pack("<HhhBHh5xHH", 0, 1, 0, 255, 0, 0, 1, 1) + b"\1")
    linked = chunk(0x2005, struct.pack("<HhhBHh5xH", 0, 1, 0, 255, 1, 0, 0))
    body = frame(50, palette, layer, cel) + frame(60, linked)
    data = struct.pack("<IHHHHHIH8xB3xH", 128 + len(body), 0xA5E0, 2, 2, 1, 8, 1, 100, 0, 2).ljust(128, b"\0") + body
    colours, sprite = nodes_of(data)
    assert colours.palette == [(0, 0, 0, 255), (1, 2, 3, 255)]
    assert sprite.frames == [(50, bytes([0, 0, 0, 0, 1, 2, 3, 255])), (60, bytes([0, 0, 0, 0, 1, 2, 3, 255]))]


def test_animations_come_back_from_gif():
    rng = np.random.default_rng(1)
    frames = []
    for ms in (100, 200, 50):
        v = rng.integers(0, 3, (5, 7, 4)).astype(np.uint8) * 100
        v[..., 3] = 255
        frames.append((ms, v.tobytes()))
    node = nodes_of(export.gif(7, 5, frames))[0]
    assert node.frames == frames and dict(node.metadata)["frames"] == 3
    moving = export.apng(7, 5, frames)
    assert nodes_of(moving, "x.png")[0].raster.rgba == frames[0][1] and moving.count(b"fcTL") == 3
    assert export.gif(300, 1, [(0, bytes(v for i in range(300) for v in (i & 255, i >> 8, 0, 255)))]) is None


def test_documents_and_photographs():
    write = struct.pack("<HH", 0xBE31, 0).ljust(14, b"\0") + struct.pack("<I", 128 + 8)
    assert nodes_of(write.ljust(128, b"\0") + b"a\r\nb\x93c\td")[0].text == "a\nb“c\td"
    ws = nodes_of(b".LM 5\r\nHell\xef\x8d\nworld\x02!\x02\r\n\x1a\x1a", "a.ws")[0]
    assert ws.text == "Hello world!\n" and dict(ws.metadata)["wordstar.dot-commands"] == 1
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\2\0\0\1\0\1\0\0" + b"\xff\xc2\0\x0b\x08\0\x05\0\x07\1\0\0\0"
    found = dict(nodes_of(jpeg)[0].metadata)
    assert nodes_of(jpeg)[0].kind == "opaque" and found["decode.warning"]
    assert (found["image.width"], found["image.height"], found["jpeg.progressive"]) == (7, 5, 1)


def test_animation_of_byte_deltas():
    head = struct.pack(">HHhhBBBBHBB", 8, 2, 0, 0, 1, 0, 0, 0, 0, 1, 1)
    first = chunks(b"ILBM", (b"BMHD", head), (b"CMAP", bytes([0, 0, 0, 255, 255, 255])), (b"BODY", b"\xf0\0\x0f\0"))
    moved = lambda ops: chunks(b"ILBM", (b"ANHD", struct.pack(">BBHHhhIIB", 5, 0, 8, 2, 0, 0, 0, 6, 0).ljust(40, b"\0")), (b"DLTA", struct.pack(">16I", 64, *[0] * 15) + ops))
    body = first + moved(b"\2\1\x81\xff\0") + moved(b"\1\0\2\xaa\0")
    node = nodes_of(b"FORM" + struct.pack(">I", len(body) + 4) + b"ANIM" + body)[0]
    lines = [[int("".join(str(v & 1) for v in rgba[y * 32 : y * 32 + 32 : 4]), 2) for y in (0, 1)] for _, rgba in node.frames]
    assert lines == [[0xF0, 0x0F], [0xF0, 0xFF], [0xAA, 0xAA]] and node.frames[0][0] == 100


def test_hold_and_modify():
    head = struct.pack(">HHhhBBBBHBB", 3, 1, 0, 0, 6, 0, 0, 0, 0, 1, 1)
    pixels = [1, 0x2F, 0x10]  # the second colour; red to 15; blue to 0
    planes = b"".join(bytes([int("".join(str(v >> p & 1) for v in pixels).ljust(8, "0"), 2), 0]) for p in range(6))
    data = chunks(b"ILBM", (b"BMHD", head), (b"CAMG", struct.pack(">I", 0x800)), (b"CMAP", bytes([0, 0, 0, 16, 32, 48] + [0] * 42)), (b"BODY", planes))
    assert nodes_of(data)[0].raster.rgba == bytes([16, 32, 48, 255, 255, 32, 48, 255, 255, 32, 0, 255])


def test_flashing_screen_has_two_frames():
    node = nodes_of(bytes(6144) + bytes([0x82]) + bytes(767))[0]
    assert [v[:3] for _, v in node.frames] == [bytes(3), bytes([215, 0, 0])]


def packed_disk(content, how):
    out, image = [], disk(0, content)
    for n in range(80):
        plain = image[n * 11264 : (n + 1) * 11264]
        body = plain if how == 0 else b"".join(b"\x90\0" if v == 0x90 else bytes([v]) for v in plain.rstrip(b"\0")) + (b"\x90\xff\0" + struct.pack(">H", 11264 - len(plain.rstrip(b"\0"))) if plain[-1:] == b"\0" else b"")
        head = b"TR" + struct.pack(">HHHHHBBHH", n, 0, len(body), len(plain), len(plain), 0, how, sum(plain) & 0xFFFF, codecs.crc16(body))
        out.append(head + struct.pack(">H", codecs.crc16(head)) + body)
    head = b" PRO" + struct.pack(">IIHHII", 0, 0, 0, 79, 0, 901120) + bytes(24) + struct.pack(">H", how)
    return b"DMS!" + head.ljust(50, b"\0") + struct.pack(">H", codecs.crc16(head.ljust(50, b"\0"))) + b"".join(out)


@pytest.mark.parametrize("how", [0, 1])
def test_packed_disk(how):
    found = {n.path: n for n in nodes_of(packed_disk(b"content \x90" * 90, how))}
    assert found["/disk/sub/a.txt"].data == b"content \x90" * 90 and found["/disk"].type_id == "amiga.dms"


def test_program_with_squashed_image():
    body = b"hello " * 1000
    parts = zlib.compress(body[:4096])
    rest = zlib.compress(body[4096:])
    meta = lambda raw: struct.pack("<H", 0x8000 | len(raw)) + raw
    file = struct.pack("<HHHHIIIIIII", 2, 0o644, 0, 0, 0, 2, 96, 0, 0, len(body), len(parts))
    root = struct.pack("<HHHHII", 1, 0o755, 0, 0, 0, 1) + struct.pack("<IIHHI", 0, 2, 3 + 12 + 8 + 5, 0, 0)
    names = struct.pack("<III", 0, 0, 2) + struct.pack("<HhHH", 0, 0, 2, 4) + b"a.txt"
    at = 96 + len(parts) + len(rest)
    inodes, folders = meta(file + root), meta(names)
    entry = meta(struct.pack("<QII", 96 + len(parts), len(rest), 0))
    table = at + len(inodes) + len(folders) + len(entry)
    image = struct.pack("<IIIIIHHHHHHQQQQQQQQ", 0x73717368, 2, 0, 4096, 1, 1, 12, 0, 1, 4, 0, len(file), table + 8, 0, 0, at, at + len(inodes), table, 0)
    image += parts + rest + inodes + folders + entry + struct.pack("<Q", at + len(inodes) + len(folders))
    elf = b"\x7fELF\2\1\1\0AI\2".ljust(40, b"\0") + struct.pack("<Q", 64) + bytes(10) + struct.pack("<HH", 0, 0)
    found = {n.path: n for n in nodes_of(elf.ljust(64, b"\0") + image)}
    assert found["/appimage/a.txt"].data == body


def test_font_descriptors():
    text = b'info face="F" size=8\ncommon lineHeight=9 base=7 scaleW=16 scaleH=16 pages=1\npage id=0 file="f.png"\nchars count=1\nchar id=65 x=1 y=2 width=3 height=4 xoffset=0 yoffset=-1 xadvance=5 page=0 chnl=15\n'
    xml = b'<font>\n<info face="F" size="8"/>\n<common lineHeight="9" base="7" scaleW="16" scaleH="16"/>\n<pages>\n<page id="0" file="f.png"/>\n</pages>\n<char id="65" x="1" y="2" width="3" height="4" xoffset="0" yoffset="-1" xadvance="5" page="0"/>\n</font>'
    part = lambda kind, body: struct.pack("<BI", kind, len(body)) + body
    binary = b"BMF\3" + part(1, struct.pack("<h", 8) + bytes(12) + b"F\0") + part(2, struct.pack("<HHHHH", 9, 7, 16, 16, 1)) + part(3, b"f.png\0") + part(4, struct.pack("<IHHHHhhhBB", 65, 1, 2, 3, 4, 0, -1, 5, 0, 15))
    found = [dict(nodes_of(d, "f.fnt")[0].metadata) for d in (text, xml, binary)]
    assert all(f["glyph.65"] == "1,2,3,4,0,-1,5,0" and f["page.0"] == "f.png" and f["font.face"] == "F" for f in found)


def wad(lumps):
    at, body, directory = 12, b"", b""
    for name, data in lumps:
        directory += struct.pack("<II8s", at + len(body), len(data), name.encode())
        body += data
    return struct.pack("<4sII", b"IWAD", len(lumps), at + len(body)) + body + directory


def test_scenery_of_a_wad():
    post = lambda y, v: bytes([y, len(v), 0]) + v + b"\0\xff"
    columns = [post(0, b"\1"), post(1, b"\2")]
    picture = struct.pack("<HHhhII", 2, 2, 5, 6, 16, 16 + len(columns[0])) + b"".join(columns)
    texture = struct.pack("<II", 1, 8) + struct.pack("<8sIHHIH", b"WALL", 0, 4, 2, 0, 2) + struct.pack("<hhHHH", 0, 0, 0, 1, 0) + struct.pack("<hhHHH", 2, 0, 0, 1, 0)
    lines = struct.pack("<HHHHHHH", 0, 1, 0, 0, 0, 0, 0) + struct.pack("<HHHHHHH", 1, 2, 128, 0, 0, 0, 0)
    lumps = [("PLAYPAL", bytes(range(256)) * 3), ("PNAMES", struct.pack("<I8s", 1, b"p1")), ("P1", b""), ("P1", picture), ("TEXTURE1", texture), ("S_START", b""), ("TROO", picture), ("S_END", b"")]
    lumps += [("E1M1", b""), ("THINGS", b""), ("LINEDEFS", lines), ("SIDEDEFS", b""), ("VERTEXES", struct.pack("<6h", 0, 0, 9, 0, 9, 5)), ("BAD", b"")]
    found = {n.path: n for n in nodes_of(wad(lumps))}
    wall = found["/wad/textures/4-TEXTURE1/0-WALL"].raster
    assert (wall.width, wall.height) == (4, 2) and wall.rgba[:8] == bytes([3, 4, 5, 255, 0, 0, 0, 0]) and wall.rgba[8:12] == wall.rgba[:4]
    assert ("position.left-offset", 5) in found["/wad/sprites/6-TROO"].metadata
    area = found["/wad/maps/8-E1M1/automap"].raster
    pixels = np.frombuffer(area.rgba, np.uint8).reshape(area.height, area.width, 4)
    assert (area.width, area.height) == (9 + 17, 5 + 17) and (pixels[13, 8:18, :3] == (128, 128, 128)).all() and not pixels[:13, :, :3].any()
    assert dict(found["/wad/maps/8-E1M1"].metadata)["map.hidden-linedefs"] == 1


def test_lines_of_a_map_have_colours():
    line = lambda a, b, flags, right, left: struct.pack("<HHHHHHH", a, b, flags, 0, 0, right, left)
    side = lambda sector: bytes(28) + struct.pack("<H", sector)
    sector = lambda floor, ceiling: struct.pack("<hh", floor, ceiling) + bytes(22)
    lines = line(0, 1, 0, 0, 0xFFFF) + line(2, 3, 0, 0, 1) + line(4, 5, 0, 0, 2) + line(6, 7, 32, 0, 0)
    lumps = [("E1M1", b""), ("LINEDEFS", lines), ("SIDEDEFS", side(0) + side(1) + side(2)), ("VERTEXES", struct.pack("<16h", *(v for y in range(4) for x in (0, 9) for v in (x, y * 2)))), ("SECTORS", sector(0, 100) + sector(0, 90) + sector(5, 100)), ("PLAYPAL", bytes(768))]
    area = {n.path: n for n in nodes_of(wad(lumps))}["/wad/maps/0-E1M1/automap"].raster
    pixels = np.frombuffer(area.rgba, np.uint8).reshape(area.height, area.width, 4)
    assert [tuple(pixels[area.height - 9 - 2 * k, 12, :3].tolist()) for k in range(4)] == [(255, 0, 0), (255, 255, 0), (160, 80, 0), (255, 0, 0)]


def baseline(values, width, height, restart=0):
    """A grey picture whose blocks are flat, with one code of 8 bits for the differences and one for the end of a block."""
    sizes = bytes([0, 0, 0, 0, 16]) + bytes(11)
    w, last, out = Writer(), 0, b""
    for i, v in enumerate(values):
        if restart and i and i % restart == 0:
            w.bits += "1" * (-len(w.bits) % 8)
            out, last = out + w.done().replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + (i // restart - 1) % 8]), 0
            w = Writer()
        d, last = v - last, v
        n = abs(d).bit_length()
        w.put(n, 5)
        w.put(d if d >= 0 else d + (1 << n) - 1, n)
        w.put(0, 1)
    w.bits += "1" * (-len(w.bits) % 8)
    out += w.done().replace(b"\xff", b"\xff\0")
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    head = part(0xDB, b"\0" + bytes([8] * 64)) + part(0xC0, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0]))
    head += part(0xC4, b"\0" + sizes + bytes(range(16))) + part(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\0") + (part(0xDD, struct.pack(">H", restart)) if restart else b"")
    return b"\xff\xd8" + head + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_photograph(restart):
    values = [-128, 127, 0, 60, -5, 100]
    got = nodes_of(baseline(values, 20, 13, restart))[0].raster
    pixels = np.frombuffer(got.rgba, np.uint8).reshape(13, 20, 4)
    assert [int(pixels[y, x, 0]) for y in (3, 12) for x in (2, 10, 18)] == [v + 128 for v in values]


def test_order_and_transform_of_coefficients():
    from dustlens.sources import jpeg

    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert np.allclose(jpeg.COSINES @ jpeg.COSINES.T, np.eye(8))


def test_moving_picture_comes_back():
    frames = [(100, bytes([1, 2, 3, 255] * 6)), (50, bytes([9, 8, 7, 128] * 6))]
    assert nodes_of(export.apng(3, 2, frames))[0].frames == frames


def test_terminal_picture():
    sauce = b"SAUCE00" + b"Title".ljust(35) + b"Me".ljust(20) + bytes(20) + b"20200101" + bytes(4) + bytes([1, 1]) + struct.pack("<H", 10) + bytes(30)
    node = nodes_of(b"\x1b[2J\x1b[1;31mabc\x1b[2;3Hx\x1b[1A\xdb\x1b[2Dd\r\n0123456789-\x1a" + sauce, "a.ans")[0]
    assert node.text == "abd█\n0123456789\n-" and dict(node.metadata)["sauce.title"] == "Title" and dict(node.metadata)["ansi.columns"] == 10


def test_program_with_banks():
    bank = b"AmBk" + struct.pack(">HHI", 1, 0, 8 + 4) + b"Data    " + b"abcd"
    data = b"AMOS Basic V134 " + struct.pack(">I", 6) + b"tokens" + b"AmBs" + struct.pack(">H", 1) + bank
    found = {n.path: n for n in nodes_of(data)}
    assert found["/listing"].data == b"tokens" and "/banks/0" in found


def test_progressive_photograph_equals_the_sequential_one():
    """The same coefficients, written at once and in six scans: approximations, then the bits that lack."""
    rng = np.random.default_rng(4)
    count, width, height = 6, 20, 13
    blocks = np.zeros((count, 64), int)
    blocks[:, 0] = rng.integers(-100, 100, count)
    for b in blocks:
        b[1 + rng.choice(63, 12, replace=False)] = rng.integers(-9, 10, 12)
    blocks[2, 1:] = 0
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    symbols = bytes(range(256))
    table = lambda head: part(0xC4, bytes([head]) + bytes([0] * 7 + [255, 1] + [0] * 7) + symbols)  # noqa: E731 - 255 codes of 8 bits, one of 9
    head = lambda kind: part(0xDB, b"\0" + bytes([1] * 64)) + part(kind, struct.pack(">BHHB", 8, height, width, 1) + bytes([1, 0x11, 0])) + table(0) + table(16)
    stuffed = lambda w: w.done_ones().replace(b"\xff", b"\xff\0")

    class Bits(Writer):
        def symbol(self, v):
            self.put(v if v < 255 else 510, 8 if v < 255 else 9)

        def signed(self, v):
            n = abs(int(v)).bit_length()
            self.put(int(v) if v >= 0 else int(v) + (1 << n) - 1, n)

        def done_ones(self):
            self.bits += "1" * (-len(self.bits) % 8)
            return self.done()

    def scan(start, end, high, low, w):
        return part(0xDA, bytes([1, 1, 0, start, end, high << 4 | low])) + stuffed(w)

    w, last = Bits(), 0
    for b in blocks:
        d, last = int(b[0]) - last, int(b[0])
        w.symbol(abs(d).bit_length()), w.signed(d)
        zeros = 0
        for v in b[1:]:
            if not v:
                zeros += 1
                continue
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(int(v)).bit_length()), w.signed(v)
            zeros = 0
        if zeros:
            w.symbol(0)
    sequential = b"\xff\xd8" + head(0xC0) + scan(0, 63, 0, 0, w) + b"\xff\xd9"
    out, low = head(0xC2), 1
    w, last = Bits(), 0
    for b in blocks:  # the first place without its lowest bit
        v = int(b[0]) >> low
        w.symbol(abs(v - last).bit_length()), w.signed(v - last)
        last = v
    out += scan(0, 0, 0, low, w)
    for start, end in ((1, 5), (6, 63)):
        w, ended = Bits(), 0

        def flush():
            nonlocal ended
            if ended:
                n = ended.bit_length() - 1
                w.symbol(n << 4), w.put(ended - (1 << n), n)
                ended = 0

        for b in blocks:
            shifted = [int(v) // 2 if v >= 0 else -(int(-v) // 2) for v in b[start : end + 1]]
            zeros = 0
            for v in shifted:
                if not v:
                    zeros += 1
                    continue
                flush()
                while zeros > 15:
                    w.symbol(0xF0)
                    zeros -= 16
                w.symbol(zeros << 4 | abs(v).bit_length()), w.signed(v)
                zeros = 0
            ended += zeros > 0
        flush()
        out += scan(start, end, 0, low, w)
    w = Bits()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out += scan(0, 0, 1, 0, w)
    for start, end in ((1, 5), (6, 63)):
        w = Bits()
        for b in blocks:
            band = [int(v) for v in b[start : end + 1]]
            fresh = [i for i, v in enumerate(band) if abs(v) == 1]
            at = 0
            for i in fresh:
                zeros, held = 0, ""
                for v in band[at:i]:
                    if abs(v) > 1:
                        held += str(abs(v) & 1)
                    else:
                        zeros += 1
                        if zeros == 16:
                            w.symbol(0xF0)
                            w.bits += held
                            zeros, held = 0, ""
                w.symbol(zeros << 4 | 1), w.put(int(band[i] > 0), 1)
                w.bits += held
                at = i + 1
            if at < len(band):
                w.symbol(0)
                w.bits += "".join(str(abs(v) & 1) for v in band[at:] if abs(v) > 1)
        out += scan(start, end, 1, 0, w)
    got, want = (nodes_of(d)[0].raster for d in (b"\xff\xd8" + out + b"\xff\xd9", sequential))
    assert got == want and len(set(got.rgba)) > 20


@pytest.mark.parametrize("way", range(1, 9))
def test_orientation(way):
    values = [-128, 127, 0, 60, -5, 100]
    exif = b"Exif\0\0MM\0\x2a\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x112, 3, 1, way, 0) + bytes(4)
    data = baseline(values, 20, 13)
    node = nodes_of(data[:2] + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + data[2:])[0]
    plain = np.frombuffer(nodes_of(data)[0].raster.rgba, np.uint8).reshape(13, 20, 4)
    turned = {1: plain, 2: plain[:, ::-1], 3: np.rot90(plain, 2), 4: plain[::-1], 5: plain.transpose(1, 0, 2), 6: np.rot90(plain, -1), 7: np.rot90(plain, 2).transpose(1, 0, 2), 8: np.rot90(plain)}[way]
    assert (node.raster.width, node.raster.height) == (turned.shape[1], turned.shape[0]) and node.raster.rgba == np.ascontiguousarray(turned).tobytes()
    assert dict(node.metadata)["exif.orientation"] == way


def moving(op, parts, first=b"\xf0\0\x0f\0", bits=0, box=(8, 2, 0, 0), mask=1):
    """An animation of 8 by 2 pixels in one plane: the lines of its frames."""
    head = struct.pack(">HHhhBBBBHBB", 8, 2, 0, 0, 1, 0, 0, 0, 0, 1, 1)
    still = chunks(b"ILBM", (b"BMHD", head), (b"CMAP", bytes([0, 0, 0, 255, 255, 255])), (b"BODY", first))
    body = still
    for part in parts:
        anhd = struct.pack(">BBHHhhIIBBI", op, mask, *box, 0, 6, 1, 0, bits).ljust(40, b"\0")
        body += chunks(b"ILBM", (b"ANHD", anhd), (b"BODY" if op < 2 else b"DLTA", part))
    node = nodes_of(b"FORM" + struct.pack(">I", len(body) + 4) + b"ANIM" + body)[0]
    return [[int("".join(str(v & 1) for v in rgba[y * 32 : y * 32 + 32 : 4]), 2) for y in (0, 1)] for _, rgba in node.frames]


def test_animations_by_other_methods():
    pointers = lambda at, n=8: struct.pack(f">{n}I", at, *[0] * (n - 1))
    assert moving(0, [b"\1\0\2\0"])[1] == [1, 2]
    assert moving(1, [b"\xff\0\xff\0"])[1] == [0x0F, 0xF0]
    assert moving(1, [b"\xf0\0"], box=(4, 1, 2, 1))[1] == [0xF0, 0x0F ^ 0b00111100]
    # Words of two bytes: the second word is set, by itself and by a run of one.
    assert moving(3, [pointers(32) + struct.pack(">hHh", 1, 0xAA00, -1)])[1] == [0xF0, 0xAA]
    assert moving(3, [pointers(32) + struct.pack(">hHHh", -2, 1, 0x0200, -1)])[1] == [0xF0, 2]
    assert moving(2, [pointers(32) + struct.pack(">hIh", 0, 0x03000400, -1)])[1] == [3, 4]
    lists = struct.pack(">16I", 32, *[0] * 7, 34, *[0] * 7)
    assert moving(4, [lists + struct.pack(">HHhhh", 0x1100, 0, 1, 1, -1)])[1] == [0xF0, 0x11]
    assert moving(4, [lists + struct.pack(">HHhhh", 0xFF00, 0, 0, -2, -1)], bits=8 | 2)[1] == [0x0F, 0xF0]
    assert moving(4, [lists + struct.pack(">HHhhh", 0x1200, 0x3400, 0, 2, -1)[:4] + struct.pack(">hhh", 0, 2, -1)], bits=0x10)[1] == [0x12, 0x34]


def test_deep_runs():
    body = bytes([1, 1, 2, 3, 4, 5, 6, 0xFF, 7, 8, 9]) + b"\0"
    deep = chunks(b"DEEP", (b"DGBL", struct.pack(">HHHBB", 2, 2, 1, 1, 1)), (b"DPEL", struct.pack(">I6H", 3, 1, 8, 2, 8, 3, 8)), (b"DBOD", body))
    assert nodes_of(deep)[0].raster.rgba == bytes([1, 2, 3, 255, 4, 5, 6, 255, 7, 8, 9, 255, 7, 8, 9, 255])


def test_bank_of_samples():
    sounds = [b"\1\xff", b"\x80\x7f\0"]
    at, table, body = 2 + 8, b"", b""
    for i, sound in enumerate(sounds):
        table += struct.pack(">I", at)
        body += struct.pack(">8sHI", b"s%d" % i, 8000 + i, len(sound)) + sound
        at += 14 + len(sound)
    payload = struct.pack(">H", 2) + table + body
    make = lambda p: b"AmBk" + struct.pack(">HHI", 5, 0, 8 + len(p)) + b"Samples " + p
    group, *own = nodes_of(make(payload))
    assert group.kind == "group" and [(n.path, n.audio.rate, n.audio.channels) for n in own] == [("/bank/samples/1", 8000, [[1, -1]]), ("/bank/samples/2", 8001, [[-128, 127, 0]])]
    damaged = nodes_of(make(payload + b"x"))
    assert damaged[0].kind == "opaque" and dict(damaged[0].metadata)["failure"]


def test_packed_picture():
    """Packed here by the rule that the reader follows backwards: bytes, bits that tell where they change, bits that tell where those change."""
    rng = np.random.default_rng(6)
    planes, lumps, high, line = 2, 3, 4, 3
    want = rng.integers(0, 3, (planes, lumps * high, line)).astype(np.uint8) * 85
    order = [(p, lump * high + row, c) for p in range(planes) for lump in range(lumps) for c in range(line) for row in range(high)]
    values, flags, last = [0], [], 0
    for place in order:
        v = int(want[place])
        flags.append(int(v != last))
        if v != last:
            values.append(v)
        last = v
    flags += [0] * (-len(flags) % 8)
    bytes_ = [int("".join(map(str, flags[i : i + 8])), 2) for i in range(0, len(flags), 8)]
    stored, points, last = [0], [], 0
    for b in bytes_ + [bytes_[-1]]:
        points.append(int(b != last))
        if b != last:
            stored.append(b)
        last = b
    points += [0] * (-len(points) % 8)
    picture = bytes(values) + bytes(stored) + bytes(int("".join(map(str, points[i : i + 8])), 2) for i in range(0, len(points), 8))
    head = struct.pack(">IHHHHHHII", 0x06071963, 0, 0, line, lumps, high, planes, 24 + len(values), 24 + len(values) + len(stored))
    colours = [0x000, 0xF00, 0x0F0, 0x12F]
    screen = struct.pack(">I11H32H", 0x12031990, 24, 12, 0, 0, 24, 12, 0, 0, 0, 4, planes, *colours, *[0] * 28)
    payload = screen + head + picture
    node = nodes_of(b"AmBk" + struct.pack(">HHI", 1, 0, 8 + len(payload)) + b"Pac.Pic." + payload)[0]
    numbers = (np.unpackbits(want, axis=2).astype(int) << np.arange(planes)[:, None, None]).sum(axis=0)
    table = np.array([[(c >> k & 15) * 17 for k in (8, 4, 0)] + [255] for c in colours], np.uint8)
    assert node.path == "/picture" and node.raster.rgba == table[numbers].tobytes()
