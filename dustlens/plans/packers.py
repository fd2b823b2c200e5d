"""Writers of small files in many formats, so that tables can be packed and scanned back. Layouts follow the formats' public descriptions."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable

import numpy as np

from dustlens.sources import codecs

#: Pictures are ``WIDE`` pixels wide and hold numbers 0 to 15, which stand for these colours.
WIDE = 8
COLOURS = np.array([(v * 17, 255 - v * 17, v * 40 % 256) for v in range(16)], np.uint8)


def grid(values: list[int]) -> np.ndarray:
    """Rows of pixel numbers, the last one filled up with zeros."""
    return np.array(values + [0] * (-len(values) % WIDE), np.uint8).reshape(-1, WIDE)


def _rgb(g: np.ndarray) -> np.ndarray:
    return COLOURS[g]


def _rgba(g: np.ndarray) -> np.ndarray:
    return np.concatenate([COLOURS[g], np.full((*g.shape, 1), 255, np.uint8)], axis=2)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(g: np.ndarray) -> bytes:
    """RGB lines, each with the next of the five filters."""
    lines, before = b"", np.zeros(WIDE * 3, np.int64)
    for y, row in enumerate(_rgb(g).reshape(len(g), -1).astype(np.int64)):
        left, corner = np.concatenate([[0, 0, 0], row[:-3]]), np.concatenate([[0, 0, 0], before[:-3]])
        p = left + before - corner
        a, b, c = abs(p - left), abs(p - before), abs(p - corner)
        guess = (0, left, before, (left + before) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner)))[y % 5]
        lines += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDE, len(g), 8, 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def png_indexed(g: np.ndarray) -> bytes:
    """Four bits a pixel and a palette."""
    lines = b"".join(b"\0" + (row[::2] << 4 | row[1::2]).astype(np.uint8).tobytes() for row in g)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDE, len(g), 4, 3, 0, 0, 0)) + _chunk(b"PLTE", COLOURS.tobytes()) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def gif(g: np.ndarray) -> bytes:
    packed = codecs.lzw_encode(g.tobytes(), 4)
    blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
    return struct.pack("<6sHHBBB", b"GIF89a", WIDE, len(g), 0x83, 0, 0) + COLOURS.tobytes() + struct.pack("<BHHHHB", 0x2C, 0, 0, WIDE, len(g), 0) + b"\4" + blocks + b"\0;"


def qoi(g: np.ndarray) -> bytes:
    """All six kinds of codes, each wherever it fits."""
    out, seen, last, run = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    pixels = [tuple(map(int, p)) for p in _rgba(g).reshape(-1, 4)]
    for i, p in enumerate(pixels):
        if p == last:
            run += 1
            if run == 62 or i + 1 == len(pixels):
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        at = (p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64
        dr, dg, db = ((a - b + 128) % 256 - 128 for a, b in zip(p[:3], last[:3], strict=True))
        if seen[at] == p:
            out.append(at)
        elif all(-2 <= d <= 1 for d in (dr, dg, db)):
            out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
        elif -32 <= dg <= 31 and all(-8 <= d - dg <= 7 for d in (dr, db)):
            out += bytes([0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8])
        else:
            out += bytes([0xFE, *p[:3]]) if i % 3 else bytes([0xFF, *p])
        seen[at] = last = p
    return struct.pack(">4sIIBB", b"qoif", WIDE, len(g), 4, 0) + bytes(out) + b"\0" * 7 + b"\1"


def _dib(g: np.ndarray, bits: int, packing: int, body: bytes) -> bytes:
    palette = b"".join(bytes([b, gr, r, 0]) for r, gr, b in COLOURS.tolist()) if bits <= 8 else b""
    return struct.pack("<IiiHHIIiiII", 40, WIDE, len(g), 1, bits, packing, len(body), 2835, 2835, 16 if bits <= 8 else 0, 0) + palette + body


def _bmp(dib: bytes, bits: int) -> bytes:
    at = 14 + 40 + (64 if bits <= 8 else 0)
    return struct.pack("<2sIHHI", b"BM", 14 + len(dib), 0, 0, at) + dib


def bmp24(g: np.ndarray) -> bytes:
    return _bmp(_dib(g, 24, 0, _rgb(g)[::-1, :, ::-1].tobytes()), 24)


def bmp8(g: np.ndarray) -> bytes:
    return _bmp(_dib(g, 8, 0, g[::-1].tobytes()), 8)


def bmp4(g: np.ndarray) -> bytes:
    return _bmp(_dib(g, 4, 0, (g[::-1, ::2] << 4 | g[::-1, 1::2]).astype(np.uint8).tobytes()), 4)


def bmp_rle8(g: np.ndarray) -> bytes:
    """Runs, and every third line as it is."""
    out = b""
    for y, row in enumerate(g[::-1].tolist()):
        out += bytes([0, WIDE, *row]) if y % 3 == 2 else b"".join(bytes([1, v]) for v in row)
        out += b"\0\0"
    return _bmp(_dib(g, 8, 1, out + b"\0\1"), 8)


def bmp_rle4(g: np.ndarray) -> bytes:
    """Runs of two pixels, every third line as it is, and a jump where a line begins with zeros."""
    out = b""
    for y, row in enumerate(g[::-1].tolist()):
        pairs = [row[i] << 4 | row[i + 1] for i in range(0, WIDE, 2)]
        if y % 3 == 2:
            out += bytes([0, WIDE, *pairs])
        elif row[0] == row[1] == 0:
            out += bytes([0, 2, 2, 0]) + b"".join(bytes([2, p]) for p in pairs[1:])
        else:
            out += b"".join(bytes([2, p]) for p in pairs)
        out += b"\0\0"
    return _bmp(_dib(g, 4, 2, out + b"\0\1"), 4)


def dib(g: np.ndarray) -> bytes:
    return _dib(g, 8, 0, g[::-1].tobytes())


def icon(g: np.ndarray) -> bytes:
    """One 32-bit picture with an empty mask."""
    n = len(g)
    body = struct.pack("<IiiHHIIiiII", 40, WIDE, 2 * n, 1, 32, 0, 0, 0, 0, 0, 0) + _rgba(g)[::-1, :, [2, 1, 0, 3]].tobytes() + bytes(4 * n)
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", WIDE, n % 256, 0, 0, 1, 32, len(body), 22) + body


def cursor(g: np.ndarray) -> bytes:
    data = bytearray(icon(g))
    data[2] = 2
    return bytes(data)


def ppm(g: np.ndarray) -> bytes:
    return b"P6\n# made\n%d %d\n255\n" % (WIDE, len(g)) + _rgb(g).tobytes()


def ppm_text(g: np.ndarray) -> bytes:
    return b"P3 %d %d 255\n" % (WIDE, len(g)) + b"\n".join(b" ".join(b"%d" % v for v in row.ravel()) for row in _rgb(g))


def pam(g: np.ndarray) -> bytes:
    return b"P7\nWIDTH %d\nHEIGHT %d\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n" % (WIDE, len(g)) + _rgba(g).tobytes()


def _runs_of(row: list, most: int) -> list[tuple[int, object]]:
    out: list[tuple[int, object]] = []
    for v in row:
        if out and out[-1][1] == v and out[-1][0] < most:
            out[-1] = (out[-1][0] + 1, v)
        else:
            out.append((1, v))
    return out


def pcx(g: np.ndarray) -> bytes:
    """Eight bits a pixel in runs, the palette behind."""
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, WIDE - 1, len(g) - 1, 72, 72) + bytes(48) + struct.pack("<BBH", 0, 1, WIDE) + bytes(60)
    body = b"".join(bytes([0xC0 | n, v]) for row in g.tolist() for n, v in _runs_of(row, 63))
    return head + body + b"\x0c" + COLOURS.tobytes().ljust(768, b"\0")


def tga(g: np.ndarray) -> bytes:
    """24 bits in packets: runs, and single pixels as they are; the first line is at the bottom."""
    body = b""
    for row in _rgb(g)[::-1, :, ::-1]:
        for n, v in _runs_of([p.tobytes() for p in row], 128):
            body += bytes([0x80 | n - 1]) + v if n > 1 else b"\0" + v
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, WIDE, len(g), 24, 0) + body


def tga_mapped(g: np.ndarray) -> bytes:
    return struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, 16, 24, 0, 0, WIDE, len(g), 8, 32) + COLOURS[:, ::-1].tobytes() + g.tobytes()


def form(kind: bytes, *parts: tuple[bytes, bytes]) -> bytes:
    body = b"".join(n + struct.pack(">I", len(v)) + v + b"\0" * (len(v) & 1) for n, v in parts)
    return b"FORM" + struct.pack(">I", len(body) + 4) + kind + body


def _planes(row: list[int]) -> list[bytes]:
    """Four planes of a line, each filled up to two bytes."""
    return [bytes([int("".join(str(v >> p & 1) for v in row), 2), 0]) for p in range(4)]


def _bitmap(g: np.ndarray, planes: int, packing: int) -> bytes:
    return struct.pack(">HHhhBBBBHBBhh", WIDE, len(g), 0, 0, planes, 0, packing, 0, 0, 1, 1, WIDE, len(g))


def ilbm(g: np.ndarray) -> bytes:
    body = b"".join(codecs.pack_runs(p) for row in g.tolist() for p in _planes(row))
    return form(b"ILBM", (b"BMHD", _bitmap(g, 4, 1)), (b"CMAP", COLOURS.tobytes()), (b"BODY", body))


def acbm(g: np.ndarray) -> bytes:
    body = b"".join(_planes(row)[p] for p in range(4) for row in g.tolist())
    return form(b"ACBM", (b"BMHD", _bitmap(g, 4, 0)), (b"CMAP", COLOURS.tobytes()), (b"ABIT", body))


def pbm(g: np.ndarray) -> bytes:
    return form(b"PBM ", (b"BMHD", _bitmap(g, 8, 1)), (b"CMAP", COLOURS.tobytes()), (b"BODY", b"".join(codecs.pack_runs(row.tobytes()) for row in g)))


def deep(g: np.ndarray) -> bytes:
    return form(b"DEEP", (b"DGBL", struct.pack(">HHHBB", WIDE, len(g), 0, 1, 1)), (b"DPEL", struct.pack(">I6H", 3, 1, 8, 2, 8, 3, 8)), (b"DBOD", _rgb(g).tobytes()))


def anim(g: np.ndarray) -> bytes:
    """Two frames: the picture, and byte deltas that change nothing."""
    still = b"".join(codecs.pack_runs(p) for row in g.tolist() for p in _planes(row))
    first = form(b"ILBM", (b"BMHD", _bitmap(g, 4, 1)), (b"CMAP", COLOURS.tobytes()), (b"BODY", still))
    second = form(b"ILBM", (b"ANHD", struct.pack(">BBHHhhIIB", 5, 0, WIDE, len(g), 0, 0, 0, 6, 0).ljust(40, b"\0")), (b"DLTA", bytes(64)))
    return b"FORM" + struct.pack(">I", len(first + second) + 4) + b"ANIM" + first + second


def aseprite(g: np.ndarray) -> bytes:
    """An indexed sprite of one compressed cel."""
    part = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    palette = part(0x2019, struct.pack("<III8x", 16, 0, 15) + b"".join(struct.pack("<H4B", 0, *c, 255) for c in COLOURS.tolist()))
    layer = part(0x2004, struct.pack("<HHHHHHB3xH", 1, 0, 0, 0, 0, 0, 255, 0))
    cel = part(0x2005, struct.pack("<HhhBHh5xHH", 0, 0, 0, 255, 2, 0, WIDE, len(g)) + zlib.compress(g.tobytes()))
    parts = palette + layer + cel
    frame = struct.pack("<IHHH2xI", 16 + len(parts), 0xF1FA, 3, 100, 3) + parts
    return struct.pack("<IHHHHHIH8xB3xH", 128 + len(frame), 0xA5E0, 1, WIDE, len(g), 8, 1, 100, 255, 16).ljust(128, b"\0") + frame


def flic(g: np.ndarray) -> bytes:
    """Colours and lines in runs; the second frame is the ring's."""
    part = lambda kind, body: struct.pack("<IH", len(body) + 6, kind) + body
    frame = lambda *parts: struct.pack("<IHH8x", 16 + sum(map(len, parts)), 0xF1FA, len(parts)) + b"".join(parts)
    colours = part(4, struct.pack("<HBB", 1, 0, 16) + COLOURS.tobytes())
    lines = b"".join(b"\0" + b"".join(bytes([n, v]) for n, v in _runs_of(row, 127)) for row in g.tolist())
    body = frame(colours, part(15, lines)) + frame()
    return struct.pack("<IHHHHHHI", 128 + len(body), 0xAF12, 1, WIDE, len(g), 8, 3, 40).ljust(128, b"\0") + body


#: Picture formats: file name, writer, and the path at which the picture is found.
PICTURES: dict[str, tuple[str, Callable[[np.ndarray], bytes], str]] = {
    "png": ("a.png", png, "/image"), "png_indexed": ("a.png", png_indexed, "/image"), "gif_lines": ("a.gif", gif, "/image"), "qoi": ("a.qoi", qoi, "/image"), "bmp": ("a.bmp", bmp24, "/image"),
    "bmp8": ("a.bmp", bmp8, "/image"), "bmp4": ("a.bmp", bmp4, "/image"), "bmp_rle8": ("a.bmp", bmp_rle8, "/image"), "bmp_rle4": ("a.bmp", bmp_rle4, "/image"), "dib": ("a.dib", dib, "/image"),
    "ico": ("a.ico", icon, "/icon/0"), "cur": ("a.cur", cursor, "/cursor/0"), "netpbm": ("a.ppm", ppm, "/image"), "netpbm_text": ("a.ppm", ppm_text, "/image"), "pam": ("a.pam", pam, "/image"),
    "pcx": ("a.pcx", pcx, "/image"), "tga": ("a.tga", tga, "/image"), "tga_mapped": ("a.tga", tga_mapped, "/image"), "ilbm": ("a.iff", ilbm, "/image"), "acbm": ("a.iff", acbm, "/image"),
    "pbm": ("a.lbm", pbm, "/image"), "deep": ("a.iff", deep, "/image"), "anim": ("a.anim", anim, "/animation"), "aseprite": ("a.aseprite", aseprite, "/sprite"), "flic": ("a.flc", flic, "/animation"), "openraster": ("a.ora", lambda g: openraster(g), "/image"),
}


# Files that hold named files: (name, content) each.

Members = list[tuple[str, bytes]]


def zip_file(members: Members) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (name, body) in enumerate(members):
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED if i % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def nested_zip(members: Members) -> bytes:
    return zip_file([("inner.zip", zip_file(members))])


def asar(members: Members) -> bytes:
    at, files = 0, {}
    for name, body in members:
        files[name] = {"size": len(body), "offset": str(at)}
        at += len(body)
    manifest = json.dumps({"files": files}).encode()
    padded = manifest + b"\0" * (-len(manifest) % 4)
    return struct.pack("<IIII", 4, len(padded) + 8, len(padded) + 4, len(manifest)) + padded + b"".join(b for _, b in members)


def lha_member(name: bytes, plain: bytes, method: bytes = b"-lh5-") -> bytes:
    body = codecs.pack_lh5(plain) if method == b"-lh5-" else plain
    head = method + struct.pack("<IIIBBB", len(body), len(plain), 0, 0, 0, len(name)) + name + struct.pack("<H", codecs.crc16(plain))
    return bytes([len(head), sum(head) & 255]) + head + body


def lha(members: Members) -> bytes:
    return b"".join(lha_member(n.encode(), b, (b"-lh5-", b"-lh0-")[i % 2]) for i, (n, b) in enumerate(members)) + b"\0"


def lha_sfx(members: Members) -> bytes:
    program = struct.pack(">6I", 0x3F3, 0, 1, 0, 0, 1) + struct.pack(">II", 0x3E9, 1) + b"\x70\0\x4e\x75" + struct.pack(">I", 0x3F2)
    return program + lha_member(b"usage", b"usage", b"-lh0-") + lha(members)


def wad(members: Members) -> bytes:
    at, directory = 12, b""
    for name, body in members:
        directory += struct.pack("<II8s", at, len(body), name.encode())
        at += len(body)
    return struct.pack("<4sII", b"PWAD", len(members), at) + b"".join(b for _, b in members) + directory


def iff(members: Members) -> bytes:
    return form(b"TEST", *((b"NAME", b) for _, b in members))


def adf(members: Members) -> bytes:
    """An old file system with one block of up to 488 bytes for each file."""
    out = bytearray(901120)
    out[:4] = b"DOS\0"

    def put(at: int, words: list[int]) -> None:
        words[5] = -sum(words) & 0xFFFFFFFF
        out[at * 512 : at * 512 + 512] = struct.pack(">128I", *words)

    def named(name: bytes) -> tuple[int, ...]:
        return struct.unpack(">8I", (bytes([len(name)]) + name).ljust(32, b"\0"))

    root = [0] * 128
    root[0], root[127], root[108:116] = 2, 1, named(b"Volume")
    for i, (name, body) in enumerate(members):
        file = [0] * 128
        file[0], file[2], file[77], file[81], file[108:116], file[127] = 2, 1, 1000 + i, len(body), named(name.encode()), 0xFFFFFFFD
        file[124], root[6 + i % 72] = root[6 + i % 72], 900 + i
        put(900 + i, file)
        put(1000 + i, [8, 900 + i, 1, len(body), 0, 0, *struct.unpack(">122I", body.ljust(488, b"\0"))])
    put(880, root)
    return bytes(out)


def dms(members: Members) -> bytes:
    """The same disk in tracks, packed in runs."""
    image, tracks = adf(members), []
    for n in range(80):
        plain = image[n * 11264 : (n + 1) * 11264]
        kept = plain.rstrip(b"\0")
        body = kept.replace(b"\x90", b"\x90\0") + (b"\x90\xff\0" + struct.pack(">H", 11264 - len(kept)) if len(kept) < 11264 else b"")
        head = b"TR" + struct.pack(">HHHHHBBHH", n, 0, len(body), len(plain), len(plain), 0, 1, sum(plain) & 0xFFFF, codecs.crc16(body))
        tracks.append(head + struct.pack(">H", codecs.crc16(head)) + body)
    head = (b" PRO" + struct.pack(">IIHHII", 0, 0, 0, 79, 0, 901120) + bytes(24) + struct.pack(">H", 1)).ljust(50, b"\0")
    return b"DMS!" + head + struct.pack(">H", codecs.crc16(head)) + b"".join(tracks)


def fat(members: Members) -> bytes:
    """A 12-bit file system with clusters of one sector; names are up to eight letters."""
    clusters, table, folder, data = 2, [0xFF0, 0xFFF], b"", b""
    for name, body in members:
        n = max(1, -(-len(body) // 512))
        table += [*range(clusters + 1, clusters + n), 0xFFF]
        folder += name.upper().encode().ljust(8) + b"TXT" + bytes(15) + struct.pack("<HI", clusters, len(body))
        data += body.ljust(n * 512, b"\0")
        clusters += n
    entries = max(16, -(-len(members) // 16) * 16)
    pairs = table + [0] * (len(table) % 2)
    packed = b"".join(struct.pack("<I", a | b << 12)[:3] for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    sectors = max(1, -(-len(packed) // 512))
    total = 1 + 2 * sectors + entries // 16 + (clusters - 2) + 4
    boot = bytearray(512)
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 2, entries, total, 0xF0, sectors)
    boot[510:] = b"\x55\xaa"
    return (bytes(boot) + packed.ljust(sectors * 512, b"\0") * 2 + folder.ljust(entries * 32, b"\0") + data).ljust(total * 512, b"\0")


def tap(members: Members) -> bytes:
    """A header and a block of code for each."""

    def block(body: bytes) -> bytes:
        x = 0
        for b in body:
            x ^= b
        return struct.pack("<H", len(body) + 1) + body + bytes([x])

    return b"".join(block(b"\0" + struct.pack("<B10sHHH", 3, name.encode().ljust(10), len(body), 32768, 32768)) + block(b"\xff" + body) for name, body in members)


def tzx(members: Members) -> bytes:
    tape, out, at = tap(members), b"ZXTape!\x1a\1\x14", 0
    while at < len(tape):
        (size,) = struct.unpack_from("<H", tape, at)
        out += b"\x10\0\0" + tape[at : at + 2 + size]
        at += 2 + size
    return out


def basic(rows: list[tuple]) -> bytes:
    """A program on tape: LET n = a number, in letters and in the machine's own form, and PRINT of a string."""
    program = b""
    for (k,) in rows:
        body = b"\xf1n=%d\x0e\0\0\0\0\0:\xf5\"x\"\r" % k
        program += struct.pack(">H", k % 9000) + struct.pack("<H", len(body)) + body

    def block(body: bytes) -> bytes:
        x = 0
        for b in body:
            x ^= b
        return struct.pack("<H", len(body) + 1) + body + bytes([x])

    return block(b"\0" + struct.pack("<B10sHHH", 0, b"program   ", len(program), 32768, len(program))) + block(b"\xff" + program)


def drawing(rows: list[tuple]) -> bytes:
    """Squares, those of even numbers in groups."""
    square = struct.pack(">H8f", 4, 1, 1, 5, 1, 5, 5, 1, 5)
    parts = [(b"CPLY", square) if k % 2 else (b"FORM", form(b"DR2D", (b"GRUP", b"\0\1"), (b"CPLY", square))[8:]) for (k,) in rows]
    return form(b"DR2D", (b"DRHD", struct.pack(">4f", 0, 0, 8, 8)), (b"CMAP", bytes(3)), (b"ATTR", struct.pack(">BBBBHHHf", 1, 0, 0, 0, 0, 0, 0, 0)), *parts)


def bank(members: Members) -> bytes:
    body = b"".join(b for _, b in members)
    return struct.pack(">4sHHI8s", b"AmBk", 1, 0, 8 + len(body), b"Data    ") + body


def bank_set(members: Members) -> bytes:
    return b"AmBs" + struct.pack(">H", len(members)) + b"".join(bank([m]) for m in members)


def program(members: Members) -> bytes:
    tokens = b"".join(b for _, b in members)
    return b"AMOS Basic V134 " + struct.pack(">I", len(tokens)) + tokens + b"AmBs" + struct.pack(">H", len(members)) + b"".join(bank([m]) for m in members)


def powerpacker(members: Members) -> bytes:
    """Literals only: bits are read from the end, a flag and a count before the bytes, which come backwards."""
    plain = b"".join(b for _, b in members)
    # A run of literals is 1 + the sum of two-bit counts up to one that is not 3; at the end nothing follows.
    rest = len(plain) - 1
    bits = "0" + "11" * (rest // 3) + f"{rest % 3:02b}" + "".join(f"{b:08b}" for b in plain[::-1])
    bits += "0" * (-len(bits) % 32)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))[::-1]
    return b"PP20" + bytes([9, 10, 12, 13]) + stream + struct.pack(">I", len(plain))[1:] + b"\0"


def xpk(members: Members) -> bytes:
    """Stored chunks, one for each member."""
    plain = b"".join(b for _, b in members)
    chunk = lambda kind, body: struct.pack(">BBHII", kind, 0, 0, len(body), len(body)) + body + b"\0" * (-len(body) % 4)
    chunks = b"".join(chunk(0, b) for _, b in members) + chunk(15, b"")
    head = bytearray(b"XPKF" + struct.pack(">I4sI", len(chunks) + 28, b"NONE", len(plain)) + plain[:16].ljust(16, b"\0") + b"\1\0\0\0")
    for b in bytes(head):
        head[33] ^= b
    return bytes(head) + chunks


def openraster(g: np.ndarray) -> bytes:
    """One layer, which is the merged picture too."""
    stack = f'<image w="{WIDE}" h="{len(g)}" version="0.0.3"><stack><layer name="only" src="data/layer0.png" x="0" y="0"/></stack></image>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "image/openraster")
        z.writestr("stack.xml", stack)
        z.writestr("data/layer0.png", png(g))
        z.writestr("mergedimage.png", png(g))
    return out.getvalue()


def font_index(rows: list[tuple]) -> bytes:
    return struct.pack(">HH", 0x0F00, len(rows)) + b"".join((b"f/%d" % k).ljust(256, b"\0") + struct.pack(">HBB", k % 200, 0, 0) for (k,) in rows)


def font_descriptor(rows: list[tuple]) -> bytes:
    lines = ['info face="F" size=8', "common lineHeight=9 base=7 scaleW=256 scaleH=256 pages=1", 'page id=0 file="f.png"', f"chars count={len(rows)}"]
    lines += [f"char id={k} x={k % 250} y=2 width={k % 7} height=4 xoffset=0 yoffset=-1 xadvance=5 page=0 chnl=15" for (k,) in rows]
    return ("\n".join(lines) + "\n").encode()


def jpeg(values: list[int]) -> bytes:
    """A grey row of flat blocks of eight by eight: differences of 0 to 15 bits, each size's code five bits long, and one code of one bit for a block's end."""
    bits, last = "", 0
    for v in values:
        d, last = v - last, v
        n = abs(d).bit_length()
        bits += f"{n:05b}" + (f"{d if d >= 0 else d + (1 << n) - 1:0{n}b}" if n else "") + "0"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    part = lambda kind, body: bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body
    head = part(0xDB, b"\0" + bytes([8] * 64)) + part(0xC0, struct.pack(">BHHB", 8, 8, 8 * len(values), 1) + bytes([1, 0x11, 0]))
    head += part(0xC4, b"\0" + bytes([0, 0, 0, 0, 16]) + bytes(11) + bytes(range(16))) + part(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\0")
    return b"\xff\xd8" + head + part(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def game_volume(members: Members) -> bytes:
    return b"".join(b"\x12\x34\0" + struct.pack("<H", len(b)) + b for _, b in members)


def game_map(members: Members) -> bytes:
    """Places in the volume, each followed by an entry that is none."""
    at, out = 0, b""
    for _, body in members:
        out += at.to_bytes(3, "big") + b"\xff\xff\xff"
        at += 5 + len(body)
    return out


def database(rows: list[tuple]) -> bytes:
    """A table t of (k, name, note)."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (k INTEGER, name TEXT, note TEXT)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    db.commit()
    return db.serialize()


def wordstar(members: Members) -> bytes:
    return b".LM 5\r\n" + b"".join(b.replace(b"\n", b"\r\n") + b"\r\n" for _, b in members) + b"\x1a" * 3


def write_document(members: Members) -> bytes:
    text = b"".join(b.replace(b"\n", b"\r\n") + b"\r\n" for _, b in members)
    head = (struct.pack("<HH", 0xBE31, 0).ljust(14, b"\0") + struct.pack("<I", 128 + len(text))).ljust(128, b"\0")
    return head + text


def bank_text(members: Members) -> bytes:
    """A terminal picture: lines of up to 80 characters, one colour each."""
    return b"".join(b"\x1b[3%dm" % (i % 8) + b + b"\r\n" for i, (_, b) in enumerate(members))


# Sound: channels of samples.


def wav(rate: int, bits: int, channels: list[list[int]]) -> bytes:
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:  # the standard library's writer
        w.setnchannels(len(channels)), w.setsampwidth(bits // 8), w.setframerate(rate)
        frames = np.array(channels).T
        w.writeframes((frames + 128).astype(np.uint8).tobytes() if bits == 8 else frames.astype("<i2").tobytes())
    data = out.getvalue()
    odd = len(data) % 2  # the library leaves out the pad byte
    return data[:4] + struct.pack("<I", len(data) + odd - 8) + data[8:] + b"\0" * odd


def svx(rate: int, channels: list[list[int]]) -> bytes:
    body = np.array(channels, np.int8).tobytes()
    return form(b"8SVX", (b"VHDR", struct.pack(">IIIHBBI", len(channels[0]), 0, 0, rate, 1, 0, 65536)), (b"BODY", body))


def svx16(rate: int, channels: list[list[int]]) -> bytes:
    body = np.array(channels, ">i2").tobytes()
    return form(b"16SV", (b"VHDR", struct.pack(">IIIHBBI", len(channels[0]), 0, 0, rate, 1, 0, 65536)), (b"BODY", body))


def voice(rate: int, channels: list[list[int]]) -> bytes:
    body = bytes([256 - 1_000_000 // rate, 0]) + bytes(v + 128 for v in channels[0])
    return b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x010A, 0x1129) + b"\1" + struct.pack("<I", len(body))[:3] + body + b"\0"


def module(rate: int, channels: list[list[int]]) -> bytes:
    """One sample of an even number of bytes."""
    body = np.array(channels[0] + [0] * (len(channels[0]) % 2), np.int8).tobytes()
    samples = b"".join(struct.pack(">22sHBBHH", b"s", len(body) // 2 if i == 0 else 0, 0, 64, 0, 1) for i in range(31))
    return b"song".ljust(20, b"\0") + samples + bytes([1, 127]) + bytes(128) + b"M.K." + bytes(1024) + body


# Palettes: colours of three numbers.


def act(colours: list[tuple]) -> bytes:
    return b"".join(map(bytes, colours)).ljust(768, b"\0")


def paint_net(colours: list[tuple]) -> bytes:
    return b"; paint.net Palette File\n" + b"".join(b"FF%02X%02X%02X\n" % c for c in colours)


def swatches(colours: list[tuple]) -> bytes:
    part = struct.pack(">HIH", 1, 22, 1) + b"\0\0" + b"RGB "
    return struct.pack(">4sHHI", b"ASEF", 1, 0, len(colours)) + b"".join(part + struct.pack(">fffH", *(v / 255 for v in c), 0) for c in colours)
