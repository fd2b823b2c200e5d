"""Parsers of Amiga disks, programs, icons, fonts and pictures, from the public descriptions of their layouts."""

from __future__ import annotations

import numpy as np

from dustlens.sources import containers
from dustlens.sources.codecs import crc16, unpack_runs
from dustlens.sources.images import _indexed, iff_chunks, ilbm, line_rows, plane_pixels, shades
from dustlens.sources.model import Node, Raster, Reader, need, safe_name

BLOCK = 512

#: Colours of the four pens before and since the second version of the desktop (fixed values).
PENS_1 = np.array([[0, 85, 170], [255, 255, 255], [0, 0, 34], [255, 136, 0]], np.uint8)
PENS_2 = np.array([[170, 170, 170], [0, 0, 0], [255, 255, 255], [102, 136, 187]], np.uint8)

#: Hunk types (fixed values).
HUNKS = {0x3E9: "code", 0x3EA: "data", 0x3EB: "bss", 0x3EC: "reloc32", 0x3F0: "symbol", 0x3F1: "debug", 0x3F2: "end", 0x3F5: "overlay", 0x3F6: "break", 0x3F7: "drel32", 0x3FC: "reloc32short"}


def planar(data: bytes, width: int, height: int, depth: int) -> np.ndarray:
    """Pixels of planes that lie one after the other, lines padded to 16 bits."""
    line = (width + 15) // 16 * 2
    planes = np.frombuffer(Reader(data).take(0, line * height * depth), np.uint8).reshape(depth, height, line)
    return (np.unpackbits(planes, axis=2)[:, :, :width].astype(int) << np.arange(depth)[:, None, None]).sum(axis=0)


class _Volume:
    """Blocks of a disk; a block is read once at most within a walk, so that loops are found."""

    def __init__(self, data: bytes):
        need(len(data) in (901120, 1802240) and data[:3] == b"DOS" and data[3] <= 5, "no disk of a known size")
        self.r, self.fast, self.root = Reader(data), bool(data[3] & 1), len(data) // BLOCK // 2

    def block(self, at: int, kind: int) -> tuple[int, ...]:
        need(0 < at < len(self.r.data) // BLOCK, "a block is outside of the disk")
        words = self.r.unpack(">128I", at * BLOCK)
        need(words[0] == kind and sum(words) & 0xFFFFFFFF == 0, f"block {at} is damaged")
        return words

    def name(self, at: int) -> str:
        n = self.r.take(at * BLOCK + 432, 1)[0]
        need(n <= 30, "a name is too long")
        return self.r.take(at * BLOCK + 433, n).decode("latin-1")

    def content(self, at: int) -> bytes:
        words, seen, out = self.block(at, 2), {at}, []
        size = words[81]
        while True:
            need(words[2] <= 72, "too many blocks in a list")
            for i in range(words[2]):
                block = words[77 - i]
                need(block not in seen, "a block is used twice")
                seen.add(block)
                if self.fast:
                    need(0 < block < len(self.r.data) // BLOCK, "a block is outside of the disk")
                    out.append(self.r.take(block * BLOCK, BLOCK))
                else:
                    own = self.block(block, 8)
                    need(own[3] <= 488, "a block holds too much")
                    out.append(self.r.take(block * BLOCK + 24, own[3]))
            if not words[126]:
                break
            need(words[126] not in seen, "lists of blocks form a loop")
            seen.add(words[126])
            words = self.block(words[126], 16)
        body = b"".join(out)
        need(len(body) >= size, "a file ends early")
        return body[:size]

    def walk(self, at: int, prefix: str, seen: set[int]) -> list[tuple[str, list, bytes | None]]:
        out = []
        for head in self.block(at, 2)[6:78]:
            while head:
                need(head not in seen, "folders form a loop")
                seen.add(head)
                words = self.block(head, 2)
                kind = words[127] - (words[127] >> 31 << 32)
                path = prefix + safe_name(self.name(head)).replace("/", "_")
                if kind == 2:
                    out += [(path, [("block", head)], None), *self.walk(head, path + "/", seen)]
                elif kind == -3:
                    try:
                        out.append((path, [("block", head), ("data.length", words[81])], self.content(head)))
                    except ValueError as e:  # one bad file does not spoil the others
                        out.append((path, [("block", head), ("data.length", words[81]), ("failure", str(e))], b""))
                else:
                    need(kind in (3, 4, -4), "an entry of an unknown kind")
                    out.append((path, [("block", head), ("link", {3: "soft", 4: "folder", -4: "file"}[kind])], b""))
                head = words[124]
        return out


def adf(data: bytes, name: str) -> list[Node]:
    """Old and fast file systems; links are listed, not followed."""
    v = _Volume(data)
    need(v.block(v.root, 2)[127] == 1, "no root block")
    files = v.walk(v.root, "", {v.root})
    return containers._tree("/disk", "amiga.adf", [("volume.name", v.name(v.root)), ("filesystem", "FFS" if v.fast else "OFS"), ("filesystem.flags", data[3]), ("root.block", v.root)], files)


def _hunks(data: bytes) -> tuple[list[tuple[str, bytes, int]], int]:
    """(kind, body, declared bytes) of the hunks, and where they end."""
    r = Reader(data)
    magic, names, count, first, last = r.unpack(">IIIII", 0)
    need(magic == 0x3F3 and names == 0 and last >= first and last - first + 1 <= count <= 65536, "no program")
    at, left = 20, last - first + 1
    for _ in range(left):
        (size,) = r.unpack(">I", at)
        at += 8 if size >> 30 == 3 else 4
    out = []
    while left:
        (kind,) = r.unpack(">I", at)
        kind &= 0x3FFFFFFF
        need(kind in HUNKS, f"unknown hunk {kind:#x}")
        begin, at = at + 4, at + 4
        if kind in (0x3E9, 0x3EA, 0x3EB, 0x3F1, 0x3F5):
            n = (r.unpack(">I", at)[0] & 0x3FFFFFFF) * 4 + (4 if kind == 0x3F5 else 0)
            at += 4
            out.append((HUNKS[kind], b"" if kind == 0x3EB else r.take(at, n), n))
            at += 0 if kind == 0x3EB else n
        elif kind in (0x3EC, 0x3F7, 0x3FC):
            wide = kind == 0x3EC
            form, step = (">I", 4) if wide else (">H", 2)
            while n := r.unpack(form, at)[0]:
                at += step * (n + 2)
                r.take(begin, at - begin)
            at += step
            at += 0 if wide else (at - begin) % 4
            out.append((HUNKS[kind], r.take(begin, at - begin), at - begin))
        elif kind == 0x3F0:
            while n := r.unpack(">I", at)[0]:
                at += 4 * ((n & 0xFFFFFF) + 2)
            at += 4
            out.append((HUNKS[kind], r.take(begin, at - begin), at - begin))
        else:
            left -= 1
            if at == len(data):
                break
    need(left == 0 and bool(out), "hunks are missing")
    return out, at


def hunk(data: bytes, name: str) -> list[Node]:
    parts, end = _hunks(data)
    out = [Node("/executable", "amiga.hunk-executable", "group", [("hunks", len(parts)), ("trailing-bytes", len(data) - end)])]
    return out + [Node(f"/executable/{i}-{kind}", "amiga.hunk", "opaque", [("hunk.kind", kind), ("data.length", size)], data=body) for i, (kind, body, size) in enumerate(parts)]


def lha_sfx(data: bytes, name: str) -> list[Node]:
    """A program, then an archive's records: a first one of level 0 holds the usage text."""
    _, end = _hunks(data)
    r = Reader(data)
    need(r.take(end + 2, 3) == b"-lh", "no archive after the program")
    out, at = hunk(data[:end], name), end
    if data[at + 20] == 0:
        size, (packed,) = data[at] + 2, r.unpack("<I", at + 7)
        usage = containers.lha(r.take(at, size + packed) + b"\0", name)
        out.append(Node("/sfx/usage", "amiga.lha-sfx", "opaque", [], data=usage[-1].data))
        at += size + packed
    return [*out, *containers.lha(data[at:], name)]


def workbench_icon(data: bytes, name: str) -> list[Node]:
    """The one or two planar pictures of an icon and its settings; picture data inside of tool types stays text."""
    r = Reader(data)
    magic, version = r.unpack(">HH", 0)
    need(magic == 0xE310, "no icon")
    select, user = r.unpack(">I", 26)[0], r.unpack(">I", 44)[0]
    render = r.unpack(">I", 22)[0]
    kind, _, tool, types, x, y, drawer, window, stack = r.unpack(">BBIIiiIII", 48)
    at, rasters = 78 + (56 if drawer else 0), []
    for label, there in (("unselected", render), ("selected", select)):
        if there:
            left, top, width, height, depth = r.unpack(">hhHHH", at)
            need(0 < width <= 4096 and 0 < height <= 4096 and 1 <= depth <= 8, "a picture of an odd size")
            size = (width + 15) // 16 * 2 * height * depth
            pixels = planar(r.take(at + 20, size), width, height, depth)
            pens = PENS_2 if user & 255 else PENS_1
            rasters.append(Node(f"/icon/{label}", "amiga.workbench-icon", "raster", [("planes", depth), ("position.x", left), ("position.y", top)], raster=Raster(width, height, _indexed(pixels % 4, pens))))
            at += 20 + size

    def text() -> str:
        nonlocal at
        (n,) = r.unpack(">I", at)
        at += 4 + n
        return r.take(at - n, n).rstrip(b"\0").decode("latin-1")

    metadata = [("workbench.version", version), ("workbench.type", kind), ("position.x", x), ("position.y", y), ("stack-size", stack)]
    if tool:
        metadata.append(("default-tool", text()))
    if types:
        (n,) = r.unpack(">I", at)
        need(4 <= n <= 1 << 16, "too many tool types")
        at += 4
        found = [text() for _ in range(n // 4 - 1)]
        metadata += [("tool-types", len(found)), *((f"tool-type.{i}", v) for i, v in enumerate(found))]
    if window:
        metadata.append(("tool-window", text()))
    return [Node("/icon", "amiga.workbench-icon", "group", metadata), *rasters]


def font_index(data: bytes, name: str) -> list[Node]:
    """Sizes of a font and the files that hold them."""
    r = Reader(data)
    kind, count = r.unpack(">HH", 0)
    need(kind in (0x0F00, 0x0F02) and 4 + 260 * count == len(data), "no font index")
    out = [Node("/font", "amiga.bitmap-diskfont-index", "group", [("index.kind", "tagged" if kind == 0x0F02 else "plain"), ("index.entries", count)])]
    for i in range(count):
        path = r.take(4 + 260 * i, 256).split(b"\0")[0].decode("latin-1")
        height, style, flags = r.unpack(">HBB", 260 + 260 * i)
        out.append(Node(f"/font/{i}", "amiga.bitmap-diskfont-index", "opaque", [("index.filename", safe_name(path)), ("index.position", i), ("height", height), ("style", style), ("flags", flags)]))
    return out


def font(data: bytes, name: str) -> list[Node]:
    """A font of one plane; its raster is the strip of all glyphs, their places are metadata."""
    parts, _ = _hunks(data)
    r = Reader(parts[0][1])
    (mark,) = r.unpack(">H", 18)
    need(mark == 0x0F80, "no font descriptor")
    height, style, flags, width, baseline, smear, _, low, high, chars, modulo, places, spaces, kerns = r.unpack(">HBBHHHHBBIHIII", 78)
    need(not flags & 0x40 and low <= high and 0 < height <= 512 and modulo > 0, "not a font of one plane")
    strip = np.unpackbits(np.frombuffer(r.take(chars, modulo * height), np.uint8).reshape(height, modulo), axis=1)
    glyphs = [r.unpack(">HH", places + 4 * i) for i in range(high - low + 2)]
    need(all(a + n <= modulo * 8 for a, n in glyphs), "a glyph is outside of the strip")
    metadata = [("height", height), ("baseline", baseline), ("style", style), ("flags", flags), ("first-character", low), ("last-character", high), ("characters", len(glyphs)), ("nominal-width", width), ("bold-smear", smear)]
    for i, (a, n) in enumerate(glyphs):
        space, kern = (r.unpack(">h", table + 2 * i)[0] if table else default for table, default in ((spaces, width), (kerns, 0)))
        metadata.append((f"glyph.{low + i if i <= high - low else 'missing'}", f"{a},{n},{space},{kern}"))
    rgba = np.repeat(strip[:, :, None] * np.uint8(255), 4, axis=2)
    return [Node("/font", "amiga.bitmap-diskfont", "font", metadata, raster=Raster(modulo * 8, height, rgba.tobytes()))]


def _bitmap_head(chunks: dict[str, bytes]) -> tuple:
    fields = Reader(chunks.get("BMHD", b"")).unpack(">HHhhBBBBHBB", 0)
    need(fields[0] > 0 and fields[1] > 0 and fields[5] <= 3, "bad header")
    return fields


def _colours(chunks: dict[str, bytes]) -> np.ndarray:
    raw = chunks.get("CMAP", b"")
    return np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3)


def _picture(type_id: str, head: tuple, colours: np.ndarray, pixels: np.ndarray) -> list[Node]:
    width, height, x, y, planes, masking, packing, _, transparent, ax, ay = head
    metadata = [("colours", len(colours)), ("planes", planes), ("masking", masking), ("compression", packing), ("transparent-colour", transparent), ("position.x", x), ("position.y", y), ("aspect.x", ax), ("aspect.y", ay)]
    rgba = _indexed(pixels, colours, transparent if masking == 2 else None)
    return [Node("/image", type_id, "raster", metadata, raster=Raster(width, height, rgba), palette=[(*map(int, c), 255) for c in colours])]


def acbm(data: bytes, name: str) -> list[Node]:
    kind, chunks = iff_chunks(data)
    own = dict(reversed(chunks))
    need(kind == "ACBM" and "ABIT" in own, "no contiguous bitmap")
    head = _bitmap_head(own)
    need(1 <= head[4] <= 8, "unsupported depth")
    return _picture("amiga.acbm", head, _colours(own), planar(own["ABIT"], head[0], head[1], head[4]))


def pbm(data: bytes, name: str) -> list[Node]:
    """A byte for each pixel, lines padded to 16 bits."""
    kind, chunks = iff_chunks(data)
    own = dict(reversed(chunks))
    need(kind == "PBM " and "BODY" in own, "no chunky bitmap")
    head = _bitmap_head(own)
    width, height, line = head[0], head[1], head[0] + (head[0] & 1)
    need(head[4] == 8 and head[6] in (0, 1) and head[5] != 1, "unsupported mode")
    body = unpack_runs(own["BODY"], line * height) if head[6] else own["BODY"]
    pixels = np.frombuffer(Reader(body).take(0, line * height), np.uint8).reshape(height, line)[:, :width]
    return _picture("amiga.pbm", head, _colours(own), pixels.astype(int))


def _pixel_runs(data: bytes, width: int, height: int, size: int) -> bytes:
    """Pixels of ``size`` bytes: a count and as many pixels, or a negative count and one pixel to repeat."""
    r, out, at = Reader(data), bytearray(), 0
    for row in range(1, height + 1):
        while len(out) < row * width * size:
            (n,) = r.unpack("b", at)
            at += 1
            if n == -128:
                continue
            pixels = r.take(at, size * (n + 1 if n >= 0 else 1))
            at += len(pixels)
            out += pixels * (1 if n >= 0 else 1 - n)
        need(len(out) == row * width * size, "a run leaves its row")
    return bytes(out)


def deep(data: bytes, name: str) -> list[Node]:
    """True-colour pixels of whole bytes, as they are or in runs of pixels that end with their row."""
    kind, chunks = iff_chunks(data)
    own = dict(reversed(chunks))
    need(kind == "DEEP" and {"DGBL", "DPEL", "DBOD"} <= set(own), "no deep bitmap")
    width, height, packing, ax, ay = Reader(own["DGBL"]).unpack(">HHHBB", 0)
    layout = Reader(own["DPEL"])
    parts = [layout.unpack(">HH", 4 + 4 * i) for i in range(min(16, layout.unpack(">I", 0)[0]))]
    if "DLOC" in own:
        width, height = Reader(own["DLOC"]).unpack(">HH", 0)
    need(packing in (0, 1) and 0 < width * height <= 1 << 26 and bool(parts) and all(bits == 8 for _, bits in parts), "unsupported packing or depth")
    body = own["DBOD"] if packing == 0 else _pixel_runs(own["DBOD"], width, height, len(parts))
    raw = np.frombuffer(Reader(body).take(0, width * height * len(parts)), np.uint8).reshape(height, width, len(parts))
    rgba = np.full((height, width, 4), 255, np.uint8)
    for i, (what, _) in enumerate(parts):
        if 1 <= what <= 4:
            rgba[:, :, what - 1] = raw[:, :, i]
    metadata = [("display.width", width), ("display.height", height), ("compression", packing), ("aspect.x", ax), ("aspect.y", ay), ("components", len(parts)), ("component-layout", ",".join(f"{a}:{b}" for a, b in parts))]
    return [Node("/image", "amiga.deep", "raster", metadata, raster=Raster(width, height, rgba.tobytes()))]


def picture_bank(data: bytes, name: str) -> list[Node]:
    """Sprites or icons with hot spots, and the 32 colours that they share."""
    nodes, end = _pictures(data, 0)
    need(end == len(data), "bytes after the colours")
    return nodes


def _pictures(data: bytes, start: int) -> tuple[list[Node], int]:
    """The pictures of the bank at ``start``, and where it ends."""
    r = Reader(data)
    tag, count = r.unpack(">4sH", start)
    need(tag in (b"AmSp", b"AmIc"), "no bank of pictures")
    word, at, found = ("sprite" if tag == b"AmSp" else "icon"), start + 6, []
    for i in range(count):
        words, height, depth, x, y = r.unpack(">HHHhh", at)
        at += 10
        if words and height and depth:
            need(depth <= 5, "too many planes")
            size = words * 2 * height * depth
            found.append((i, words * 16, height, depth, x, y, planar(r.take(at, size), words * 16, height, depth)))
            at += size
    colours = np.array([[(v >> s & 15) * 17 for s in (8, 4, 0)] for v in r.unpack(">32H", at)], np.uint8)
    out = [Node(f"/{word}", f"amos.{word}-bank", "group", [("images", count)])]
    return out + [Node(f"/{word}/{i}", f"amos.{word}-bank", "raster", [("planes", depth), ("hotspot.x", x), ("hotspot.y", y)], raster=Raster(w, h, _indexed(pixels, colours, 0))) for i, w, h, depth, x, y, pixels in found], at + 64


def bank_set(data: bytes, name: str) -> list[Node]:
    """Banks one after the other, numbered from 0; pictures lie below their bank's number."""
    r = Reader(data)
    tag, count = r.unpack(">4sH", 0)
    need(tag == b"AmBs", "no set of banks")
    at, out = 6, [Node("/banks", "amos.bank-set", "group", [("banks", count)])]
    for i in range(count):
        if r.take(at, 4) == b"AmBk":
            size = (r.unpack(">I", at + 8)[0] & 0x0FFFFFFF) + 12
            nodes, at = containers.bank(r.take(at, size), name), at + size
        else:
            nodes, at = _pictures(data, at)
        out += [n._replace(path=f"/banks/{i}{n.path.removeprefix('/bank')}") for n in nodes]
    need(at == len(data), "data behind the banks")
    return out


def program(data: bytes, name: str) -> list[Node]:
    """Tokens, which are not listed as text, and the banks behind them."""
    r = Reader(data)
    need(data[:11] == b"AMOS Basic " or data[:8] == b"AMOS Pro", "no program")
    (size,) = r.unpack(">I", 16)
    tokens = r.take(20, size)
    banks = bank_set(data[20 + size :], name)
    header = data[:16].rstrip(b"\0 ").decode("latin-1")
    return [Node("/", "amos.program", "group", [("amos.header", header), ("data.length", size)]), Node("/listing", "amos.tokens", "opaque", [("data.length", size), ("decode.warning", "tokens are not listed as text")], data=tokens), *banks]


def _bytes_down(delta: bytes, rows: np.ndarray) -> None:
    """The vertical byte delta: for each plane and column, counts of lines to skip, to copy and to fill."""
    r, (height, planes, line) = Reader(delta), rows.shape
    for plane in range(planes):
        (at,) = r.unpack(">I", 4 * plane)
        if not at:
            continue
        for column in range(line):
            (n,) = r.unpack("B", at)
            at, y = at + 1, 0
            for _ in range(n):
                (op,) = r.unpack("B", at)
                size = op & 127 if op else r.unpack("B", at + 1)[0]
                if op & 128 or not op:
                    need(y + size <= height, "a run leaves the picture")
                    rows[y : y + size, plane, column] = np.frombuffer(r.take(at + 1, size), np.uint8) if op else r.unpack("B", at + 2)[0]
                at += 1 + (size if op & 128 else 0 if op else 2)
                y += size


def _units_along(delta: bytes, rows: np.ndarray, size: int) -> None:
    """Runs of words of two or four bytes along a plane: an offset from the last word and one word, or a negative offset, a count and as many; -1 ends a plane."""
    r, (height, planes, line) = Reader(delta), rows.shape
    need(height * line % size == 0, "a plane is no whole number of words")
    for plane in range(planes):
        (at,) = r.unpack(">I", 4 * plane)
        if not at:
            continue
        need(at >= 32, "a plane begins among the pointers")
        flat, place = rows[:, plane].reshape(-1).copy(), 0
        while True:
            (step,) = r.unpack(">h", at)
            at += 2
            if step == -1:
                break
            count = 1
            if step < 0:
                (count,) = r.unpack(">H", at)
                at, step = at + 2, -step - 1
            place += step
            need(count > 0 and 0 <= place and (place + count) * size <= len(flat), "a run leaves the picture")
            flat[place * size : (place + count) * size] = np.frombuffer(r.take(at, count * size), np.uint8)
            at, place = at + count * size, place + count - 1
        rows[:, plane] = flat.reshape(height, line)


def _units_by_list(delta: bytes, rows: np.ndarray, bits: int) -> None:
    """Words and, apart from them, a list of places and counts (a negative count repeats one word), along the rows or down a column, put or mixed in."""
    r, (height, planes, line) = Reader(delta), rows.shape
    size, info = 4 if bits & 1 else 2, ">i" if bits & 0x20 else ">h"
    wide = 4 if bits & 0x20 else 2
    need(bits < 0x40 and line % size == 0, "unknown options")
    stride = line // size if bits & 0x10 else 1
    for plane in range(planes):
        words, places = (2 * r.unpack(">I", 4 * (plane + 8 * k))[0] for k in (0, 1))
        if not words:
            continue
        need(words >= 64 and places >= 64, "a plane begins among the pointers")
        flat = rows[:, plane].reshape(-1, size).copy()
        while True:
            (place,) = r.unpack(info, places)
            places += wide
            if place == -1:
                break
            (count,) = r.unpack(info, places)
            places += wide
            n = abs(count)
            need(place >= 0 and (count >= 0 or bits & 8) and (not n or place + (n - 1) * stride < len(flat)), "a run leaves the picture")
            if n:
                own = np.frombuffer(r.take(words, size * (1 if count < 0 else n)), np.uint8).reshape(-1, size)
                words += own.size
                spots = place + stride * np.arange(n)
                flat[spots] = flat[spots] ^ own if bits & 2 else own
        rows[:, plane] = flat.reshape(height, line)


def _mixed_in(body: bytes, rows: np.ndarray, mask: int, width: int, height: int, x: int, y: int, packing: int) -> None:
    """A rectangle of some planes whose bits turn those of the picture."""
    planes = [p for p in range(rows.shape[1]) if mask >> p & 1]
    need(bool(planes) and width > 0 and height > 0 and x >= 0 and y >= 0 and x + width <= rows.shape[2] * 8 and y + height <= rows.shape[0], "a rectangle leaves the picture")
    own = np.unpackbits(line_rows(body, width, height, len(planes), packing), axis=2)[:, :, :width]
    for k, plane in enumerate(planes):
        bits = np.unpackbits(rows[y : y + height, plane], axis=1)
        bits[:, x : x + width] ^= own[:, k]
        rows[y : y + height, plane] = np.packbits(bits, axis=1)


def anim(data: bytes, name: str) -> list[Node]:
    """A first picture, then whole pictures (method 0), mixed-in rectangles (1), or deltas of words (2, 3, 4) or bytes (5) against the frame two, or as many as it says, before."""
    kind, forms = iff_chunks(data)
    need(kind == "ANIM" and bool(forms) and all(n == "FORM" and v[:4] == b"ILBM" for n, v in forms) and len(forms) <= 10_000, "no animation of bitmaps")
    parts = [dict(reversed(iff_chunks(b"FORM" + len(v).to_bytes(4, "big") + v)[1])) for _, v in forms]
    first = b"FORM" + len(forms[0][1]).to_bytes(4, "big") + forms[0][1]
    still, head = ilbm(first, name)[0], _bitmap_head(parts[0])
    width, height, _, _, planes, masking, packing, *_ = head
    mode = Reader(parts[0]["CAMG"]).unpack(">I", 0)[0] if "CAMG" in parts[0] else 0
    need(still.raster is not None and masking != 1 and not mode & 0x800 and width * height * len(parts) <= 1 << 26, "unsupported mode")
    kept, frames = [line_rows(parts[0]["BODY"], width, height, planes, packing)], [(0, still.raster.rgba)]
    colours = _colours(parts[0])
    for own in parts[1:]:
        told = Reader(own.get("ANHD", b""))
        op, mask, w, h, x, y, _, jiffies, back = told.unpack(">BBHHhhIIB", 0)
        bits = told.unpack(">I", 20)[0] if len(told.data) >= 24 else 0
        need(op in (0, 1, 2, 3, 4, 5), f"unsupported method {op}")
        rows = kept[max(0, len(kept) - (back or 2))].copy()
        if op == 0 and "BODY" in own:
            rows = line_rows(own["BODY"], width, height, planes, _bitmap_head(own)[6] if "BMHD" in own else packing)
        elif op == 1 and "BODY" in own:
            _mixed_in(own["BODY"], rows, mask, w, h, x, y, packing)
        elif "DLTA" in own:
            if op == 5:
                _bytes_down(own["DLTA"], rows)
            elif op == 4:
                _units_by_list(own["DLTA"], rows, bits)
            else:
                _units_along(own["DLTA"], rows, 4 if op == 2 else 2)
        colours = _colours(own) if "CMAP" in own else colours
        kept.append(rows)
        kept = kept[-256:]
        frames.append((round(jiffies * 1000 / 60), _indexed(plane_pixels(rows, width), shades(colours, mode))))
    shown = [(frames[min(i + 1, len(frames) - 1)][0], v) for i, (_, v) in enumerate(frames)]  # a delta's time is that before it
    return [Node("/animation", "amiga.anim", "raster", [("frames", len(frames)), ("stored-frames", len(parts)), ("planes", planes), ("camg", mode)], raster=still.raster, frames=shown if len(shown) > 1 else None)]


def _unpack_marked_runs(data: bytes, size: int) -> bytes:
    """0x90 marks a run: a count and a byte, or 0xFF, a byte and a long count; a count of 0 is the mark itself."""
    r, out, at = Reader(data), bytearray(), 0
    while len(out) < size:
        b = r.take(at, 1)
        at += 1
        if b != b"\x90":
            out += b
            continue
        n = r.take(at, 1)[0]
        at += 1
        if not n:
            out += b
            continue
        value = r.take(at, 1)
        at += 1
        if n == 255:
            (n,) = r.unpack(">H", at)
            at += 2
        out += value * n
    need(len(out) == size, "a run crosses the end")
    return bytes(out)


def dms(data: bytes, name: str) -> list[Node]:
    """A disk in tracks, stored or packed by runs; where all tracks can be read they are joined to a disk, else listed."""
    r = Reader(data)
    need(data[:4] == b"DMS!" and crc16(r.take(4, 50)) == r.unpack(">H", 54)[0], "no disk archive")
    info, _, low, high, packed, unpacked = r.unpack(">IIHHII", 8)
    (method,) = r.unpack(">H", 52)
    at, tracks = 56, []
    while at + 20 <= len(data) and data[at : at + 2] == b"TR":
        number, _, stored, _, size, flags, how, total, crc, head = r.unpack(">HHHHHBBHHH", at + 2)
        need(crc16(r.take(at, 18)) == head, "a track's header is damaged")
        body = r.take(at + 20, stored)
        need(crc16(body) == crc, "a track is damaged")
        plain = body if how == 0 else _unpack_marked_runs(body, size) if how == 1 else None
        need(plain is None or sum(plain) & 0xFFFF == total, "a track's checksum is wrong")
        tracks.append((number, how, size, body, plain if not info & 2 else None))
        at += 20 + stored
    need(bool(tracks), "no tracks")
    metadata = [("dms.info-flags", info), ("dms.low-track", low), ("dms.high-track", high), ("dms.tracks", len(tracks)), ("dms.packed-length", packed), ("dms.unpacked-length", unpacked), ("dms.compression", method)]
    disk = [plain for number, *_, plain in tracks if number < 80]
    if all(p is not None for p in disk):
        joined = b"".join(disk)
        if joined[:3] == b"DOS" and len(joined) in (901120, 1802240):
            files = adf(joined, name)
            return [files[0]._replace(type_id="amiga.dms", metadata=metadata + files[0].metadata), *files[1:]]
    return [Node("/tracks", "amiga.dms", "group", metadata), *[Node(f"/tracks/{i}", "amiga.dms-track", "opaque", [("track.number", n), ("compression", how), ("unpacked.length", size), ("packed.length", len(body))], data=plain if plain is not None else body) for i, (n, how, size, body, plain) in enumerate(tracks)]]
