"""Parsers of animations, display dumps, fonts and documents, from the public descriptions of their layouts."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from dustlens.sources.codecs import lzw_decode
from dustlens.sources.images import _indexed, _over, zx_screen
from dustlens.sources.jpeg import decode as decode_jpeg
from dustlens.sources.jpeg import exif_fields, oriented
from dustlens.sources.model import Node, Raster, Reader, need
from dustlens.sources.palettes_audio import next_palette

#: Pixels that an animation may have over all its frames; how many frames these are does not matter.
MOST_PIXELS = 1 << 26


def _animation(type_id: str, metadata: list, width: int, height: int, frames: list[tuple[int, bytes]], path: str = "/image", palette: list | None = None) -> Node:
    need(bool(frames), "no frame")
    return Node(path, type_id, "raster", metadata, raster=Raster(width, height, frames[0][1]), palette=palette, frames=frames if len(frames) > 1 else None)


def gif(data: bytes, name: str) -> list[Node]:
    """All frames as they are shown: drawn over what the disposal of the last one leaves, on a transparent canvas."""
    r = Reader(data)
    version, width, height, flags, back, aspect = r.unpack("<6sHHBBB", 0)
    need(version in (b"GIF87a", b"GIF89a") and 0 < width * height <= MOST_PIXELS, "no GIF")
    size = 3 << (flags & 7) + 1 if flags & 128 else 0
    table, at, extensions = r.take(13, size), 13 + size, 0
    canvas, frames = np.zeros((height, width, 4), np.uint8), []
    transparent, ms, disposal = None, 0, 0
    while (kind := r.take(at, 1)[0]) != 0x3B:
        if kind == 0x21:
            extensions += 1
            if r.take(at + 1, 2) == b"\xf9\x04":
                own, delay, index = r.unpack("<BHB", at + 3)
                transparent, ms, disposal = index if own & 1 else None, delay * 10, own >> 2 & 7
            at += 2
        else:
            need(kind == 0x2C, "unknown block")
            x, y, w, h, own = r.unpack("<HHHHB", at + 1)
            at += 10
            local = 3 << (own & 7) + 1 if own & 128 else 0
            colours, bits = r.take(at, local) or table, r.take(at + local, 1)[0]
            at += local + 1
        blocks = []
        while n := r.take(at, 1)[0]:
            blocks.append(r.take(at + 1, n))
            at += 1 + n
        at += 1
        if kind == 0x21:
            continue
        pixels = np.frombuffer(lzw_decode(b"".join(blocks), bits), np.uint8)
        need(len(pixels) == w * h and x + w <= width and y + h <= height and bool(colours), "pixels do not cover the frame")
        need((len(frames) + 1) * width * height <= MOST_PIXELS, "too many frames")
        rows = pixels.reshape(h, w)
        if own & 64:
            rows = rows[np.argsort([*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)])]
        before = canvas.copy()
        drawn = np.frombuffer(_indexed(rows, np.frombuffer(colours, np.uint8).reshape(-1, 3), transparent), np.uint8).reshape(h, w, 4)
        part = canvas[y : y + h, x : x + w]
        part[:] = np.where(drawn[:, :, 3:] > 0, drawn, part)
        frames.append((ms, canvas.tobytes()))
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        transparent, ms, disposal = None, 0, 0
    return [_animation("gif", [("gif.version", version.decode()), ("frames", len(frames)), ("background-index", back), ("pixel-aspect-ratio", aspect), ("extensions", extensions)], width, height, frames)]


def _packets(r: Reader, at: int, colours: np.ndarray, scale: bool) -> None:
    """Colours in packets of (skipped, count, values); 6-bit values are spread to 8."""
    (n,), place = r.unpack("<H", at), 0
    at += 2
    for _ in range(n):
        skip, count = r.unpack("<BB", at)
        place, count = place + skip, count or 256
        need(place + count <= len(colours), "too many colours")
        v = np.frombuffer(r.take(at + 2, 3 * count), np.uint8).reshape(-1, 3)
        colours[place : place + count] = (v << 2 | v >> 4) if scale else v
        place, at = place + count, at + 2 + 3 * count


def _flic_lines(r: Reader, kind: int, screen: np.ndarray) -> None:
    """One chunk of pixels, drawn into ``screen``."""
    height, width = screen.shape
    flat, at, line = screen.reshape(-1), 0, 0

    def put(place: int, values: bytes) -> int:
        need(line < height and place + len(values) <= width, "a run leaves the picture")
        flat[line * width + place : line * width + place + len(values)] = np.frombuffer(values, np.uint8)
        return place + len(values)

    if kind == 13:
        screen[:] = 0
    elif kind == 16:
        screen[:] = np.frombuffer(r.take(0, width * height), np.uint8).reshape(height, width)
    elif kind == 15:
        for line in range(height):
            at, place = at + 1, 0
            while place < width:
                (n,) = r.unpack("<b", at)
                need(n != 0, "an empty run")
                place = put(place, r.take(at + 1, 1) * n if n > 0 else r.take(at + 1, -n))
                at += 2 if n > 0 else 1 - n
    elif kind == 12:
        line, count = r.unpack("<HH", 0)
        at = 4
        for _ in range(count):
            place, packets, at = 0, r.take(at, 1)[0], at + 1
            for _ in range(packets):
                skip, n = r.unpack("<Bb", at)
                place = put(place + skip, r.take(at + 2, n) if n >= 0 else r.take(at + 2, 1) * -n)
                at += 2 + (n if n >= 0 else 1)
            line += 1
    elif kind == 7:
        (count,) = r.unpack("<H", 0)
        at = 2
        for _ in range(count):
            while True:
                (word,) = r.unpack("<H", at)
                at += 2
                if word >> 14 == 3:
                    line += 65536 - word
                elif word >> 14 == 2:
                    put(width - 1, bytes([word & 255]))
                else:
                    need(word >> 14 == 0, "an odd line")
                    break
            place = 0
            for _ in range(word):
                skip, n = r.unpack("<Bb", at)
                place = put(place + skip, r.take(at + 2, 2 * n) if n >= 0 else r.take(at + 2, 2) * -n)
                at += 2 + (2 * n if n >= 0 else 2)
            line += 1


def flic(data: bytes, name: str) -> list[Node]:
    """Both generations of 256 colours; the frame that leads back to the first is not shown."""
    r = Reader(data)
    size, magic, count, width, height, depth, flags, speed = r.unpack("<IHHHHHHI", 0)
    need(magic in (0xAF11, 0xAF12) and size <= len(data) and 0 < width * height and 0 < count and count * width * height <= MOST_PIXELS, "no FLIC")
    ms = speed if magic == 0xAF12 else round((speed & 0xFFFF) * 1000 / 70)
    at = r.unpack("<I", 80)[0] or 128 if magic == 0xAF12 else 128
    screen, colours, frames = np.zeros((height, width), np.uint8), np.zeros((256, 3), np.uint8), []
    while len(frames) < count:
        length, kind, chunks = r.unpack("<IHH", at)
        need(length >= 6, "a chunk is too short")
        if kind == 0xF1FA:
            inner = at + 16
            for _ in range(chunks):
                n, what = r.unpack("<IH", inner)
                need(n >= 6 and inner + n <= at + length, "a chunk leaves its frame")
                body = Reader(r.take(inner + 6, n - 6))
                need(what in (4, 7, 11, 12, 13, 15, 16, 18), "unsupported chunk")
                if what in (4, 11):
                    _packets(body, 0, colours, what == 11)
                elif what != 18:
                    _flic_lines(body, what, screen)
                inner += n
            frames.append((ms, _indexed(screen, colours)))
        at += length
    metadata = [("file-type", f"{magic:04x}"), ("frames", count), ("depth", depth), ("speed", speed), ("flags", flags)]
    return [_animation("flic", metadata, width, height, frames, "/animation")]


def aseprite(data: bytes, name: str) -> list[Node]:
    """The sprite's palette and its frames; layers of other than the normal mode are drawn in it and counted."""
    r = Reader(data)
    size, magic, count, width, height, depth, flags, speed = r.unpack("<IHHHHHIH", 0)
    transparent, declared = r.unpack("<B3xH", 28)
    need(magic == 0xA5E0 and size == len(data) and depth in (8, 16, 32) and 0 < count and 0 < width * height and count * width * height <= MOST_PIXELS, "no sprite")
    colours, at = np.full((256, 4), 255, np.uint8), 128
    layers, cels, times, used, chunks_read, old = [], {}, [], 0, 0, True
    for f in range(count):
        length, mark, few, ms, many = r.unpack("<IHHH2xI", at)
        need(mark == 0xF1FA and length >= 16, "no frame")
        times.append(ms or speed)
        inner = at + 16
        for _ in range(many or few):
            n, kind = r.unpack("<IH", inner)
            need(n >= 6 and inner + n <= at + length, "a chunk leaves its frame")
            body, chunks_read = Reader(r.take(inner + 6, n - 6)), chunks_read + 1
            if kind == 0x2019:
                total, first, last = body.unpack("<III", 0)
                need(first <= last < 256, "more than 256 colours")
                old, used, place = False, max(used, min(total, 256)), 20
                for i in range(first, last + 1):
                    named, *rgba = body.unpack("<H4B", place)
                    colours[i] = rgba
                    place += 6
                    if named & 1:
                        place += 2 + body.unpack("<H", place)[0]
            elif kind in (0x0004, 0x0011) and old:
                _packets(body, 0, colours[:, :3], kind == 0x0011)
                used = declared or 256
            elif kind == 0x2004:
                own, what, _, _, _, blend, opacity = body.unpack("<HHHHHHB", 0)
                layers.append((own & 1, what, blend, opacity if flags & 1 else 255))
            elif kind == 0x2005:
                layer, x, y, opacity, what = body.unpack("<HhhBH", 0)
                need(layer < len(layers), "a cel of no layer")
                if what == 1:
                    cel = cels.get((body.unpack("<H", 16)[0], layer))
                elif what in (0, 2):
                    w, h = body.unpack("<HH", 16)
                    need(0 < w * h <= MOST_PIXELS, "a cel is too large")
                    need_bytes = w * h * depth // 8
                    raw = body.data[20:] if what == 0 else zlib.decompressobj().decompress(body.data[20:], need_bytes + 1)
                    need(len(raw) >= need_bytes, "a cel ends early")
                    cel = (x, y, opacity, np.frombuffer(raw[:need_bytes], np.uint8).reshape(h, w, depth // 8))
                else:
                    cel = None  # tile maps
                if cel is not None:
                    cels[f, layer] = cel
            inner += n
        at += length
    frames = []
    for f in range(count):
        canvas = np.zeros((height, width, 4), np.uint8)
        for i, (visible, what, _, strength) in enumerate(layers):
            if not visible or what or (f, i) not in cels:
                continue
            x, y, opacity, raw = cels[f, i]
            if depth == 32:
                rgba = raw.copy()
            elif depth == 16:
                rgba = raw[:, :, [0, 0, 0, 1]].copy()
            else:
                rgba = colours[raw[:, :, 0]]
                rgba[..., 3] = np.where(raw[:, :, 0] == transparent, 0, rgba[..., 3])
            rgba[..., 3] = np.rint(rgba[..., 3] * (opacity / 255) * (strength / 255)).astype(np.uint8)
            left, top, right, bottom = max(x, 0), max(y, 0), min(x + rgba.shape[1], width), min(y + rgba.shape[0], height)
            if left < right and top < bottom:
                canvas[top:bottom, left:right] = _over(canvas[top:bottom, left:right], rgba[top - y : bottom - y, left - x : right - x])
        frames.append((times[f], canvas.tobytes()))
    metadata = [("width", width), ("height", height), ("frames", count), ("colour-depth", depth), ("chunks", chunks_read), ("layers", len(layers)), ("cels", len(cels)), ("unsupported-blend-modes", sum(b != 0 for _, _, b, _ in layers)), ("transparent-index", transparent), ("declared-colours", declared)]
    out = [Node("/palette", "aseprite.sprite", "palette", [("colours", used)], palette=[tuple(map(int, c)) for c in colours[:used]])] if used else []
    return [*out, _animation("aseprite.sprite", metadata, width, height, frames, "/sprite")]


def gigascreen(data: bytes, name: str) -> list[Node]:
    """One bitmap under two sets of attributes, shown in turn; the third picture is their mean."""
    need(len(data) == 7680 and data[:2] != b"MZ", "not the size of the dump")
    a, b = (zx_screen(data[:6144] + data[6144 + 768 * i : 6912 + 768 * i], name)[0].raster for i in (0, 1))
    mean = ((np.frombuffer(a.rgba, np.uint8).astype(np.uint16) + np.frombuffer(b.rgba, np.uint8)) // 2).astype(np.uint8).tobytes()
    kind = "zx-spectrum.gigascreen"
    return [Node("/screen", kind, "group", []), *[Node(f"/screen/{n}", kind, "raster", [], raster=v) for n, v in (("palette-a", a), ("palette-b", b), ("averaged", Raster(256, 192, mean)))]]


def layer2(data: bytes, name: str) -> list[Node]:
    """A byte for each pixel; colours are the file's own where it has them, else those of the 8-bit default."""
    colours = next_palette(bytes(range(256)), "")[0].palette
    tall = len(data) == 81920
    if len(data) == 49664:
        colours, data = next_palette(data[:512], "")[0].palette, data[512:]
    elif len(data) == 49280:
        need(data[:8] == b"PLUS3DOS", "no disk header")
        data = data[128:]
    need(tall or len(data) == 49152, "not the size of the dump")
    pixels = np.frombuffer(data, np.uint8)
    pixels = pixels.reshape(320, 256).T if tall else pixels.reshape(192, 256)
    rgba = np.array(colours, np.uint8)[pixels]
    return [Node("/image", "zx-spectrum-next.layer2-image", "raster", [("column-major", int(tall))], raster=Raster(pixels.shape[1], pixels.shape[0], rgba.tobytes()))]


def fzx(data: bytes, name: str) -> list[Node]:
    """Glyphs from the space on; the raster has them side by side, the metadata their kerning, shift and width."""
    r = Reader(data)
    height, tracking, last = r.unpack("<BbB", 0)
    need(0 < height <= 192 and last >= 32, "no font")
    count, metadata, glyphs = last - 31, [], []
    starts = [3 + 3 * i + (r.unpack("<H", 3 + 3 * i)[0] & 0x3FFF) for i in range(count + 1)]
    for i in range(count):
        word, form = r.unpack("<HB", 3 + 3 * i)
        shift, width = form >> 4, (form & 15) + 1
        step = 2 if width > 8 else 1
        body = r.take(starts[i], starts[i + 1] - starts[i])
        rows = len(body) // step
        need(len(body) % step == 0 and shift + rows <= height, "a glyph does not fit the font")
        bits = np.zeros((height, 16), np.uint8)
        bits[shift : shift + rows, : 8 * step] = np.unpackbits(np.frombuffer(body, np.uint8).reshape(rows, step), axis=1)
        glyphs.append(bits)
        metadata.append((f"glyph.{32 + i}", f"{word >> 14},{shift},{width}"))
    strip = np.concatenate(glyphs, axis=1)
    head = [("height", height), ("tracking", tracking), ("first-character", 32), ("last-character", last), ("characters", count)]
    return [Node("/font", "zx-spectrum.fzx-font", "font", head + metadata, raster=Raster(strip.shape[1], height, np.repeat(strip[:, :, None] * np.uint8(255), 4, axis=2).tobytes()))]


def write_document(data: bytes, name: str) -> list[Node]:
    """The text; formatting is not read."""
    r = Reader(data)
    magic, zero = r.unpack("<HH", 0)
    need(magic in (0xBE31, 0xBE32) and zero == 0, "no document")
    (end,) = r.unpack("<I", 14)
    body = r.take(128, end - 128)
    text = "".join(bytes([b]).decode("cp1252", "replace") for b in body).replace("\r\n", "\n").replace("\f", "\n")
    metadata = [("windows-write.variant", f"{magic:04x}"), ("windows-write.text.offset", 128), ("windows-write.text.length", len(body)), ("windows-write.line-breaks", body.count(b"\r\n")), ("windows-write.tabs", body.count(b"\t")), ("windows-write.extended-characters", sum(b > 127 for b in body))]
    return [Node("/document", "windows.write", "document", metadata, text=text)]


def wordstar(data: bytes, name: str) -> list[Node]:
    """The text without markers: soft returns join lines, print toggles go, dot commands are counted and left out."""
    header = len(data) >= 128 and data[:3] == b"\x1d\x7d\x00" and data[127] == 0x1D
    ending = name.rpartition(".")[2].lower()
    need(header or bool(re.fullmatch(r"ws\w?|wsd", ending)), "no header and no known ending")
    body = data[128 if header else 0 :].split(b"\x1a")[0]
    need(header or not re.search(rb"[\x00]", body), "not a text")
    body = re.sub(rb"\x1b(.)\x1c", rb"\1", body, flags=re.S)
    soft, toggles = body.count(b"\x8d"), len(re.findall(rb"[\x02\x04\x13\x14\x16\x18\x19]", body))
    joined = re.sub(rb"[\x00-\x08\x0b\x0e-\x1f]", b"", body.replace(b"\x8d\n", b" ").replace(b"\x8d\x8a", b" ").replace(b"\x8a", b"").replace(b"\xa0", b""))
    lines = bytes(b & 127 for b in joined).decode("ascii").replace("\r\n", "\n").split("\n")
    kept = [line for line in lines if not re.match(r"\.[A-Za-z.]", line)]
    text = re.sub(r" {2,}", " ", "\n".join(kept)) if soft else "\n".join(kept)
    metadata = [("wordstar.header.present", int(header)), ("wordstar.content.offset", 128 if header else 0), ("wordstar.content.length", len(body)), ("wordstar.hard-returns", len(lines) - 1), ("wordstar.soft-returns", soft), ("wordstar.formatting-controls", toggles), ("wordstar.dot-commands", len(lines) - len(kept))]
    return [Node("/document", "wordstar.document", "document", metadata, text=text)]


def jpeg(data: bytes, name: str) -> list[Node]:
    """Size and process from the markers; the pixels of pictures with prefix codes, turned as Exif says. Others stay as they are, with a warning."""
    r, at, found, jfif, exif, fields, wrong = Reader(data), 2, None, None, 0, {}, None
    need(data[:2] == b"\xff\xd8", "no JPEG")
    while found is None:
        mark, size = r.unpack(">HH", at)
        need(mark >> 8 == 0xFF and size >= 2, "no marker")
        body = Reader(r.take(at + 4, size - 2))
        kind = mark & 255
        if kind == 0xE0 and body.data[:5] == b"JFIF\0":
            jfif = body.unpack(">BBBHH", 5)
        if kind == 0xE1 and body.data[:6] == b"Exif\0\0":
            exif = 1
            try:
                fields = exif_fields(body.data)
            except (ValueError, struct.error) as e:
                wrong = str(e)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            found = (kind, *body.unpack(">BHHB", 0))
        need(kind != 0xDA or found is not None, "no frame before the scan")
        at += 2 + size
    kind, precision, height, width, parts = found
    metadata = [("image.width", width), ("image.height", height), ("jpeg.precision", precision), ("jpeg.frame-marker", f"{kind:02x}"), ("jpeg.coding", "arithmetic" if kind >= 0xC9 else "huffman"), ("jpeg.progressive", int(kind in (0xC2, 0xCA))), ("jpeg.components", parts), ("exif.present", exif), ("jfif.present", int(jfif is not None))]
    if jfif:
        metadata += [("jfif.version", f"{jfif[0]}.{jfif[1]:02d}"), ("jfif.density-units", jfif[2]), ("jfif.density.x", jfif[3]), ("jfif.density.y", jfif[4])]
    turn = fields.get("orientation", 1) if fields.get("orientation", 1) in range(1, 9) else 1
    metadata += [("exif.orientation", turn), *[(f"exif.{k}", v) for k, v in fields.items() if k != "orientation"], *([("exif.error", wrong)] if wrong else [])]
    try:
        picture = Raster(*oriented(*decode_jpeg(data), turn))
    except (ValueError, KeyError, IndexError) as e:
        return [Node("/image", "jpeg", "opaque", [*metadata, ("decode.warning", str(e))], data=data)]
    return [Node("/image", "jpeg", "raster", metadata, raster=picture)]


def bmfont(data: bytes, name: str) -> list[Node]:
    """A descriptor as text, XML or binary: its glyphs are metadata (x, y, width, height, offsets, advance, page); its page files are named."""
    head, pages, glyphs, kernings = {}, {}, [], 0
    if data[:4] == b"BMF\3":
        r, at = Reader(data), 4
        while at < len(data):
            kind, size = r.unpack("<BI", at)
            body = Reader(r.take(at + 5, size))
            if kind == 1:
                head["size"], head["face"] = abs(body.unpack("<h", 0)[0]), body.data[14:].split(b"\0")[0].decode("utf-8", "replace")
            elif kind == 2:
                head["lineHeight"], head["base"], head["scaleW"], head["scaleH"], count = body.unpack("<HHHHH", 0)
                head["pages"] = count
            elif kind == 3:
                pages = dict(enumerate(body.data.rstrip(b"\0").decode("utf-8", "replace").split("\0")))
            elif kind == 4:
                glyphs = [body.unpack("<IHHHHhhhB", i) for i in range(0, size - size % 20, 20)]
            elif kind == 5:
                kernings = size // 10
            at += 5 + size
    else:
        for kind, rest in re.findall(r"(?m)^\s*<?(info|common|page|char|kerning)\s+(.*)$", data.decode("utf-8", "replace")):
            own = {k: a or b for k, a, b in re.findall(r'(\w+)=(?:"([^"]*)"|(\S+?)(?=\s|/|$))', rest)}
            if kind in ("info", "common"):
                head |= own
            elif kind == "page":
                pages[int(own["id"])] = own["file"]
            elif kind == "char":
                glyphs.append(tuple(int(own[k]) for k in ("id", "x", "y", "width", "height", "xoffset", "yoffset", "xadvance", "page")))
            else:
                kernings += 1
    need(int(head.get("lineHeight", 0)) > 0 and bool(pages) and all(g[8] in pages for g in glyphs), "no font, or a page is missing")
    wide, high = int(head.get("scaleW", 0)), int(head.get("scaleH", 0))
    need(all(g[1] + g[3] <= wide and g[2] + g[4] <= high for g in glyphs), "a glyph is outside of its page")
    metadata = [("font.face", head.get("face", "")), ("font.size", head.get("size", 0)), ("font.declared-line-height", head["lineHeight"]), ("font.declared-baseline", head.get("base", 0)), ("pages", len(pages)), ("characters", len(glyphs)), ("kernings", kernings), ("atlas.width", wide), ("atlas.height", high)]
    metadata += [(f"page.{i}", f) for i, f in sorted(pages.items())] + [(f"glyph.{g[0]}", ",".join(map(str, g[1:]))) for g in glyphs]
    return [Node("/font", "bitmap-font.bmfont", "font", metadata)]


#: Lines that a terminal's picture may have.
MOST_LINES = 10_000


def ansi(data: bytes, name: str) -> list[Node]:
    """The characters that stand on the terminal in the end, as text; colours and glyph shapes are not drawn."""
    sauce = data[-128:] if len(data) >= 128 and data[-128:-123] == b"SAUCE" else b""
    body = data[: len(data) - len(sauce)].split(b"\x1a")[0]
    need(b"\x1b[" in body, "no control sequences")
    width = int.from_bytes(sauce[96:98], "little") if sauce and sauce[94] == 1 else 0
    width = width if 0 < width <= 1024 else 80
    cells: dict[tuple[int, int], str] = {}
    x = y = controls = 0
    kept = (0, 0)
    for args, final, char in re.findall(rb"\x1b\[([0-9;?=]*)([@-~])|(.)", body, re.S):
        if final:
            controls += 1
            n = [int(v) if v.isdigit() else 0 for v in args.split(b";")]
            step = max(1, n[0])
            if final in b"ABCD":
                x = min(max(x + {67: step, 68: -step}.get(final[0], 0), 0), width - 1)
                y = max(y + {65: -step, 66: step}.get(final[0], 0), 0)
            elif final in b"Hf":
                y, x = max(n[0], 1) - 1, min(max(n[1] if len(n) > 1 else 1, 1), width) - 1
            elif final == b"J" and n[0] == 2:
                cells, x, y = {}, 0, 0
            elif final == b"K":
                for c in range(x, width):
                    cells.pop((y, c), None)
            elif final == b"s":
                kept = (x, y)
            elif final == b"u":
                x, y = kept
        elif char == b"\r":
            x = 0
        elif char == b"\n":
            y += 1
        elif char == b"\t":
            x = min(x // 8 * 8 + 8, width - 1)
        elif char >= b" ":
            if x == width:
                x, y = 0, y + 1
            cells[y, x] = char.decode("cp437")
            x += 1
        need(y < MOST_LINES, "too many lines")
    last = max((r for r, _ in cells), default=-1)
    lines = ["".join(cells.get((r, c), " ") for c in range(width)).rstrip() for r in range(last + 1)]
    metadata = [("ansi.columns", width), ("ansi.control-sequences", controls), ("sauce.present", int(bool(sauce)))]
    for key, a, b in (("title", 7, 42), ("author", 42, 62), ("group", 62, 82), ("date", 82, 90), ("font", 106, 128)):
        value = sauce[a:b].rstrip(b"\0 ").decode("cp437")
        metadata += [(f"sauce.{key}", value)] if value else []
    return [Node("/image", "ansi.art", "text", metadata, text="\n".join(lines))]
