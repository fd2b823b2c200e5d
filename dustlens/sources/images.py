"""Parsers of images."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from dustlens.sources.codecs import unpack_runs
from dustlens.operators.colour_cycles import Cycle
from dustlens.sources.listings import spectrum_basic
from dustlens.sources.model import Node, Raster, Reader, need


def _rgba(rgb: np.ndarray, alpha: np.ndarray | int = 255) -> bytes:
    out = np.empty((*rgb.shape[:2], 4), np.uint8)
    out[..., :3], out[..., 3] = rgb, alpha
    return out.tobytes()


def _indexed(pixels: np.ndarray, palette: np.ndarray, transparent: int | None = None) -> bytes:
    need(not pixels.size or int(pixels.max()) < len(palette), "an index is outside of the palette")
    return _rgba(palette[pixels], np.where(pixels == transparent, 0, 255) if transparent is not None else 255)


def png(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    need(len(data) >= 33 and r.take(0, 8) == b"\x89PNG\r\n\x1a\n", "no PNG")
    at, chunks, idat, palette, trns, ended, parts = 8, [], b"", None, b"", False, []
    while at < len(data):
        need(not ended, "data after IEND")
        (size,), kind = r.unpack(">I", at), r.take(at + 4, 4)
        body = r.take(at + 8, size)
        need(kind.isalpha() and r.unpack(">I", at + 8 + size)[0] == zlib.crc32(kind + body), "bad chunk")
        need(bool(chunks) == (kind != b"IHDR"), "IHDR is not first")
        if kind == b"IDAT":
            need(not idat or chunks[-1] == "IDAT", "IDAT chunks are apart")
            idat += body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            trns = body
        elif kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = Reader(body).unpack(">IIBBBBB", 0)
        elif kind == b"fcTL":
            parts.append((Reader(body).unpack(">IIIIIHHBB", 0), not idat, []))
        elif kind == b"fdAT":
            need(bool(parts), "a frame without its control")
            parts[-1][2].append(body[4:])
        ended = kind == b"IEND"
        chunks.append(kind.decode())
        at += 12 + size
    need(ended, "no IEND")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 0)
    need(width > 0 and height > 0 and channels > 0 and depth in {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(colour, (8, 16)), "bad header")

    def decode(packed: bytes, w: int, h: int) -> np.ndarray:
        rgba = _png_pixels(zlib.decompress(packed), w, h, depth, colour, channels, interlace, palette, trns)
        return np.frombuffer(rgba, np.uint8).reshape(h, w, 4)

    still = decode(idat, width, height)
    frames, canvas = [], np.zeros((height, width, 4), np.uint8)
    for (_, w, h, x, y, top, below, disposal, blend), first, own in parts:
        need(x + w <= width and y + h <= height and (len(frames) + 1) * width * height <= 1 << 26, "a frame leaves the picture, or too many")
        drawn = still if first and not own else decode(b"".join(own), w, h)
        need(drawn.shape[:2] == (h, w), "a frame of another size")
        before, part = canvas.copy(), canvas[y : y + h, x : x + w]
        part[:] = _over(part, drawn) if blend else drawn
        frames.append((round(top * 1000 / (below or 100)), canvas.tobytes()))
        if disposal == 1:
            part[:] = 0
        elif disposal == 2:
            canvas = before
    rgba = frames[0][1] if frames else still.tobytes()
    return [Node("/image", "png", "raster", [("bit-depth", depth), ("colour-type", colour), ("interlace-method", interlace), ("chunks", len(chunks)), *[(f"chunk.{i}", c) for i, c in enumerate(chunks)]], raster=Raster(width, height, rgba), frames=frames if len(frames) > 1 else None)]


def _over(below: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Straight alpha, above over below."""
    a, b = above[..., 3:] / 255.0, below[..., 3:] / 255.0
    alpha = a + b * (1 - a)
    rgb = (above[..., :3] * a + below[..., :3] * b * (1 - a)) / np.maximum(alpha, 1e-9)
    return np.rint(np.concatenate([rgb, alpha * 255], axis=2)).astype(np.uint8)


def _png_pixels(raw: bytes, width: int, height: int, depth: int, colour: int, channels: int, interlace: int, palette: np.ndarray | None, trns: bytes) -> bytes:
    step = max(1, channels * depth // 8)
    samples = np.zeros((height, width, channels), np.uint16)
    passes = [(0, 0, 1, 1)] if not interlace else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    at = 0
    for x0, y0, dx, dy in passes:
        w, h = max(0, -(-(width - x0) // dx)), max(0, -(-(height - y0) // dy))
        if not w or not h:
            continue
        line = (w * channels * depth + 7) // 8
        before = bytearray(line)
        for y in range(h):
            need(at + 1 + line <= len(raw), "image data ends early")
            kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + line])
            at += 1 + line
            need(kind < 5, "unknown filter")
            for i in range(line if kind else 0):
                a, b, c = row[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
                if kind == 4:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    a = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = (row[i] + (a if kind in (1, 4) else b if kind == 2 else (a + b) // 2)) & 255
            before = row
            own = np.frombuffer(bytes(row), np.uint8)
            values = own.reshape(-1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16) if depth == 16 else own if depth == 8 else (np.unpackbits(own).reshape(-1, depth) @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)
            samples[y0 + y * dy, x0::dx] = values[: w * channels].reshape(w, channels)
    need(at == len(raw), "more image data than pixels")
    most = (1 << depth) - 1
    eight = (samples >> 8 if depth == 16 else samples if depth == 8 else samples.astype(np.uint32) * 255 // most).astype(np.uint8)
    if colour == 3:
        need(palette is not None and int(samples.max()) < len(palette), "an index is outside of the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(trns)] = np.frombuffer(trns[: len(palette)], np.uint8)
        return _rgba(palette[samples[..., 0]], alpha[samples[..., 0]])
    else:
        rgb = np.repeat(eight[..., :1], 3, axis=2) if channels < 3 else eight[..., :3]
        alpha = eight[..., -1] if channels in (2, 4) else 255
        if trns and channels in (1, 3):
            alpha = np.where((samples == np.frombuffer(trns, ">u2")[:channels]).all(axis=2), 0, 255)
        return _rgba(rgb, alpha)


def qoi(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    need(len(data) >= 22 and data[-8:] == b"\0\0\0\0\0\0\0\1", "no QOI")
    magic, width, height, channels, space = r.unpack(">4sIIBB", 0)
    need(magic == b"qoif" and channels in (3, 4) and space in (0, 1) and width > 0 and height > 0, "bad header")
    out, seen, pixel, at, end = bytearray(), [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, len(data) - 8
    while len(out) < width * height * 4:
        need(at < end, "image data ends early")
        b, run = data[at], 1
        at += 1
        red, green, blue, alpha = pixel
        if b >= 254:
            pixel = (*r.take(at, 3), alpha) if b == 254 else tuple(r.take(at, 4))
            at += b - 251
        elif b >> 6 == 0:
            pixel = seen[b]
        elif b >> 6 == 1:
            pixel = ((red + (b >> 4 & 3) - 2) & 255, (green + (b >> 2 & 3) - 2) & 255, (blue + (b & 3) - 2) & 255, alpha)
        elif b >> 6 == 2:
            d, other = (b & 63) - 32, r.take(at, 1)[0]
            at += 1
            pixel = ((red + d + (other >> 4) - 8) & 255, (green + d) & 255, (blue + d + (other & 15) - 8) & 255, alpha)
        else:
            run = (b & 63) + 1
        seen[(pixel[0] * 3 + pixel[1] * 5 + pixel[2] * 7 + pixel[3] * 11) % 64] = pixel
        out += bytes(pixel) * run
    need(len(out) == width * height * 4 and at == end, "pixels do not cover the image")
    return [Node("/image", "qoi", "raster", [("channels", channels), ("colour-space", space)], raster=Raster(width, height, bytes(out)))]


def pcx(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    maker, version, coding, bits, x0, y0, x1, y1, dx, dy = r.unpack("<BBBBHHHHHH", 0)
    reserved, planes, line = r.unpack("<BBH", 64)
    width, height = x1 - x0 + 1, y1 - y0 + 1
    need(maker == 10 and version in (0, 2, 3, 4, 5) and coding in (0, 1) and bits in (1, 2, 4, 8) and not reserved and 1 <= planes <= 4, "no PCX header")
    need(width > 0 and height > 0 and line % 2 == 0 and line * 8 >= width * bits and (planes in (1, 3) if bits == 8 else bits * planes <= 4), "bad header")
    at, rows = 128, []
    for _ in range(height):
        row = bytearray()
        while len(row) < line * planes:
            b = r.take(at, 1)[0]
            at += 1
            if coding and b >= 192:
                row += r.take(at, 1) * (b & 63)
                at += 1
            else:
                row.append(b)
        need(len(row) == line * planes, "a run crosses a line")
        rows.append(np.frombuffer(bytes(row), np.uint8).reshape(planes, line))
    block = np.stack(rows)
    if bits == 8 and planes == 3:
        rgba = _rgba(block[:, :, :width].transpose(0, 2, 1))
    elif bits == 8:
        need(len(data) >= 769 and data[-769] == 12, "no palette")
        rgba = _indexed(block[:, 0, :width], np.frombuffer(data[-768:], np.uint8).reshape(-1, 3))
    else:
        values = (np.unpackbits(block, axis=2).reshape(height, planes, -1, bits) @ (1 << np.arange(bits - 1, -1, -1)))[:, :, :width]
        pixels = (values << (np.arange(planes) * bits)[None, :, None]).sum(axis=1)
        colours = np.frombuffer(data[16:64], np.uint8).reshape(-1, 3) if bits * planes > 1 else np.array([[0, 0, 0], [255, 255, 255]], np.uint8)
        rgba = _indexed(pixels, colours)
    return [Node("/image", "pcx", "raster", [("bits-per-pixel", bits), ("planes", planes), ("position.x", x0), ("position.y", y0), ("dpi.x", dx), ("dpi.y", dy)], raster=Raster(width, height, rgba))]


#: Pixels of a picture that are decoded at most; larger ones are refused.
MOST_PIXELS = 1 << 26


def unpack_bitmap_runs(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Pixel numbers of run-length coded lines, the first one at the bottom; those that no run reaches are 0. A code is a count and a value (two values of four bits in turn), or 0 and: an end, a jump, or a count of plain values."""
    out = np.zeros((height, width), np.uint8)
    x = y = at = 0

    def put(values: list[int]) -> None:
        nonlocal x
        need(y < height and x + len(values) <= width, "a run leaves the picture")
        out[y, x : x + len(values)] = values
        x += len(values)

    while at < len(data):
        need(at + 2 <= len(data), "a code ends early")
        count, value = data[at], data[at + 1]
        at += 2
        if count:
            put([value] * count if bits == 8 else [value >> 4, value & 15] * (count // 2) + [value >> 4] * (count % 2))
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        elif value == 2:
            need(at + 2 <= len(data), "a jump ends early")
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = value if bits == 8 else (value + 1) // 2
            need(at + size <= len(data), "plain values end early")
            plain = data[at : at + size]
            put(list(plain) if bits == 8 else [v for b in plain for v in (b >> 4, b & 15)][:value])
            at += size + (size & 1)
    return out


def bmp(data: bytes, name: str, offset: int = 14) -> list[Node]:
    r = Reader(data)
    start = r.unpack("<I", 10)[0] if offset else None
    need(not offset or data[:2] == b"BM", "no bitmap header")
    (size,) = r.unpack("<I", offset)
    if size == 12:
        width, height, _, bits = r.unpack("<HHHH", offset + 4)
        packing, used, dpm = 0, 0, (0, 0)
    else:
        need(size in (40, 52, 56, 108, 124), "unknown header")
        width, height, _, bits, packing, _, *dpm, used, _ = r.unpack("<iiHHIIiiII", offset + 4)
    need(width > 0 and height != 0 and bits in (1, 4, 8, 16, 24, 32) and (packing in (0, 3) or (packing, bits) in ((1, 8), (2, 4)) and height > 0) and width * abs(height) <= MOST_PIXELS, "unsupported bitmap")
    entry, colours = (3 if size == 12 else 4), (used or 1 << bits) if bits <= 8 else 0
    at = offset + size + (12 if packing == 3 and size == 40 else 0)
    palette = np.frombuffer(r.take(at, colours * entry), np.uint8).reshape(-1, entry)[:, 2::-1]
    at = start if start is not None else at + colours * entry
    line = (width * bits + 31) // 32 * 4
    if packing in (1, 2):
        rgba, rows = _indexed(unpack_bitmap_runs(data[at:], width, height, bits)[::-1], palette), None
    else:
        rows = np.frombuffer(r.take(at, line * abs(height)), np.uint8).reshape(abs(height), line)
        rows = rows[::-1] if height > 0 else rows
    if rows is None:
        pass
    elif bits <= 8:
        pixels = rows[:, :width] if bits == 8 else (np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits) @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
        rgba = _indexed(pixels, palette)
    elif bits == 24 or bits == 32 and packing == 0:
        rgba = _rgba(rows[:, : width * bits // 8].reshape(abs(height), width, -1)[..., 2::-1])
    else:
        masks = r.unpack("<III", offset + 40) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        words = rows[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.uint64)
        need(all(masks), "empty mask")
        rgb = [(((words & np.uint64(m)) >> np.uint64((m & -m).bit_length() - 1)) * np.uint64(255) + np.uint64(m // (m & -m) // 2)) // np.uint64(m // (m & -m)) for m in masks]
        rgba = _rgba(np.stack(rgb, axis=2).astype(np.uint8))
    kind = "windows.bmp" if offset else "windows.dib"
    return [Node("/image", kind, "raster", [("bits-per-pixel", bits), ("compression", packing), ("colours-used", used), ("pixels-per-metre.x", dpm[0]), ("pixels-per-metre.y", dpm[1])], raster=Raster(width, abs(height), rgba))]


def pam(data: bytes) -> list[Node]:
    """The variant with a header of lines: one to four values a pixel."""
    end = data.find(b"ENDHDR\n")
    need(end > 0, "the header does not end")
    own = dict(line.split(None, 1) for line in data[3:end].split(b"\n") if line and not line.startswith(b"#") and b" " in line.strip())
    need(all(own.get(k, b"").strip().isdigit() for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL")), "bad header")
    width, height, depth, most = (int(own[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    need(0 < width * height <= MOST_PIXELS and 1 <= depth <= 4 and 0 < most < 65536, "bad header")
    values = np.frombuffer(Reader(data).take(end + 7, width * height * depth * (1 + (most > 255))), ">u2" if most > 255 else np.uint8).astype(np.uint32).reshape(height, width, depth)
    need(int(values.max()) <= most, "a value is over the maximum")
    values = (values * 255 // most).astype(np.uint8)
    rgba = np.full((height, width, 4), 255, np.uint8)
    rgba[..., :3] = values[..., :3] if depth >= 3 else values[..., :1]
    if depth in (2, 4):
        rgba[..., 3] = values[..., -1]
    return [Node("/image", "netpbm", "raster", [("images", 1), ("variant", "P7"), ("depth", depth), ("maxval", most), ("tuple-type", own.get(b"TUPLTYPE", b"").decode("latin-1").strip())], raster=Raster(width, height, rgba.tobytes()))]


def netpbm(data: bytes, name: str) -> list[Node]:
    variant, at, fields = data[:2].decode("latin-1"), 2, []
    if variant == "P7":
        return pam(data)
    need(variant in ("P1", "P2", "P3", "P4", "P5", "P6"), "no Netpbm variant that is known")
    token = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])*([0-9]+)")
    for _ in range(2 if variant in ("P1", "P4") else 3):
        m = token.match(data, at)
        need(m is not None, "bad header")
        fields.append(int(m[1]))
        at = m.end()
    width, height, most = (*fields, 1)[:3]
    depth = 3 if variant in ("P3", "P6") else 1
    need(width > 0 and height > 0 and 0 < most < 65536, "bad header")
    count = width * height * depth
    if variant == "P4":
        line = (width + 7) // 8
        values = np.unpackbits(np.frombuffer(Reader(data).take(at + 1, line * height), np.uint8).reshape(height, line), axis=1)[:, :width]
    elif variant in ("P5", "P6"):
        values = np.frombuffer(Reader(data).take(at + 1, count * (1 + (most > 255))), ">u2" if most > 255 else np.uint8)
    else:
        found = re.findall(rb"[01]" if variant == "P1" else rb"[0-9]+", re.sub(rb"#[^\r\n]*", b"", data[at:]))
        need(len(found) >= count, "image data ends early")
        values = np.fromiter(map(int, found), np.int64, count)
    values = values.astype(np.uint32).reshape(height, width, depth)
    need(int(values.max()) <= most, "a value is over the maximum")
    values = (1 - values if variant in ("P1", "P4") else values) * 255 // most
    return [Node("/image", "netpbm", "raster", [("images", 1), ("variant", variant), ("depth", depth), ("maxval", most)], raster=Raster(width, height, _rgba(np.broadcast_to(values, (height, width, 3)).astype(np.uint8))))]


def tga(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    note, mapped, kind, origin, length, entry, x, y, width, height, bits, flags = r.unpack("<BBBHHBHHHHBB", 0)
    need(kind in (1, 2, 3, 9, 10, 11) and width > 0 and height > 0 and bits in (8, 15, 16, 24, 32), "no TGA header")
    at = 18 + note

    def colours(raw: bytes, depth: int) -> np.ndarray:
        if depth in (15, 16):
            v = np.frombuffer(raw, "<u2").astype(np.uint32)
            return np.stack([*[(v >> s & 31) * 255 // 31 for s in (10, 5, 0)], np.full(len(v), 255)], axis=1).astype(np.uint8)
        v = np.frombuffer(raw, np.uint8).reshape(-1, depth // 8)
        return np.concatenate([v[:, 2::-1], v[:, 3:] if depth == 32 else np.full((len(v), 1), 255, np.uint8)], axis=1)

    palette = colours(r.take(at, length * ((entry + 7) // 8)), entry) if mapped else None
    at += length * ((entry + 7) // 8) if mapped else 0
    step = (bits + 7) // 8
    if kind < 8:
        raw = r.take(at, width * height * step)
    else:
        out = bytearray()
        while len(out) < width * height * step:
            n = r.take(at, 1)[0]
            count = (n & 127) + 1
            out += r.take(at + 1, step) * count if n & 128 else r.take(at + 1, step * count)
            at += 1 + (step if n & 128 else step * count)
        need(len(out) == width * height * step, "a run crosses the end")
        raw = bytes(out)
    if kind & 7 == 1:
        index = np.frombuffer(raw, np.uint8 if step == 1 else "<u2").astype(int) - origin
        need(palette is not None and index.min() >= 0 and index.max() < len(palette), "an index is outside of the palette")
        pixels = palette[index]
    elif kind & 7 == 3:
        v = np.frombuffer(raw, np.uint8)[::step]
        pixels = np.stack([v, v, v, np.full(len(v), 255, np.uint8)], axis=1)
    else:
        pixels = colours(raw, bits)
    pixels = pixels.reshape(height, width, 4)
    pixels = pixels if flags & 32 else pixels[::-1]
    pixels = pixels[:, ::-1] if flags & 16 else pixels
    return [Node("/image", "tga", "raster", [("image-type", kind), ("bits-per-pixel", bits), ("attribute-bits", flags & 15), ("position.x", x), ("position.y", y)], raster=Raster(width, height, np.ascontiguousarray(pixels).tobytes()))]


#: The display's colours: bit 0 blue, bit 1 red, bit 2 green, at 215 or, bright, 255 (fixed values).
ZX = np.array([[(255 if i & 8 else 215) * (i >> b & 1) for b in (1, 2, 0)] for i in range(16)], np.uint8)


def zx_screen(data: bytes, name: str) -> list[Node]:
    need(len(data) == 6912, "a screen has 6,912 bytes")
    raw = np.frombuffer(data, np.uint8)
    y = np.arange(192)
    rows = raw[:6144].reshape(192, 32)[(y & 0xC0) | (y & 7) << 3 | (y & 0x38) >> 3]
    cells = raw[6144:].reshape(24, 32).repeat(8, axis=0).repeat(8, axis=1).astype(int)
    bright = cells >> 3 & 8
    ink, flash, front, back = np.unpackbits(rows, axis=1), cells >> 7, cells & 7 | bright, cells >> 3 & 7 | bright
    shown = [_rgba(ZX[np.where(ink ^ flash & turn, front, back)]) for turn in (0, 1)]
    frames = [(320, v) for v in shown] if flash.any() else None  # flashing cells swap their colours every 16 fields
    return [Node("/screen", "zx-spectrum.screen", "raster", [("flash", int(flash.any()))], raster=Raster(256, 192, shown[0]), frames=frames)]


def zx_snapshot(data: bytes, name: str) -> list[Node]:
    """The screen, and the program that lies between two addresses that the machine keeps."""
    out = [Node("/", "zx-spectrum.snapshot", "group", [])] + [n._replace(path="/screen") for n in zx_screen(data[27 : 27 + 6912], name)]
    start, end = (struct.unpack_from("<H", data, 27 + at - 16384)[0] for at in (23635, 23627))
    if 16384 <= start < end <= 65535:
        try:
            out.append(Node("/listing", "zx-spectrum.basic", "text", [("basic.start", start), ("basic.length", end - start)], text=spectrum_basic(data[27 + start - 16384 : 27 + end - 16384])))
        except ValueError:
            pass  # a machine without a program
    return out


def koala(data: bytes, name: str) -> list[Node]:
    """Multicolour picture: address, 8,000 bytes of bitmap, 1,000 of screen, 1,000 of colour memory, the background."""
    need(len(data) >= 10003, "a picture has 10,003 bytes")
    raw = np.frombuffer(data, np.uint8)
    two = (np.unpackbits(raw[2:8002]).reshape(25, 40, 8, 4, 2) @ np.array([2, 1])).transpose(0, 2, 1, 3).reshape(200, 160)
    screen, colour = (x.reshape(25, 40).repeat(8, axis=0).repeat(4, axis=1) for x in (raw[8002:9002], raw[9002:10002]))
    pixels = np.choose(two, [raw[10002] & 15, screen >> 4, screen & 15, colour & 15])
    return [Node("/image", "commodore64.koala-painter", "raster", [("load-address", int(raw[0]) | int(raw[1]) << 8), ("background-byte", int(raw[10002])), ("background-colour", int(raw[10002]) & 15), ("trailing-bytes", len(data) - 10003)], raster=Raster(160, 200, _rgba(C64[pixels])))]


#: A widely used rendering of the computer's 16 colours (fixed values).
C64 = np.array([[0, 0, 0], [255, 255, 255], [136, 0, 0], [170, 255, 238], [204, 68, 204], [0, 204, 85], [0, 0, 170], [238, 238, 119], [221, 136, 85], [102, 68, 0], [255, 119, 119], [51, 51, 51], [119, 119, 119], [170, 255, 102], [0, 136, 255], [187, 187, 187]], np.uint8)


def iff_chunks(data: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """The type of a FORM and its chunks; the size must be that of the data, odd chunks must be padded."""
    r = Reader(data)
    tag, size, kind = r.unpack(">4sI4s", 0)
    need(tag == b"FORM" and size + 8 == len(data), "no FORM of this size")
    out, at = [], 12
    while at < len(data):
        name, n = r.unpack(">4sI", at)
        out.append((name.decode("latin-1"), r.take(at + 8, n)))
        at += 8 + n + (n & 1)
        need(at <= len(data), "no pad byte")
    return kind.decode("latin-1"), out


def colour_ranges(chunks: list[tuple[str, bytes]], colours: int) -> list[Cycle]:
    """The active ranges of CRNG and CCRT chunks, in order; ranges outside of the palette are refused."""
    out = []
    for kind, body in chunks:
        if kind == "CRNG":
            need(len(body) == 8, "a colour range has 8 bytes")
            rate, flags, low, high = struct.unpack(">2xHHBB", body)
            # 16384 is 60 steps a second.
            cycle = Cycle(low, high, max(1, (16_384_000 + rate * 30) // (rate * 60)), -1 if flags & 2 else 1) if flags & 1 and rate else None
        elif kind == "CCRT":
            need(len(body) == 14, "a timed colour range has 14 bytes")
            way, low, high, seconds, micros = struct.unpack(">hBBII2x", body)
            cycle = Cycle(low, high, max(1, seconds * 1000 + (micros + 500) // 1000), way) if way else None
        else:
            continue
        if cycle and low < high:
            need(high < colours, "a colour range is outside of the palette")
            out.append(cycle)
    return out


def ilbm(data: bytes, name: str) -> list[Node]:
    kind, chunks = iff_chunks(data)
    need(kind == "ILBM", "no ILBM")
    own = dict(reversed(chunks))
    head = Reader(own.get("BMHD", b""))
    width, height, x, y, planes, masking, packing, _, transparent, ax, ay = head.unpack(">HHhhBBBBHBB", 0)
    mode = Reader(own["CAMG"]).unpack(">I", 0)[0] if "CAMG" in own else 0
    need(width > 0 and height > 0 and packing in (0, 1) and masking <= 3, "bad header")
    cmap = np.frombuffer(own.get("CMAP", b"")[: len(own.get("CMAP", b"")) // 3 * 3], np.uint8).reshape(-1, 3)
    metadata = [("colours", len(cmap)), ("camg", mode), ("planes", planes), ("masking", masking), ("transparent-colour", transparent), ("position.x", x), ("position.y", y), ("aspect.x", ax), ("aspect.y", ay)]
    palette = [(*map(int, c), 255) for c in cmap]
    cycles = colour_ranges(chunks, len(cmap))
    if "BODY" not in own:
        return [Node("/palette", "amiga.ilbm", "palette", [*metadata, ("colour-cycle-ranges", len(cycles))], palette=palette, cycles=cycles or None)]
    need(1 <= planes <= 8, "unsupported mode")
    rows = line_rows(own["BODY"], width, height, planes + (masking == 1), packing)
    pixels = plane_pixels(rows[:, :planes], width)
    if mode & 0x800 and planes >= 5:
        return [Node("/image", "amiga.ilbm", "raster", [*metadata, ("colour-cycle-ranges", 0)], raster=Raster(width, height, _rgba(held_colours(pixels, 4 if planes < 7 else 6, cmap))), palette=palette)]
    rgba = _indexed(pixels, shades(cmap, mode), transparent if masking == 2 else None)
    turning = bool(cycles) and int(pixels.max(initial=0)) < len(cmap)
    return [Node("/image", "amiga.ilbm", "raster", [*metadata, ("colour-cycle-ranges", len(cycles))], raster=Raster(width, height, rgba), palette=palette, index=pixels.astype(np.uint8).tobytes() if turning else None, cycles=cycles if turning else None)]


def line_rows(body: bytes, width: int, height: int, total: int, packing: int) -> np.ndarray:
    """(line, plane, byte) of interleaved lines; a packed line ends where its bytes do."""
    line, rows, at = (width + 15) // 16 * 2, [], 0
    for _ in range(height * total):
        if packing:
            row = bytearray()
            while len(row) < line:
                n = Reader(body).take(at, 1)[0]
                size = 2 if n > 128 else 1 if n == 128 else n + 2
                row += unpack_runs(Reader(body).take(at, size), 257 - n if n > 128 else n + 1) if n != 128 else b""
                at += size
            need(len(row) == line, "a run crosses a line")
        else:
            row = Reader(body).take(at, line)
            at += line
        rows.append(np.frombuffer(bytes(row), np.uint8))
    return np.stack(rows).reshape(height, total, line)


def plane_pixels(rows: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=2)[:, :, :width]
    return (bits.astype(int) << np.arange(rows.shape[1])[None, :, None]).sum(axis=1)


def shades(cmap: np.ndarray, mode: int) -> np.ndarray:
    """The colours, and in the half-bright mode their darker halves."""
    return np.concatenate([cmap, cmap // 2]) if mode & 0x80 and len(cmap) == 32 else cmap


def held_colours(pixels: np.ndarray, low: int, cmap: np.ndarray) -> np.ndarray:
    """Hold and modify: a pixel names a colour, or changes blue, red or green of the one on its left; lines begin with the first colour."""
    need(len(cmap) > 0, "no colours")
    value, what = pixels & (1 << low) - 1, pixels >> low
    need(int(value[what == 0].max(initial=0)) < len(cmap), "an index is outside of the palette")
    wide = (value << 8 - low | value >> max(0, 2 * low - 8)) if low < 8 else value
    out, held = np.zeros((*pixels.shape, 3), np.uint8), np.tile(cmap[0], (pixels.shape[0], 1))
    for x in range(pixels.shape[1]):
        held = np.where(what[:, x, None] == 0, cmap[np.where(what[:, x] == 0, value[:, x], 0)], held)
        for code, channel in ((1, 2), (2, 0), (3, 1)):
            held[:, channel] = np.where(what[:, x] == code, wide[:, x], held[:, channel])
        out[:, x] = held
    return out
