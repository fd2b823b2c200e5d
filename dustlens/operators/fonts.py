"""Text set in bitmap fonts: which glyphs stand where, and the picture of it."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from dustlens.sources.model import need

#: A sentence with all letters.
SENTENCE = "The quick brown fox jumps over the lazy dog. 0123456789"


class Glyph(NamedTuple):
    """A stretch of the font's strip, how far it stands from the pen, and how far the pen moves."""

    x: int
    y: int
    width: int
    height: int
    left: int
    top: int
    advance: int


class Font(NamedTuple):
    """Glyphs by character, the height of a line, and the strip that holds them (rows of RGBA)."""

    glyphs: dict[int, Glyph]
    line: int
    strip: np.ndarray
    missing: int = 0  # the character that stands for those without a glyph; 0 if there is none
    kerning: dict[tuple[int, int], int] = {}
    ligatures: dict[tuple[int, ...], int] = {}  # characters to the one whose glyph stands for all of them


def font_of(row: dict) -> Font:
    """A font resource's glyphs: fields of four (place, width, advance, kerning), three (offset, height, width) or eight (a rectangle, offsets, advance, page)."""
    own = {m["key"]: m["value"] for m in row["metadata"]}
    need(row["rgba"] is not None, "a font without a strip")
    strip = np.frombuffer(row["rgba"], np.uint8).reshape(row["height"], row["width"], 4)
    glyphs, place = {}, 0
    for key, value in own.items():
        if not key.startswith("glyph."):
            continue
        name, fields = key[6:], [int(x) for x in value.split(",")]
        code = int(name) if name.isdigit() else -1
        if len(fields) == 4:
            glyphs[code] = Glyph(fields[0], 0, fields[1], row["height"], fields[3], 0, fields[2] + fields[3])
        elif len(fields) == 8:
            x, y, w, h, left, top, advance, _ = fields
            glyphs[code] = Glyph(x, y, w, h, left, top, advance)
        else:
            left, _, width = fields[:3]
            glyphs[code] = Glyph(16 * place, 0, width, row["height"], -left, 0, width - left + int(own.get("tracking", 0)))
            place += 1
    return Font({c: g for c, g in glyphs.items() if c >= 0}, int(own.get("line-height", row["height"])), strip)


def shaped(font: Font, text: str) -> list[tuple[int, int]]:
    """(character, place of the pen before it) of each glyph: the longest ligature that fits, else the character's own glyph, else that of missing ones; -1 for a line's end, nothing for what has no glyph."""
    codes, out, i, pen, last = [ord(c) for c in text], [], 0, 0, None
    while i < len(codes):
        if codes[i] == 10:
            out.append((-1, pen))
            i, pen, last = i + 1, 0, None
            continue
        fit = max((k for k in font.ligatures if tuple(codes[i : i + len(k)]) == k), key=len, default=None)
        code = font.ligatures[fit] if fit else codes[i] if codes[i] in font.glyphs else font.missing
        i += len(fit) if fit else 1
        if code in font.glyphs:
            pen += font.kerning.get((last, code), 0)
            out.append((code, pen))
            pen, last = pen + font.glyphs[code].advance, code
    return out


def preview_text(font: Font) -> str:
    """A sentence if the font has its letters, else the characters that it has, sixteen to a line."""
    if all(ord(c) in font.glyphs or c == " " for c in SENTENCE[:43]):
        return SENTENCE
    every = [chr(c) for c in sorted(font.glyphs) if c > 32]
    return "\n".join("".join(every[i : i + 16]) for i in range(0, len(every), 16))


def rendered(font: Font, text: str, most_width: int = 800) -> np.ndarray:
    """Rows of RGBA of a text; lines that are too wide are broken between glyphs."""
    lines: list[list[tuple[int, int]]] = [[]]
    base = 0
    for code, pen in shaped(font, text):
        if code < 0:
            lines.append([])
            base = 0
            continue
        g = font.glyphs[code]
        if lines[-1] and pen - base + g.left + g.width > most_width:
            lines.append([])
            base = pen
        lines[-1].append((code, pen - base))
    width = max([1, *(p + font.glyphs[c].left + font.glyphs[c].width for own in lines for c, p in own), *(p + font.glyphs[c].advance for own in lines for c, p in own)])
    out = np.zeros((max(1, len(lines)) * font.line, min(width, most_width + 256), 4), np.uint8)
    for i, own in enumerate(lines):
        for code, pen in own:
            g = font.glyphs[code]
            x, y = pen + g.left, i * font.line + g.top
            part = font.strip[g.y : g.y + g.height, g.x : g.x + g.width]
            x0, y0 = max(0, x), max(0, y)
            x1, y1 = min(out.shape[1], x + part.shape[1]), min(out.shape[0], y + part.shape[0])
            if x0 < x1 and y0 < y1:
                seen = part[y0 - y : y1 - y, x0 - x : x1 - x]
                out[y0:y1, x0:x1] = np.where(seen[..., 3:] > 0, seen, out[y0:y1, x0:x1])
    return out


def glyph_grid(font: Font, columns: int = 16) -> np.ndarray:
    """Rows of RGBA with all glyphs by character, in cells of one size."""
    codes = sorted(font.glyphs)
    wide = max([1, *(font.glyphs[c].width for c in codes)]) + 2
    out = np.zeros((-(-max(1, len(codes)) // columns) * (font.line + 2), columns * wide, 4), np.uint8)
    for i, code in enumerate(codes):
        g = font.glyphs[code]
        part = font.strip[g.y : g.y + g.height, g.x : g.x + g.width][: font.line]
        y, x = i // columns * (font.line + 2) + 1, i % columns * wide + 1
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out
