"""Structured drawings: paths, texts and groups in layers, what they look like, and as SVG."""

from __future__ import annotations

import math
import struct
from html import escape
from typing import NamedTuple

import numpy as np

from dustlens.sources.images import iff_chunks
from dustlens.sources.model import Node, Raster, Reader, need

#: Pixels of a preview's longer side, and straight pieces that a curve is drawn in.
PREVIEW, PIECES = 1024, 16

Point = tuple[float, float]
#: Commands of a path: ("M" or "L", point), ("C", two controls and a point) or ("Z",).
Command = tuple


class Element(NamedTuple):
    """kind: path, text, image or group."""

    kind: str
    layer: int
    visible: bool
    commands: list[Command] = []
    fill: tuple[int, int, int] | None = None
    stroke: tuple[int, int, int] | None = None
    width: float = 0.0
    dashes: tuple[float, ...] = ()
    text: str = ""
    place: tuple[float, ...] = ()
    children: list["Element"] = []


class Drawing(NamedTuple):
    bounds: tuple[float, float, float, float]  # left, top, right, bottom
    units: str
    layers: list[tuple[int, str, bool]]
    fonts: dict[int, str]
    elements: list[Element]


def _numbers(r: Reader, at: int, n: int) -> tuple[float, ...]:
    out = r.unpack(f">{n}f", at)
    need(all(map(math.isfinite, out)), "a coordinate is not finite")
    return out


def _path(data: bytes, closed: bool) -> list[Command]:
    """Points, of which a pair of all ones and flags is none: flag 2 begins another part, flag 1 says that the next four points are a curve."""
    r = Reader(data)
    (count,) = r.unpack(">H", 0)
    need(count > 0 and len(data) == 2 + 8 * count, "the points do not fill the chunk")
    out: list[Command] = []
    i, open_ = 0, False
    while i < count:
        mark, flags = r.unpack(">II", 2 + 8 * i)
        if mark != 0xFFFFFFFF:
            out.append(("L" if open_ else "M", _numbers(r, 2 + 8 * i, 2)))
            i, open_ = i + 1, True
            continue
        need(not flags & ~3, "unknown flags")
        if flags & 2:
            if closed and open_:
                out.append(("Z",))
            open_ = False
        i += 1
        if flags & 1:
            need(i + 4 <= count, "a curve ends early")
            a, b, c, d = (_numbers(r, 2 + 8 * (i + k), 2) for k in range(4))
            out += [("L" if open_ else "M", a), ("C", b, c, d)]
            i, open_ = i + 4, True
    if closed and open_:
        out.append(("Z",))
    need(bool(out), "a path without points")
    return out


def _forms(body: bytes) -> list[tuple[str, bytes]]:
    kind, own = iff_chunks(b"FORM" + struct.pack(">I", len(body)) + body)
    need(kind == "DR2D" and bool(own), "a part that is no drawing")
    return own


class _State(NamedTuple):
    """Attributes that hold for the objects after them."""

    fill_type: int = 0
    dash: int = 0
    fill: int = 0
    edge: int = 0
    layer: int = 0
    width: float = 0.0


def parse(data: bytes) -> Drawing:
    kind, chunks = iff_chunks(data)
    need(kind == "DR2D", "no drawing")
    bounds, units, colours = None, "Inch", []
    dashes: dict[int, tuple[float, ...]] = {}
    fonts: dict[int, str] = {}
    layers: list[tuple[int, str, bool]] = []
    patterns: set[int] = set()
    text = lambda raw: raw.split(b"\0")[0].decode("latin-1")
    for name, body in chunks:
        r = Reader(body)
        if name == "DRHD":
            need(bounds is None and len(body) == 16, "the header is not alone, or of another size")
            bounds = _numbers(r, 0, 4)
        elif name == "CMAP":
            need(len(body) % 3 == 0, "odd colours")
            colours += [tuple(body[i : i + 3]) for i in range(0, len(body), 3)]
        elif name == "DASH":
            number, count = r.unpack(">HH", 0)
            need(number > 0 and count % 2 == 0 and len(body) == 4 + 4 * count and number not in dashes, "odd dashes")
            dashes[number] = _numbers(r, 4, count)
            need(all(v > 0 for v in dashes[number]), "dashes without length")
        elif name == "FONS":
            need(len(body) >= 4 and body[1] == 0 and body[0] not in fonts, "odd font")
            fonts[body[0]] = text(body[4:])
        elif name == "LAYR":
            need(len(body) == 20 and body[19] == 0, "odd layer")
            layers.append((r.unpack(">H", 0)[0], text(body[2:18]), bool(body[18] & 2)))
        elif name == "PPRF":
            for part in body.split(b"\0"):
                if part.startswith(b"Units="):
                    units = text(part[6:])
        elif name == "FORM" and (own := _forms(body))[0][0] == "FILL":
            patterns.add(Reader(own[0][1]).unpack(">H", 0)[0])
    need(bounds is not None and bounds[0] != bounds[2] and bounds[1] != bounds[3], "no header, or an empty page")
    need(len({n for n, *_ in layers}) == len(layers), "a layer comes twice")
    shown = {n: visible for n, _, visible in layers}

    def colour(i: int) -> tuple[int, int, int]:
        need(i < len(colours), "a colour that is not there")
        return colours[i]

    def objects(parts: list[tuple[str, bytes]], state: _State, layer: int | None, depth: int) -> list[Element]:
        need(depth <= 64, "groups in groups without end")
        out: list[Element] = []
        for name, body in parts:
            r, own = Reader(body), state.layer if layer is None else layer
            seen = shown.get(own, True)
            if name == "ATTR":
                need(len(body) == 14 and body[0] <= 2 and body[1] <= 3, "odd attributes")
                fill, edge, on = r.unpack(">HHH", 4)
                state = _State(body[0], body[2], fill, edge, on, _numbers(r, 10, 1)[0])
                need(state.width >= 0, "a line of negative width")
            elif name in ("CPLY", "OPLY"):
                need(not state.dash or state.dash in dashes, "dashes that are not there")
                need(state.fill_type != 2 or name == "OPLY" or state.fill in patterns, "a pattern that is not there")
                stroke = colour(state.edge) if state.dash and state.width > 0 else None
                out.append(Element("path", own, seen, _path(body, name == "CPLY"), colour(state.fill) if name == "CPLY" and state.fill_type == 1 else None, stroke, state.width, tuple(d * state.width for d in dashes[state.dash]) if stroke else ()))
            elif name == "STXT":
                need(len(body) >= 24 and body[0] == 0 and len(body) == 24 + r.unpack(">H", 22)[0], "odd text")
                out.append(Element("text", own, seen, text=text(body[24:]), place=_numbers(r, 2, 5)))
            elif name == "TPTH":
                need(len(body) >= 14 and body[0] <= 3, "odd text")
                letters, points = r.unpack(">HH", 10)
                begin = 14 + letters + letters % 2
                need(len(body) == begin + 8 * points, "odd text")
                out.append(Element("text", own, seen, _path(struct.pack(">H", points) + body[begin:], False), text=text(body[14 : 14 + letters]), place=_numbers(r, 2, 2)))
            elif name == "VBM ":
                need(len(body) >= 22 and len(body) == 22 + r.unpack(">H", 20)[0], "odd picture")
                out.append(Element("image", own, seen, text=text(body[22:]), place=_numbers(r, 0, 5)))
            elif name == "FORM":
                inner = _forms(body)
                need(inner[0][0] in ("GRUP", "FILL") and len(inner[0][1]) == 2, "a part of no known kind")
                if inner[0][0] == "GRUP":
                    children = objects(inner[1:], state, own, depth + 1)
                    need(len(children) == Reader(inner[0][1]).unpack(">H", 0)[0], "a group has other objects than it says")
                    out.append(Element("group", own, seen, children=children))
        return out

    return Drawing(bounds, units, layers, fonts, objects(chunks, _State(), None, 0))


def counts(elements: list[Element]) -> dict[str, int]:
    """How many paths, texts, images and groups there are, those in groups included."""
    out = dict.fromkeys(("path", "text", "image", "group"), 0)
    for e in elements:
        out[e.kind] += 1
        for kind, n in counts(e.children).items():
            out[kind] += n
    return out


def flattened(commands: list[Command]) -> list[tuple[list[Point], bool]]:
    """The parts of a path as lines of points, and whether they are closed."""
    out: list[tuple[list[Point], bool]] = []
    now: list[Point] = []
    for command in commands:
        if command[0] == "M":
            if now:
                out.append((now, False))
            now = [command[1]]
        elif command[0] == "L":
            now.append(command[1])
        elif command[0] == "C":
            a, (b, c, d) = now[-1], command[1:]
            for k in range(1, PIECES + 1):
                t = k / PIECES
                u = 1 - t
                now.append(tuple(u**3 * a[i] + 3 * u * u * t * b[i] + 3 * u * t * t * c[i] + t**3 * d[i] for i in (0, 1)))
        else:
            out.append((now, True))
            now = []
    return [*out, (now, False)] if now else out


def _dashed(points: list[Point], dashes: tuple[float, ...]) -> list[tuple[Point, Point]]:
    """The drawn pieces of a line, dashes and gaps in turn."""
    pairs = list(zip(points, points[1:], strict=False))
    if not dashes:
        return pairs
    out, k, left = [], 0, dashes[0]
    for (x0, y0), (x1, y1) in pairs:
        length, done = math.hypot(x1 - x0, y1 - y0), 0.0
        need(length / min(dashes) < 1 << 16, "too many dashes")
        while done < length:
            step = min(left, length - done)
            if k % 2 == 0:
                out.append(tuple((x0 + (x1 - x0) * s / length, y0 + (y1 - y0) * s / length) for s in (done, done + step)))
            done, left = done + step, left - step
            if left <= 1e-12:
                k += 1
                left = dashes[k % len(dashes)]
    return out


def rendered(drawing: Drawing, size: int = PREVIEW) -> Raster:
    """The visible paths on white, fills by whether a pixel's middle lies inside (even and odd), lines as wide as they say, a pixel at least. Texts and pictures, whose fonts and files lie elsewhere, are left out.

    Paint is opaque, so paths are drawn from the last to the first, each where nothing is yet; a fill whose pixels all lie behind others is not looked at further.
    """
    left, top, right, bottom = drawing.bounds
    scale = size / max(abs(right - left), abs(bottom - top))
    width, height = max(1, round(abs(right - left) * scale)), max(1, round(abs(bottom - top) * scale))
    sx, sy = width / (right - left), height / (bottom - top)
    canvas, painted, drawn = np.full((height, width, 4), 255, np.uint8), np.zeros((height, width), bool), np.zeros((height, width), bool)
    whole = canvas.view(np.uint32)[..., 0]  # a number for each pixel
    at = lambda p: ((p[0] - left) * sx, (p[1] - top) * sy)

    def fill(parts: list[list[Point]], colour: tuple[int, int, int]) -> None:
        edges = np.array([(p, q) for own in parts for p, q in zip(own, own[1:] + own[:1], strict=True) if p[1] != q[1]])
        if not len(edges):
            return
        # Lines and columns of pixels whose middles may lie inside.
        y0, y1 = (max(0, min(height, math.ceil(v - 0.5))) for v in (edges[:, :, 1].min(), edges[:, :, 1].max()))
        x0, x1 = (max(0, min(width, math.ceil(v - 0.5))) for v in (edges[:, :, 0].min(), edges[:, :, 0].max()))
        behind = painted[y0:y1, x0:x1]
        if behind.all():
            return
        crossed = np.zeros((y1 - y0, x1 - x0 + 1), np.int32)  # at each pixel, the edges that its line of pixels crosses there
        for (ax, ay), (bx, by) in edges.tolist():
            rows = np.arange(max(y0, math.ceil(min(ay, by) - 0.5)), min(y1, math.ceil(max(ay, by) - 0.5)))
            columns = np.ceil(ax + (rows + 0.5 - ay) * (bx - ax) / (by - ay) - 0.5)
            crossed[rows - y0, np.clip(columns - x0, 0, x1 - x0).astype(int)] += 1
        inside = (np.cumsum(crossed, axis=1)[:, :-1] & 1 == 1) & ~behind
        whole[y0:y1, x0:x1][inside] = np.array([*colour, 255], np.uint8).view(np.uint32)[0]
        behind |= inside

    def line(a: Point, b: Point, wide: float) -> None:
        half = max(0.5, wide / 2)
        n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1])) * 2) + 1
        need(n < 1 << 20, "a line is too long")
        for t in np.linspace(0, 1, n + 1):
            x, y = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
            x0, x1, y0, y1 = (math.floor(v) for v in (x - half + 0.5, x + half + 0.5, y - half + 0.5, y + half + 0.5))
            drawn[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = True

    def draw(elements: list[Element]) -> None:
        for e in reversed(elements):
            if not e.visible:
                continue
            if e.kind == "path":
                parts = flattened(e.commands)
                if e.stroke:
                    for own, closed in parts:
                        for a, b in _dashed(own + own[:1] if closed else own, e.dashes):
                            line(at(a), at(b), e.width * (abs(sx) + abs(sy)) / 2)
                    around, points = max(0.5, e.width * (abs(sx) + abs(sy)) / 4) + 2, [at(p) for own, _ in parts for p in own]
                    (x0, y0), (x1, y1) = (tuple(max(0, min(most, f(p[k] for p in points) + pad)) for k, most in ((0, width), (1, height))) for f, pad in ((min, -around), (max, around)))
                    box = np.s_[int(y0) : math.ceil(y1), int(x0) : math.ceil(x1)]
                    fresh = drawn[box] & ~painted[box]
                    whole[box][fresh] = np.array([*e.stroke, 255], np.uint8).view(np.uint32)[0]
                    painted[box] |= fresh
                    drawn[box] = False
                if e.fill:
                    fill([[at(p) for p in own] for own, _ in parts], e.fill)
            draw(e.children)

    draw(drawing.elements)
    return Raster(width, height, canvas.tobytes())


def svg(drawing: Drawing) -> str:
    """All elements, in order; those of hidden layers are there but not displayed."""
    left, top, right, bottom = drawing.bounds
    number = lambda v: f"{v:.6g}"
    paint = lambda c: "none" if c is None else "#%02x%02x%02x" % c

    def one(e: Element) -> str:
        hidden = "" if e.visible else ' display="none"'
        way = " ".join(" ".join([c[0], *(number(v) for p in c[1:] for v in p)]) for c in e.commands)
        if e.kind == "group":
            return f"<g{hidden}>{''.join(map(one, e.children))}</g>"
        if e.kind == "path":
            dashes = f' stroke-dasharray="{" ".join(map(number, e.dashes))}"' if e.dashes else ""
            return f'<path{hidden} d="{way}" fill="{paint(e.fill)}" stroke="{paint(e.stroke)}" stroke-width="{number(e.width)}"{dashes}/>'
        if e.kind == "text":
            x, y = e.place[2:4] if len(e.place) == 5 else e.commands[0][1]
            return f'<text{hidden} x="{number(x)}" y="{number(y)}" font-size="{number(e.place[1])}">{escape(e.text)}</text>'
        x, y, w, h, _ = e.place
        return f'<image{hidden} x="{number(x)}" y="{number(y)}" width="{number(w)}" height="{number(h)}" href="{escape(e.text)}"/>'

    box = f"{number(min(left, right))} {number(min(top, bottom))} {number(abs(right - left))} {number(abs(bottom - top))}"
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{box}">{"".join(map(one, drawing.elements))}</svg>'


def dr2d(data: bytes, name: str) -> list[Node]:
    """A drawing: its preview as pixels, its elements as SVG."""
    drawing = parse(data)
    n = counts(drawing.elements)
    metadata = [("vector.units", drawing.units), *[(f"vector.bounds.{k}", v) for k, v in zip(("left", "top", "right", "bottom"), drawing.bounds, strict=True)], ("vector.layers", len(drawing.layers)), ("vector.fonts", len(drawing.fonts)), *[(f"vector.{k}s", v) for k, v in n.items()]]
    if n["text"] or n["image"]:
        metadata.append(("preview.warning", "texts and pictures are not drawn, as their fonts and files lie elsewhere"))
    return [Node("/drawing", "amiga.dr2d", "vector", metadata, raster=rendered(drawing), text=svg(drawing))]
