"""What lies in the lumps of a WAD beside raw data: sprites, wall textures and maps."""

from __future__ import annotations

import re
import struct

import numpy as np

from dustlens.sources.model import Node, Raster, Reader, need

#: Lumps that follow a map's marker (fixed values).
MAP_LUMPS = ("THINGS", "LINEDEFS", "SIDEDEFS", "VERTEXES", "SEGS", "SSECTORS", "NODES", "SECTORS", "REJECT", "BLOCKMAP", "BEHAVIOR")
#: The longer side of a drawn map, and the colours of one-sided and of two-sided lines.
MAP_PIXELS, MARGIN = 1024, 8
#: Colours of lines (fixed values).
ONE_SIDED, CEILING, FLOOR, SAME = (255, 0, 0), (255, 255, 0), (160, 80, 0), (128, 128, 128)

Lump = tuple[str, bytes]


def patch(body: bytes) -> tuple[np.ndarray, int, int]:
    """Palette indices (-1: nothing there), and the offsets, of a picture in columns of posts."""
    r = Reader(body)
    width, height, left, top = r.unpack("<HHhh", 0)
    need(0 < width <= 4096 and 0 < height <= 4096, "a picture of an odd size")
    out = np.full((height, width), -1, np.int16)
    for x, at in enumerate(r.unpack(f"<{width}I", 8)):
        while (y := r.take(at, 1)[0]) != 255:
            n = r.take(at + 1, 1)[0]
            need(y + n <= height, "a post leaves the picture")
            out[y : y + n, x] = np.frombuffer(r.take(at + 3, n), np.uint8)
            at += n + 4
    return out, left, top


def _raster(index: np.ndarray, colours: np.ndarray) -> Raster:
    rgba = np.zeros((*index.shape, 4), np.uint8)
    rgba[..., :3], rgba[..., 3] = colours[np.maximum(index, 0)], np.where(index < 0, 0, 255)
    rgba[index < 0] = 0
    return Raster(index.shape[1], index.shape[0], rgba.tobytes())


def _textures(lump: int, label: str, body: bytes, names: list[str], latest: dict[str, int], lumps: list[Lump], colours: np.ndarray) -> list[Node]:
    r, out, known = Reader(body), [], {}
    for i, at in enumerate(r.unpack(f"<{r.unpack('<I', 0)[0]}I", 4)):
        raw, masked, width, height, _, count = r.unpack("<8sIHHIH", at)
        need(0 < width <= 4096 and 0 < height <= 4096, "a texture of an odd size")
        wall, parts = np.full((height, width), -1, np.int16), []
        for p in range(count):
            x, y, which, step, shade = r.unpack("<hhHHH", at + 22 + 10 * p)
            need(which < len(names), "a patch has no name")
            place = latest.get(names[which].upper())
            parts += [(f"patch.{p}.origin-x", x), (f"patch.{p}.origin-y", y), (f"patch.{p}.pname-index", which), (f"patch.{p}.name", names[which]), (f"patch.{p}.lump-index", -1 if place is None else place)]
            if place is None:
                continue
            if place not in known:
                known[place] = patch(lumps[place][1])[0]
            own = known[place]
            x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + own.shape[1], width), min(y + own.shape[0], height)
            if x0 < x1 and y0 < y1:
                part, seen = wall[y0:y1, x0:x1], own[y0 - y : y1 - y, x0 - x : x1 - x]
                part[:] = np.where(seen < 0, part, seen)
        name = raw.split(b"\0")[0].decode("latin-1")
        metadata = [("texture.directory", label), ("texture.index", i), ("texture.name", name), ("texture.width", width), ("texture.height", height), ("texture.masked", masked), ("texture.patches", count), *parts]
        out.append(Node(f"/wad/textures/{lump}-{label}/{i}-{name}", "doom.texture", "raster", metadata, raster=_raster(wall, colours)))
    return out


def _line(canvas: np.ndarray, x: int, y: int, x1: int, y1: int, colour: tuple[int, int, int]) -> None:
    """A line of single pixels from one place to another, both included; the longer way goes by ones."""
    dx, dy = abs(x1 - x), -abs(y1 - y)
    sx, sy, rest = 1 if x < x1 else -1, 1 if y < y1 else -1, dx + dy
    while True:
        canvas[y, x, :3] = colour
        if (x, y) == (x1, y1):
            return
        twice = 2 * rest
        if twice >= dy:
            rest, x = rest + dy, x + sx
        if twice <= dx:
            rest, y = rest + dx, y + sy


def _map(marker: str, at: int, own: dict[str, bytes]) -> list[Node]:
    """The lines of a map, north up, with a margin. Lines with one side, or secret ones, are red; others tell by colour whether ceilings or floors differ; hidden lines are counted and not drawn."""
    points = np.frombuffer(own["VERTEXES"], "<i2").reshape(-1, 2).astype(int)
    wide = "BEHAVIOR" in own
    size = 16 if wide else 14
    need(len(own["LINEDEFS"]) % size == 0 and len(points) > 0, "odd records")
    records = [struct.unpack_from("<HHH6xHH" if wide else "<HHHHHHH", own["LINEDEFS"], i) for i in range(0, len(own["LINEDEFS"]), size)]
    lines = [(r[0], r[1], r[2], r[-2], r[-1]) for r in records]
    need(bool(lines) and all(a < len(points) and b < len(points) for a, b, *_ in lines), "no lines, or a line without an end")
    sides = [struct.unpack_from("<H", own.get("SIDEDEFS", b""), i + 28)[0] for i in range(0, len(own.get("SIDEDEFS", b"")) // 30 * 30, 30)]
    sectors = [struct.unpack_from("<hh", own.get("SECTORS", b""), i) for i in range(0, len(own.get("SECTORS", b"")) // 26 * 26, 26)]
    known = bool(sides) and bool(sectors)
    if known:
        need(all(s < len(sides) for *_, r, left in lines for s in (r, left) if s != 0xFFFF) and all(s < len(sectors) for s in sides), "a side or sector is missing")
    low, high = points.min(axis=0), points.max(axis=0)
    span = np.maximum(1, high - low)
    scale = min(1.0, *((MAP_PIXELS - 2 * MARGIN) / span))
    width, height = (np.floor(span * scale).astype(int) + 2 * MARGIN + 1).tolist()
    canvas = np.zeros((height, width, 4), np.uint8)
    canvas[..., 3] = 255
    for a, b, flags, right, left in lines:
        if flags & 128:
            continue
        colour = SAME
        if left == 0xFFFF or flags & 32:
            colour = ONE_SIDED
        elif known and right != 0xFFFF:
            (floor0, ceiling0), (floor1, ceiling1) = sectors[sides[right]], sectors[sides[left]]
            colour = CEILING if ceiling0 != ceiling1 else FLOOR if floor0 != floor1 else SAME
        (x0, y0), (x1, y1) = ((MARGIN + np.floor((points[k] - low) * scale).astype(int)).tolist() for k in (a, b))
        _line(canvas, x0, height - 1 - y0, x1, height - 1 - y1, colour)
    metadata = [("map.name", marker), ("map.marker-index", at), ("map.lumps", len(own)), ("map.bounds.minimum-x", low[0]), ("map.bounds.maximum-x", high[0]), ("map.bounds.minimum-y", low[1]), ("map.bounds.maximum-y", high[1]), ("map.hidden-linedefs", sum(f & 128 > 0 for _, _, f, *_ in lines))]
    path = f"/wad/maps/{at}-{marker}"
    return [Node(path, "doom.map", "group", metadata), Node(f"{path}/automap", "doom.automap", "raster", [("map.linedefs", len(lines))], raster=Raster(width, height, canvas.tobytes()))]


def scenery(lumps: list[Lump]) -> list[Node]:
    """Sprites between their markers, textures of named patches (the last lump of a name counts) and maps; what is damaged is a node that says so."""
    out: list[Node] = []
    colours = next((np.frombuffer(b[:768], np.uint8).reshape(256, 3) for n, b in lumps if n.upper() == "PLAYPAL" and len(b) >= 768 and len(b) % 768 == 0), None)
    latest = {name.upper(): i for i, (name, _) in enumerate(lumps)}
    groups: dict[str, list[Node]] = {"sprites": [], "textures": [], "maps": []}

    def attempt(group: str, path: str, make) -> None:
        try:
            groups[group] += make()
        except (ValueError, struct.error, KeyError) as e:
            groups[group].append(Node(path, "doom.damaged", "opaque", [("failure", str(e))], data=b""))

    inside = False
    for i, (name, body) in enumerate(lumps):
        inside = name.upper() in ("S_START", "SS_START") or inside and name.upper() not in ("S_END", "SS_END")
        if inside and body and colours is not None:
            def sprite(body=body, i=i, name=name):
                pixels, left, top = patch(body)
                return [Node(f"/wad/sprites/{i}-{name}", "doom.sprite", "raster", [("wad.index", i), ("position.left-offset", left), ("position.top-offset", top)], raster=_raster(pixels, colours))]

            attempt("sprites", f"/wad/sprites/{i}-{name}", sprite)
        elif re.fullmatch(r"E[1-9]M[1-9]|MAP[0-9][0-9]", name):
            own = {}
            for label, part in lumps[i + 1 : i + 1 + len(MAP_LUMPS)]:
                if label not in MAP_LUMPS or label in own:
                    break
                own[label] = part
            if own:
                attempt("maps", f"/wad/maps/{i}-{name}", lambda own=own, i=i, name=name: _map(name, i, own))
    if colours is not None and "PNAMES" in latest:
        def names() -> list[str]:
            r = Reader(lumps[latest["PNAMES"]][1])
            return [r.take(4 + 8 * i, 8).split(b"\0")[0].decode("latin-1") for i in range(r.unpack("<I", 0)[0])]

        for label in ("TEXTURE1", "TEXTURE2"):
            if label in latest:
                attempt("textures", f"/wad/textures/{latest[label]}-{label}", lambda label=label: [Node(f"/wad/textures/{latest[label]}-{label}", "doom.texture-directory", "group", [("wad.index", latest[label])]), *_textures(latest[label], label, lumps[latest[label]][1], names(), latest, lumps, colours)])
    for group, nodes in groups.items():
        if nodes:
            out += [Node(f"/wad/{group}", "folder", "group", []), *nodes]
    return out
