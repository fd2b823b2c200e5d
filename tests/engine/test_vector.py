"""Drawings: structure, preview and SVG."""

import struct
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from dustlens.plans.packers import form
from dustlens.sources import vector
from dustlens.sources.inspect import inspect_bytes

MARK = b"\xff\xff\xff\xff"
points = lambda *ps: struct.pack(">H", len(ps)) + b"".join(p if isinstance(p, bytes) else struct.pack(">2f", *p) for p in ps)
attributes = lambda fill_type, dash, fill, edge, layer, width: struct.pack(">BBBBHHHf", fill_type, 0, dash, 0, fill, edge, layer, width)
group = lambda n, *parts: form(b"DR2D", (b"GRUP", struct.pack(">H", n)), *parts)[8:]
SQUARE = points((1, 1), (5, 1), (5, 5), (1, 5))


def drawing(*parts, layers=((0, 2),)):
    head = [(b"DRHD", struct.pack(">4f", 0, 0, 8, 4)), (b"PPRF", b"Units=Cm\0"), (b"CMAP", bytes([255, 0, 0, 0, 0, 255])), (b"DASH", struct.pack(">HH", 1, 0)), (b"DASH", struct.pack(">HH2f", 2, 2, 4, 4))]
    return form(b"DR2D", *head, *[(b"LAYR", struct.pack(">H16sBB", n, b"layer", flags, 0)) for n, flags in layers], *parts)


def test_fills_lines_and_layers():
    data = drawing((b"ATTR", attributes(1, 0, 0, 0, 0, 0)), (b"CPLY", SQUARE), (b"ATTR", attributes(0, 1, 0, 1, 1, 1)), (b"OPLY", points((0, 0), (8, 4))), layers=((0, 2), (1, 0)))
    node = inspect_bytes(data, "a.dr2d")[0][0]
    pixels = np.frombuffer(node.raster.rgba, np.uint8).reshape(node.raster.height, node.raster.width, 4)
    assert (node.path, node.kind, node.raster.width, node.raster.height) == ("/drawing", "vector", 1024, 512)
    assert tuple(pixels[300, 300]) == (255, 0, 0, 255) and tuple(pixels[300, 800, :3]) == (255, 255, 255) and not (pixels[..., 2] > pixels[..., 0]).any()  # the line's layer is hidden
    assert dict(node.metadata)["vector.paths"] == 2 and dict(node.metadata)["vector.units"] == "Cm"
    tree = ET.fromstring(node.text)
    assert [(e.tag.split("}")[1], e.get("fill"), e.get("display")) for e in tree] == [("path", "#ff0000", None), ("path", "none", "none")]


def test_holes_curves_and_dashes():
    hole = points((0, 0), (8, 0), (8, 4), (0, 4), MARK + struct.pack(">I", 2), (2, 1), (6, 1), (6, 3), (2, 3))
    got = vector.rendered(vector.parse(drawing((b"ATTR", attributes(1, 0, 0, 0, 0, 0)), (b"CPLY", hole))), 64)
    pixels = np.frombuffer(got.rgba, np.uint8).reshape(32, 64, 4)
    assert tuple(pixels[16, 32, :3]) == (255, 255, 255) and tuple(pixels[2, 2, :3]) == (255, 0, 0)
    curve = vector.parse(drawing((b"OPLY", points(MARK + struct.pack(">I", 1), (0, 0), (0, 4), (8, 4), (8, 0))))).elements[0].commands
    assert [c[0] for c in curve] == ["M", "C"]
    line = vector.flattened(curve)[0][0]
    assert line[0] == (0, 0) and line[-1] == (8, 0) and line[8] == pytest.approx((4, 3))
    assert vector._dashed([(0, 0), (10, 0)], (2.0, 3.0)) == [((0, 0), (2, 0)), ((5, 0), (7, 0))]


def test_groups_texts_and_pictures():
    text = struct.pack(">BB5fH", 0, 3, 1, 2, 3, 4, 0, 5) + b"hello"
    picture = struct.pack(">5fH", 0, 0, 1, 1, 0, 4) + b"a/b\0"
    data = drawing((b"FONS", b"\3\0\1\1Sans\0"), (b"FORM", group(2, (b"STXT", text), (b"FORM", group(1, (b"VBM ", picture))))))
    parsed = vector.parse(data)
    assert vector.counts(parsed.elements) == {"path": 0, "text": 1, "image": 1, "group": 2} and parsed.fonts == {3: "Sans"}
    assert "hello" in vector.svg(parsed) and 'href="a/b"' in vector.svg(parsed)
    node = inspect_bytes(data, "a.dr2d")[0][0]
    assert "preview.warning" in dict(node.metadata)


@pytest.mark.parametrize("part", [(b"CPLY", b"\0\0"), (b"CPLY", points((float("nan"), 0))), (b"CPLY", points(MARK + struct.pack(">I", 4))), (b"FORM", group(2, (b"OPLY", SQUARE))), (b"ATTR", b"x"), (b"DRHD", bytes(16))])
def test_what_does_not_hold_is_refused(part):
    nodes, why = inspect_bytes(drawing(part), "a.dr2d")
    assert not [n for n in nodes if n.kind == "vector"] and (nodes or why)


def test_fills_behind_others_are_not_drawn_again(monkeypatch):
    square = lambda a, b, colour: vector.Element("path", 0, True, [("M", (a, a)), ("L", (b, a)), ("L", (b, b)), ("L", (a, b)), ("Z",)], colour)
    drawing = vector.Drawing((0, 0, 8, 8), "Inch", [], {}, [square(1, 5, (1, 2, 3)) for _ in range(50)] + [square(0, 4, (9, 9, 9)), square(1, 5, (4, 5, 6))])
    summed, cumsum = [], np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **k: summed.append(1) or cumsum(*a, **k))
    pixels = np.frombuffer(vector.rendered(drawing, 8).rgba, np.uint8).reshape(8, 8, 4)
    assert len(summed) == 2 and pixels[0, 0].tolist() == [9, 9, 9, 255] and pixels[3, 3].tolist() == [4, 5, 6, 255] and pixels[7, 7].tolist() == [255] * 4
