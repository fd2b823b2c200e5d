"""Games in maps and volumes, their codecs and ciphers."""

import random
import struct

import pytest

from dustlens.sources import packages

rng = random.Random(4)


def table(spark, *rows):
    return spark.createDataFrame([(c, p, bytearray(d)) for c, p, d in rows], "collection string, rel_path string, content binary")


def agi2(root, payloads):
    """A game of the early kind: logics only, in volume 1."""
    volume, listing = b"", b""
    for body in payloads:
        listing += (b"\xff\xff\xff" if body is None else (1 << 20 | len(volume)).to_bytes(3, "big"))
        if body is not None:
            volume += b"\x12\x34\1" + struct.pack("<H", len(body)) + body
    return [(f"{root}LogDir", listing), (f"{root}PICDIR", b""), (f"{root}VIEWDIR", b""), (f"{root}SNDDIR", b"\xff" * 6), (f"{root}vol.1", volume)]


def test_early_game(spark):
    files = table(spark, *[("c", p, d) for p, d in agi2("g/", [b"first", None, b"third"])], ("c", "g/readme", b"x"))
    found = {r["number"]: r for r in packages.unpacked(packages.resources(files)).collect()}
    assert {n: bytes(r["data"]) for n, r in found.items()} == {0: b"first", 2: b"third"} and {r["kind"] for r in found.values()} == {"logic"}
    got = packages.discover(files).collect()
    assert [(r["collection"], len(r["packages"]), r["problem"]) for r in got] == [("c", 1, None)]


def test_several_packages_and_missing_volumes(spark):
    files = table(spark, *[("two", p, d) for g in ("a/", "b/") for p, d in agi2(g, [b"x"])], *[("none", p, d) for p, d in agi2("", [b"x"])[:-1]], *[("both", p, d) for p, d in agi2("", [b"x"])], ("both", "VOL.1", b"again"))
    got = {r["collection"]: r["problem"] for r in packages.discover(files).collect()}
    assert got == {"two": "more than one game package is available; select one"}
    warnings = {r["collection"]: r["warning"] for r in packages.inspect_entries(packages.entries(files), files).collect()}
    assert warnings["none"] == warnings["both"] == "missing or ambiguous volume file" and warnings["two"] is None


def lzw_codes(codes, top):
    """Codes in growing widths, lowest bit first."""
    value = at = 0
    for code, width in codes:
        value |= code << at
        at += width
    return value.to_bytes((at + 7) // 8, "little")


def agi_pack(data):
    words, out, width, last = {bytes([i]): i for i in range(256)}, [(256, 9)], 9, b""
    count = 258
    for b in data:
        if last + bytes([b]) in words:
            last += bytes([b])
            continue
        out.append((words[last], width))
        if count < 2048:
            words[last + bytes([b])] = count
            count += 1
        # The reader's table is one entry behind the writer's.
        if count - 1 == 1 << width and width < 11:
            width += 1
        last = bytes([b])
    out.append((words[last], width))
    return lzw_codes(out, 11)


@pytest.mark.parametrize("size", [1, 10, 300, 5000])
def test_codes_of_the_early_games(size):
    data = bytes(rng.choice(b"abcde") for _ in range(size))
    assert packages.agi_lzw(agi_pack(data), size) == data
    with pytest.raises(ValueError):
        packages.agi_lzw(agi_pack(data), size + 1000)


def test_later_game_with_one_map(spark):
    body, picture = b"hello hello hello hello", bytes([0xF0, 5, 1, 2, 0xF2, 7])
    packed = agi_pack(body)
    bits = "".join(f"{b:08b}" for b in (0xF0,)) + "0101" + f"{1:08b}{2:08b}" + f"{0xF2:08b}" + "0111"
    thin = int(bits.ljust(48, "0"), 2).to_bytes(6, "big")
    volume = b"\x12\x34\0" + struct.pack("<HH", len(body), len(packed)) + packed
    at = len(volume)
    volume += b"\x12\x34\x80" + struct.pack("<HH", len(picture), len(thin)) + thin
    listing = struct.pack("<4H", 8, 11, 14, 14) + (0).to_bytes(3, "big") + at.to_bytes(3, "big")
    files = table(spark, ("c", "KQDIR", listing), ("c", "kqvol.0", volume))
    got = {r["kind"]: (r["generation"], bytes(r["data"]), r["failure"]) for r in packages.unpacked(packages.resources(files)).collect()}
    assert got == {"logic": ("v3", body, None), "picture": ("v3", picture, None)}


def sci_pack(data):
    """Codes of single bytes and, where the last two bytes come again, of the stretch that the reader has there."""
    out, places, width, pos = [(256, 9)], [], 9, 0
    while pos < len(data):
        best, size = None, 1
        for i, (at, n) in enumerate(places):
            if pos + n + 1 <= len(data) and data[at : at + n + 1] == data[pos : pos + n + 1] and at + n < pos + n + 1 and at + n + 1 <= pos + 1 and n + 1 > size:
                best, size = i, n + 1
        out.append((258 + best, width) if best is not None else (data[pos], width))
        last = (1 << width) - 1
        if 258 + len(places) > last and width < 12:
            width += 1
            last = (1 << width) - 1
        if 258 + len(places) <= last:
            places.append((pos, size))
        pos += size
    return lzw_codes(out, 12)


@pytest.mark.parametrize("size", [1, 40, 2500])
def test_codes_of_the_later_games(size):
    data = bytes(rng.choice(b"abc") for _ in range(size))
    packed = sci_pack(data)
    assert packages.sci_lzw(packed, size) == data and (size < 100 or len(packed) < size)


def test_tree_codes():
    # Left: 'a'. Right: left 'b', right: eight plain bits.
    tree = bytes([3, 0xEE, 0, 0x12, ord("a"), 0, 0, 0x10, ord("b"), 0])
    tree = bytes([4, 0xEE]) + bytes([0, 0x12, ord("a"), 0, 0, 0x10, ord("b"), 0])
    bits = "0" + "10" + "11" + f"{ord('z'):08b}" + "0" + "11" + f"{0xEE:08b}"
    data = tree + int(bits.ljust(24, "0"), 2).to_bytes(3, "big")
    assert packages.sci_huffman(data, 4) == b"abza"
    with pytest.raises(ValueError):
        packages.sci_huffman(data, 5)


def test_generations_of_maps(spark):
    body, stored = b"text text text", sci_pack(b"text text text")
    head = lambda kind, n, packed, method, size=14: struct.pack("<HHHH", kind << 11 | n, len(packed) + 4, size, method) + packed
    early = head(3, 7, body, 0) + head(2, 9, stored, 1)
    listing = struct.pack("<HI", 3 << 11 | 7, 1 << 26 | 0) + struct.pack("<HI", 2 << 11 | 9, 1 << 26 | 22) + b"\xff" * 6
    late = b"\x83" + struct.pack("<HHHH", 7, 14, 14, 0) + body + b"\0"
    late_map = struct.pack("<BHBH", 0x83, 6, 0xFF, 11) + struct.pack("<H", 7) + b"\0\0\0"
    files = table(spark, ("early", "x/resource.map", listing), ("early", "x/RESOURCE.001", early), ("late", "RESOURCE.MAP", late_map), ("late", "RESOURCE.000", late), ("bad", "RESOURCE.MAP", b"\xff" * 7))
    got = {(r["collection"], r["kind"], r["number"]): (r["generation"], bytes(r["data"]), r["failure"]) for r in packages.unpacked(packages.resources(files)).collect()}
    assert got == {("early", "text", 7): ("sci0", body, None), ("early", "script", 9): ("sci0", body, None), ("late", "text", 7): ("sci1.1", body, None)}


def test_words_and_things():
    turned = lambda word: bytes([*(ord(c) ^ 0x7F for c in word[:-1]), (ord(word[-1]) ^ 0x7F) | 0x80])
    data = bytes(52) + b"\0" + turned("look") + b"\0\5" + b"\3" + turned("p") + b"\0\2" + b"\0"
    assert packages.vocabulary(data) == [(2, "loop"), (5, "look")]
    names = b"key\0lamp\0"
    plain = struct.pack("<HB", 6, 0) + struct.pack("<HB", 6, 255) + struct.pack("<HB", 10, 3) + names
    assert packages.inventory(plain) == packages.inventory(packages.mixed(plain, b"Avis Durgan")) == [(0, 255, "key"), (1, 3, "lamp")]
    assert packages.mixed(packages.mixed(b"text", b"Alex Simkin"), b"Alex Simkin") == b"text"
    with pytest.raises(ValueError):
        packages.inventory(b"\5\0\0")
