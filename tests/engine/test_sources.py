"""Parsers on files that the tests build, and on hostile ones."""

import io
import json
import random
import sqlite3
import struct
import wave
import zipfile
import zlib

import numpy as np
import pytest

from dustlens.operators.detection import PROBES, Probe, candidates_of, ordered
from dustlens.plans import packers
from dustlens.sources import codecs, export
from dustlens.sources.images import unpack_bitmap_runs
from dustlens.sources import inspect as scan
from dustlens.sources.inspect import PARSERS, UNREAD, detect_bytes, inspect_bytes
from dustlens.sources.model import Node
from dustlens.sources.model import Raster, safe_name

rng = random.Random(1)
RGBA = bytes(rng.randrange(256) for _ in range(7 * 5 * 4))
HOSTILE = [b"", b"\0", b"\xff", b"-lh5-", bytes(range(256)), b"\0\xff" * 2048, b"FORM" + b"\0" * 20, b"PK\5\6" + b"\0" * 18, b"SQLite format 3\0" + b"\0" * 600]


@pytest.mark.parametrize("type_id", sorted(PARSERS))
def test_hostile_data_is_refused_or_read(type_id):
    for data in HOSTILE + [bytes(rng.randrange(256) for _ in range(n)) for n in (3, 50, 900, 6911, 6913, 10002)]:
        nodes, failure = inspect_bytes(data, "x.bin", type_id)
        assert bool(nodes) != bool(failure)


def test_truncated_files_are_refused_or_read():
    whole = export.png(7, 5, RGBA)
    for n in range(len(whole)):
        assert inspect_bytes(whole[:n], "x.png", "png")[0] == []


def raster(data, name="x"):
    nodes, failure = inspect_bytes(data, name)
    assert not failure, failure
    return next(n.raster for n in nodes if n.raster)


def test_png_of_own_and_of_filters():
    assert raster(export.png(7, 5, RGBA)) == Raster(7, 5, RGBA)
    rows = [RGBA[i : i + 28] for i in range(0, 140, 28)]
    out, before = b"", bytes(28)
    for kind, row in enumerate(rows):
        own = bytearray()
        for i, v in enumerate(row):
            a, b, c = row[i - 4] if i > 3 else 0, before[i], before[i - 4] if i > 3 else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            own.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        out, before = out + bytes([kind]) + own, row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")
    assert raster(data).rgba == RGBA


def test_gif_with_lzw():
    pixels = bytes(rng.randrange(4) for _ in range(35))
    colours = bytes(range(12))
    packed = codecs.lzw_encode(pixels, 2)
    data = struct.pack("<6sHHBBB", b"GIF89a", 7, 5, 0x81, 0, 0) + colours + struct.pack("<BHHHHB", 0x2C, 0, 0, 7, 5, 0) + b"\2" + bytes([len(packed)]) + packed + b"\0;"
    assert raster(data).rgba == b"".join(colours[3 * p : 3 * p + 3] + b"\xff" for p in pixels)


def test_pcx_and_tga_runs():
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, 5, 0, 72, 72) + bytes(48) + struct.pack("<BBH", 0, 1, 6) + bytes(60)
    palette = bytes(range(256)) * 3
    got = raster(head[:128] + bytes([0xC4, 9, 1, 2]) + b"\x0c" + palette)
    assert got.rgba[::4] == bytes(palette[3 * i] for i in (9, 9, 9, 9, 1, 2))
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 3, 1, 24, 32) + b"\x82\1\2\3"
    assert raster(tga, "x.tga").rgba == b"\3\2\1\xff" * 3


def test_screen_and_koala():
    screen = bytes([0x80]) + bytes(6143) + bytes([2]) + bytes(767)
    assert raster(screen).rgba[:8] == bytes([215, 0, 0, 255, 0, 0, 0, 255])
    assert [n.path for n in inspect_bytes(bytes(27) + screen + bytes(49179 - 27 - 6912), "x.sna")[0]] == ["/", "/screen"]
    koala = b"\0\x60" + b"\xe4" + bytes(7999) + bytes([0x25]) + bytes(999) + bytes([7]) + bytes(999) + b"\1"
    from dustlens.sources.images import C64

    assert raster(koala).rgba[:16:4] == bytes(int(C64[i][0]) for i in (7, 5, 2, 1))


def test_ilbm_rows():
    row = bytes([0b10100000, 0])
    body = (codecs.pack_runs(row) + codecs.pack_runs(bytes(2))) * 2
    chunks = b"BMHD" + struct.pack(">IHHhhBBBBHBBhh", 20, 3, 2, 0, 0, 2, 0, 1, 0, 0, 1, 1, 3, 2) + b"CMAP" + struct.pack(">I", 12) + bytes(range(12)) + b"BODY" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) & 1)
    form = b"FORM" + struct.pack(">I", len(chunks) + 4) + b"ILBM" + chunks
    assert raster(form).rgba == b"\3\4\5\xff\0\1\2\xff\3\4\5\xff" * 2


def test_sounds():
    values = [[rng.randrange(-128, 128) for _ in range(9)] for _ in range(2)]
    audio = inspect_bytes(export.wav(8000, 8, values), "x.wav")[0][0].audio
    assert (audio.rate, audio.bits, audio.channels) == (8000, 8, values)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(44100), w.writeframes(struct.pack("<4h", 1, -2, 32767, -32768))
    assert inspect_bytes(out.getvalue(), "x.wav")[0][0].audio.channels == [[1, -2, 32767, -32768]]
    vhdr = struct.pack(">IIIHBBI", 4, 0, 0, 8000, 1, 1, 65536)
    body = bytes([0, 5, 0x89, 0x70])
    chunks = b"VHDR" + struct.pack(">I", 20) + vhdr + b"BODY" + struct.pack(">I", 4) + body
    assert inspect_bytes(b"FORM" + struct.pack(">I", len(chunks) + 4) + b"8SVX" + chunks, "x")[0][0].audio.channels == [[5, 6, 5, -29]]


def test_database_with_inner_pages_and_overflow():
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY, b TEXT, c REAL, d BLOB, e INT)")
    rows = [(i, f"t\t{i}\n" * (1 if i % 50 else 3000), i + 0.25, bytes([i % 256]), -i * 10**9) for i in range(1, 600)]
    db.executemany("INSERT INTO t VALUES (?,?,?,?,?)", rows)
    db.commit()
    nodes = {n.path: n for n in inspect_bytes(db.serialize(), "x.db")[0]}
    lines = nodes["/table/t/rows"].text.split("\n")
    want = ["\t".join([str(i), "NULL", b.replace("\t", "\\t").replace("\n", "\\n"), str(c), f"x'{d.hex()}'", str(e)]) for i, b, c, d, e in rows]
    assert lines == want and nodes["/table/t/schema"].text.startswith("CREATE TABLE t")
    bad = bytearray(db.serialize())
    bad[28:32] = b"\0\0\0\1"
    assert inspect_bytes(bytes(bad), "x.db")[0] == []


def test_zip_isolates_a_bad_member_and_refuses_unsafe_names():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/one.txt", "first")
        z.writestr("a/two.txt", "second" * 50, zipfile.ZIP_DEFLATED)
    data = out.getvalue().replace(b"first", b"fIrst")
    nodes = {n.path: n for n in inspect_bytes(data, "x.zip")[0]}
    assert dict(nodes["/archive/a/one.txt"].metadata)["failure"] and nodes["/archive/a/two.txt"].data == b"second" * 50
    assert nodes["/archive/a"].kind == "group"
    for name in ("/x", "../x", "a/./b", "", "c:/x", "a//b"):
        with pytest.raises(ValueError):
            safe_name(name)


def test_other_containers():
    manifest = json.dumps({"files": {"d": {"files": {"x": {"size": 3, "offset": "2"}}}, "y": {"size": 2, "offset": "0"}}}).encode()
    padded = manifest + b"\0" * (-len(manifest) % 4)
    asar = struct.pack("<IIII", 4, len(padded) + 8, len(padded) + 4, len(manifest)) + padded + b"hiyou"
    assert {n.path: n.data for n in inspect_bytes(asar, "x.asar")[0] if n.data} == {"/archive/d/x": b"you", "/archive/y": b"hi"}

    def block(body):
        x = 0
        for b in body:
            x ^= b
        return struct.pack("<H", len(body) + 1) + body + bytes([x])

    tape = block(b"\0" + struct.pack("<B10sHHH", 3, b"code      ", 4, 32768, 32768)) + block(b"\xffabcd")
    nodes = inspect_bytes(tape, "x.tap")[0]
    assert nodes[1].data == b"abcd" and dict(nodes[1].metadata)["code.start-address"] == 32768
    tzx = b"ZXTape!\x1a\1\x14" + b"".join(b"\x10\0\0" + b for b in (tape[:21], tape[21:]))
    assert inspect_bytes(tzx, "x.tzx")[0][1].data == b"abcd"
    bank = struct.pack(">4sHHI8s", b"AmBk", 1, 0, 8 + 4, b"Data    ") + b"abcd"
    assert inspect_bytes(bank, "x.abk")[0][0].data == b"abcd"
    assert [n.path for n in inspect_bytes(b"AmBs\0\2" + bank * 2, "x.abk")[0]] == ["/banks", "/banks/0", "/banks/1"]
    module = b"song".ljust(20, b"\0") + b"".join(struct.pack(">22sHBBHH", b"s", 2 if i == 0 else 0, 0, 64, 0, 1) for i in range(31)) + bytes([1, 127]) + bytes(128) + b"M.K." + bytes(1024) + b"\1\2\xff\0"
    nodes = inspect_bytes(module, "x.mod")[0]
    assert nodes[-1].audio.channels == [[1, 2, -1, 0]] and nodes[1].kind == "tracker"


def test_fat_volume():
    table = bytearray(512)
    table[:3] = b"\xf0\xff\xff"
    table[3:6] = bytes([0xFF, 0x0F, 0])
    boot = bytearray(512)
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 2, 16, 40, 0xF0, 1)
    boot[510:] = b"\x55\xaa"
    entry = b"HELLO   TXT" + bytes(15) + struct.pack("<HI", 2, 5)
    volume = bytes(boot) + bytes(table) * 2 + entry.ljust(512, b"\0") + b"howdy".ljust(512, b"\0")
    volume = volume.ljust(40 * 512, b"\0")
    assert {n.path: n.data for n in inspect_bytes(volume, "x.img")[0] if n.data} == {"/disk/HELLO.TXT": b"howdy"}
    assert inspect_bytes(volume[:-1], "x.img")[0] == []


def test_palettes():
    act = bytes(range(256)) * 3
    assert inspect_bytes(act, "x.act")[0][0].palette[1] == (3, 4, 5, 255)
    assert inspect_bytes(b"GIMP Palette\nName: x\nColumns: 2\n#\n 1 2 3 red\n", "x.gpl")[0][0].palette == [(1, 2, 3, 255)]
    assert inspect_bytes(b"; paint.net Palette File\n; note\nFF010203\n", "x.txt")[0][0].palette == [(1, 2, 3, 255)]
    assert inspect_bytes(bytes([0xE0]) * 256, "x.npl")[0][0].palette[0] == (255, 0, 0, 255)
    swatch = struct.pack(">4sHHI", b"ASEF", 1, 0, 1) + struct.pack(">HIH", 1, 22, 1) + b"\0\0" + b"RGB " + struct.pack(">fffH", 1, 0, 0.5, 0)
    assert inspect_bytes(swatch, "x.ase")[0][0].palette == [(255, 0, 128, 255)]
    assert inspect_bytes(b"JASC-PAL\r\n0100\r\n2\r\n1 2 3\r\n", "x.pal")[0] == []


def test_powerpacker_literals():
    # Four literal bytes: bits are read from the end, the first flag 0, a count of 3 + 0, then the bytes backwards.
    bits = "0" + "11" + "00" + "".join(f"{b:08b}" for b in b"dcba")
    bits += "0" * (-len(bits) % 32)
    stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))[::-1]
    data = b"PP20" + bytes([9, 10, 12, 13]) + stream + b"\0\0\4" + b"\0"
    assert inspect_bytes(data, "x.pp")[0][0].data == b"abcd"


def test_codecs_refuse_bad_data():
    for call in (lambda: codecs.inflate(b"\xff\xff"), lambda: codecs.unpack_runs(b"\5a", 6), lambda: codecs.lzw_decode(b"\xff\xff", 8), lambda: codecs.unlzma(b"nonsense!")):
        with pytest.raises(ValueError):
            call()
    assert codecs.unfilter_sub(bytes([1, 2, 3, 4]), 1) == bytes([1, 3, 6, 10])


def test_order_of_candidates():
    types = lambda data, name: [p.type_id for p, _ in candidates_of(data, name)]
    assert types(b"PK\x03\x04" + bytes(26) + b"mimetypeimage/openraster", "x.ora")[:2] == ["image.openraster", "archive.zip"]
    assert types(b"%PDF-1.4", "x.act") == ["adobe.pdf"]
    assert {p.type_id for p in PROBES} - UNREAD <= set(PARSERS) and len({p.type_id for p in PROBES}) == 71
    derivations = dict((p.type_id, d) for p, d in ordered())
    assert derivations["image.openraster"] == ("archive.zip", "image.openraster")


def test_discs_have_a_budget(monkeypatch):
    disc = lambda *sizes: [Node("/disc", "filesystem.iso9660", "group", []), *[Node(f"/disc/{i}", "file", "opaque", [], data=bytes(n)) for i, n in enumerate(sizes)]]
    monkeypatch.setattr(scan, "DISC_FILE_BYTES", 10)
    monkeypatch.setattr(scan, "DISC_BYTES", 16)
    assert scan.looked_into(disc(8, 11, 9, 8, 0)) == [False, True, False, False, True, False]
    monkeypatch.setattr(scan, "DISC_FILES", 2)
    assert not any(scan.looked_into(disc(1, 1, 1))) and any(scan.looked_into(disc(1, 1)))
    assert scan.looked_into([n._replace(type_id="archive.zip") for n in disc(99)])[1]


def test_refiners_nest_and_do_not_repeat():
    chain = (Probe("a", "a", "^x"), Probe("b", "b", "^x", carrier="a"), Probe("c", "c", "^x", carrier="b"), Probe("a", "again", "^x", carrier="c"))
    assert [(p.type_id, d) for p, d in ordered(chain)] == [("c", ("a", "b", "c")), ("b", ("a", "b")), ("a", ("a",))]


def test_whatever_a_parser_raises_stays_with_its_source():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "image/openraster")
        z.writestr("stack.xml", "<image><broken")
    nodes, failure = inspect_bytes(out.getvalue(), "x.ora")
    assert nodes[0].type_id == "archive.zip" and failure is None  # the archive still holds
    nodes, failure = inspect_bytes(out.getvalue(), "x.ora", "image.openraster")
    assert nodes == [] and "image.openraster" in failure
    with pytest.raises(ValueError):
        inspect_bytes(b"", "x", "no.such-type")


@pytest.mark.parametrize("data", [b"", b"\0", b"\xff", b"-lh5-", bytes(range(256)), b"\0\xff" * 2048, b"GIF89a", b"PK\3\4", b"BM" + bytes(60), b"FORM\0\0\0\4ILBM", b"\x7fELF" + bytes(60)])
def test_hostile_bytes(data):
    assert detect_bytes(data, "x.pal") == detect_bytes(data, "x.pal")
    assert all(nodes == [] or why is None for _, _, nodes, why in detect_bytes(data, "x"))


@pytest.mark.parametrize("size", [6911, 6913, 7679, 7681, 49178, 49180, 131102, 131104, 147486, 147488])
def test_sizes_next_to_the_right_ones(size):
    assert not {p.type_id for p, _, nodes, _ in detect_bytes(bytes(size), "x.scr") if nodes} & {"zx-spectrum.screen", "zx-spectrum.gigascreen", "zx-spectrum.snapshot"}


@pytest.mark.parametrize("name", packers.PICTURES)
def test_pictures_of_several_lines(name):
    file, write, path = packers.PICTURES[name]
    g = packers.grid([i * i % 16 for i in range(75)] + [0] * 20)
    found = {n.path: n.raster for n in inspect_bytes(write(g), file)[0] if n.raster}
    assert np.array_equal(np.frombuffer(found[path].rgba, np.uint8).reshape(-1, 8, 4)[..., :3], packers.COLOURS[g])


def test_bitmap_runs_leave_gaps_and_refuse_overruns():
    pixels = unpack_bitmap_runs(bytes([2, 5, 0, 2, 1, 1, 1, 7, 0, 1]), 4, 2, 8)
    assert pixels.tolist() == [[5, 5, 0, 0], [0, 0, 0, 7]]
    with pytest.raises(ValueError):
        unpack_bitmap_runs(bytes([5, 1, 0, 1]), 4, 2, 8)
    with pytest.raises(ValueError):
        unpack_bitmap_runs(bytes([1]), 4, 2, 8)


def test_lzw_of_a_published_picture():
    """The ten by ten pixels of three colours that descriptions of the format take as their example."""
    packed = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01")
    pixels = codecs.lzw_decode(packed, 2)
    rows = [pixels[i : i + 10] for i in range(0, 100, 10)]
    top, mixed, bottom = bytes([1] * 5 + [2] * 5), bytes([1, 1, 1, 0, 0, 0, 0, 2, 2, 2]), bytes([2] * 5 + [1] * 5)
    assert rows[:3] == [top] * 3 and rows[3:5] == [mixed] * 2 and rows[5:7] == [bytes([2, 2, 2, 0, 0, 0, 0, 1, 1, 1])] * 2 and rows[7:] == [bottom] * 3


def test_runs_of_a_published_example():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert codecs.unpack_runs(packed, 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
