"""Sessions, companions, listings, voices, modules, fonts and old text."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustlens.functions import text
from dustlens.operators import companions, detection, fonts, lookups
from dustlens.plans import packers
from dustlens.sources import containers, session
from dustlens.sources.inspect import PARSERS, inspect, inspect_bytes, read_collection, register
from dustlens.sources.listings import spectrum_basic
from dustlens.sources.model import Node


def sources(spark, *files):
    return spark.createDataFrame([(i, n, bytearray(d)) for i, (n, d) in enumerate(files)], "source_id long, filename string, content binary")


def test_session_step_by_step(spark):
    own = sources(spark, ("a.zip", packers.zip_file([("d/x.txt", b"hello"), ("d/y.bin", bytes(2500)), ("z", b"")])))
    opened = session.open_session(own)
    assert "data" not in opened.columns
    assert [r["path"] for r in session.expand(opened).collect()] == ["/archive"]
    assert sorted(r["path"] for r in session.expand(opened, "/archive").collect()) == ["/archive/d", "/archive/z"]
    assert {r["path"]: r["estimated_bytes"] for r in session.expand(opened, "/archive/d").collect()} == {"/archive/d/x.txt": 5, "/archive/d/y.bin": 2500}
    can = {r["path"]: r["can"] for r in session.capabilities(opened).collect()}
    assert can["/archive/d"] == ["enumerate-children"] and "materialize-payload" in can["/archive/d/x.txt"] and "materialize-payload" not in can["/archive/z"]
    assert [bytes(r["data"]) for r in session.load(own, "/archive/d/x.txt").collect()] == [b"hello"]
    chunks = session.stream_payload(session.load(own, "/archive/d/y.bin"), 1000).orderBy("chunk").collect()
    assert [(r["chunk"], r["offset"], len(r["data"])) for r in chunks] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 500)]
    rows = {json.loads(r["json"])["path"]: json.loads(r["json"]) for r in session.projection(inspect(own)).collect()}
    assert rows["/archive/d/x.txt"]["kind"] == "opaque" and isinstance(rows["/archive/d/x.txt"]["metadata"], dict)


def test_decoding_on_demand(spark):
    picture = packers.qoi(packers.grid(list(range(16))))
    found = session.decode(inspect(sources(spark, ("a.zip", packers.zip_file([("plain.dat", picture), ("words", b"just words")])))).where("depth = 0")).collect()
    assert {(r["path"], r["found_path"], r["found_type"]) for r in found} == {("/archive/plain.dat", "/image", "qoi"), ("/archive/words", "/file", "unknown")}


def test_types_can_be_added(spark):
    before = detection.PROBES
    try:
        register(detection.Probe("own.note", "note signature", "^NOTE"), lambda data, name: [Node("/note", "own.note", "text", [], text=data[4:].decode())])
        register(detection.Probe("own.memo", "memo in a note", "^NOTEMEMO", carrier="own.note"), lambda data, name: [Node("/memo", "own.memo", "text", [], text=data[8:].decode())])
        assert [n.path for n in inspect_bytes(b"NOTEMEMOx", "a")[0]] == ["/memo"] and [n.path for n in inspect_bytes(b"NOTEx", "a")[0]] == ["/note"]
        rows = detection.candidates(sources(spark, ("a", b"NOTEMEMOx"))).collect()
        assert [(r["type_id"], r["derivation"]) for r in rows] == [("own.memo", ["own.note", "own.memo"]), ("own.note", ["own.note"])]
    finally:
        detection.PROBES = before
        detection._COMPILED = detection._compiled()
        PARSERS.pop("own.note"), PARSERS.pop("own.memo")


def test_companions(spark):
    index = struct.pack(">HH", 0x0F00, 2) + b"".join(p.ljust(256, b"\0") + struct.pack(">HBB", h, 0, 0) for p, h in ((b"f/8", 8), (b"f/11", 11)))
    descriptor = b'info face="F" size=8\ncommon lineHeight=9 base=7 scaleW=16 scaleH=16 pages=2\npage id=0 file="P.png"\npage id=1 file="q.png"\nchars count=0\n'
    rows = [("c", "fonts/my.font", index), ("c", "Fonts/F/8", b"eight"), ("c", "b/x.fnt", descriptor), ("c", "b/p.PNG", b"page"), ("c", "b/q.png", b"1"), ("c", "b/Q.PNG", b"2"), ("other", "fonts/f/11", b"elsewhere"), ("c", "s/a.nxi", b"picture"), ("c", "s/A.PAL", b"colours"), ("c", "s/a.npl", b"better")]
    files = spark.createDataFrame([(c, p, bytearray(d)) for c, p, d in rows], "collection string, rel_path string, content binary")
    found = companions.inspect_files(files)
    sizes = {r["filename"]: (r["height"], r["content"] and bytes(r["content"])) for r in companions.font_files(found, files).collect()}
    assert sizes == {"f/8": (8, b"eight"), "f/11": (11, None)}
    pages = {r["page"]: (r["content"] and bytes(r["content"]), r["missing"]) for r in companions.font_pages(found, files).collect()}
    assert pages == {0: (b"page", False), 1: (None, True)}  # two files have the second name
    palettes = companions.picture_palettes(files.where("rel_path LIKE '%.nxi'"), files).collect()
    assert [(r["palette"], bytes(r["content"])) for r in palettes] == [("s/a.npl", b"better")]


def test_a_folder_is_a_collection(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    for name in ("a.fnt", "sub/B.png", "sub/deep/c"):
        (tmp_path / name).write_bytes(name.encode())
    rows = read_collection(spark, str(tmp_path)).collect()
    assert {r["rel_path"]: bytes(r["content"]) for r in rows} == {"a.fnt": b"a.fnt", "sub/B.png": b"sub/B.png"} and {r["collection"] for r in rows} == {str(tmp_path)}


def line(number, body):
    return struct.pack(">H", number) + struct.pack("<H", len(body) + 1) + body + b"\r"


def test_listings():
    program = line(10, b"\xf1a=1\x0e\0\0\1\0\0") + line(20, b'\xf5"x\x0e1";\xa5') + line(300, b"\xea \x90\x8f\x10\2\x07") + line(9999, b"\xec10\x0e\0\0\x0a\0\0:\xfa a\xc9b\xcb\xf5\xa6")
    assert spectrum_basic(program + b"\xff\xff").split("\n") == [" 10 LET a=1", ' 20 PRINT "x⟦$0E⟧1"; RND', "300 REM  ⟦UDG A⟧█⟦INK 2⟧⟦$07⟧", "9999 GO TO 10: IF  a <> b THEN PRINT INKEY$"]
    with pytest.raises(ValueError):
        spectrum_basic(b"\0\x0a\5\0abc")

    def block(body):
        x = 0
        for b in body:
            x ^= b
        return struct.pack("<H", len(body) + 1) + body + bytes([x])

    tape = block(b"\0" + struct.pack("<B10sHHH", 0, b"prog      ", len(program), 10, len(program))) + block(b"\xff" + program)
    node = inspect_bytes(tape, "a.tap")[0][1]
    assert (node.path, node.kind) == ("/listing/1", "text") and node.text.startswith(" 10 LET a=1\n")
    memory = bytearray(49152)
    memory[23755 - 16384 : 23755 - 16384 + len(program)] = program
    struct.pack_into("<H", memory, 23635 - 16384, 23755)
    struct.pack_into("<H", memory, 23627 - 16384, 23755 + len(program))
    listed = {n.path: n for n in inspect_bytes(bytes(27) + bytes(memory), "a.sna")[0]}
    assert listed["/listing"].text.split("\n")[0] == " 10 LET a=1"


def voice(*blocks):
    return b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x010A, 0x1129) + b"".join(bytes([k]) + (struct.pack("<I", len(b))[:3] + b if k != 7 else b"") for k, b in blocks) + b"\0"


def test_packed_voices():
    sound = lambda *blocks: inspect_bytes(voice(*blocks), "a.voc")[0][0].audio.channels[0]
    # Four bits: the second code's value 5 makes the step grow, so that the third counts double.
    assert sound((1, bytes([156, 1, 100, 0x15, 0x19]))) == [-28, -27, -22, -20, -22]
    assert sound((1, bytes([156, 2, 128, 0b001_111_01]))) == [0, 1, -2, 0]
    assert sound((1, bytes([156, 3, 128, 0b01_11_00_01]))) == [0, 4, -4, -4, 4]
    assert sound((1, bytes([156, 0, 130])), (6, b"\1\0"), (2, bytes([131])), (3, bytes([1, 0, 156])), (7, b"")) == [2, 3, 0, 0, 3, 0, 0]
    stereo = inspect_bytes(voice((8, struct.pack("<HBB", 65536 - 256_000_000 // (8000 * 2), 0, 1)), (1, bytes([0, 0, 1, 2, 3, 4]))), "a.voc")[0][0].audio
    assert stereo.rate == 8000 and stereo.channels == [[-127, -125], [-126, -124]]
    for bad in (((7, b""),), ((2, b"a"),), ((6, b"\1\0"), (1, bytes([156, 0, 1]))), ((1, bytes([156, 9, 1])),)):
        assert inspect_bytes(voice(*bad), "a.voc")[0] == []


def flow(cells, orders, restart=None):
    patterns = max(orders) + 1
    raw = bytearray(patterns * 64 * 4 * 4)
    for (pattern, row, channel), (command, value) in cells.items():
        at = ((pattern * 64 + row) * 4 + channel) * 4
        raw[at + 2 : at + 4] = bytes([command, value])
    return containers.control_flow(bytes(raw), 4, orders, restart)


def test_control_flow_of_modules():
    assert flow({}, [0, 0]) == ("terminates", 128, None, 0)
    assert flow({}, [0, 0], 1) == ("cycles", 128, (1, 0), 64)
    assert flow({(0, 9, 1): (11, 0)}, [0]) == ("cycles", 10, (0, 0), 10)
    assert flow({(0, 3, 0): (13, 0x16)}, [0, 1]) == ("terminates", 4 + 64 - 16, None, 0)
    assert flow({(0, 2, 0): (14, 0x60), (0, 5, 0): (14, 0x62)}, [0]) == ("terminates", 64 + 2 * 4, None, 0)
    assert flow({(0, 0, 0): (11, 0), (0, 0, 1): (13, 0x99)}, [0])[0] == "analysis-limit"
    data = packers.module(8000, [[1, 2, 3, 4]])
    assert ("loop.status", "terminates") in inspect_bytes(data, "a.mod")[0][0].metadata


def test_text_in_fonts():
    strip = np.zeros((2, 6, 4), np.uint8)
    strip[:, 0:2], strip[:, 2:5], strip[0, 5] = (1, 1, 1, 255), (2, 2, 2, 255), (3, 3, 3, 255)
    font = fonts.Font({65: fonts.Glyph(0, 0, 2, 2, 0, 0, 3), 66: fonts.Glyph(2, 0, 3, 2, 0, 0, 4), 64257: fonts.Glyph(5, 0, 1, 2, 0, 0, 2)}, 2, strip, 65, {(65, 66): -1}, {(66, 66): 64257})
    assert fonts.shaped(font, "AB\nBBx") == [(65, 0), (66, 2), (-1, 6), (64257, 0), (65, 2)]
    picture = fonts.rendered(font, "AB")
    assert picture[0, :, 0].tolist() == [1, 1, 2, 2, 2, 0] and fonts.rendered(font, "AAAA", 6).shape[0] == 4
    assert fonts.preview_text(font).startswith("AB") and fonts.glyph_grid(font).shape == (4, 16 * 5, 4)


def test_old_text(spark):
    rows = spark.createDataFrame([(bytearray(b"A\xc1\x84\xa0\xa0"), bytearray(b"h\0i\0\0\0x\0"), bytearray([99, 12, 31, 23, 59, 30, 4]))], "a binary, b binary, d binary")
    got = rows.select(text.petscii("a"), text.petscii_shifted("a"), text.cp437("a"), text.utf16_zero_ended("b"), text.disc_date(F.col("d")).cast("string"), text.days_date(F.lit(1), F.lit(61), F.lit(75)).cast("string")).first()
    assert tuple(got) == ("AA\x84", "aA\x84", "A┴äáá", "hi", "1999-12-31 22:59:30", "1978-01-02 01:01:01.5")
    assert spark.createDataFrame([(bytearray([99, 13, 31, 23, 59, 30, 4]),), (bytearray(b"x"),)], "d binary").select(text.disc_date(F.col("d")).alias("t")).where("t IS NOT NULL").count() == 0


def test_totals_and_choices(spark):
    rows = spark.createDataFrame([(1, "a", 3, 10), (1, "a", 5, 2), (1, "b", 5, 1)], "g int, n string, o int, s int")
    assert [tuple(r) for r in lookups.last_ends(rows, "g", "o", "s").collect()] == [(1, 13)]
    assert [tuple(r) for r in lookups.best_generation(rows, "g", "o", "s", "n").collect()] == [(1, 5, "b")]
    assert sorted((r["n"], r["o"]) for r in lookups.first_by_path(rows, "g", "n", "o").collect()) == [("a", 3), ("b", 5)]
    assert sorted(r["copy_name"] for r in lookups.copy_names(rows, "g", "o", "n").collect()) == ["a", "a-copy-1", "b"]
    found = lookups.member_totals(inspect(sources(spark, ("a.lha", packers.lha([("x", b"abcabcabc" * 9), ("y", b"12")])))))
    assert [r["unpacked"] for r in found.collect()] == [83]


def test_stored_chunks_of_a_packed_file():
    chunk = lambda kind, body: struct.pack(">BBHHH", kind, 0, 0, len(body), len(body)) + body + b"\0" * (-len(body) % 4)
    chunks = chunk(0, b"hello ") + chunk(0, b"there") + chunk(15, b"")
    head = b"XPKF" + struct.pack(">I4sI", len(chunks) + 28, b"NONE", 11) + b"hello there".ljust(16, b"\0") + bytes(4)
    x = 0
    for b in head:
        x ^= b
    head = head[:33] + bytes([x]) + head[34:]
    assert inspect_bytes(head + chunks, "a.xpk")[0][0].data == b"hello there"
    assert inspect_bytes(head[:32] + b"\1" + head[33:] + chunks, "a.xpk")[0] == []


def test_squashed_blocks_of_other_packers():
    import lzma

    import zstandard

    body = b"block " * 500
    for packing, packed in ((4, lzma.compress(body)), (2, lzma.compress(body, lzma.FORMAT_ALONE)), (6, zstandard.ZstdCompressor().compress(body))):
        assert containers._unzip(packed, len(body) + 1, packing) == body
        with pytest.raises(ValueError):
            containers._unzip(packed, 100, packing)
        with pytest.raises(ValueError):
            containers._unzip(b"nonsense" * 4, 100, packing)


def test_runs_are_found_without_a_step_for_each_byte():
    import time

    from dustlens.sources import codecs

    text = b"The quick brown fox jumps over the lazy dog. " * 45_000
    start = time.process_time()
    packed = codecs.pack_runs(text)
    assert time.process_time() - start < 1 and codecs.unpack_runs(packed, len(text)) == text
    assert codecs.pack_runs(b"a" * 130 + b"bc") == b"\x81a\x03aabc"


def test_lzma2_dictionaries_fit_their_texts():
    import lzma
    import time

    from dustlens.plans import queries

    plain, texts, took = [{"id": lzma.FILTER_LZMA2, "preset": 6}], [b"%d some short text of its own " % i * 20 for i in range(300)], []
    for pack in (lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=plain), queries._lzma2):
        start = time.process_time()
        took.append((list(map(pack, texts)), time.process_time() - start))
    assert took[0][0] == took[1][0] and took[1][1] < took[0][1] / 2
