"""Registered queries against SQL, and plans that must not shuffle."""

import hashlib
import json
import struct
from urllib.parse import quote

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dustlens.functions import paths
from dustlens.operators import colour_cycles, extraction, lookups
from dustlens.operators.colour_cycles import Cycle, expand, next_boundary, palette_at, period
from dustlens.plans import packers, queries
from dustlens.sources import export
from dustlens.sources.inspect import inspect, inspect_bytes
from dustlens.streaming import landing

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    return "NULL" if v is None or str(v) in ("nan", "<NA>", "None") else f"{float(v):.12g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    rows = sorted(tuple(map(shown, (r[c] for c in sorted(got.columns)))) for r in got.collect())
    if name in queries.SQL:
        want = con.execute(queries.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert rows == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())
    assert rows


def test_registry_of_the_driver(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("pattern", ["a/b", "/a/**", "/a/../b", "/a/x*"])
def test_bad_patterns(spark, pattern):
    with pytest.raises(ValueError):
        paths.matches(F.lit("x"), pattern)


def test_names(spark):
    row = spark.range(1).select(paths.export_name(F.lit("/con.txt")), paths.export_name(F.lit("/a/b?c ")), paths.percent_encode(F.lit("a ~*ü")), paths.percent_encode(F.lit(""))).first()
    assert tuple(row) == ("_con.txt", "a/b_c", "a%20%7E%2A%C3%BC", "%00")


def test_percent_encode_reads_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL").collect()
    want = {r["doc_id"]: hashlib.sha256((quote(r["text"], safe="").replace("~", "%7E") or "%00").encode()).hexdigest() for r in docs}
    got = {r["doc_id"]: r["encoded_sha256"] for r in queries.QUERIES["path_percent_encode"](spark, SF).where("encoded_sha256 IS NOT NULL").collect()}
    assert got == want


def test_names_of_strings_and_columns_agree(spark):
    every = ["/a/con", "/Nul.txt/b. .", "/x:y|z//...", "/com7/LPT1.a.b/console", "/q?*", "/", "", "/ a/.b", "/COM1 ."]
    rows = spark.createDataFrame([(p,) for p in every], "p string").select("p", paths.export_name(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == {p: paths.portable_path(p) for p in every}
    assert paths.portable_path("/a/con") == "a/_con" and paths.portable_path("/COM1 .") == "_COM1" and paths.portable_path("/Nul.txt/b. .") == "_Nul.txt/b"


def test_names_that_are_taken_are_tried_on(spark):
    assert lookups.free_names(["a", "A", "a-2", "a", "x.y", "X.Y", "d/x.y", "x-2.y"]) == ["a", "A-2", "a-2-2", "a-3", "x.y", "X-2.Y", "d/x.y", "x-2-2.y"]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(["a", "A", "a-2"])] + [(2, 0, "a"), (2, 1, "b")], "g long, o int, n string")
    got = {(r["g"], r["o"]): r["unique_name"] for r in lookups.deduped_names(rows, "g", "o", "n").collect()}
    assert got == {(1, 0): "a", (1, 1): "A-2", (1, 2): "a-2-2", (2, 0): "a", (2, 1): "b"}


def test_markdown_escapes_inline_marks_only(spark):
    text = "1. (a) - b + c # d! {e} *f* _g_ `h` [i](j) <k> | l \\ m"
    want = "1. (a) - b + c # d! {e} \\*f\\* \\_g\\_ \\`h\\` \\[i\\](j) \\<k\\> \\| l \\\\ m"
    assert export.markdown(text).decode() == want
    assert spark.createDataFrame([(text,)], "t string").select(paths.markdown_escaped(F.col("t"))).first()[0] == want


def test_limits_are_errors(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 10)], "g long, o int, s long")
    assert lookups.within_limit(rows, "g", "o", "s", 11).count() == 3
    with pytest.raises(Exception, match="more than 10 in 1"):
        lookups.within_limit(rows, "g", "o", "s", 10).collect()


def resources(spark, members, name="a.zip", pack=packers.zip_file):
    return inspect(spark.createDataFrame([(1, name, bytearray(pack(members)))], "source_id long, filename string, content binary"))


def test_extraction_plans(spark):
    rows = {r["path"]: r for r in extraction.plan(resources(spark, [("a/con", b"1"), ("a/x.", b"22"), ("a/X", b"3"), ("b/ok.txt", b"4444")])).collect()}
    assert rows["/archive/a/con"]["relative_path"] == "a/_con" and rows["/archive/a/con"]["renamed"] and not rows["/archive/b"]["renamed"]
    assert rows["/archive/a/x."]["problem"].startswith("extraction path collision") and rows["/archive/a/X"]["problem"] and rows["/archive/b/ok.txt"]["problem"] is None
    assert rows["/archive/b"]["entry"] == "directory" and rows["/archive/b/ok.txt"]["bytes"] == 4
    none = extraction.plan(inspect(spark.createDataFrame([(1, "a.qoi", bytearray(packers.qoi(packers.grid([1, 2]))))], "source_id long, filename string, content binary"))).collect()
    assert [r["problem"] for r in none] == ["the selected format does not expose an extractable hierarchy"]


def test_preflight(spark):
    planned = extraction.plan(resources(spark, [("a/x", b"1"), ("b", b"2"), ("c", b"3"), ("d/y", b"4")]))
    there = spark.createDataFrame([("a", "file"), ("b", "file"), ("c", "directory"), ("d", "link")], "relative_path string, kind string")
    got = lambda force: {r["relative_path"]: r["conflict"] for r in extraction.preflight(planned, there, force).collect()}
    assert got(False) == {"a": "output directory conflicts with a file: a", "a/x": "output directory conflicts with a file: a", "b": "output already exists: b", "c": "output path is a directory: c", "d": "output path is a symbolic link: d", "d/y": "output path is a symbolic link: d"}
    assert got(True)["b"] is None and got(True)["a"]


def test_selecting_one_resource(spark):
    rows = resources(spark, [("a.txt", b"1"), ("b.txt", b"2")])
    told = lambda df: [(r["path"], r["problem"]) for r in df.collect()]
    assert told(extraction.selected(rows, "/archive/a.txt")) == [("/archive/a.txt", None)]
    assert told(extraction.selected(rows, "/archive")) == [(None, "resource is not exportable: /archive")]
    assert told(extraction.selected(rows, "/x")) == [(None, "resource was not found: /x")]
    assert told(extraction.selected(rows)) == [(None, "more than one exportable resource is available; select one")]
    assert told(extraction.selected(resources(spark, [("a.txt", b"1")]))) == [("/archive/a.txt", None)]


def test_artifacts_of_whole_trees_and_their_files(spark, tmp_path):
    rows = resources(spark, [("a/con", b"1"), ("a/b.txt", b"two")])
    made = {r["path"]: json.loads(bytes(r["data"])) for r in export.artifacts(export.with_children(rows), "metadata-json").collect()}
    assert made["/archive/a"]["children"] == ["/archive/a/con", "/archive/a/b.txt"] and made["/archive/a/b.txt"]["resource"]["bytes"] == 3
    pages = [bytes(r["data"]).decode() for r in export.artifacts(export.with_children(rows), "html-report").collect()]
    assert all("Metadata JSON" in p for p in pages) and any("Children" in p for p in pages)
    written = export.write_artifacts(export.artifacts(rows), f"file://{tmp_path}").collect()
    assert sorted(r["filename"] for r in written) == ["archive/a/_con.bin", "archive/a/b.txt.bin"]
    assert (tmp_path / "1" / "archive" / "a" / "b.txt.bin").read_bytes() == b"two"


def test_a_registered_format_reaches_tasks(spark):
    export.register("size", lambda row: str(len(row["data"] or b"")).encode(), "text/plain")
    rows = export.artifacts(resources(spark, [("a", b"12345")]).where("data IS NOT NULL"), "size").collect()
    assert [(r["filename"], bytes(r["data"])) for r in rows] == [("archive/a.size", b"5")]


def test_colour_cycles():
    cycles = [Cycle(0, 3, 10), Cycle(4, 5, 15, -1)]
    assert period(cycles) == 120 and next_boundary(cycles, 10) == 15 and next_boundary(cycles, 15) == 20
    palette = np.arange(6)[:, None]
    assert palette_at(palette, cycles, 10).ravel().tolist() == [3, 0, 1, 2, 4, 5] and palette_at(palette, cycles, 15).ravel().tolist() == [3, 0, 1, 2, 5, 4]
    frames = expand(cycles)
    assert sum(ms for *_, ms in frames) == 120 and [f[1] for f in frames] == sorted({t for s in (10, 15) for t in range(0, 120, s)})
    assert expand([Cycle(0, 1, 30)], [20, 40]) == [(0, 0, 20), (1, 20, 10), (1, 30, 30)]
    for wrong in (lambda: expand(cycles, most=3), lambda: period([Cycle(0, 0, 0)]), lambda: next_boundary([], 0), lambda: period([Cycle(0, 2, (1 << 40) + 1), Cycle(0, 4, (1 << 40) + 15)])):
        with pytest.raises(ValueError):
            wrong()


def test_cycled_pictures_are_exported(spark):
    ranges = (b"CRNG", struct.pack(">HHHBB", 0, 16384, 1, 1, 3))
    head = struct.pack(">HHhhBBBBHBBhh", 8, 1, 0, 0, 2, 0, 0, 0, 0, 1, 1, 8, 1)
    picture = packers.form(b"ILBM", (b"BMHD", head), (b"CMAP", bytes(range(12))), ranges, (b"BODY", bytes([0b01010101, 0, 0b00110011, 0])))
    rows = inspect(spark.createDataFrame([(1, "a.iff", bytearray(picture))], "source_id long, filename string, content binary"))
    made = export.artifacts(rows, "gif-cycled").collect()
    frames = inspect_bytes(bytes(made[0]["data"]), "a.gif")[0][0].frames
    assert [r["cycles"] for r in rows.collect()][0][0].asDict() == {"low": 1, "high": 3, "step": 17, "direction": 1}
    assert len(frames) == 3 and frames[0][1][4:7] == bytes([3, 4, 5]) and frames[1][1][4:7] == bytes([9, 10, 11])
    assert export.artifacts(rows, "apng-cycled").count() == 1


def test_inspecting_does_not_shuffle(spark):
    sources = spark.createDataFrame([(1, "x", bytearray(b"qoif")), (2, None, None)], "source_id long, filename string, content binary")
    out = inspect(sources)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["type_id"], r["failure"] is None) for r in out.collect()] == [("unknown", False), ("unknown", True)]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.gpl").write_bytes(b"GIMP Palette\n1 2 3\n")
    stream = landing.arriving(spark, str(tmp_path / "in"))
    landing.store_resources(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r["kind"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["palette"]
    assert landing.formats_by_hour(stream).isStreaming


def test_groups_that_one_file_cannot_hold(spark, con, tmp_path):
    """A photograph's row has at most 8,191 blocks, a module's sample at most 65,535 words; an animation may have any number of frames."""
    con2 = duckdb.connect()
    con2.execute(f"copy (select (7 + i % 2)::INT as p_size, i::BIGINT as p_partkey from range(40_001) t(i)) to '{tmp_path}/part.parquet'")
    con2.execute(f"copy (select (97 * (i % 3 // 2) + 5)::BIGINT as o_custkey, i::BIGINT as o_orderkey from range(131_073) t(i)) to '{tmp_path}/orders.parquet'")
    for t in ("part", "orders"):
        con2.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet')")
    for name in ("scan_jpeg", "scan_mod", "scan_gif"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con2.execute(f"select {', '.join(got.columns)} from ({queries.SQL[name]})").fetchall()
        assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want, name


def test_expanded_cycles_stay_in_the_engine(spark):
    rows = [(1, [(0, 3, 2, 1), (6, 8, 3, -1)]), (2, [(0, 1, 7, 1)]), (3, []), (4, None), (5, [(0, 499, 1, 1), (0, 1, 250, 1)])]
    df = spark.createDataFrame(rows, "k long, cycles array<struct<low:int,high:int,step:int,direction:int>>")
    found = colour_cycles.expanded(df, "k", "cycles")
    want = [(k, i, start, ms) for k, own in rows if own for i, (_, start, ms) in enumerate(expand([Cycle(*c) for c in own]))]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    for bad, why in (([(0, 0, 1, 1), (0, 2000, 1 << 20, 1)], "would exceed"), ([(0, 1, 0, 1)], "must be positive")):
        with pytest.raises(Exception, match=why):
            colour_cycles.expanded(spark.createDataFrame([(1, bad)], df.schema), "k", "cycles").collect()


def test_pixels_are_sent_in_bounded_pieces(spark):
    from dustlens.sources import inspect as scan

    rgba = np.random.default_rng(1).integers(0, 256, 4 * 300 * 500, np.uint8).tobytes()
    found = scan.pixels(spark.createDataFrame([(3, "/image", 300, bytearray(rgba)), (4, "/other", 1, bytearray(b"\1\2\3\4"))], "source_id long, path string, width int, rgba binary"))
    rows = found.where("source_id = 3").orderBy("y", "x").toPandas()
    assert rows[list("rgba")].to_numpy().astype(np.uint8).tobytes() == rgba and len(rows) == 150_000 and found.where("source_id = 4").count() == 1
    assert scan.PIXEL_ROWS < 150_000
