"""The engine's operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

import hashlib
import lzma
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustlens.functions import binary, paths, text
from dustlens.operators import colour_cycles, companions, detection, extraction, lookups
from dustlens.plans import packers
from dustlens.sources import codecs, export, packages, session
from dustlens.sources.inspect import animation_frames, database_rows, inspect, metadata_rows, pixels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Detection. Parts become sources whose first bytes, sizes and names come from their numbers.


class Sample(NamedTuple):
    """First bytes, the size that zeros fill up to, an ending, and what is expected: (type, confidence without and with the ending), by rank."""

    head: bytes
    ending: str
    expected: tuple[tuple[str, str, str], ...]
    size: int = 0
    only_named: tuple[tuple[str, str], ...] = ()  # further types that only the ending brings in: before (0) or behind (1) the others in rank


def _one(head: bytes, ending: str, type_id: str, confidence: str = "certain", named: str = "", size: int = 0) -> Sample:
    return Sample(head, ending, ((type_id, confidence, named or confidence),), size)


#: What each start of a file is, written down by hand from the formats' descriptions.
SAMPLES = (
    _one(b"%PDF-1.4 ", "pdf", "adobe.pdf"), _one(b"\x31\xbe\0\0", "wri", "windows.write", "probable"), _one(b"SQLite format 3\0", "db", "database.sqlite3"), _one(b"\x7fELF\2\1\1\0AI\1", "appimage", "executable.appimage-type1"),
    _one(b"\x7fELF\2\1\1\0AI\2", "appimage", "executable.appimage-type2"), _one(b"PWAD", "wad", "doom.wad"), _one(b"IWAD", "wad", "doom.wad"), _one(b"\4\0\0\0", "asar", "archive.electron-asar"),
    _one(b"\x0f\0\0\1", "font", "amiga.bitmap-diskfont-index"), _one(b"\xe3\x10\0\1", "info", "amiga.workbench-icon"), _one(b"GIF89a", "gif", "gif"), _one(b"GIF87a", "gif", "gif"), _one(b"\0\0\0\0\x12\xaf", "flc", "flic"),
    _one(b"\x89PNG\r\n\x1a\n", "png", "png"), _one(b"\xff\xd8\xff\xe0", "jpg", "jpeg"), _one(b"qoif", "qoi", "qoi"), _one(b"\0\x60", "kla", "commodore64.koala-painter", "possible", "probable", 10003),
    _one(b"P6\n8 8\n255\n", "ppm", "netpbm"), _one(b"P7\nWIDTH 8\n", "pam", "netpbm"), _one(b"BM", "bmp", "windows.bmp"), _one(b"\x28\0\0\0", "dib", "windows.dib", "probable"), _one(b"\0\0\1\0\1\0", "ico", "windows.ico"),
    _one(b"\0\0\2\0\1\0", "cur", "windows.cur"), _one(b"\x0a\5\1\x08", "pcx", "pcx", "probable"), _one(b"BMF\3", "fnt", "bitmap-font.bmfont", "probable"), _one(b"RIFFxxxxWAVE", "wav", "wav"), _one(b"Creative Voice File", "voc", "creative.voice"),
    _one(b"; paint.net Palette File", "txt", "paint-net.palette"), _one(b"GIMP Palette\n", "gpl", "gimp.palette"), _one(b"JASC-PAL\r\n0100\r\n", "pal", "jasc.palette"), _one(b"\0\0\0\0\xe0\xa5", "aseprite", "aseprite.sprite"),
    _one(b"ASEF\0\1", "ase", "adobe.swatch-exchange"), _one(b"PK\3\4", "zip", "archive.zip"), _one(b"xx-lh5-", "lha", "archive.lha"), _one(b"DMS!", "dms", "amiga.dms"), _one(b"XPKF", "xpk", "archive.xpk"), _one(b"PP20", "pp", "archive.powerpacker"),
    _one(b"FORMxxxx16SV", "16sv", "amiga.16sv"), _one(b"FORMxxxx8SVX", "8svx", "amiga.8svx"), _one(b"FORMxxxxANIM", "anim", "amiga.anim"), _one(b"FORMxxxxDEEP", "deep", "amiga.deep"), _one(b"FORMxxxxPBM ", "lbm", "amiga.pbm"),
    _one(b"FORMxxxxACBM", "acbm", "amiga.acbm"), _one(b"FORMxxxxDR2D", "dr2d", "amiga.dr2d"), _one(b"FORMxxxxILBM", "ilbm", "amiga.ilbm"), _one(b"FORMxxxxANNO", "iff", "amiga.iff"), _one(b"AMOS Basic V134", "amos", "amos.program"),
    _one(b"AmBs\0\1", "abs", "amos.bank-set"), _one(b"AmBk\0\1", "abk", "amos.bank"), _one(b"AmSp\0\1", "abk", "amos.sprite-bank"), _one(b"AmIc\0\1", "abk", "amos.icon-bank"), _one(b"\x1b[31m", "ans", "ansi.art", "probable"),
    _one(b"screen", "scr", "zx-spectrum.screen", "probable", size=6912), _one(b"snap", "sna", "zx-spectrum.snapshot", "probable", size=49179), _one(b"\x13\0\0", "tap", "zx-spectrum.tap", "probable"),
    _one(b"ZXTape!\x1a", "tzx", "zx-spectrum.tzx"), _one(b"\x1d\x7d\0", "ws", "wordstar.document"), Sample(b"\0\0\3\xf3", "bin", (("amiga.lha-sfx", "certain", "certain"), ("amiga.hunk-executable", "certain", "certain"))),
    Sample(b"screens", "scr", (("zx-spectrum.gigascreen", "", "probable"),), 7680), Sample(b"layer", "nxi", (("zx-spectrum-next.layer2-image", "", "probable"),), 49152), Sample(b"table", "act", (("adobe.color-table", "", "probable"),), 768),
    Sample(b"text", "ws", (("wordstar.document", "", "probable"),)), Sample(b"\2\0\0\0", "pal", (("rgba8.palette", "", "possible"),), 12), Sample(b"colours", "nxp", (("zx-spectrum-next.palette", "", "probable"),), 512),
    Sample(b"%PDF-3.0", "txt", ()), Sample(b"plain text", "txt", ()),
    Sample(b"PK\3\4".ljust(30, b"\0") + b"mimetypeimage/openraster", "ora", (("image.openraster", "certain", "certain"), ("archive.zip", "certain", "certain"))),
)


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a sample's file; odd sizes have its ending, even ones another."""
    heads = spark.createDataFrame([(i, bytearray(x.head), x.size, x.ending) for i, x in enumerate(SAMPLES)], "sample int, head binary, size int, ending string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), (F.col("p_partkey") % len(SAMPLES)).cast("int").alias("sample"), (F.col("p_size") % 2 == 1).alias("named"), "p_name")
    # A sample's size is exact; others go on with the part's name.
    zeros = F.unhex(F.repeat(F.lit("00"), F.col("size") - F.octet_length("head")))
    content = F.concat("head", F.when(F.col("size") > 0, zeros).otherwise(F.concat(F.unhex(F.lit("00" * 16)), F.col("p_name").cast("binary"))))
    return part.join(F.broadcast(heads), "sample").select("source_id", F.concat(F.lit("part."), F.when(F.col("named"), F.col("ending")).otherwise("data")).alias("filename"), content.alias("content"))


_EVIDENCE = {p.type_id: p.evidence for p in reversed(detection.PROBES)}
_EXPECTED = ", ".join(f"({i}, {k}, '{t}', {c!r}, {n!r}, '{x.ending}', {str(bool(c)).lower()}, {str(x.ending in own).lower()}, '{text}')" for i, x in enumerate(SAMPLES) for k, (t, c, n) in enumerate(x.expected) for own, text in [next((p.extensions, p.evidence) for p in detection.PROBES if p.type_id == t and p.required == (not c))])
_SOURCES_SQL = f"""
expected(sample, k, type_id, plain, with_ending, ending, always, usual, evidence) AS (VALUES {_EXPECTED}),
found AS (SELECT p_partkey AS source_id, k + 1 AS rank, type_id, CASE WHEN p_size % 2 = 1 THEN with_ending ELSE plain END AS confidence, evidence, p_size % 2 = 1 AND usual AS named, ending
  FROM part JOIN expected ON sample = p_partkey % {len(SAMPLES)} WHERE always OR p_size % 2 = 1)"""


@query("detect_candidates", f"WITH {_SOURCES_SQL} SELECT source_id, rank, type_id, confidence FROM found")
def detect_candidates(spark, sf_dir):
    return detection.candidates(part_sources(spark, sf_dir)).select("source_id", "rank", "type_id", "confidence")


@query("detect_winner", f"WITH {_SOURCES_SQL} SELECT source_id, type_id FROM found WHERE rank = 1")
def detect_winner(spark, sf_dir):
    return detection.winners(part_sources(spark, sf_dir)).select("source_id", "type_id")


@query("detect_evidence", f"WITH {_SOURCES_SQL} SELECT source_id, type_id, 'detection.evidence.1' AS key, evidence AS value FROM found UNION ALL SELECT source_id, type_id, 'detection.evidence.2', 'file extension is .' || ending FROM found WHERE named")
def detect_evidence(spark, sf_dir):
    return detection.evidence_rows(detection.candidates(part_sources(spark, sf_dir)))


@query("format_summary", f"WITH {_SOURCES_SQL} SELECT type_id, confidence, count(*) AS n FROM found GROUP BY type_id, confidence")
def format_summary(spark, sf_dir):
    return detection.candidates(part_sources(spark, sf_dir)).groupBy("type_id", "confidence").agg(F.count("*").alias("n"))


@query("refine_derivation", f"SELECT p_partkey AS source_id, k AS rank, CASE k WHEN 1 THEN 'archive.zip>image.openraster' ELSE 'archive.zip' END AS derivation FROM part, (VALUES (1), (2)) t(k) WHERE p_partkey % {len(SAMPLES)} = {len(SAMPLES) - 1}")
def refine_derivation(spark, sf_dir):
    found = detection.candidates(part_sources(spark, sf_dir))
    refined = found.where("type_id = 'image.openraster'").select("source_id")
    return found.join(refined, "source_id", "left_semi").select("source_id", "rank", F.array_join("derivation", ">").alias("derivation"))


# Paths and names.

_PATH = "'/' || split_part(url, '://', 2)"


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.element_at(F.split("url", "://"), 2)).alias("path"))


@query("path_pattern_select", f"SELECT page_id, {_PATH} AS path FROM pages WHERE regexp_matches({_PATH}, '^/[^/]+/en/[^/]+$') OR regexp_matches({_PATH}, '^/[^/]+/de/[^/]+$')")
def path_pattern_select(spark, sf_dir):
    return page_paths(spark, sf_dir).where(paths.matches_any(F.col("path"), ["/*/en/*", "/*/de/*"]))


@query("path_percent_encode", "SELECT doc_id, sha256(CASE WHEN text = '' THEN '%00' ELSE replace(url_encode(text), '~', '%7E') END) AS encoded_sha256 FROM documents")
def path_percent_encode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(paths.percent_encode(F.col("text")).cast("binary"), 256).alias("encoded_sha256"))


# Each segment by itself: unsafe characters, then spaces and dots at the end, then names of devices.
_SEGMENT = "rtrim(regexp_replace(x, '[\\x00-\\x1f<>:\"/\\\\|?*]', '_', 'g'), ' .')"
_DEVICES = ", ".join(f"'{d.lower()}'" for d in ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))))
_NAME = f"array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x != ''), lambda x: CASE WHEN {_SEGMENT} = '' THEN '_' WHEN lower(split_part({_SEGMENT}, '.', 1)) IN ({_DEVICES}) THEN '_' || {_SEGMENT} ELSE {_SEGMENT} END), '/')"
#: Paths with device names, spaces and dots at the end, unsafe signs and empty segments in them.
ODD = ("/a/con", "/Nul.txt/b. .", "/x:y|z//...", "/com7/LPT1.a.b/console", "/q?*")


@query("export_name_normalize", f"SELECT page_id, {_NAME} AS name FROM (SELECT page_id, '/' || split_part(url, '://', 2) || ({list(ODD)})[page_id % {len(ODD)} + 1] AS path FROM pages) p")
def export_name_normalize(spark, sf_dir):
    odd = F.element_at(F.array(*map(F.lit, ODD)), (F.col("page_id") % len(ODD) + 1).cast("int"))
    return page_paths(spark, sf_dir).select("page_id", paths.export_name(F.concat("path", odd)).alias("name"))


@query("export_name_dedupe", "SELECT p_partkey, p_brand, CASE WHEN k = 1 THEN p_type ELSE p_type || '-' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) AS k FROM part) p")
def export_name_dedupe(spark, sf_dir):
    return lookups.deduped_names(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type").select("p_partkey", "p_brand", "unique_name")


# Trees: pages packed into archives, twenty to a source.

PAGES = 20
#: Where a page's member lies in its archive, and the folders above it.
_MEMBERS = f"""members AS (SELECT page_id // {PAGES} AS source_id, page_id, '/archive/' || (page_id % 3) || '/' || (page_id % 2) || '/n' || page_id || '.txt' AS path, url FROM pages),
tree AS (SELECT source_id, path, strlen(url) AS bytes, 'file' AS kind FROM members
  UNION SELECT DISTINCT source_id, array_to_string(string_split(path, '/')[1:k], '/'), 0, 'group' FROM members, range(2, 5) t(k))"""


def page_files(spark: SparkSession, sf_dir: str, name: str, pack: Callable[[packers.Members], bytes], folders: bool = False) -> DataFrame:
    """A file for each ``PAGES`` pages whose members hold their addresses."""
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).alias("source_id"), "page_id", "url")
    label = (lambda k: f"{k % 3}/{k % 2}/n{k}.txt") if folders else (lambda k: f"n{k}")
    return packed(pages, "source_id", ["page_id", "url"], name, lambda rows: pack([(label(k), url.encode()) for k, url in rows]))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect(page_files(spark, sf_dir, "pages.zip", packers.zip_file, folders=True))


@query("tree_walk", f"WITH {_MEMBERS} SELECT source_id, path, (row_number() OVER (PARTITION BY source_id ORDER BY path) > 0) AS listed, kind = 'group' AS is_group FROM tree")
def tree_walk(spark, sf_dir):
    return page_tree(spark, sf_dir).select("source_id", "path", F.lit(True).alias("listed"), (F.col("kind") == "group").alias("is_group"))


@query("tree_direct_children", f"WITH {_MEMBERS} SELECT source_id, regexp_replace(path, '/[^/]+$', '') AS parent, count(*) AS children, min(path) AS first FROM tree WHERE path != '/archive' GROUP BY 1, 2")
def tree_direct_children(spark, sf_dir):
    own = export.with_children(page_tree(spark, sf_dir)).where("children IS NOT NULL")
    return own.select("source_id", F.col("path").alias("parent"), F.size("children").cast("long").alias("children"), F.array_min(F.transform("children", lambda c: c["path"])).alias("first"))


@query("tree_subtree_bytes", f"WITH {_MEMBERS}, up AS (SELECT source_id, path, bytes, unnest(range(2, len(string_split(path, '/')) + 1)) AS k FROM tree) SELECT source_id, array_to_string(string_split(path, '/')[1:k], '/') AS root, sum(bytes)::BIGINT AS bytes, count(*) AS resources FROM up GROUP BY 1, 2")
def tree_subtree_bytes(spark, sf_dir):
    return lookups.subtree_totals(page_tree(spark, sf_dir), "source_id", "path", F.octet_length("data"))


@query("extraction_plan", f"WITH {_MEMBERS} SELECT source_id, path, CASE kind WHEN 'group' THEN 'directory' ELSE 'file' END AS entry, substr(path, 10) AS relative_path, bytes, NULL::VARCHAR AS problem FROM tree WHERE path != '/archive'")
def extraction_plan(spark, sf_dir):
    return extraction.plan(page_tree(spark, sf_dir)).select("source_id", "path", "entry", "relative_path", "bytes", "problem")


@query("extraction_totals", f"WITH {_MEMBERS} SELECT source_id, count(*) FILTER (kind = 'group' AND path != '/archive') AS directories, count(*) FILTER (kind = 'file') AS files, sum(bytes)::BIGINT AS bytes, 0::BIGINT AS renamed, 0::BIGINT AS problems FROM tree GROUP BY 1")
def extraction_totals(spark, sf_dir):
    return extraction.totals(extraction.plan(page_tree(spark, sf_dir)))


@query("extraction_preflight", f"WITH {_MEMBERS} SELECT source_id, path, CASE WHEN path LIKE '/archive/1%' THEN 'output directory conflicts with a file: 1' WHEN path LIKE '/archive/2/0%' THEN 'output path is a symbolic link: 2/0' END AS conflict FROM tree WHERE path != '/archive'")
def extraction_preflight(spark, sf_dir):
    there = spark.createDataFrame([("1", "file"), ("2/0", "link"), ("0", "directory"), ("elsewhere", "file")], "relative_path string, kind string")
    return extraction.preflight(extraction.plan(page_tree(spark, sf_dir)), there).select("source_id", "path", "conflict")


@query("export_select_path", f"SELECT DISTINCT page_id // {PAGES} AS source_id, CASE WHEN page_id // {PAGES} > 0 THEN 'resource was not found: /archive/1/1/n7.txt' END AS problem FROM pages")
def export_select_path(spark, sf_dir):
    return extraction.selected(page_tree(spark, sf_dir), "/archive/1/1/n7.txt").select("source_id", "problem")


@query("export_bulk", f"WITH {_MEMBERS} SELECT source_id, 'archive/' || (page_id % 3) || '/' || (page_id % 2) || '/n' || page_id || '.txt.bin' AS filename, 'application/octet-stream' AS media_type, sha256(url) AS digest FROM members WHERE page_id % 3 = 1")
def export_bulk(spark, sf_dir):
    made = export.artifacts(extraction.matched(page_tree(spark, sf_dir), ["/archive/1/*/*"]))
    return made.select("source_id", "filename", "media_type", F.sha2("data", 256).alias("digest"))


@query("export_metadata_json", f"WITH {_MEMBERS} SELECT source_id, path, CASE kind WHEN 'file' THEN 'opaque' ELSE kind END AS kind, (SELECT count(*) FROM tree c WHERE c.source_id = tree.source_id AND regexp_replace(c.path, '/[^/]+$', '') = tree.path) AS children FROM tree")
def export_metadata_json(spark, sf_dir):
    made = export.artifacts(export.with_children(page_tree(spark, sf_dir)), "metadata-json")
    text = F.decode("data", "UTF-8")
    return made.select("source_id", F.get_json_object(text, "$.path").alias("path"), F.get_json_object(text, "$.kind").alias("kind"), F.coalesce(F.json_array_length(F.get_json_object(text, "$.children")), F.lit(0)).cast("long").alias("children"))


# Sessions: descriptions first, then what is asked for.


@query("session_expand", f"WITH {_MEMBERS} SELECT source_id, path, kind = 'group' AS is_group, bytes AS estimated_bytes FROM tree WHERE len(string_split(path, '/')) = 4 AND path LIKE '/archive/1/%'")
def session_expand(spark, sf_dir):
    opened = session.open_session(page_files(spark, sf_dir, "pages.zip", packers.zip_file, folders=True))
    return session.expand(opened, "/archive/1").select("source_id", "path", (F.col("kind") == "group").alias("is_group"), "estimated_bytes")


@query("session_payload_chunks", f"WITH {_MEMBERS} SELECT source_id, path, k::INT AS chunk, (k * 16)::BIGINT AS \"offset\", substr(url, k * 16 + 1, 16) AS text FROM (SELECT *, unnest(range((strlen(url) + 15) // 16)) AS k FROM members) x")
def session_payload_chunks(spark, sf_dir):
    return session.stream_payload(page_tree(spark, sf_dir), 16).select("source_id", "path", "chunk", "offset", F.decode("data", "UTF-8").alias("text"))


@query("session_projection", f"WITH {_MEMBERS} SELECT source_id, path, CASE kind WHEN 'file' THEN 'opaque' ELSE kind END AS kind FROM tree")
def session_projection(spark, sf_dir):
    rows = session.projection(page_tree(spark, sf_dir))
    return rows.select("source_id", F.get_json_object("json", "$.path").alias("path"), F.get_json_object("json", "$.kind").alias("kind"))


# Lookups.


@query("companion_lookup", "SELECT n_nationkey, c.v AS companion FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS v FROM supplier GROUP BY s_nationkey, lower('S' || (s_suppkey % 3)) HAVING count(*) = 1 AND lower('S' || (min(s_suppkey) % 3)) = 's1') c ON s_nationkey = n_nationkey")
def companion_lookup(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").withColumn("rel_path", F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")))
    own = lookups.unambiguous(files, "s_nationkey", "rel_path", "s_suppkey").where("key = 's1'")
    nation = table(spark, sf_dir, "nation")
    return nation.join(own, nation.n_nationkey == own.collection, "left").select("n_nationkey", F.col("value").alias("companion"))


@query("last_match_lookup", "SELECT upper(p_brand) AS name, arg_max(p_retailprice, p_partkey) AS value FROM part GROUP BY 1")
def last_match_lookup(spark, sf_dir):
    return lookups.last_match(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_retailprice")


@query("first_valid_lookup", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
def first_valid_lookup(spark, sf_dir):
    return lookups.first_valid(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "O")


@query("chunk_extent", "SELECT l_orderkey, l_linenumber, coalesce((SELECT min(b.o) FROM (SELECT l_orderkey AS k, l_quantity::BIGINT AS o FROM lineitem) b WHERE b.k = l.l_orderkey AND b.o > l.l_quantity::BIGINT), 100) - l_quantity::BIGINT AS extent FROM lineitem l")
def chunk_extent(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("offset"))
    return lookups.extents(rows, "l_orderkey", "offset", F.lit(100)).select("l_orderkey", "l_linenumber", F.col("extent").cast("long").alias("extent"))


@query("copy_names", "SELECT p_partkey, CASE WHEN k = 1 THEN p_type ELSE p_type || '-copy-' || (k - 1) END AS copy_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS k FROM part) p")
def copy_names(spark, sf_dir):
    return lookups.copy_names(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_type").select("p_partkey", "copy_name")


@query("best_generation", "SELECT p_brand, p_size, p_partkey AS value FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part) p WHERE k = 1")
def best_generation(spark, sf_dir):
    return lookups.best_generation(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey", "p_partkey")


@query("last_ends", "SELECT l_orderkey, max(l_quantity::BIGINT + l_linenumber) AS \"end\" FROM lineitem GROUP BY 1")
def last_ends(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("offset"), F.col("l_linenumber").cast("long").alias("size"))
    return lookups.last_ends(rows, "l_orderkey", "offset", "size")


@query("first_by_path", "SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def first_by_path(spark, sf_dir):
    return lookups.first_by_path(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn").select("conv_id", "role", "turn")


@query("member_totals", f"SELECT page_id // {PAGES} AS source_id, count(*) AS members, sum(strlen(url))::BIGINT AS unpacked FROM pages GROUP BY 1")
def member_totals(spark, sf_dir):
    found = inspect(page_files(spark, sf_dir, "a.lha", packers.lha))
    return lookups.member_totals(found).select("source_id", "members", "unpacked")


# Ordered state.

@query("namespace_markers", "SELECT event_id, nullif(last_value(CASE WHEN event_type = 'signup' THEN 'S' || event_id WHEN event_type = 'purchase' THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS namespace FROM events")
def namespace_markers(spark, sf_dir):
    name = F.concat(F.lit("S"), F.col("event_id").cast("string"))
    return lookups.namespaces(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", name).select("event_id", "namespace")


@query("ordinal_paths", "SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id) = 1 THEN '/turn' ELSE '/turn/' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS path FROM conversations")
def ordinal_paths(spark, sf_dir):
    return lookups.ordinal_paths(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.lit("/turn")).select("conv_id", "turn", "path")


@query("implicit_export", "SELECT p_brand, max(p_size) AS best, count(*) > 1 AS ambiguous FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand")
def implicit_export(spark, sf_dir):
    return lookups.implicit_export(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("limit_enforce", "SELECT o_orderkey, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 500000 AS probed FROM orders")
def limit_enforce(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("size", F.round("o_totalprice").cast("long"))
    return lookups.within_budget(rows, "o_custkey", "o_orderkey", "size", 500_000).select("o_orderkey", "probed")


# Metadata and documents.


# Bytes.


@query("checksum_xor", "SELECT p_partkey, list_reduce(list_transform(string_split(p_name, ''), lambda c: ord(c)), lambda a, b: xor(a, b)) AS checksum FROM part")
def checksum_xor(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", binary.xor_checksum(F.col("p_name").cast("binary")).alias("checksum"))


@query("checksum_sum256", "SELECT p_partkey, list_sum(list_transform(string_split(p_name, ''), lambda c: ord(c)))::BIGINT % 256 AS checksum FROM part")
def checksum_sum256(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", binary.sum_checksum(F.col("p_name").cast("binary")).alias("checksum"))


# A disc's dates: seven bytes, the last a quarter of an hour's offset from Greenwich.
@query("disc_dates", "SELECT o_orderkey, strftime(date_trunc('second', o_orderdate) - to_minutes((((o_orderkey % 9) - 4) * 15)::INTEGER), '%Y-%m-%d %H:%M:%S') AS moment FROM orders WHERE year(o_orderdate) BETWEEN 1901 AND 2155")
def disc_dates(spark, sf_dir):
    d = F.col("o_orderdate")
    two = lambda v: F.lpad(F.hex(v), 2, "0")
    quarter = F.pmod((F.col("o_orderkey") % 9 - 4), F.lit(256))
    raw = F.unhex(F.concat(two(F.year(d) - 1900), two(F.month(d)), two(F.dayofmonth(d)), two(F.hour(d)), two(F.minute(d)), two(F.second(d)), two(quarter)))
    rows = table(spark, sf_dir, "orders").where(F.year(d).between(1901, 2155)).select("o_orderkey", text.disc_date(raw).alias("t"))
    return rows.select("o_orderkey", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("moment"))


# The table of the checksum's remainders, and the fold over an address's bytes.
_CRC = """WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, list_transform(range(8), lambda k: 0::BIGINT)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT page_id, list_prepend(4294967295, list_transform(string_split(url, ''), lambda x: ord(x)::BIGINT)) AS bytes FROM pages)
SELECT page_id, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS checksum FROM b, t"""


@query("checksum_crc32", _CRC)
def checksum_crc32(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", binary.crc32_checksum(F.col("url").cast("binary")).alias("checksum"))


@query("hexdump_lines", "SELECT page_id, s AS offset, lower(substr(hex(encode(url)), 2 * s + 1, 32)) AS hex, substr(url, s + 1, 16) AS text FROM (SELECT page_id, url, unnest(range(0, strlen(url), 16)) AS s FROM pages) p")
def hexdump_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(binary.hex_lines(F.col("url").cast("binary"))).alias("l")).select("page_id", "l.offset", "l.hex", "l.text")


# Blue has two bits; its third is set where any of them is.
@query("palette_rgb332", "SELECT v AS byte, round((v >> 5) * 255.0 / 7)::INT AS r, round((v >> 2 & 7) * 255.0 / 7)::INT AS g, ([0, 109, 182, 255])[(v & 3) + 1]::INT AS b FROM (SELECT DISTINCT (p_partkey % 256)::INT AS v FROM part) p")
def palette_rgb332(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 256).cast("int").alias("byte")).distinct().select("byte", binary.rgb332(F.col("byte")).alias("c")).select("byte", "c.r", "c.g", "c.b")


# Two ranges of two to five colours that turn at steps of one to seven.
_CYCLES = "cycles AS (SELECT p_partkey, (p_size % 5 + 1)::BIGINT AS s1, (p_partkey % 4 + 2)::BIGINT AS n1, (p_partkey % 7 + 1)::BIGINT AS s2, (p_size % 3 + 2)::BIGINT AS n2 FROM part)"


def part_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycle = lambda low, length, step, way: F.struct(low.cast("int").alias("low"), (low + length - 1).cast("int").alias("high"), step.cast("int").alias("step"), F.lit(way).alias("direction"))
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.array(cycle(F.lit(0), k % 4 + 2, size % 5 + 1, 1), cycle(F.lit(6), size % 3 + 2, k % 7 + 1, -1)).alias("cycles"))


@query("cycle_period", f"WITH {_CYCLES} SELECT p_partkey, lcm(s1 * n1, s2 * n2) AS period FROM cycles")
def cycle_period(spark, sf_dir):
    return part_cycles(spark, sf_dir).select("p_partkey", colour_cycles.period_of(F.col("cycles")).alias("period"))


@query("cycle_next_boundary", f"WITH {_CYCLES} SELECT p_partkey, least((p_partkey % 50 // s1 + 1) * s1, (p_partkey % 50 // s2 + 1) * s2) AS boundary FROM cycles")
def cycle_next_boundary(spark, sf_dir):
    return part_cycles(spark, sf_dir).select("p_partkey", colour_cycles.boundary_of(F.col("cycles"), F.col("p_partkey") % 50).cast("long").alias("boundary"))


@query("cycle_frames", f"WITH {_CYCLES}, moments AS (SELECT DISTINCT p_partkey, lcm(s1 * n1, s2 * n2) AS whole, unnest(list_concat(range(0, lcm(s1 * n1, s2 * n2), s1), range(0, lcm(s1 * n1, s2 * n2), s2))) AS start FROM cycles) SELECT p_partkey AS key, start, coalesce(lead(start) OVER (PARTITION BY p_partkey ORDER BY start), whole) - start AS ms FROM moments")
def cycle_frames(spark, sf_dir):
    return colour_cycles.expanded(part_cycles(spark, sf_dir), "p_partkey", "cycles").select("key", "start", "ms")


@query("metadata_rows", f"WITH {_MEMBERS} SELECT source_id, path, 'data.length' AS key, bytes::VARCHAR AS value FROM tree WHERE kind = 'file'")
def metadata_rows_query(spark, sf_dir):
    return metadata_rows(page_tree(spark, sf_dir)).where("key = 'data.length'").select("source_id", "path", "key", "value")


@query("doc_markdown_escape", r"SELECT doc_id, sha256(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '`', '\`'), '*', '\*'), '_', '\_'), '[', '\['), ']', '\]'), '<', '\<'), '>', '\>'), '|', '\|')) AS escaped_sha256 FROM documents")
def doc_markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(paths.markdown_escaped(F.col("text")).cast("binary"), 256).alias("escaped_sha256"))


# Codecs: what a library packs comes back; what has no library's writer is packed here, and the tests hold its reader against fixed bytes.


def _codec(name: str, key: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes, int], bytes]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(unpack(pack(t), len(t))).hexdigest() for t in texts])], names=[key, "sha256"])

        return table(spark, sf_dir, name).select(key, "text").mapInArrow(trip, f"{key} long, sha256 string")

    return run


def _deflate(data: bytes) -> bytes:
    stream = zlib.compressobj(9, zlib.DEFLATED, -15)
    return stream.compress(data) + stream.flush()


def _lzma2(data: bytes) -> bytes:
    """What preset 6 gives: a dictionary beyond the data's size changes no byte, and costs more than a short text itself."""
    return lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": min(1 << 23, max(4096, len(data)))}])


_LZMA = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 20, "lc": 3, "lp": 0, "pb": 2}]
for _name, _table, _key, _pack, _unpack in (
    ("codec_deflate", "documents", "doc_id", _deflate, lambda d, n: codecs.inflate(d)),
    ("codec_lzma", "documents", "doc_id", lambda d: lzma.compress(d, lzma.FORMAT_RAW, filters=_LZMA), lambda d, n: codecs.unlzma(d)),
    ("codec_lzma2", "documents", "doc_id", _lzma2, lambda d, n: codecs.unlzma2(d)),
    ("codec_byterun1", "documents", "doc_id", codecs.pack_runs, codecs.unpack_runs),
    ("codec_lh5", "benchmark", "item_id", codecs.pack_lh5, codecs.unpack_lh5),
    ("codec_lzw", "benchmark", "item_id", lambda d: codecs.lzw_encode(d, 8), lambda d, n: codecs.lzw_decode(d, 8)),
):
    query(_name, f"SELECT {_key}, sha256(text) AS sha256 FROM {_table}")(_codec(_table, _key, _pack, _unpack))


# Scans: tables packed into a format, read back.


def packed(rows: DataFrame, group: str, columns: list[str], name: str, pack: Callable[[list[tuple]], bytes]) -> DataFrame:
    """A source for each value of ``group`` (few rows each), its content packed from the group's rows in order of the first column."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.select(columns).sort_by(columns[0])
        content = pack(list(zip(*(part.column(c).to_pylist() for c in columns), strict=True)))
        return pa.table({"source_id": pa.array([key[0].as_py()], pa.int64()), "filename": [name], "content": pa.array([content], pa.binary())})

    return rows.withColumn(group, F.col(group).cast("long")).groupBy(group).applyInArrow(run, "source_id long, filename string, content binary")


#: A piece's source number is its group's, shifted by so many bits, and its own place in the group.
PIECE_BITS = 24


def packed_pieces(rows: DataFrame, group: str, column: str, name: str, pack: Callable[[list[tuple]], bytes], most: int) -> DataFrame:
    """The same for groups that one file cannot hold: as many files as are needed, each of the next ``most`` rows. ``whole_of`` and ``piece_of`` read their numbers."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(column)) - 1
    file = F.shiftleft(F.col(group).cast("long"), PIECE_BITS) + F.floor(place / most)
    return packed(rows.select(file.alias("file"), column), "file", [column], name, pack)


def whole_of(source: str) -> Column:
    return F.shiftright(source, PIECE_BITS)


def piece_of(source: str) -> Column:
    return F.col(source).bitwiseAND(F.lit((1 << PIECE_BITS) - 1))


# Pictures: a part's pixel is its key modulo 16, eight to a line, the last line filled up with zeros.
_GRID = f"""WITH p AS (SELECT p_size AS source_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS i, (p_partkey % 16)::INT AS v FROM part),
cells AS (SELECT source_id, unnest(range((count(*) + {packers.WIDE - 1}) // {packers.WIDE} * {packers.WIDE})) AS i FROM p GROUP BY 1)
SELECT source_id, (i % {packers.WIDE})::INT AS x, (i // {packers.WIDE})::INT AS y, coalesce(v, 0) * 17 AS r, 255 - coalesce(v, 0) * 17 AS g, coalesce(v, 0) * 40 % 256 AS b FROM cells LEFT JOIN p USING (source_id, i)"""


def _picture_scan(name: str, write: Callable, path: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sources = packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], name, lambda rows: write(packers.grid([k % 16 for (k,) in rows])))
        return pixels(inspect(sources, columns=("source_id", "path", "width", "rgba")).where(F.col("path") == path)).select("source_id", "x", "y", "r", "g", "b")

    return run


for _name, (_file, _write, _path) in packers.PICTURES.items():
    query(f"scan_{_name}", _GRID)(_picture_scan(_file, _write, _path))


# Files in files: addresses of pages as members. One query for each format: what is found where.


def _member_scan(name: str, pack: Callable[[packers.Members], bytes], folders: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = inspect(page_files(spark, sf_dir, name, pack, folders)).where("data IS NOT NULL")
        return found.select("source_id", "path", F.sha2("data", 256).alias("digest"))

    return run


def _member_sql(path: str, where: str = "") -> str:
    return f"WITH m AS (SELECT page_id // {PAGES} AS source_id, page_id, url, row_number() OVER (PARTITION BY page_id // {PAGES} ORDER BY page_id) - 1 AS i FROM pages) SELECT source_id, {path} AS path, sha256(url) AS digest FROM m{where}"


_WHOLE = f"SELECT page_id // {PAGES} AS source_id, '%s' AS path, sha256(string_agg(url, '' ORDER BY page_id)) AS digest FROM pages GROUP BY 1"
query("scan_zip", _member_sql("'/archive/' || (page_id % 3) || '/' || (page_id % 2) || '/n' || page_id || '.txt'"))(_member_scan("a.zip", packers.zip_file, True))
query("scan_asar", _member_sql("'/archive/n' || page_id"))(_member_scan("a.asar", packers.asar))
query("scan_lha", _member_sql("'/archive/n' || page_id"))(_member_scan("a.lha", packers.lha))
query("scan_adf", _member_sql("'/disk/n' || page_id"))(_member_scan("a.adf", packers.adf))
query("scan_dms", _member_sql("'/disk/n' || page_id"))(_member_scan("a.dms", packers.dms))
query("scan_fat", _member_sql("'/disk/N' || page_id || '.TXT'"))(_member_scan("a.img", packers.fat))
query("scan_wad", _member_sql("'/wad/lumps/' || i || '-n' || page_id"))(_member_scan("a.wad", packers.wad))
query("scan_iff", _member_sql("'/chunks/' || i || '-NAME'"))(_member_scan("a.iff", packers.iff))
query("scan_tap", _member_sql("CASE WHEN count(*) OVER (PARTITION BY source_id) = 1 THEN '/code' ELSE '/code/' || (i + 1) END"))(_member_scan("a.tap", packers.tap))
query("scan_tzx", _member_sql("CASE WHEN count(*) OVER (PARTITION BY source_id) = 1 THEN '/code' ELSE '/code/' || (i + 1) END"))(_member_scan("a.tzx", packers.tzx))
query("scan_amos_bank", _WHOLE % "/bank")(_member_scan("a.abk", packers.bank))
query("scan_amos_bank_set", _member_sql("'/banks/' || i"))(_member_scan("a.abs", packers.bank_set))
query("scan_amos_program", _member_sql("'/banks/' || i") + " UNION ALL " + _WHOLE % "/listing")(_member_scan("a.amos", packers.program))
query("scan_xpk", _WHOLE % "/content")(_member_scan("a.xpk", packers.xpk))
query("scan_powerpacker", _WHOLE % "/content")(_member_scan("a.pp", packers.powerpacker))


@query("scan_nested", _member_sql("'/archive/inner.zip/archive/n' || page_id"))
def scan_nested(spark, sf_dir):
    found = inspect(page_files(spark, sf_dir, "outer.zip", packers.nested_zip)).where("depth = 1 AND type_id = 'file'")
    return found.select("source_id", "path", F.sha2("data", 256).alias("digest"))


@query("scan_lha_sfx", _member_sql("'/archive/n' || page_id"))
def scan_lha_sfx(spark, sf_dir):
    found = inspect(page_files(spark, sf_dir, "a", packers.lha_sfx)).where("type_id = 'file' AND path LIKE '/archive/%'")
    return found.select("source_id", "path", F.sha2("data", 256).alias("digest"))


# Packages of a map and a volume beside it, in different cases.
@query("package_resources", f"WITH m AS (SELECT page_id // {PAGES} AS source_id, url, row_number() OVER (PARTITION BY page_id // {PAGES} ORDER BY page_id) - 1 AS i FROM pages) SELECT source_id::VARCHAR AS collection, (2 * i)::INT AS number, sha256(url) AS digest FROM m")
def package_resources(spark, sf_dir):
    files = [page_files(spark, sf_dir, name, pack).select(F.col("source_id").cast("string").alias("collection"), F.concat(F.lit("game/"), "filename").alias("rel_path"), "content") for name, pack in (("LogDir", packers.game_map), ("vol.0", packers.game_volume))]
    found = packages.unpacked(packages.resources(files[0].union(files[1])))
    return found.where("warning IS NULL AND failure IS NULL").select("collection", "number", F.sha2("data", 256).alias("digest"))


# Companions: a font's descriptor and its page in other cases; where two files have the name there is none.
@query("companion_pages", f"SELECT (page_id // {PAGES})::VARCHAR AS collection, 0 AS page, page_id // {PAGES} % 2 = 1 AS missing FROM pages GROUP BY page_id // {PAGES}")
def companion_pages(spark, sf_dir):
    own = page_files(spark, sf_dir, "x", lambda members: b"page").select(F.col("source_id").cast("string").alias("collection"), "source_id", "content")
    descriptor = own.select("collection", F.lit("fonts/a.fnt").alias("rel_path"), F.lit(bytearray(packers.font_descriptor([(65,)]))).alias("content"))
    pages = own.select("collection", F.lit("Fonts/F.PNG").alias("rel_path"), "content")
    twice = own.where("source_id % 2 = 1").select("collection", F.lit("fonts/f.png").alias("rel_path"), "content")
    files = descriptor.union(pages).union(twice)
    return companions.font_pages(companions.inspect_files(files), files).select("collection", "page", "missing")


# Documents: a line for each page; their text as a whole.
_LINES = f"SELECT page_id // {PAGES} AS source_id, sha256(string_agg(url, chr(10) ORDER BY page_id){{}}) AS digest FROM pages GROUP BY 1"


def _document_scan(name: str, pack: Callable[[packers.Members], bytes]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return inspect(page_files(spark, sf_dir, name, pack)).where("text IS NOT NULL").select("source_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))

    return run


query("scan_wordstar", _LINES.format(" || chr(10)"))(_document_scan("a.ws", packers.wordstar))
query("scan_write", _LINES.format(" || chr(10)"))(_document_scan("a.wri", packers.write_document))


@query("scan_ansi", f"SELECT page_id // {PAGES} AS source_id, sha256(string_agg('page ' || page_id, chr(10) ORDER BY page_id)) AS digest FROM pages GROUP BY 1")
def scan_ansi(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).alias("source_id"), "page_id")
    sources = packed(pages, "source_id", ["page_id"], "a.ans", lambda rows: packers.bank_text([("", b"page %d" % k) for (k,) in rows]))
    return inspect(sources).where("text IS NOT NULL").select("source_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


# Programs: a line for each page, LET n = the page's number.
@query("scan_basic", f"SELECT page_id // {PAGES} AS source_id, string_agg(lpad((page_id % 9000)::VARCHAR, greatest(3, length((page_id % 9000)::VARCHAR))::INT, ' ') || ' LET n=' || page_id || ': PRINT \"x\"', chr(10) ORDER BY page_id) AS text FROM pages GROUP BY 1")
def scan_basic(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / PAGES).alias("source_id"), "page_id")
    return inspect(packed(pages, "source_id", ["page_id"], "a.tap", packers.basic)).where("text IS NOT NULL").select("source_id", "text")


# Drawings: a square for each part, in a group by itself if its key is even.
@query("scan_drawing", "SELECT p_size AS source_id, count(*) AS paths, count(*) FILTER (p_partkey % 2 = 0) AS groups FROM part GROUP BY 1")
def scan_drawing(spark, sf_dir):
    found = inspect(packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "a.dr2d", packers.drawing), columns=("source_id", "kind", "metadata")).where("kind = 'vector'")
    value = lambda key: F.get(F.filter("metadata", lambda m: m["key"] == key), 0)["value"].cast("long")
    return found.select("source_id", value("vector.paths").alias("paths"), value("vector.groups").alias("groups"))


# A database: whole texts of documents, with overflow pages, tabs and line breaks in them.
@query("scan_sqlite", r"SELECT doc_id // 50 AS source_id, doc_id AS k, lang AS name, sha256(replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(13), '\r'), chr(10), '\n')) AS note_sha256 FROM documents")
def scan_sqlite(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 50).alias("source_id"), "doc_id", "lang", "text")
    v = F.col("values")
    rows = database_rows(inspect(packed(docs, "source_id", ["doc_id", "lang", "text"], "docs.db", packers.database)))
    return rows.where("table = 't'").select("source_id", v[0].cast("long").alias("k"), v[1].alias("name"), F.sha2(v[2].cast("binary"), 256).alias("note_sha256"))


# Sounds: lines of an order as samples, one channel or two.
def _sound_sql(count: int, value: str, key: str = "o_custkey % 97") -> str:
    """The samples' number, least, greatest and sum by source and channel, and their sum weighted by place."""
    channels = " UNION ALL ".join(f"SELECT {key} AS source_id, {c} AS channel, row_number() OVER (PARTITION BY {key} ORDER BY o_orderkey) AS i, {value.format(c=c)} AS v FROM orders" for c in range(count))
    return f"SELECT source_id::BIGINT AS source_id, channel::INT AS channel, count(*) AS samples, min(v)::BIGINT AS low, max(v)::BIGINT AS high, sum(i * v)::BIGINT AS weighted FROM ({channels}) x GROUP BY 1, 2"


def _sound_scan(name: str, count: int, value: Callable[[int, int], int], pack: Callable[[list[list[int]]], bytes], through: Callable[[DataFrame], DataFrame] = lambda found: found) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("source_id"), "o_orderkey")
        sources = packed(orders, "source_id", ["o_orderkey"], name, lambda rows: pack([[value(k, c) for (k,) in rows] for c in range(count)]))
        channels = through(inspect(sources)).where("kind = 'audio'").select("source_id", F.posexplode("pcm").alias("channel", "v"))
        return channels.select(
            "source_id", "channel", F.size("v").cast("long").alias("samples"), F.array_min("v").cast("long").alias("low"), F.array_max("v").cast("long").alias("high"),
            F.aggregate(F.transform("v", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("weighted"),
        )

    return run


_WORD, _BYTE = lambda k, c: (k * (c + 3)) % 65536 - 32768, lambda k, c: (k * (c + 3)) % 256 - 128
query("scan_wav", _sound_sql(2, "o_orderkey * ({c} + 3) % 65536 - 32768"))(_sound_scan("a.wav", 2, _WORD, lambda chs: packers.wav(8000, 16, chs)))
query("scan_wav8", _sound_sql(1, "o_orderkey * ({c} + 3) % 256 - 128"))(_sound_scan("a.wav", 1, _BYTE, lambda chs: packers.wav(8000, 8, chs)))
query("scan_8svx", _sound_sql(1, "o_orderkey * ({c} + 3) % 256 - 128"))(_sound_scan("a.8svx", 1, _BYTE, lambda chs: packers.svx(8000, chs)))
query("scan_16sv", _sound_sql(1, "o_orderkey * ({c} + 3) % 65536 - 32768"))(_sound_scan("a.16sv", 1, _WORD, lambda chs: packers.svx16(8000, chs)))
query("scan_voice", _sound_sql(1, "o_orderkey * ({c} + 3) % 256 - 128"))(_sound_scan("a.voc", 1, _BYTE, lambda chs: packers.voice(8000, chs)))


#: Words that a tracker module's sample has at most: its length is a number of 16 bits.
SAMPLE_WORDS = 65535


# A tracker module's first sample: every number twice, so that it is a whole number of words.
@query("scan_mod", "SELECT source_id, (2 * count(*))::BIGINT AS samples, sum((4 * i - 1) * v)::BIGINT AS weighted, 'terminates' AS status FROM (SELECT (o_custkey % 97)::BIGINT AS source_id, row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderkey) AS i, o_orderkey * 3 % 256 - 128 AS v FROM orders) x GROUP BY 1")
def scan_mod(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("source_id"), "o_orderkey")
    pack = lambda rows: packers.module(8000, [[_BYTE(k, 0) for (k,) in rows for _ in (0, 1)]])
    found = inspect(packed_pieces(orders, "source_id", "o_orderkey", "a.mod", pack, SAMPLE_WORDS), columns=("source_id", "path", "kind", "metadata", "pcm")).where("kind = 'audio' OR path = '/module'")
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    v = F.col("pcm")[0]
    each = found.select(
        whole_of("source_id").alias("source_id"), (piece_of("source_id") * (2 * SAMPLE_WORDS)).alias("before"), F.size(v).cast("long").alias("samples"),
        total(F.transform(v, lambda x, i: x.cast("long") * (i + 1))).alias("weighted"), total(F.transform(v, lambda x: x.cast("long"))).alias("sum"),
        F.when(F.col("path") == "/module", F.get(F.filter("metadata", lambda m: m["key"] == "loop.status"), 0)["value"]).alias("status"),
    )
    counted = F.sum(F.when(F.col("weighted").isNotNull(), F.col("samples"))).alias("samples")  # the size of no sample is -1 or null
    return each.groupBy("source_id").agg(counted, F.sum(F.col("weighted") + F.col("before") * F.col("sum")).alias("weighted"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("status"))


#: Blocks that a row of a photograph has at most: its width is a number of 16 bits.
JPEG_BLOCKS = 65535 // 8


# Photographs: a flat block of eight by eight for each part, its grey the key modulo 256.
@query("scan_jpeg", "SELECT p_size AS source_id, (p_partkey % 256)::INT AS grey, (64 * count(*))::BIGINT AS n FROM part GROUP BY 1, 2")
def scan_jpeg(spark, sf_dir):
    sources = packed_pieces(table(spark, sf_dir, "part"), "p_size", "p_partkey", "a.jpg", lambda rows: packers.jpeg([k % 256 - 128 for (k,) in rows]), JPEG_BLOCKS)
    return pixels(inspect(sources)).where("r = g AND g = b AND a = 255").groupBy(whole_of("source_id").alias("source_id"), F.col("r").alias("grey")).agg(F.count("*").alias("n"))


# Fonts: entries of an index, glyphs of a descriptor.
@query("scan_font_index", "SELECT p_size AS source_id, 'f/' || p_partkey AS filename, (p_partkey % 200)::INT AS height FROM part")
def scan_font_index(spark, sf_dir):
    value = lambda key: F.get(F.filter("metadata", lambda m: m["key"] == key), 0)["value"]
    found = inspect(packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "a.font", packers.font_index)).where("path != '/font'")
    return found.select("source_id", value("index.filename").alias("filename"), value("height").cast("int").alias("height"))


@query("scan_bmfont", "SELECT p_size AS source_id, 'glyph.' || p_partkey AS key, (p_partkey % 250) || ',2,' || (p_partkey % 7) || ',4,0,-1,5,0' AS value FROM part")
def scan_bmfont(spark, sf_dir):
    found = inspect(packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "a.fnt", packers.font_descriptor))
    return metadata_rows(found).where("key LIKE 'glyph.%'").select("source_id", "key", "value")


# Palettes.
_COLOURS = "SELECT p_size AS source_id, (p_partkey % 256)::INT AS r, (p_partkey // 256 % 256)::INT AS g, (p_partkey % 251)::INT AS b FROM part"


def _palette_scan(name: str, pack: Callable[[list[tuple]], bytes], most: int = 0) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = lambda rows: pack([(k % 256, k // 256 % 256, k % 251) for (k,) in rows])
        sources = packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], name, own)
        return inspect(sources).select("source_id", F.explode("colours").alias("c")).select("source_id", "c.r", "c.g", "c.b")

    return run


query("scan_jasc_palette", _COLOURS)(_palette_scan("p.pal", lambda cs: ("JASC-PAL\r\n0100\r\n%d\r\n" % len(cs) + "".join("%d %d %d\r\n" % c for c in cs)).encode()))
query("scan_gimp_palette", _COLOURS)(_palette_scan("p.gpl", lambda cs: export.gpl([dict(zip("rgba", (*c, 255), strict=True)) for c in cs])))
query("scan_rgba8_palette", _COLOURS)(_palette_scan("p.pal", lambda cs: struct.pack("<I", len(cs)) + b"".join(bytes((*c, 255)) for c in cs)))
query("scan_swatch_exchange", _COLOURS)(_palette_scan("p.ase", packers.swatches))


@query("scan_color_table", "SELECT p_size AS source_id, ((p_size * i) % 256)::INT AS r, ((p_size + i) % 256)::INT AS g, (i * 3 % 256)::INT AS b FROM (SELECT DISTINCT p_size FROM part) p, range(256) t(i)")
def scan_color_table(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct().withColumn("k", F.col("p_size"))
    sources = packed(sizes, "p_size", ["k"], "p.act", lambda rows: packers.act([(rows[0][0] * i % 256, (rows[0][0] + i) % 256, i * 3 % 256) for i in range(256)]))
    return inspect(sources).select("source_id", F.explode("colours").alias("c")).select("source_id", "c.r", "c.g", "c.b")


# Three, three and two bits a colour, in levels that the machine has; blue's third bit is set where any of its two is.
@query("scan_next_palette", "SELECT p_size AS source_id, lv[((p_size + i) % 256 >> 5) + 1] AS r, lv[((p_size + i) % 256 >> 2 & 7) + 1] AS g, ([0, 109, 182, 255])[((p_size + i) % 4) + 1] AS b FROM (SELECT DISTINCT p_size, [0, 36, 73, 109, 146, 182, 219, 255] AS lv FROM part) p, range(256) t(i)")
def scan_next_palette(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select("p_size").distinct().withColumn("k", F.col("p_size"))
    sources = packed(sizes, "p_size", ["k"], "p.npl", lambda rows: bytes((rows[0][0] + i) % 256 for i in range(256)))
    return inspect(sources).select("source_id", F.explode("colours").alias("c")).select("source_id", "c.r", "c.g", "c.b")


@query("scan_paint_net_palette", "SELECT p_size AS source_id, (p_partkey % 256)::INT AS r, (p_partkey // 256 % 256)::INT AS g, (p_partkey % 251)::INT AS b FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS i FROM part) p WHERE i <= 96")
def scan_paint_net_palette(spark, sf_dir):
    """The format holds 96 colours, so that is what each file has."""
    own = lambda rows: packers.paint_net([(k % 256, k // 256 % 256, k % 251) for (k,) in rows[:96]])
    sources = packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "p.txt", own)
    return inspect(sources).select("source_id", F.explode("colours").alias("c")).select("source_id", "c.r", "c.g", "c.b")


@query(
    "scan_gif",
    """
    SELECT source_id, frame, ms, coalesce(sum(ms) OVER (PARTITION BY source_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms, r, g, b
    FROM (SELECT p_size AS source_id, p_partkey, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS frame, (p_partkey % 90 * 10)::INT AS ms,
                 (p_partkey % 256)::INT AS r, (p_partkey // 256 % 256)::INT AS g, (p_partkey % 251)::INT AS b, count(*) OVER (PARTITION BY p_size) AS n FROM part)
    WHERE n > 1
    """,
)
def scan_gif(spark, sf_dir):
    pack = lambda rows: export.gif(1, 1, [(k % 90 * 10, bytes([k % 256, k // 256 % 256, k % 251, 255])) for (k,) in rows])
    frames = animation_frames(inspect(packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "part.gif", pack), columns=("source_id", "path", "width", "height", "frames")))
    channel = lambda i: F.conv(F.hex(F.substr("rgba", F.lit(i), F.lit(1))), 16, 10).cast("int")
    return frames.select("source_id", "frame", "ms", "start_ms", channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


# Sinks: what is exported is scanned again.
def _exported(form: str, ending: str, kinds: str) -> Callable[[DataFrame], DataFrame]:
    """Resources exported to a format, as sources."""

    def run(resources: DataFrame) -> DataFrame:
        made = export.artifacts(resources.where(f"kind = '{kinds}'"), form).where(F.col("filename").endswith(ending))
        return made.select("source_id", F.regexp_extract("filename", r"([^/]+)$", 1).alias("filename"), F.col("data").alias("content"))

    return run


for _form, _ending in (("png", ".png"), ("apng", ".png"), ("gif", ".gif")):

    @query(f"export_{_form}", _GRID)
    def _export_pictures(spark, sf_dir, again=_exported(_form, _ending, "raster")):
        sources = packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "a.pcx", lambda rows: packers.pcx(packers.grid([k % 16 for (k,) in rows])))
        return pixels(inspect(again(inspect(sources)))).select("source_id", "x", "y", "r", "g", "b")


@query("export_gpl", _COLOURS)
def export_gpl(spark, sf_dir):
    own = lambda rows: packers.swatches([(k % 256, k // 256 % 256, k % 251) for (k,) in rows])
    again = _exported("gpl", ".gpl", "palette")(inspect(packed(table(spark, sf_dir, "part"), "p_size", ["p_partkey"], "p.ase", own)))
    return inspect(again).select("source_id", F.explode("colours").alias("c")).select("source_id", "c.r", "c.g", "c.b")


@query("export_wav", _sound_sql(1, "o_orderkey * ({c} + 3) % 256 - 128"))
def export_wav(spark, sf_dir):
    again = _exported("wav", ".wav", "audio")
    return _sound_scan("a.8svx", 1, _BYTE, lambda chs: packers.svx(8000, chs), lambda found: inspect(again(found)))(spark, sf_dir)


@query("failure_isolation", "SELECT n_nationkey AS source_id, 'unknown' AS type_id, 'gif: 13 bytes at 0 are outside of 9' AS failure FROM nation")
def failure_isolation(spark, sf_dir):
    sources = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("filename"), F.concat(F.lit("GIF89a"), F.substring("n_name", 1, 3)).cast("binary").alias("content"))
    return inspect(sources).select("source_id", "type_id", "failure")
