"""The scan: sources to resources, nested ones included."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.operators import detection
from dustlens.sources import amiga, animations, containers, images, palettes_audio, vector
from dustlens.sources.model import Node

Parser = Callable[[bytes, str], list[Node]]

#: Parsers by type; ``detection.PROBES`` tells which to try, and in which order.
PARSERS: dict[str, Parser] = {
    "adobe.pdf": containers.pdf, "database.sqlite3": containers.sqlite, "doom.wad": containers.wad, "gif": animations.gif, "jpeg": animations.jpeg, "png": images.png, "qoi": images.qoi,
    "netpbm": images.netpbm, "windows.bmp": images.bmp, "pcx": images.pcx, "wav": palettes_audio.wav, "paint-net.palette": palettes_audio.paint_net,
    "gimp.palette": palettes_audio.gimp, "jasc.palette": palettes_audio.jasc, "adobe.swatch-exchange": palettes_audio.swatches, "archive.zip": containers.zip_archive,
    "image.openraster": containers.openraster, "archive.lha": containers.lha, "archive.powerpacker": containers.powerpacker, "amiga.16sv": palettes_audio.svx,
    "amiga.8svx": palettes_audio.svx, "amiga.ilbm": images.ilbm, "amiga.iff": containers.iff, "amos.bank": containers.bank, "adobe.color-table": palettes_audio.adobe_table,
    "windows.ico": containers.icon, "windows.cur": containers.icon, "creative.voice": palettes_audio.voice, "protracker.mod": containers.module, "amos.bank-set": amiga.bank_set,
    "commodore.d64": containers.d64, "filesystem.fat-disk-image": containers.fat, "filesystem.iso9660": containers.iso9660, "archive.electron-asar": containers.asar,
    "zx-spectrum.tap": containers.tap, "zx-spectrum.tzx": containers.tzx, "zx-spectrum.screen": images.zx_screen, "zx-spectrum.snapshot": images.zx_snapshot,
    "commodore64.koala-painter": images.koala, "tga": images.tga, "rgba8.palette": palettes_audio.rgba8, "zx-spectrum-next.palette": palettes_audio.next_palette,
    "windows.dib": lambda data, name: images.bmp(data, name, 0),
    "amiga.adf": amiga.adf, "amiga.hunk-executable": amiga.hunk, "amiga.lha-sfx": amiga.lha_sfx, "amiga.workbench-icon": amiga.workbench_icon, "amiga.bitmap-diskfont-index": amiga.font_index,
    "amiga.bitmap-diskfont": amiga.font, "amiga.acbm": amiga.acbm, "amiga.pbm": amiga.pbm, "amiga.deep": amiga.deep, "amos.sprite-bank": amiga.picture_bank, "amos.icon-bank": amiga.picture_bank,
    "amiga.anim": amiga.anim, "amiga.dms": amiga.dms, "executable.appimage-type1": containers.appimage, "executable.appimage-type2": containers.appimage2, "bitmap-font.bmfont": animations.bmfont,
    "ansi.art": animations.ansi, "amos.program": amiga.program,
    "flic": animations.flic, "aseprite.sprite": animations.aseprite, "zx-spectrum.gigascreen": animations.gigascreen, "zx-spectrum-next.layer2-image": animations.layer2,
    "archive.xpk": containers.xpk, "amiga.dr2d": vector.dr2d, "zx-spectrum.fzx-font": animations.fzx, "windows.write": animations.write_document, "wordstar.document": animations.wordstar,
}

SCHEMA = (
    "source_id long, ordinal int, path string, depth int, type_id string, kind string, failure string, metadata array<struct<key:string,value:string>>, "
    "data binary, width int, height int, rgba binary, rate int, bits int, pcm array<array<int>>, colours array<struct<r:int,g:int,b:int,a:int>>, text string, frames array<struct<ms:int,rgba:binary>>, index binary, cycles array<struct<low:int,high:int,step:int,direction:int>>"
)


#: Types that the registry lists but nothing reads.
UNREAD = frozenset({"windows.inno-setup"})


def register(probe: detection.Probe, parser: Parser) -> None:
    """Adds a type, or a refiner of one (``probe.carrier``), behind those there are. Tasks see what was added before their function was sent."""
    detection.add(probe)
    PARSERS[probe.type_id] = parser


def detect_bytes(data: bytes, name: str, type_id: str | None = None) -> list[tuple[detection.Probe, tuple[str, ...], list[Node], str | None]]:
    """The candidates of a source, by rank, each with its resources and, where the parser refuses, why.

    Where a terminal candidate's structure holds it is the only one. ``type_id`` forces a type,
    which then is the only candidate, "selected by the caller"; its parser still judges the data.
    Whatever a parser raises is its refusal of this source, and no other's business.
    """
    if type_id:
        known = [(p, d) for p, d in detection.ordered() if p.type_id == type_id][:1]
        if not known:
            raise ValueError(f"not a type: {type_id!r}")
        tried = [(known[0][0]._replace(evidence="format selected by the caller", confidence="probable", terminal=True), known[0][1])]
    else:
        tried = detection.candidates_of(data, name)
    out = []
    for probe, derivation in tried:
        if probe.type_id not in PARSERS:
            out.append((probe, derivation, [], f"{probe.type_id} is not read"))
            continue
        try:
            nodes, why = PARSERS[probe.type_id](data, name), None
        except Exception as e:  # noqa: BLE001 - the data are untrusted, and a source's failure is a row
            nodes, why = [], f"{probe.type_id}: {e}" if isinstance(e, ValueError) else f"{probe.type_id}: {type(e).__name__}: {e}"
        if probe.terminal and nodes:
            return [(probe, derivation, nodes, None)]
        out.append((probe, derivation, nodes, why))
    return out


def inspect_bytes(data: bytes, name: str, type_id: str | None = None) -> tuple[list[Node], str | None]:
    """The resources of a source by its first candidate that holds, and why the first one failed if none does."""
    first = None
    for _, _, nodes, why in detect_bytes(data, name, type_id):
        if nodes:
            return nodes, None
        first = first or why
    return [], first


def detect(sources: DataFrame) -> DataFrame:
    """(source_id, rank, type_id, support, confidence, evidence, derivation) of each candidate whose whole structure its parser accepts.

    ``sources`` has source_id, filename and content. What ``detection.candidates`` finds by a few
    bytes is confirmed by parsing; where a terminal candidate holds it is alone, a type that
    comes twice counts once, and types that are only recognised have support "detection-only".
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([("source_id", pa.int64()), ("rank", pa.int32()), ("type_id", text), ("support", text), ("confidence", text), ("evidence", pa.list_(text)), ("derivation", pa.list_(text))])
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                source, name, content = (batch.column(c)[i].as_py() for c in range(3))
                name, seen = name or "", set()
                for probe, derivation, nodes, _ in detect_bytes(content or b"", name):
                    if (nodes or probe.type_id in UNREAD) and probe.type_id not in seen:
                        ending = name.rpartition(".")[2].lower() if "." in name else ""
                        named = ending in probe.extensions
                        rows.append({
                            "source_id": source, "rank": len(seen) + 1, "type_id": probe.type_id, "support": "detection-only" if probe.type_id in UNREAD or probe.type_id == "adobe.pdf" else "inspectable",
                            "confidence": probe.with_extension if named and probe.with_extension else probe.confidence, "evidence": [probe.evidence] + [f"file extension is .{ending}"] * named, "derivation": list(derivation),
                        })
                        seen.add(probe.type_id)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("source_id", "filename", "content").mapInArrow(run, "source_id long, rank int, type_id string, support string, confidence string, evidence array<string>, derivation array<string>")


#: Of a disc's files so many are looked into without being asked for, each of at most so many bytes, and all together; a disc with more files is not looked into at all (fixed values).
DISC_FILES, DISC_FILE_BYTES, DISC_BYTES = 512, 64 << 20, 128 << 20


def looked_into(nodes: list[Node]) -> list[bool]:
    """Which resources' payloads are inspected in turn. Discs have a budget; what does not fit stays as it is."""
    wanted = [bool(n.data) and n.type_id != "adobe.pdf" for n in nodes]
    if not nodes or nodes[0].type_id not in ("filesystem.iso9660", "executable.appimage-type1"):
        return wanted
    if sum(n.data is not None for n in nodes) > DISC_FILES:
        return [False] * len(nodes)
    held, out = 0, []
    for n, w in zip(nodes, wanted, strict=True):
        fits = w and len(n.data) <= DISC_FILE_BYTES and held + len(n.data) <= DISC_BYTES
        held += len(n.data) if fits else 0
        out.append(fits)
    return out


def _walk(data: bytes, name: str, prefix: str, depth: int, most_depth: int, type_id: str | None) -> Iterator[tuple[str, int, Node, str | None]]:
    nodes, failure = inspect_bytes(data, name, type_id)
    if not nodes:
        if not depth:
            yield "/file", 0, Node("/file", "unknown", "opaque", [], data=data), failure
        return
    for node, inner in zip(nodes, looked_into(nodes), strict=True):
        path = (prefix + node.path).rstrip("/") or "/"
        yield path, depth, node, None
        if inner and depth + 1 < most_depth:
            yield from _walk(node.data, node.path, path, depth + 1, most_depth, None)


def _row(source: int | None, ordinal: int, path: str, depth: int, n: Node, failure: str | None) -> dict:
    return {
        "source_id": source, "ordinal": ordinal, "path": path, "depth": depth, "type_id": n.type_id, "kind": n.kind, "failure": failure,
        "metadata": [{"key": k, "value": str(v)} for k, v in n.metadata], "data": n.data,
        "width": n.raster and n.raster.width, "height": n.raster and n.raster.height, "rgba": n.raster and n.raster.rgba,
        "rate": n.audio and n.audio.rate, "bits": n.audio and n.audio.bits, "pcm": n.audio and n.audio.channels,
        "colours": n.palette and [dict(zip("rgba", c, strict=True)) for c in n.palette], "text": n.text, "frames": n.frames and [{"ms": ms, "rgba": v} for ms, v in n.frames], "index": n.index, "cycles": n.cycles and [c._asdict() for c in n.cycles],
        "estimated_bytes": next((len(v) for v in (n.data, n.raster and n.raster.rgba, n.text and n.text.encode()) if v is not None), 0),
    }


def inspect(sources: DataFrame, type_id: str | None = None, most_depth: int = 8, most_resources: int = 200_000, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The resources of ``sources`` (source_id, filename, content), in pre-order by ordinal.

    Content is read once where it lies, whole trees are expanded within a task, one source at a
    time, and nothing is shuffled. ``columns`` names those that are wanted (of ``SCHEMA``, or
    estimated_bytes, the payload's size); others never leave the task. A source that no parser
    takes gives one opaque row with the first failure; one with more than ``most_resources``
    resources gives one failed row. How many sources a worker is sent at once, and how many
    bytes, is bounded by the session (spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch).
    """
    kinds = dict(zip((f.name for f in arrow_schema()), _typed(SCHEMA), strict=True)) | {"estimated_bytes": "estimated_bytes long"}
    wanted = columns or tuple(f.name for f in arrow_schema())
    fields = {f.name: f for f in arrow_schema()} | {"estimated_bytes": pa.field("estimated_bytes", pa.int64())}
    schema = pa.schema([fields[c] for c in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one source at a time is held besides the batch
                source, name, content = (batch.column(c)[i].as_py() for c in range(3))
                rows = []
                for path, depth, n, failure in _walk(content or b"", name or "", "", 0, most_depth, type_id):
                    if len(rows) >= most_resources:
                        node = Node("/file", "unknown", "opaque", [])
                        rows = [{k: v for k, v in _row(source, 0, "/file", 0, node, f"more than {most_resources} resources").items() if k in wanted}]
                        break
                    rows.append({k: v for k, v in _row(source, len(rows), path, depth, n, failure).items() if k in wanted})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sources.select("source_id", "filename", "content").mapInArrow(run, ", ".join(kinds[c] for c in wanted))


def _typed(schema: str) -> list[str]:
    """The columns of a schema's text, each with its type."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]


def arrow_schema() -> pa.Schema:
    number, text = pa.int32(), pa.string()
    return pa.schema([
        ("source_id", pa.int64()), ("ordinal", number), ("path", text), ("depth", number), ("type_id", text), ("kind", text), ("failure", text),
        ("metadata", pa.list_(pa.struct([("key", text), ("value", text)]))), ("data", pa.binary()), ("width", number), ("height", number), ("rgba", pa.binary()),
        ("rate", number), ("bits", number), ("pcm", pa.list_(pa.list_(number))), ("colours", pa.list_(pa.struct([(c, number) for c in "rgba"]))), ("text", text), ("frames", pa.list_(pa.struct([("ms", number), ("rgba", pa.binary())]))),
        ("index", pa.binary()), ("cycles", pa.list_(pa.struct([(c, number) for c in ("low", "high", "step", "direction")]))),
    ])


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files as sources (source_id, filename, content), by Spark's binary file reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("source_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content")


def read_collection(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, rel_path, content): a folder's files and those one level down, as what belongs together (see ``operators.companions`` and ``packages``).

    Names that come twice but for case stay; looking them up finds none of them.
    """
    root = folder.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [path, *[s.getPath() for s in store.listStatus(path) if s.isDirectory()]]
    named = [f.toString() for f in folders if any(s.isFile() for s in store.listStatus(f))]
    if not named:
        return spark.createDataFrame([], "collection string, rel_path string, content binary")
    plain = re.sub("^[a-z]+:/+", "/", root)
    files = spark.read.format("binaryFile").load(named)  # a folder's own files, not those below
    whole = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return files.select(F.lit(plain).alias("collection"), F.substr(whole, F.lit(len(plain) + 2)).alias("rel_path"), "content")


def database_rows(resources: DataFrame) -> DataFrame:
    """(source_id, table, rowid, values): the rows of embedded databases, as escaped text; NULL is null."""
    lines = resources.where("kind = 'text' AND path RLIKE '/rows$'").select("source_id", F.regexp_extract("path", r"/table/([^/]+)/rows$", 1).alias("table"), F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    parts = F.split("line", "\t")
    return lines.select("source_id", "table", F.get(parts, 0).cast("long").alias("rowid"), F.transform(F.slice(parts, 2, F.size(parts)), lambda v: F.when(v != "NULL", v)).alias("values"))


def metadata_rows(resources: DataFrame) -> DataFrame:
    """(source_id, path, place, key, value): metadata as rows, in order; keys may repeat."""
    return resources.select("source_id", "path", F.posexplode("metadata").alias("place", "m")).select("source_id", "path", "place", "m.key", "m.value")


#: Rows of frames, and of pixels, that a task sends at once.
FRAME_ROWS, PIXEL_ROWS = 10_000, 1 << 16


def pixels(resources: DataFrame) -> DataFrame:
    """(source_id, path, x, y, r, g, b, a): a row for each pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one picture at a time, and of it PIXEL_ROWS pixels
                width, rgba = batch.column(2)[k].as_py(), np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8).reshape(-1, 4)
                for start in range(0, len(rgba), PIXEL_ROWS):
                    v = rgba[start : start + PIXEL_ROWS].astype(np.int32)
                    at = np.arange(start, start + len(v), dtype=np.int32)
                    source, path = (pa.repeat(batch.column(c)[k], len(v)) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([source, path, pa.array(at % width), pa.array(at // width), *[pa.array(v[:, c]) for c in range(4)]], names=["source_id", "path", "x", "y", "r", "g", "b", "a"])

    return resources.where("rgba IS NOT NULL").select("source_id", "path", "width", "rgba").mapInArrow(run, "source_id long, path string, x int, y int, r int, g int, b int, a int")


def animation_frames(resources: DataFrame) -> DataFrame:
    """(source_id, path, frame, ms, start_ms, width, height, rgba): the frames of animations in order, from 0; a still picture has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # linear in the frames, and of the frames only references are held
                own = batch.column(4).slice(i, 1).flatten()
                ms, rgba = own.flatten()
                before = np.concatenate([[0], np.cumsum(ms.to_numpy(zero_copy_only=False).astype(np.int64))])
                for at in range(0, len(own), FRAME_ROWS):
                    n = min(FRAME_ROWS, len(own) - at)
                    source, path, width, height = (pa.repeat(batch.column(c)[i], n) for c in range(4))
                    yield pa.RecordBatch.from_arrays([source, path, pa.array(np.arange(at, at + n, dtype=np.int32)), ms.slice(at, n), pa.array(before[at : at + n]), width, height, rgba.slice(at, n)], names=["source_id", "path", "frame", "ms", "start_ms", "width", "height", "rgba"])

    return resources.where("frames IS NOT NULL").select("source_id", "path", "width", "height", "frames").mapInArrow(run, "source_id long, path string, frame int, ms int, start_ms long, width int, height int, rgba binary")
