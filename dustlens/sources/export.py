"""Sinks: resources to artifacts in formats of today."""

from __future__ import annotations

import base64
import html
import json
import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustlens.functions.paths import MARKDOWN_SIGNS, portable_path
from dustlens.operators.colour_cycles import Cycle, cycled_frames
from dustlens.operators.fonts import font_of, glyph_grid, preview_text, rendered
from dustlens.operators.lookups import deduped_names
from dustlens.sources.codecs import lzw_encode

#: Formats for each kind, the default one first.
FORMATS = {"raster": ("png", "apng", "gif", "gif-cycled", "apng-cycled", "palette-swatch"), "font": ("bmfont", "png"), "audio": ("wav",), "palette": ("gpl", "palette-swatch"), "text": ("txt", "md"), "document": ("md", "txt"), "tracker": ("tracker-json",), "vector": ("png", "svg"), "opaque": ("bin",)}
MEDIA = {"png": "image/png", "palette-swatch": "image/png", "apng": "image/apng", "gif": "image/gif", "gif-cycled": "image/gif", "apng-cycled": "image/apng", "bmfont": "text/plain", "tracker-json": "application/json", "wav": "audio/wav", "gpl": "text/plain", "svg": "image/svg+xml", "txt": "text/plain", "md": "text/markdown", "bin": "application/octet-stream", "metadata-json": "application/json", "html-report": "text/html"}
ENDINGS = {"palette-swatch": "png", "apng": "png", "gif-cycled": "gif", "apng-cycled": "png", "bmfont": "fnt", "tracker-json": "json", "metadata-json": "json", "html-report": "html"}


def png(width: int, height: int, rgba: bytes) -> bytes:
    """RGBA, or RGB where all is opaque."""
    pixels = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    alpha = bool((pixels[..., 3] != 255).any())
    rows = (pixels if alpha else pixels[..., :3]).reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6 if alpha else 2, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def apng(width: int, height: int, frames: list[tuple[int, bytes]]) -> bytes:
    """Whole RGBA frames that repeat for ever; the first one is also the still picture."""
    out = [b"\x89PNG\r\n\x1a\n", _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)), _chunk(b"acTL", struct.pack(">II", len(frames), 0))]
    number = 0
    for i, (ms, rgba) in enumerate(frames):
        out.append(_chunk(b"fcTL", struct.pack(">IIIIIHHBB", number, width, height, 0, 0, min(ms, 65535), 1000, 0, 0)))
        lines = b"".join(b"\0" + rgba[y * width * 4 : (y + 1) * width * 4] for y in range(height))
        number += 1
        if i:
            out.append(_chunk(b"fdAT", struct.pack(">I", number) + zlib.compress(lines)))
            number += 1
        else:
            out.append(_chunk(b"IDAT", zlib.compress(lines)))
    return b"".join([*out, _chunk(b"IEND", b"")])


def gif(width: int, height: int, frames: list[tuple[int, bytes]]) -> bytes | None:
    """Frames with a table each; None where one has half-transparent pixels or over 256 colours, as nothing is quantized."""
    loop = b"\x21\xff\x0bNETSCAPE2.0\3\1\0\0\0" if len(frames) > 1 else b""
    out = [struct.pack("<6sHHBBB", b"GIF89a", width, height, 0, 0, 0), loop]
    for ms, rgba in frames:
        pixels = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
        if ((pixels[:, 3] > 0) & (pixels[:, 3] < 255)).any():
            return None
        colours, index = np.unique(np.where(pixels[:, 3:] > 0, pixels, 0).astype(np.uint8).view(np.uint32).reshape(-1), return_inverse=True)
        if len(colours) > 256:
            return None
        rows = colours.view(np.uint8).reshape(-1, 4)
        bits = max(1, (len(rows) - 1).bit_length())
        clear = np.flatnonzero(rows[:, 3] == 0)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 8 | int(clear.size > 0), min(round(ms / 10), 65535), int(clear[0]) if clear.size else 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, height, 0x80 | bits - 1) + rows[:, :3].tobytes() + bytes(3 * ((1 << bits) - len(rows))))
        depth = max(2, bits)
        packed = lzw_encode(index.astype(np.uint8).tobytes(), depth)
        out.append(bytes([depth]) + b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0")
    return b"".join([*out, b";"])


def bmfont(name: str, width: int, height: int, metadata: list[dict]) -> bytes:
    """A text descriptor of a strip of glyphs; the page is the resource's PNG. Glyphs carry offset and width, or follow each other by 16 pixels."""
    own = {m["key"]: m["value"] for m in metadata}
    glyphs = [(k[6:], [int(x) for x in v.split(",")]) for k, v in own.items() if k.startswith("glyph.") and k[6:].isdigit()]
    lines = [f'info face="{name}" size={height} unicode=0', f"common lineHeight={height} base={own.get('baseline', height)} scaleW={width} scaleH={height} pages=1 packed=0", f'page id=0 file="{file_name(name, "png")}"', f"chars count={len(glyphs)}"]
    for i, (code, v) in enumerate(glyphs):
        x, w, step = (v[0], v[1], v[2] + v[3]) if len(v) == 4 else (16 * i, v[2], v[2] - v[0] + int(own.get("tracking", 0)))
        lines.append(f"char id={code} x={x} y=0 width={w} height={height} xoffset={v[3] if len(v) == 4 else -v[0]} yoffset=0 xadvance={step} page=0 chnl=15")
    return ("\n".join(lines) + "\n").encode()


def wav(rate: int, bits: int, channels: list[list[int]]) -> bytes:
    """8 bits are stored unsigned, more as little-endian two's complement."""
    size = bits // 8
    frames = np.stack([np.asarray(c, np.int64) for c in channels], axis=1) if channels else np.zeros((0, 0), np.int64)
    if bits == 8:
        body = (frames + 128).astype(np.uint8).tobytes()
    else:
        body = np.ascontiguousarray(frames.astype("<i4").reshape(-1)).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
    align = size * len(channels)
    form = struct.pack("<HHIIHH", 1, len(channels), rate, rate * align, align, bits)
    data = b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(data) + 4) + b"WAVE" + data


def gpl(colours: list[dict]) -> bytes:
    """A palette as text; with a fourth field where any colour is not opaque."""
    alpha = any(c["a"] < 255 for c in colours)
    head = "GIMP Palette\n" + ("Channels: RGBA\n" if alpha else "") + "#\n"
    return (head + "".join(" ".join(f"{c[k]:3d}" for k in ("rgba" if alpha else "rgb")) + f"\tcolour {i}\n" for i, c in enumerate(colours))).encode()


def swatch(colours: list[dict], cell: int = 16) -> bytes:
    """A square of cells, row by row."""
    columns = math.ceil(math.sqrt(len(colours)))
    rows = math.ceil(len(colours) / columns)
    out = bytearray(columns * cell * rows * cell * 4)
    for i, c in enumerate(colours):
        line = bytes([c["r"], c["g"], c["b"], c["a"]]) * cell
        for y in range(cell):
            at = (((i // columns) * cell + y) * columns + i % columns) * cell * 4
            out[at : at + len(line)] = line
    return png(columns * cell, rows * cell, bytes(out))


_MARKUP = re.compile("[" + re.escape(MARKDOWN_SIGNS) + "]")


def markdown(text: str) -> bytes:
    """Plain text, with what Markdown would read as markup escaped; lines stay lines."""
    return _MARKUP.sub(lambda m: "\\" + m.group(), text).replace("\n", "  \n").encode()


def _facts(row: dict) -> dict:
    """What a resource is, by its kind."""
    kind = row["kind"]
    cycles = [{"low": c["low"], "high": c["high"], "direction": c["direction"], "stepDurationMs": c["step"]} for c in row.get("cycles") or []]
    if kind == "group":
        return {"children": len(row.get("children") or [])}
    if kind == "raster" and row["rgba"] is not None:
        frames = row.get("frames") or []
        out = {"archetype": "animation" if frames else "image", "width": row["width"], "height": row["height"], "hasAlpha": bool((np.frombuffer(row["rgba"], np.uint8)[3::4] < 255).any()), "paletteSize": len(row["colours"] or []), "colourCycles": cycles}
        return out | ({"frames": len(frames), "frameDurationsMs": [f["ms"] for f in frames]} if frames else {})
    if kind == "palette":
        return {"archetype": "palette", "colourCycles": cycles, "colours": [{k: c[k] for k in "rgba"} for c in row["colours"] or []]}
    if kind == "audio":
        pcm = row["pcm"] or []
        return {"archetype": "sound", "sampleRate": row["rate"], "bitsPerSample": row["bits"], "channels": len(pcm), "samplesPerChannel": len(pcm[0]) if pcm else 0}
    if kind in ("text", "document", "tracker") and row["text"] is not None:
        return {"archetype": kind, "utf8Bytes": len(row["text"].encode())} | ({"paragraphs": row["text"].count("\n") + 1} if kind == "document" else {"rows": row["text"].count("\n") + 1} if kind == "tracker" else {})
    return {"archetype": kind, "rawDataAvailable": row["data"] is not None, "bytes": len(row["data"] or b"")}


def metadata_json(row: dict) -> bytes:
    """A resource, its metadata in order, the paths of its direct children, its failure and what it is."""
    value = lambda v: {"kind": "integer", "value": int(v)} if re.fullmatch(r"-?(0|[1-9][0-9]{0,17})", v) else {"kind": "string", "value": v}
    document = {"schema": "resource-metadata.v1", "path": row["path"], "type": row["type_id"], "kind": row["kind"], "metadata": [{"key": m["key"], **value(m["value"])} for m in row["metadata"]]}
    if row.get("failure"):
        document["failure"] = {"format": row["failure"].partition(":")[0], "message": row["failure"].partition(": ")[2]}
    document |= {"children": [c["path"] for c in row.get("children") or []], "resource": _facts(row)}
    return (json.dumps(document, ensure_ascii=False, indent=2) + "\n").encode()


def palette_of(rgba: bytes) -> list[tuple[int, int, int, int]]:
    """The distinct colours of a picture, in order of first appearance."""
    colours, first = np.unique(np.frombuffer(rgba, np.uint8).reshape(-1, 4), axis=0, return_index=True)
    return [tuple(map(int, c)) for c in colours[np.argsort(first)]]


def _image(label: str, media: str, data: bytes) -> str:
    return f'<section><h2>{label}</h2><img src="data:{media};base64,{base64.b64encode(data).decode()}" alt="{label}"></section>'


def html_report(row: dict) -> bytes:
    """A page without outer parts: title, type, what the resource looks or sounds like, and its metadata."""
    esc = html.escape
    kind, body = row["kind"], ""
    if kind == "font" and row["rgba"] is not None:
        font = font_of(row)
        sample, every = rendered(font, preview_text(font)), glyph_grid(font)
        body = "".join(_image(label, "image/png", png(p.shape[1], p.shape[0], p.tobytes())) for label, p in (("Sample text", sample), ("Glyph grid", every)))
    elif kind in ("raster", "vector") and row["rgba"] is not None:
        moving = row.get("frames")
        body = _image("Preview", "image/png", apng(row["width"], row["height"], [(f["ms"], f["rgba"]) for f in moving]) if moving else png(row["width"], row["height"], row["rgba"]))
    elif kind == "palette" and row["colours"]:
        body = _image("Palette swatch", "image/png", swatch(row["colours"]))
    elif kind == "audio" and row["pcm"] is not None:
        body = f'<section><h2>Audio</h2><audio controls src="data:audio/wav;base64,{base64.b64encode(wav(row["rate"], row["bits"], row["pcm"])).decode()}"></audio></section>'
    elif kind in ("text", "document", "tracker") and row["text"] is not None:
        body = f"<section><h2>Text</h2><pre>{esc(row['text'])}</pre></section>"
    elif kind == "group":
        items = "".join(f"<li><code>{esc(c['path'])}</code> — {esc(c['type_id'])}</li>" for c in row.get("children") or []) or "<li>None</li>"
        body = f"<section><h2>Children</h2><ul>{items}</ul></section>"
    else:
        failed = f"<h2>Decode failure</h2><pre>{esc(row['failure'])}</pre>" if row.get("failure") else "<h2>Opaque resource</h2>"
        body = f"<section>{failed}<p>{len(row['data'] or b'')} retained byte(s).</p></section>"
    facts = f"<section><details open><summary>Metadata JSON</summary><pre>{esc(metadata_json(row).decode())}</pre></details></section>"
    head = f"<h1>{esc(row['path'])}</h1><p><code>{esc(row['type_id'])}</code></p>"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{esc(row["path"])}</title></head><body>{head}{body}{facts}</body></html>\n'.encode()


def _frames(row: dict) -> list[tuple[int, bytes]]:
    return [(f["ms"], f["rgba"]) for f in row.get("frames") or [{"ms": 0, "rgba": row["rgba"]}]]


def _cycled(row: dict) -> list[tuple[int, bytes]]:
    palette = np.array([[c[k] for k in "rgba"] for c in row["colours"]], np.uint8)
    return cycled_frames(row["index"], palette, [Cycle(c["low"], c["high"], c["step"], c["direction"]) for c in row["cycles"]])


def _png(row: dict) -> bytes | None:
    return png(row["width"], row["height"], row["rgba"]) if row["rgba"] is not None else None


def _gif(row: dict) -> bytes | None:
    return gif(row["width"], row["height"], _frames(row)) if row["rgba"] is not None else None


def _apng(row: dict) -> bytes | None:
    return apng(row["width"], row["height"], _frames(row)) if row["rgba"] is not None else None


def _turning(encode: Callable[[int, int, list[tuple[int, bytes]]], bytes | None]) -> Callable[[dict], bytes | None]:
    return lambda row: encode(row["width"], row["height"], _cycled(row)) if row.get("cycles") and row.get("index") is not None else None


def _tracker(row: dict) -> bytes | None:
    if row["kind"] != "tracker":
        return None
    return json.dumps({"schema": 1, "type": row["type_id"], "path": row["path"], "text": row["text"], "metadata": {m["key"]: m["value"] for m in row["metadata"]}}, ensure_ascii=False).encode()


def _colours(row: dict) -> list[dict]:
    """A resource's palette; of a picture without one its own colours, if they are at most 256."""
    if row["colours"] or row["rgba"] is None or row["kind"] != "raster":
        return row["colours"] or []
    own = palette_of(row["rgba"])
    return [dict(zip("rgba", c, strict=True)) for c in own] if len(own) <= 256 else []


#: Encoders by format: a resource's row to bytes, or None where the format cannot hold it. ``register`` adds to them.
ENCODERS: dict[str, Callable[[dict], bytes | None]] = {
    "png": _png, "apng": _apng, "gif": _gif, "gif-cycled": _turning(gif), "apng-cycled": _turning(apng), "tracker-json": _tracker,
    "bmfont": lambda row: bmfont(row["path"], row["width"], row["height"], row["metadata"]) if row["kind"] == "font" and row["rgba"] is not None else None,
    "wav": lambda row: wav(row["rate"], row["bits"], row["pcm"]) if row["pcm"] is not None else None,
    "gpl": lambda row: gpl(own) if (own := _colours(row)) else None,
    "palette-swatch": lambda row: swatch(own) if (own := _colours(row)) else None,
    "txt": lambda row: row["text"].encode() if row["text"] is not None else None,
    "md": lambda row: markdown(row["text"]) if row["text"] is not None else None,
    "bin": lambda row: row["data"],
    "svg": lambda row: row["text"].encode() if row["kind"] == "vector" else None,
    "metadata-json": metadata_json, "html-report": html_report,
}


def default_format(row: dict) -> str:
    """The format of a resource's kind; moving pictures go to GIF if it can hold them, else to APNG."""
    if row["kind"] == "raster" and row.get("frames"):
        return "gif" if _gif(row) is not None else "apng"
    return FORMATS.get(row["kind"], ("",))[0]


def file_name(path: str, form: str) -> str:
    return f"{portable_path(path) or 'resource'}.{ENDINGS.get(form, form)}"


def with_children(resources: DataFrame) -> DataFrame:
    """``resources`` and children: path and type of each one's direct children, in order; what whole-tree exports need."""
    parent = F.regexp_replace("path", "/[^/]+$", "")
    below = resources.select("source_id", parent.alias("parent"), "ordinal", "path", "type_id").where("parent != ''")
    lists = below.groupBy("source_id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "type_id"))).alias("children"))
    return resources.join(lists, ["source_id", "path"], "left")


def artifacts(resources: DataFrame, form: str | None = None) -> DataFrame:
    """(source_id, path, ordinal, format, filename, media_type, data) for each resource that ``form``, or its kind's default, can hold.

    File names follow the paths, a folder for each but the last segment; of resources of one
    source whose names are equal but for case, later ones get -2, -3 and so on (see
    ``lookups.deduped_names``). A font's descriptor comes with its page, as a PNG.
    """
    encoders, known = dict(ENCODERS), dict(MEDIA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("source_id", pa.int64()), ("path", pa.string()), ("ordinal", pa.int32())] + [(n, pa.string()) for n in ("format", "name", "media_type")] + [("data", pa.binary())]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = form or default_format(row)
                parts = [(own, encoders[own](row))] if own in encoders else []
                if own == "bmfont" and parts[0][1] is not None:
                    parts.append(("png", _png(row)))
                out = [{"source_id": row["source_id"], "path": row["path"], "ordinal": row["ordinal"], "format": own, "name": file_name(row["path"], f), "media_type": known[f], "data": data} for f, data in parts if data is not None]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(kinds))

    made = resources.mapInArrow(run, "source_id long, path string, ordinal int, format string, name string, media_type string, data binary")
    return deduped_names(made, "source_id", "ordinal", "name").withColumnRenamed("unique_name", "filename").select("source_id", "path", "ordinal", "format", "filename", "media_type", "data")


def write_artifacts(made: DataFrame, folder: str) -> DataFrame:
    """Writes each artifact to folder/source_id/filename, and returns (source_id, filename, bytes) of what was written.

    Tasks write by Arrow's file systems, so that folder may be any address those know; a file is
    written under a name of its own and then moved, so that a task that runs twice leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for source, name, data in zip(*(batch.column(c).to_pylist() for c in ("source_id", "filename", "data")), strict=True):
                path = f"{base}/{source}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("filename"), pc.binary_length(batch.column("data")).cast(pa.int64())], names=["source_id", "filename", "bytes"])

    return made.select("source_id", "filename", "data").mapInArrow(run, "source_id long, filename string, bytes long")


def register(name: str, encode: Callable[[dict], bytes | None], media: str) -> None:
    """Adds a format for ``artifacts(resources, name)``; tasks are sent the encoder with their function."""
    ENCODERS[name], MEDIA[name] = encode, media
