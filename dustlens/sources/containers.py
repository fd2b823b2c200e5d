"""Parsers of archives, disks, databases and game files."""

from __future__ import annotations

import json
import lzma
import struct
import zlib

import numpy as np

from dustlens.sources.codecs import crc16, inflate, unpack_lh5
from dustlens.sources.doom import scenery
from dustlens.sources.images import bmp, iff_chunks, png
from dustlens.sources.listings import spectrum_basic
from dustlens.sources.model import Audio, Node, Raster, Reader, need, safe_name


def _tree(root: str, type_id: str, metadata: list, files: list[tuple[str, list, bytes | None]]) -> list[Node]:
    """A group, its files, and a group for each folder on the way, in order; a clash of names is an error."""
    out, seen = [Node(root, type_id, "group", metadata)], {}
    for name, own, data in files:
        parts = name.split("/")
        for i in range(1, len(parts)):
            folder = "/".join(parts[:i])
            need(seen.setdefault(folder, "group") == "group", f"{folder!r} is a file and a folder")
            if (node := Node(f"{root}/{folder}", "folder", "group", [])) not in out:
                out.append(node)
        if data is None:
            need(seen.setdefault(name, "group") == "group", f"{name!r} is a file and a folder")
            if not any(n.path == f"{root}/{name}" for n in out):
                out.append(Node(f"{root}/{name}", "folder", "group", own))
        else:
            need(name not in seen, f"{name!r} comes twice")
            seen[name] = "file"
            out.append(Node(f"{root}/{name}", "file", "opaque", own, data=data))
    return out


def zip_archive(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    end = data.rfind(b"PK\5\6", max(0, len(data) - 65557))
    need(end >= 0, "no end record")
    disk, first_disk, here, count, size, start, note = r.unpack("<HHHHIIH", end + 4)
    need(not disk and not first_disk and here == count and end + 22 + note == len(data) and start + size == end, "bad end record")
    at, files = start, []
    for _ in range(count):
        sign, _, _, flags, method, _, _, crc, packed, unpacked, n, extra, remark, _, _, _, local = r.unpack("<IHHHHHHIIIHHHHHII", at)
        need(sign == 0x02014B50 and not flags & 1 and method in (0, 8) and 0xFFFFFFFF not in (packed, unpacked, local), "unsupported member")
        raw = r.take(at + 46, n)
        at += 46 + n + extra + remark
        lsign, _, lflags, lmethod, _, _, _, _, _, ln, lextra = r.unpack("<IHHHHHIIIHH", local)
        need(lsign == 0x04034B50 and lflags == flags and lmethod == method and r.take(local + 30, ln) == raw, "local and central records differ")
        path = safe_name(raw.decode("utf-8" if flags & 2048 else "cp437"))
        body = r.take(local + 30 + ln + lextra, packed)
        own = [("compression", method), ("data.length", unpacked)]
        if raw.endswith(b"/"):
            files.append((path, own, None))
            continue
        try:
            content = body if method == 0 else inflate(body, unpacked + 1)
            need(len(content) == unpacked and zlib.crc32(content) == crc, "the checksum is wrong")
        except ValueError as e:  # one bad member does not spoil the others
            own, content = [*own, ("failure", str(e))], b""
        files.append((path, own, content))
    need(at == end, "data behind the central directory")
    return _tree("/archive", "archive.zip", [("entries", count), ("comment", data[end + 22 :].decode("cp437"))], files)


def openraster(data: bytes, name: str) -> list[Node]:
    nodes = zip_archive(data, name)
    own = {n.path.removeprefix("/archive/"): n for n in nodes if n.data is not None}
    need(len(own) > 1 and next(iter(own)) == "mimetype" and own["mimetype"].data == b"image/openraster", "no mimetype member")
    import xml.etree.ElementTree as tree

    need("stack.xml" in own and b"<!" not in own["stack.xml"].data, "no plain layer stack")
    image = tree.fromstring(own["stack.xml"].data)
    width, height, out = int(image.get("w", 0)), int(image.get("h", 0)), []
    for place, path, role in (("/image", "mergedimage.png", "canonical merged image"), ("/thumbnail", "Thumbnails/thumbnail.png", "document thumbnail")):
        if path in own:
            picture = png(own[path].data, path)[0]
            size = [("canvas.width", width), ("canvas.height", height)] if place == "/image" else []
            out.append(picture._replace(path=place, type_id="image.openraster", metadata=[("role", role), *size]))
    layers = list(image.iter("layer"))
    out.append(Node("/layers", "image.openraster-layers", "group", [("openraster.version", image.get("version", "")), ("layers", len(layers))]))
    for i, layer in enumerate(layers, 1):
        src = layer.get("src", "")
        need(src in own, f"no member {src!r}")
        told = [(f"layer.{k}", v) for k, v in layer.attrib.items()]
        out.append(png(own[src].data, src)[0]._replace(path=f"/layers/{i}", type_id="image.openraster-layer", metadata=told))
    return out


def sqlite(data: bytes, name: str) -> list[Node]:
    """Tables with their rows. No column names or affinity; a column that stands for the row id is null, as stored."""
    r = Reader(data)
    need(r.take(0, 16) == b"SQLite format 3\0", "no database")
    (page,) = r.unpack(">H", 16)
    page = 65536 if page == 1 else page
    write, read, spare, most, least, leaf = r.unpack(">6B", 18)
    pages, schema_format, version, encoding, application = r.unpack(">I", 28)[0], r.unpack(">I", 44)[0], r.unpack(">I", 60)[0], r.unpack(">I", 56)[0], r.unpack(">I", 68)[0]
    need(page >= 512 and page & (page - 1) == 0 and (write, read) == (1, 1) and (most, least, leaf) == (64, 32, 32) and encoding == 1 and pages * page == len(data), "unsupported database")
    usable = page - spare

    def varint(at: int) -> tuple[int, int]:
        value = 0
        for i in range(9):
            b = r.take(at + i, 1)[0]
            if i == 8:
                value = value << 8 | b
            else:
                value = value << 7 | b & 127
                if b < 128:
                    break
        return value - (1 << 64) if value >= 1 << 63 else value, at + i + 1

    def payload(at: int, size: int, most: int) -> bytes:
        if size <= most:
            return r.take(at, size)
        low = (usable - 12) * 32 // 255 - 23
        local = low + (size - low) % (usable - 4)
        local = local if local <= most else low
        out, (following,), seen = r.take(at, local), r.unpack(">I", at + local), set()
        while len(out) < size:
            need(0 < following <= pages and following not in seen, "bad overflow chain")
            seen.add(following)
            base = (following - 1) * page
            out += r.take(base + 4, min(usable - 4, size - len(out)))
            (following,) = r.unpack(">I", base)
        return out

    def record(body: bytes) -> list:
        own = Reader(body)

        def number(at: int) -> tuple[int, int]:
            value = 0
            for i in range(9):
                b = own.take(at + i, 1)[0]
                value = value << 8 | b if i == 8 else value << 7 | b & 127
                if b < 128:
                    break
            return value, at + i + 1

        head, at = number(0)
        kinds, values, place = [], [], head
        while at < head:
            kind, at = number(at)
            kinds.append(kind)
        for kind in kinds:
            need(kind not in (10, 11), "a reserved type")
            if kind == 0:
                values.append(None)
            elif kind in (8, 9):
                values.append(kind - 8)
            elif kind < 8:
                size = (0, 1, 2, 3, 4, 6, 8, 8)[kind]
                raw = own.take(place, size)
                values.append(struct.unpack(">d", raw)[0] if kind == 7 else int.from_bytes(raw, "big", signed=True))
                place += size
            else:
                size = (kind - 12) // 2
                raw = own.take(place, size)
                values.append(raw.decode("utf-8") if kind % 2 else raw)
                place += size
        return values

    def rows(root: int, seen: set[int], depth: int = 0) -> list[tuple[int | None, list]]:
        need(0 < root <= pages and root not in seen and depth < 64, "bad tree")
        seen.add(root)
        base = (root - 1) * page
        top = base + (100 if root == 1 else 0)
        kind, _, cells = r.unpack(">BHH", top)
        need(kind in (2, 5, 10, 13), "not a page of a tree")
        inner = kind in (2, 5)
        places = r.unpack(f">{cells}H", top + (12 if inner else 8))
        out = []
        for p in places:
            at = base + p
            if inner:
                out += rows(r.unpack(">I", at)[0], seen, depth + 1)
                at += 4
            if kind == 13:
                size, at = varint(at)
                rowid, at = varint(at)
                out.append((rowid, record(payload(at, size, usable - 35))))
            elif kind in (2, 10):
                size, at = varint(at)
                out.append((None, record(payload(at, size, (usable - 12) * 64 // 255 - 23))))
        return out + (rows(r.unpack(">I", top + 8)[0], seen, depth + 1) if inner else [])

    tables = [v for _, v in rows(1, set()) if v[0] == "table" and v[3]]
    out = [Node("/table", "database.sqlite3", "group", [("page-size", page), ("usable-page-size", usable), ("schema-format", schema_format), ("text-encoding", "UTF-8"), ("user-version", version), ("application-id", application), ("tables", len(tables))])]
    for _, table, _, root, text in tables:
        found = rows(root, set())
        out.append(Node(f"/table/{table}", "database.table", "group", [("table.name", table), ("table.root-page", root), ("table.without-rowid", int("WITHOUT ROWID" in (text or "").upper())), ("table.rows", len(found))]))
        out.append(Node(f"/table/{table}/schema", "text", "text", [], text=text))
        escape = str.maketrans({"\\": "\\\\", "\t": "\\t", "\r": "\\r", "\n": "\\n"})
        lines = ["\t".join(["" if i is None else str(i), *["NULL" if v is None else f"x'{v.hex()}'" if isinstance(v, bytes) else str(v).translate(escape) for v in values]]) for i, values in found]
        out.append(Node(f"/table/{table}/rows", "text", "text", [], text="\n".join(lines)))
    return out


def wad(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    kind, count, start = r.unpack("<4sII", 0)
    need(kind in (b"IWAD", b"PWAD") and start + 16 * count <= len(data), "no WAD")
    out = [Node("/wad", "doom.wad", "group", [("wad.kind", kind.decode()), ("wad.entries", count), ("wad.directory-offset", start)]), Node("/wad/lumps", "folder", "group", [])]
    sounds, lumps = [], []
    for i in range(count):
        at, size, raw = r.unpack("<II8s", start + 16 * i)
        label = raw.split(b"\0")[0].decode("latin-1")
        body = r.take(at, size) if size else b""
        lumps.append((label, body))
        metadata = [("wad.index", i), ("wad.name", label), ("wad.offset", at), ("wad.size", size)]
        if label == "PLAYPAL" and size and size % 768 == 0:
            for p in range(size // 768):
                own = body[768 * p : 768 * p + 768]
                out.append(Node(f"/wad/lumps/{i}-{label}/palette-{p}", "doom.palette", "palette", [*metadata, ("wad.palette-index", p)], palette=[(*own[c : c + 3], 255) for c in range(0, 768, 3)]))
        else:
            out.append(Node(f"/wad/lumps/{i}-{label}", "doom.lump", "opaque", metadata, data=body))
        if label.startswith("DS") and size >= 8:
            form, rate, samples = struct.unpack_from("<HHI", body)
            if form == 3 and samples + 8 <= size:
                sounds.append(Node(f"/wad/sounds/{i}-{label}", "doom.sound", "audio", [("sound.format", 3), ("sound.sample-rate", rate), ("sound.samples", samples)], audio=Audio(rate, 8, [[b - 128 for b in body[8 : 8 + samples]]])))
    return out + ([Node("/wad/sounds", "folder", "group", []), *sounds] if sounds else []) + scenery(lumps)


def iff(data: bytes, name: str) -> list[Node]:
    kind, chunks = iff_chunks(data)
    return [Node("/chunks", "amiga.iff", "group", [("form.type", kind)]), *[Node(f"/chunks/{i}-{k.strip()}", "iff.chunk", "opaque", [("chunk.id", k), ("data.length", len(body))], data=body) for i, (k, body) in enumerate(chunks)]]


def asar(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    four, header, inner, text = r.unpack("<IIII", 0)
    need(four == 4 and inner == header - 4 and text <= inner - 4, "no archive header")
    try:
        manifest = json.loads(r.take(16, text))
    except (ValueError, RecursionError):
        raise ValueError("the manifest is no JSON") from None
    base, files = 8 + header, []

    def walk(node: dict, prefix: str) -> None:
        for label, entry in node.get("files", {}).items():
            need("/" not in label and isinstance(entry, dict), "bad entry")
            path = safe_name(prefix + label)
            if "files" in entry:
                files.append((path, [], None))
                walk(entry, path + "/")
            elif not entry.get("unpacked") and "size" in entry:
                files.append((path, [("data.length", entry["size"]), ("asar.executable", int(bool(entry.get("executable"))))], r.take(base + int(entry["offset"]), entry["size"])))

    need(isinstance(manifest, dict), "the manifest is no object")
    walk(manifest, "")
    return _tree("/archive", "archive.electron-asar", [("entries", len(files)), ("header.length", header), ("manifest.length", text), ("data.length", len(data) - base)], files)


def tap(data: bytes, name: str) -> list[Node]:
    r, at, blocks, out, number = Reader(data), 0, [], [], 0
    while at < len(data):
        (size,) = r.unpack("<H", at)
        need(size >= 2, "a block is too short")
        blocks.append(r.take(at + 2, size))
        at += 2 + size
    need(bool(blocks), "no blocks")

    def fine(block: bytes) -> bool:
        total = 0
        for b in block:
            total ^= b
        return total == 0

    head = None
    for block in blocks:
        if head is None and block[0] == 0 and len(block) == 19 and fine(block):
            head = block
            continue
        number += 1
        metadata: list[tuple[str, str | int]] = [("data.length", len(block) - 2), ("tap.checkbit-valid", int(fine(block)))]
        label = "block"
        if head:
            kind, title, size, a, b = struct.unpack("<B10sHHH", head[1:18])
            label = {0: "basic", 1: "array", 2: "array", 3: "code"}.get(kind, "block")
            metadata += [("tap.name", title.decode("latin-1").rstrip())]
            metadata += [("code.start-address", a), ("code.length", size), ("code.parameter-2", b)] if kind == 3 else [("basic.variable-area-offset", b), *([("basic.autostart-line", a)] if a < 32768 else [])] if kind == 0 else []
        if label == "basic":
            try:
                out.append(Node(f"/listing/{number}", "zx-spectrum.basic", "text", metadata, text=spectrum_basic(block[1 : 1 + b if b <= len(block) - 2 else len(block) - 1])))
            except ValueError as e:
                out.append(Node(f"/listing/{number}", "zx-spectrum.basic", "opaque", [*metadata, ("failure", str(e))], data=block[1:-1]))
        else:
            out.append(Node(f"/{label}/{number}", f"zx-spectrum.{label}", "opaque", metadata, data=block[1:-1]))
        head = None
    return [Node("/", "zx-spectrum.tap", "group", [("blocks", len(blocks))]), *out]


def tzx(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    need(r.take(0, 8) == b"ZXTape!\x1a", "no tape")
    at, records = 10, b""
    while at < len(data):
        kind = data[at]
        if kind == 0x10:
            (size,) = r.unpack("<H", at + 3)
            records += r.take(at + 3, size + 2)
            at += 5 + size
            continue
        fixed = {0x12: 4, 0x20: 2, 0x21: None, 0x22: 0, 0x24: 2, 0x25: 0, 0x30: None, 0x5A: 9}
        need(kind in fixed or kind in (0x11, 0x13, 0x14, 0x32, 0x33, 0x35), "unknown block")
        if kind in fixed:
            size = fixed[kind] if fixed[kind] is not None else 1 + r.take(at + 1, 1)[0]
        elif kind == 0x13:
            size = 1 + 2 * r.take(at + 1, 1)[0]
        elif kind == 0x33:
            size = 1 + 3 * r.take(at + 1, 1)[0]
        elif kind == 0x32:
            size = 2 + r.unpack("<H", at + 1)[0]
        elif kind == 0x35:
            size = 20 + r.unpack("<I", at + 17)[0]
        else:
            skip = 18 if kind == 0x11 else 10
            size = skip + int.from_bytes(r.take(at + 1 + skip - 3, 3), "little")
        r.take(at + 1, size)
        at += 1 + size
    nodes = tap(records, name) if records else [Node("/", "", "group", [])]
    return [nodes[0]._replace(type_id="zx-spectrum.tzx"), *nodes[1:]]


def d64(data: bytes, name: str) -> list[Node]:
    sizes = {174848: (35, 0), 175531: (35, 683), 196608: (40, 0), 197376: (40, 768)}
    need(len(data) in sizes, "not the size of a disk")
    tracks, errors = sizes[len(data)]
    sectors = [21 if t <= 17 else 19 if t <= 24 else 18 if t <= 30 else 17 for t in range(1, tracks + 1)]

    def sector(t: int, s: int) -> bytes:
        need(1 <= t <= tracks and s < sectors[t - 1], "a sector is outside of the disk")
        at = 256 * (sum(sectors[: t - 1]) + s)
        return data[at : at + 256]

    def chain(t: int, s: int) -> tuple[bytes, int]:
        out, seen = b"", set()
        while t:
            need((t, s) not in seen, "a chain runs in a circle")
            seen.add((t, s))
            block = sector(t, s)
            out += block[2:] if block[0] else block[2 : block[1] + 1]
            t, s = block[0], block[1]
        return out, len(seen)

    def petscii(raw: bytes) -> str:
        return "".join(chr(b) if 32 <= b < 91 and b not in b'/\\:*?"<>|' else f"_{b:02X}" for b in raw.rstrip(b"\xa0"))

    bam = sector(18, 0)
    t, s, seen, files = 18, 1, set(), []
    while t:
        need((t, s) not in seen, "the directory runs in a circle")
        seen.add((t, s))
        block = sector(t, s)
        for i in range(0, 256, 32):
            e = block[i : i + 32]
            if e[2] & 15:
                body, used = chain(e[3], e[4]) if e[3] else (b"", 0)
                label = petscii(e[5:21]) or "_"
                files.append((f"{len(files) + 1}-{label}", [("d64.name", label), ("d64.file-type", ("DEL", "SEQ", "PRG", "USR", "REL")[min(e[2] & 15, 4)]), ("d64.closed", e[2] >> 7), ("d64.locked", e[2] >> 6 & 1), ("d64.start-track", e[3]), ("d64.start-sector", e[4]), ("d64.declared-sectors", e[30] | e[31] << 8), ("d64.actual-sectors", used), ("data.length", len(body))], body))
        t, s = block[0], block[1]
    return _tree("/disk", "commodore.d64", [("disk.name", petscii(bam[144:160])), ("disk.id", petscii(bam[162:164])), ("tracks", tracks), ("sectors", sum(sectors)), ("error-bytes", errors), ("entries", len(files))], files)


def fat(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    sector, per, reserved, copies, entries, small, media, fat_size = r.unpack("<HBHBHHBH", 11)
    total = small or r.unpack("<I", 32)[0]
    need(128 <= sector <= 4096 and sector & (sector - 1) == 0 and 0 < per <= 128 and per & (per - 1) == 0 and 1 <= copies <= 4 and reserved and fat_size and media >= 0xF0 and total * sector == len(data), "no FAT volume of this size")
    fats = [r.take((reserved + i * fat_size) * sector, fat_size * sector) for i in range(copies)]
    table = fats[0]
    need(all(f == table for f in fats) and table[0] == media and table[1:3] == b"\xff\xff", "the tables differ")
    root = (reserved + copies * fat_size) * sector
    first = root + -(-entries * 32 // sector) * sector
    clusters = (total * sector - first) // (sector * per)
    need(clusters < 65525, "no FAT12 or FAT16 volume")
    small_fat = clusters < 4085

    def chain(c: int) -> bytes:
        out, seen = b"", set()
        while c < (0xFF8 if small_fat else 0xFFF8):
            need(2 <= c < clusters + 2 and c not in seen, "bad chain")
            seen.add(c)
            out += r.take(first + (c - 2) * sector * per, sector * per)
            if small_fat:
                v = int.from_bytes(table[c * 3 // 2 : c * 3 // 2 + 2], "little")
                c = v >> 4 if c & 1 else v & 0xFFF
            else:
                c = int.from_bytes(table[2 * c : 2 * c + 2], "little")
        return out

    files, label = [], ""

    def folder(raw: bytes, prefix: str, depth: int) -> None:
        nonlocal label
        need(depth < 32, "folders are too deep")
        for i in range(0, len(raw) - 31, 32):
            e = raw[i : i + 32]
            if e[0] == 0:
                return
            if e[0] in (0xE5, 0x2E) or e[11] == 15:
                continue
            stem, ending = e[:8].decode("cp437").rstrip(), e[8:11].decode("cp437").rstrip()
            if e[11] & 8:
                label = label or (stem + ending)
                continue
            path = prefix + stem + ("." + ending if ending else "")
            start, size = struct.unpack_from("<HI", e, 26)
            if e[11] & 16:
                files.append((path, [], None))
                folder(chain(start), path + "/", depth + 1)
            else:
                body = chain(start) if size else b""
                need(len(body) >= size, "a file is shorter than its size")
                files.append((path, [("data.length", size)], body[:size]))

    folder(r.take(root, entries * 32), "", 0)
    return _tree("/disk", "filesystem.fat-disk-image", [("filesystem", "FAT12" if small_fat else "FAT16"), ("volume.label", label), ("bytes-per-sector", sector), ("sectors-per-cluster", per), ("reserved-sectors", reserved), ("fat.copies", copies), ("fat.sectors", fat_size), ("root.entries", entries), ("volume.sectors", total), ("clusters", clusters)], files)


def iso9660(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    at, primary = 16 * 2048, None
    while True:
        kind, sign = r.unpack("<B5s", at)
        need(sign == b"CD001", "no volume descriptor")
        primary = r.take(at, 2048) if kind == 1 and primary is None else primary
        if kind == 255:
            break
        at += 2048
    need(primary is not None, "no primary descriptor")
    (block,) = struct.unpack_from("<H", primary, 128)
    files: list = []

    def folder(record: bytes, prefix: str, seen: frozenset[int]) -> None:
        start, size = struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]
        need(start not in seen and len(seen) < 32, "folders run in a circle")
        raw, i = r.take(start * block, size), 0
        while i < len(raw):
            n = raw[i]
            if not n:
                i = (i // block + 1) * block
                continue
            own = raw[i : i + n]
            label = own[33 : 33 + own[32]]
            if label not in (b"\0", b"\1"):
                path = safe_name(prefix + label.decode("latin-1").split(";")[0].rstrip("."))
                if own[25] & 2:
                    files.append((path, [], None))
                    folder(own, path + "/", seen | {start})
                else:
                    a, s = struct.unpack_from("<I", own, 2)[0], struct.unpack_from("<I", own, 10)[0]
                    files.append((path, [("data.length", s)], r.take(a * block, s)))
            i += n

    folder(primary[156:190], "", frozenset())
    text = lambda a, b: primary[a:b].decode("latin-1").rstrip(" \0")
    return _tree("/disc", "filesystem.iso9660", [("layout", "2048"), ("volume.identifier", text(40, 72)), ("system.identifier", text(8, 40)), ("logical-block-size", block), ("volume.blocks", struct.unpack_from("<I", primary, 80)[0]), ("entries", len(files))], files)


def lha(data: bytes, name: str) -> list[Node]:
    """Levels 0 and 1; stored members and those of method 5 are read, others are listed."""
    r, at, files = Reader(data), 0, []
    while at < len(data) and data[at]:
        size, total, method, packed, unpacked, _, _, level, n = r.unpack("<BB5sIIIBBB", at)
        need(method[:1] == b"-" and method[-1:] == b"-" and level in (0, 1) and sum(r.take(at + 2, size)) & 255 == total, "bad header")
        label = r.take(at + 22, n).replace(b"\xff", b"/").decode("latin-1")
        (crc,) = r.unpack("<H", at + 22 + n)
        body_at, skip = at + 2 + size, 0
        if level == 1:
            (extra,) = r.unpack("<H", at + size)
            while extra:
                skip += extra
                (extra,) = r.unpack("<H", body_at + skip - 2)
        body = r.take(body_at + skip, packed - skip)
        own = [("compression", method.decode("latin-1")), ("data.length", unpacked)]
        content = None if method == b"-lhd-" else b""
        if method in (b"-lh0-", b"-lh5-"):
            try:
                content = body if method == b"-lh0-" else unpack_lh5(body, unpacked)
                need(crc16(content) == crc and len(content) == unpacked, "the checksum is wrong")
            except ValueError as e:  # one bad member does not spoil the others
                own, content = [*own, ("failure", str(e))], b""
        elif method != b"-lhd-":
            own.append(("failure", "unsupported method"))
        files.append((safe_name(label), own, content))
        at = body_at + packed
    need(bool(files), "no members")
    return _tree("/archive", "archive.lha", [("entries", len(files))], files)


def icon(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    zero, kind, count = r.unpack("<HHH", 0)
    need(zero == 0 and kind in (1, 2) and count, "no icon")
    word = "icon" if kind == 1 else "cursor"
    out = [Node(f"/{word}", f"windows.{word[:3] if kind == 2 else 'ico'}", "group", [("container.kind", word), ("images", count)])]
    for i in range(count):
        w, h, colours, _, a, b, size, at = r.unpack("<BBBBHHII", 6 + 16 * i)
        body = r.take(at, size)
        metadata = [("directory.width", w or 256), ("directory.height", h or 256), ("directory.colour-count", colours), ("data.offset", at), ("data.length", size)] + ([("hotspot.x", a), ("hotspot.y", b)] if kind == 2 else [])
        try:
            if body[:4] == b"\x89PNG":
                node = png(body, name)[0]
            else:
                height = struct.unpack_from("<i", body, 8)[0] // 2
                node = bmp(body[:8] + struct.pack("<i", height) + body[12:], name, 0)[0]
                bits, width = struct.unpack_from("<H", body, 14)[0], node.raster.width
                line = (width + 31) // 32 * 4
                mask, rgba = body[-line * height :], bytearray(node.raster.rgba)
                for y in range(height):
                    for x in range(width):
                        if mask[(height - 1 - y) * line + x // 8] >> (7 - x % 8) & 1:
                            rgba[(y * width + x) * 4 + 3] = 0
                node = node._replace(raster=node.raster._replace(rgba=bytes(rgba)), metadata=[*node.metadata, ("bits-per-pixel", bits)])
            out.append(node._replace(path=f"/{word}/{i}", metadata=metadata + node.metadata))
        except (ValueError, struct.error, IndexError) as e:
            out.append(Node(f"/{word}/{i}", "opaque", "opaque", [*metadata, ("failure", str(e))], data=body))
    return out


#: Rows of a module that are followed at most.
MOST_TRANSITIONS = 1_000_000


def control_flow(raw: bytes, channels: int, orders: list[int], restart: int | None) -> tuple[str, int, tuple[int, int] | None, int]:
    """(status, rows followed, entry, length) of a module's playback: "terminates", "cycles" (then the place where the cycle is entered, and its rows) or "analysis-limit".

    Jumps to an order (command 11), breaks to a row of the next (13) and loops within a pattern
    (14, 6) are followed; the state of every channel's loop is part of the place.
    """
    cells = np.frombuffer(raw, np.uint8).reshape(-1, 64, channels, 4)
    command, value = cells[..., 2] & 15, cells[..., 3]
    # Only these commands matter; most rows have none.
    matters = ((command == 11) | (command == 13) | ((command == 14) & (value >> 4 == 6))).any(axis=2)
    order, row = 0, 0
    starts, left = [0] * channels, [0] * channels
    seen: dict[tuple, int] = {}
    for step in range(MOST_TRANSITIONS):
        if order >= len(orders):
            return "terminates", step, None, 0
        if row >= 64 or orders[order] >= len(cells):
            return "analysis-limit", step, None, 0
        place = (order, row, *starts, *left)
        if place in seen:
            return "cycles", step, (order, row), step - seen[place]
        seen[place] = step
        pattern, jump, leave, back = orders[order], None, None, None
        if matters[pattern, row]:
            for c in range(channels):
                what, arg = int(command[pattern, row, c]), int(value[pattern, row, c])
                if what == 11:
                    jump = arg
                elif what == 13:
                    leave = (arg >> 4) * 10 + (arg & 15)
                elif what == 14 and arg >> 4 == 6:
                    times = arg & 15
                    if not times:
                        starts[c] = row
                    else:
                        left[c] = times if not left[c] else left[c] - 1
                        back = starts[c] if left[c] else back
        if jump is not None or leave is not None:
            order, row = order + 1 if jump is None else jump, leave or 0
        elif back is not None:
            row = back
            continue
        elif row < 63:
            row += 1
            continue
        else:
            order, row = order + 1, 0
            if order >= len(orders) and restart is not None:
                order = restart
        starts, left = [0] * channels, [0] * channels
    return "analysis-limit", MOST_TRANSITIONS, None, 0


def module(data: bytes, name: str) -> list[Node]:
    """A 31-sample tracker module: its order, patterns as text, and samples as sounds."""
    r = Reader(data)
    mark = r.take(1080, 4)
    channels = {b"M.K.": 4, b"M!K!": 4, b"FLT4": 4, b"4CHN": 4, b"6CHN": 6, b"8CHN": 8, b"FLT8": 8}.get(mark, 0)
    need(channels > 0, "no module mark")
    length, restart = r.unpack("<BB", 950)
    order = list(r.take(952, 128))
    need(1 <= length <= 128, "bad order")
    patterns = max(order) + 1
    samples, at = [], 1084 + patterns * 64 * channels * 4
    for i in range(31):
        title, words, tune, volume, loop, loop_size = r.unpack(">22sHBBHH", 20 + 30 * i)
        need(volume <= 64 and tune < 16, "bad sample")
        body = r.take(at, words * 2)
        at += words * 2
        if words:
            samples.append(Node(f"/module/samples/{i + 1}", "protracker.sample", "audio", [("name", title.split(b"\0")[0].decode("latin-1")), ("volume", volume), ("finetune", tune), ("loop.start", loop * 2), ("loop.length", loop_size * 2), ("samples", words * 2)], audio=Audio(8287, 8, [[b - 256 if b > 127 else b for b in body]])))
    need(at == len(data), "the samples do not end the data")
    cells = []
    for p in range(patterns):
        rows = []
        for row in range(64):
            raw = r.take(1084 + (p * 64 + row) * channels * 4, channels * 4)
            rows.append(" ".join(f"{(raw[c] & 15) << 8 | raw[c + 1]:03x}:{raw[c] & 0xF0 | raw[c + 2] >> 4:02x}:{raw[c + 2] & 15:x}{raw[c + 3]:02x}" for c in range(0, channels * 4, 4)))
        cells.append(Node(f"/module/patterns/{p}", "protracker.pattern", "tracker", [("rows", 64)], text="\n".join(rows)))
    raw = r.take(1084, patterns * 64 * channels * 4)
    status, steps, entry, length_of = control_flow(raw, channels, order[:length], restart if restart != 127 and restart < length else None)
    flow = [("loop.status", status), ("loop.transitions", steps), *([("loop.entry-order", entry[0]), ("loop.entry-row", entry[1]), ("loop.length", length_of)] if entry else [])]
    return [Node("/module", "protracker.mod", "tracker", [("title", r.take(0, 20).split(b"\0")[0].decode("latin-1")), ("channels", channels), ("orders", length), ("restart", restart), ("patterns", patterns), ("order", ",".join(map(str, order[:length]))), *flow]), *cells, *samples]


def _bank_samples(payload: bytes) -> list[Node]:
    """Sounds of a name, a rate and signed bytes each, one behind the other."""
    r = Reader(payload)
    (count,) = r.unpack(">H", 0)
    need(count <= 4096, "too many samples")
    at, out = 2 + 4 * count, []
    for i in range(count):
        (place,) = r.unpack(">I", 2 + 4 * i)
        title, rate, size = r.unpack(">8sHI", place)
        need(place == at and rate > 0 and size > 0, "samples do not follow each other")
        body = np.frombuffer(r.take(place + 14, size), np.int8)
        label = title.split(b"\0")[0].decode("ascii").rstrip()
        out.append(Node(f"/bank/samples/{i + 1}", "amos.sample", "audio", [("sample.name", label), ("sample-rate", rate), ("samples", size)], audio=Audio(rate, 8, [body.tolist()])))
        at = place + 14 + size
    need(at == len(payload), "data behind the samples")
    return out


def packed_picture(payload: bytes) -> tuple[int, int, bytes, list[tuple[int, int, int, int]]]:
    """Width, height, RGBA and palette of a picture whose bytes change only where a bit of a second stream says so, whose own bytes change only where a bit of a third one does."""
    r = Reader(payload)
    need(r.unpack(">I", 0)[0] in (0x12031990, 0x00031990, 0x12030090), "no screen, so no colours")
    count, planes = r.unpack(">HH", 22)
    words = r.unpack(">32H", 26)
    magic, _, _, line, lumps, high, own, bits_at, points_at = r.unpack(">IHHHHHHII", 90)
    need(magic == 0x06071963 and own == planes and line > 0 and lumps > 0 and high > 0 and 1 <= planes <= 6 and line * lumps * high * planes <= 1 << 26, "no picture")
    needed = 32 if planes == 6 else 1 << planes
    need(needed <= count <= 32, "too few colours")
    values, flags, points = 90 + 24, 90 + bits_at, 90 + points_at
    end = min(flags, points)
    need(values < end and flags < len(payload) and points < len(payload), "streams are outside of the picture")

    def bits(at: int):
        """The bits of a stream from a place on, highest first."""
        while True:
            need(at < len(payload), "a stream ends early")
            for k in range(7, -1, -1):
                yield payload[at] >> k & 1
            at += 1

    change, flag, again = payload[values], payload[flags], bits(points)
    values, flags = values + 1, flags + 1
    if next(again):
        flag = r.take(flags, 1)[0]
        flags += 1
    height, left = lumps * high, 7
    out = np.zeros((planes, height, line), np.uint8)
    for plane in range(planes):
        for lump in range(lumps):
            for column in range(line):
                for row in range(lump * high, lump * high + high):
                    if flag >> left & 1:
                        need(values < end, "a stream ends early")
                        change, values = payload[values], values + 1
                    out[plane, row, column] = change
                    left -= 1
                    if left < 0:
                        left = 7
                        if next(again, 0):
                            flag = r.take(flags, 1)[0]
                            flags += 1
    pixels = (np.unpackbits(out, axis=2).astype(np.uint8) << np.arange(planes, dtype=np.uint8)[:, None, None]).sum(axis=0)
    palette = [tuple((w >> k & 15) * 17 for k in (8, 4, 0)) for w in words[:count]]
    if planes == 6:
        palette = palette[:32] + [tuple(v >> 1 for v in c) for c in palette[:32]]
    colours = np.array([(*c, 255) for c in palette], np.uint8)
    return line * 8, height, colours[pixels].tobytes(), [(*c, 255) for c in palette]


def bank(data: bytes, name: str) -> list[Node]:
    """A bank's bytes or, of the kinds that are known, its sounds or its picture; what does not hold stays as it is."""
    r = Reader(data)
    tag, number, _, size, label = r.unpack(">4sHHI8s", 0)
    need(tag == b"AmBk" and (size & 0x0FFFFFFF) - 8 == len(data) - 20, "no bank of this size")
    title, payload = label.decode("latin-1").strip(), data[20:]
    metadata: list[tuple[str, str | int]] = [("bank.number", number), ("bank.label", title), ("data.length", len(payload))]
    try:
        if title == "Samples":
            return [Node("/bank", "amos.bank.samples", "group", metadata), *_bank_samples(payload)]
        if title == "Pac.Pic.":
            width, height, rgba, palette = packed_picture(payload)
            return [Node("/picture", "amos.packed-picture", "raster", metadata, raster=Raster(width, height, rgba), palette=palette)]
    except (ValueError, struct.error, UnicodeDecodeError) as e:
        metadata.append(("failure", str(e)))
    return [Node("/bank", f"amos.bank.{title.lower() or 'data'}", "opaque", metadata, data=payload)]


def pdf(data: bytes, name: str) -> list[Node]:
    return [Node("/file", "adobe.pdf", "opaque", [("pdf.version", data[5:8].decode("latin-1"))], data=data)]


def powerpacker(data: bytes, name: str) -> list[Node]:
    """Crunched backwards: a bit stream from the end, copies of 2 bytes on with offsets of the four given widths."""
    r = Reader(data)
    tag, *widths = r.unpack(">4s4B", 0)
    need(tag == b"PP20" and len(data) >= 12 and all(9 <= w <= 16 for w in widths), "no crunched data")
    size, skip = int.from_bytes(data[-4:-1], "big"), data[-1]
    stream, at, hold, held = data[8:-4], len(data) - 12, 0, 0

    def bits(n: int) -> int:
        nonlocal at, hold, held
        out = 0
        for _ in range(n):
            if not held:
                need(at > 0, "the stream ends early")
                at -= 1
                hold, held = stream[at], 8
            out = out << 1 | hold & 1
            hold >>= 1
            held -= 1
        return out

    bits(skip)
    out = bytearray(size)
    place = size
    while place > 0:
        if not bits(1):
            count = 1
            while (x := bits(2)) == 3:
                count += 3
            for _ in range(count + x):
                need(place > 0, "literals run over the start")
                place -= 1
                out[place] = bits(8)
            if place == 0:
                break
        x = bits(2)
        width, count = widths[x], x + 2
        if x == 3:
            offset = bits(width if bits(1) else 7)
            while (y := bits(3)) == 7:
                count += 7
            count += y
        else:
            offset = bits(width)
        need(place + offset < size, "a copy reaches over the end")
        for _ in range(count):
            need(place > 0, "a copy runs over the start")
            place -= 1
            out[place] = out[place + offset + 1] if place + offset + 1 < size else 0
    return [Node("/content", "archive.powerpacker", "opaque", [("powerpacker.version", "PP20"), ("powerpacker.compressed-length", len(data)), ("powerpacker.uncompressed-length", size)], data=bytes(out))]


def xpk(data: bytes, name: str) -> list[Node]:
    """Chunks behind a checked header. Chunks that are stored come back; those of packers are listed, with a warning that says which packer."""
    r = Reader(data)
    tag, size, packer, plain = r.unpack(">4sI4sI", 0)
    need(tag == b"XPKF" and size + 8 <= len(data) and size >= 28, "no packed file of this size")
    total = 0
    for b in r.take(0, 36):
        total ^= b
    need(total == 0, "the header's checksum is wrong")
    flags, at, out, chunks, known = data[32], 36, [], 0, True
    need(not flags & 2, "the file has a password")
    if flags & 4:
        at += 2 + r.unpack(">H", at)[0]
    while True:
        kind = r.take(at, 1)[0]
        if flags & 1:
            packed, own = r.unpack(">II", at + 4)
            at += 12
        else:
            packed, own = r.unpack(">HH", at + 4)
            at += 8
        if kind == 15:
            break
        chunks += 1
        need(kind in (0, 1), "a chunk of no known kind")
        known &= kind == 0
        body = r.take(at, packed)
        if kind == 0:
            need(packed == own, "a stored chunk has two sizes")
        out.append(body)
        at += packed + (-packed % 4)
        need(chunks < 1 << 20 and sum(map(len, out)) <= 1 << 29, "too much data")
    metadata = [("xpk.packer", packer.decode("latin-1")), ("xpk.compressed-length", size + 8), ("xpk.uncompressed-length", plain), ("xpk.chunks", chunks)]
    if not known:
        return [Node("/content", "archive.xpk", "opaque", [*metadata, ("decode.warning", f"chunks of {packer.decode('latin-1')} are not unpacked")], data=data[36 : size + 8])]
    body = b"".join(out)
    need(len(body) == plain, "the chunks do not make up the file")
    return [Node("/content", "archive.xpk", "opaque", metadata, data=body)]


def appimage(data: bytes, name: str) -> list[Node]:
    """The first kind: a program that is a disc image as well."""
    need(data[:4] == b"\x7fELF" and data[8:11] == b"AI\x01", "no program of this kind")
    disc, *files = iso9660(data, name)
    return [n._replace(path="/appimage" + n.path.removeprefix("/disc"), type_id="executable.appimage-type1" if n is disc else n.type_id) for n in (disc, *files)]


def _unzip(data: bytes, most: int, packing: int = 1) -> bytes:
    """A packed block of less than ``most`` bytes, by the image's number of its coding: 1 zlib, 2 LZMA, 4 xz, 6 Zstandard."""
    try:
        if packing == 1:
            out = zlib.decompressobj().decompress(data, most)
        elif packing in (2, 4):
            out = lzma.LZMADecompressor(lzma.FORMAT_ALONE if packing == 2 else lzma.FORMAT_XZ, memlimit=1 << 28).decompress(data, most)
        else:
            import zstandard

            try:
                with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as stream:
                    out = stream.read(most)
            except zstandard.ZstdError as e:
                raise ValueError(str(e)) from e
    except (zlib.error, lzma.LZMAError, EOFError) as e:
        raise ValueError(str(e)) from e
    need(len(out) < most, "a block is too large")
    return out


class _Squash:
    """Inodes, folders and blocks of a SquashFS 4 image."""

    def __init__(self, data: bytes):
        self.r = Reader(data)
        magic, _, _, self.block, self.fragments, packing, _, flags, _, major, _, self.root, used, _, _, self.inodes, self.folders, self.fragment_table, _ = self.r.unpack("<IIIIIHHHHHHQQQQQQQQ", 0)
        self.packing = packing
        need(magic == 0x73717368 and major == 4 and packing in (1, 2, 4, 6) and 4096 <= self.block <= 1 << 20 and used <= len(data), "no image, or packed otherwise")
        self.cache: dict[int, tuple[bytes, int]] = {}

    def meta(self, at: int) -> tuple[bytes, int]:
        """A metadata block and where the next one begins."""
        if at not in self.cache:
            (head,) = self.r.unpack("<H", at)
            raw = self.r.take(at + 2, head & 0x7FFF)
            self.cache[at] = (raw if head & 0x8000 else _unzip(raw, 8193, self.packing), at + 2 + (head & 0x7FFF))
        return self.cache[at]

    def span(self, start: int, offset: int, size: int) -> bytes:
        out = b""
        while len(out) < offset + size:
            part, start = self.meta(start)
            need(bool(part), "an empty block")
            out += part
        return out[offset : offset + size]

    def content(self, start: int, sizes: list[int], total: int, fragment: int, offset: int) -> bytes:
        out = []
        for i, size in enumerate(sizes):
            raw = self.r.take(start, size & 0xFFFFFF)
            start += size & 0xFFFFFF
            plain = min(self.block, total - i * self.block)
            out.append(bytes(plain) if not size else raw if size & 1 << 24 else _unzip(raw, plain + 1, self.packing))
        if fragment != 0xFFFFFFFF:
            need(fragment < self.fragments, "no such fragment")
            (index,) = self.r.unpack("<Q", self.fragment_table + fragment // 512 * 8)
            at, size, _ = struct.unpack("<QII", self.span(index, fragment % 512 * 16, 16))
            raw = self.r.take(at, size & 0xFFFFFF)
            out.append((raw if size & 1 << 24 else _unzip(raw, self.block + 1, self.packing))[offset : offset + total % self.block])
        body = b"".join(out)
        need(len(body) == total, "a file ends early")
        return body

    def walk(self, ref: int, prefix: str, depth: int) -> list[tuple[str, list, bytes | None]]:
        need(depth <= 64, "folders form a loop")
        at, offset = self.inodes + (ref >> 16), ref & 0xFFFF
        kind, mode = struct.unpack("<HH", self.span(at, offset, 4))
        own = [("mode", oct(mode))]
        if kind in (1, 8):
            if kind == 1:
                start, _, size, place, _ = struct.unpack("<IIHHI", self.span(at, offset + 16, 16))
            else:
                _, size, start, _, _, place, _ = struct.unpack("<IIIIHHI", self.span(at, offset + 16, 24))
            out: list[tuple[str, list, bytes | None]] = [(prefix[:-1], own, None)] if prefix else []
            raw, here = self.span(self.folders + start, place, max(0, size - 3)), 0
            while here < len(raw):
                count, block, _ = struct.unpack_from("<III", raw, here)
                here += 12
                for _ in range(count + 1):
                    inside, _, _, n = struct.unpack_from("<HhHH", raw, here)
                    label = safe_name(raw[here + 8 : here + 9 + n].decode("utf-8"))
                    out += self.walk(block << 16 | inside, f"{prefix}{label}/", depth + 1)
                    here += 9 + n
            return out
        if kind in (2, 9):
            if kind == 2:
                start, fragment, place, total = struct.unpack("<IIII", self.span(at, offset + 16, 16))
                after = 32
            else:
                start, total, _, _, fragment, place, _ = struct.unpack("<QQQIIII", self.span(at, offset + 16, 40))
                after = 56
            need(total <= 1 << 31, "a file is too large")
            count = total // self.block if fragment != 0xFFFFFFFF else -(-total // self.block)
            sizes = list(struct.unpack(f"<{count}I", self.span(at, offset + after, 4 * count)))
            return [(prefix[:-1], [*own, ("data.length", total)], self.content(start, sizes, total, fragment, place))]
        return [(prefix[:-1], [*own, ("inode", kind)], b"")]  # links and devices are listed


def appimage2(data: bytes, name: str) -> list[Node]:
    """The second kind: a program with a SquashFS image after its sections."""
    r = Reader(data)
    need(data[:4] == b"\x7fELF" and data[8:11] == b"AI\x02" and data[4] in (1, 2) and data[5] == 1, "no program of this kind")
    table = r.unpack("<Q", 40)[0] if data[4] == 2 else r.unpack("<I", 32)[0]
    size, count = r.unpack("<HH", 58 if data[4] == 2 else 46)
    image = _Squash(data[table + size * count :])
    files = image.walk(image.root, "", 0)
    return _tree("/appimage", "executable.appimage-type2", [("entries", len(files)), ("image.offset", table + size * count)], files)
