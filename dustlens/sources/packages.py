"""Games whose resources lie in volumes beside the maps that list them. Files have collection, rel_path and content."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustlens.operators.lookups import unambiguous
from dustlens.sources.model import Reader, need

#: The four kinds of an early map, in the order in which a combined map has them (fixed values).
AGI_KINDS = ("logic", "picture", "view", "sound")
#: Kinds by number of the later maps (fixed values).
SCI_KINDS = ("view", "pic", "script", "text", "sound", "memory", "vocab", "font", "cursor", "patch", "bitmap", "palette", "cdaudio", "audio", "sync", "message", "map", "heap")
#: Words that inventories are mixed with (fixed values).
CIPHERS = (b"", b"Avis Durgan", b"Alex Simkin")

ENTRY = "collection string, root string, package string, generation string, prefix string, kind string, number int, volume int, offset long"


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?", 0)


def _name(path: Column) -> Column:
    return F.upper(F.regexp_extract(path, "([^/]+)$", 1))


def _three_bytes(data: bytes) -> list[tuple[int, int, int]]:
    """(number, volume, offset) of a map of three bytes an entry; all ones is none."""
    need(len(data) % 3 == 0, "half an entry")
    rows = [(i // 3, int.from_bytes(data[i : i + 3], "big")) for i in range(0, len(data), 3)]
    return [(n, v >> 20, v & 0xFFFFF) for n, v in rows if v != 0xFFFFFF]


def _combined(data: bytes) -> list[tuple[str, int, int, int]]:
    """The same four kinds in one file, behind their places."""
    starts = [*Reader(data).unpack("<4H", 0), len(data)]
    need(starts[0] == 8 and starts == sorted(starts), "places out of order")
    return [(kind, *row) for kind, a, b in zip(AGI_KINDS, starts, starts[1:], strict=False) for row in _three_bytes(data[a:b])]


def _six_bytes(data: bytes, shift: int) -> list[tuple[int, int, int, int]]:
    """(kind, number, volume, offset) of an early map, up to its end of all ones."""
    need(len(data) >= 6 and len(data) % 6 == 0 and data[-6:] == b"\xff" * 6, "a map without its end")
    rows = [struct.unpack_from("<HI", data, i) for i in range(0, len(data) - 6, 6)]
    need((0xFFFF, 0xFFFFFFFF) not in rows, "entries behind the end")
    return [(i >> 11, i & 0x7FF, at >> shift, at & (1 << shift) - 1) for i, at in rows]


def _by_kind(data: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """The same of a later map, whose kinds have tables of their own; six bytes an entry with a volume, or five without one."""
    r, kinds, at = Reader(data), [], 0
    while True:
        kind, first = r.unpack("<BH", at)
        at += 3
        kinds.append((kind, first))
        if kind == 0xFF:
            break
        need(0x80 <= kind <= 0x91 and (len(kinds) < 2 or kind > kinds[-2][0]), "kinds out of order")
    need(len(kinds) > 1 and kinds[0][1] >= at and kinds[-1][1] == len(data), "tables outside of the map")
    out = []
    for (kind, a), (_, b) in zip(kinds, kinds[1:], strict=False):
        need(a <= b and (b - a) % size == 0, "half an entry")
        for i in range(a, b, size):
            if size == 6:
                number, place = r.unpack("<HI", i)
                out.append((kind - 0x80, number, place >> 28, place & 0x0FFFFFFF))
            else:
                out.append((kind - 0x80, r.unpack("<H", i)[0], 0, int.from_bytes(data[i + 2 : i + 5], "little") * 2))
    return out


def _candidates(name: str, data: bytes) -> list[tuple[str, str, str, list[tuple[str, int, int, int]]]]:
    """(package, generation, prefix, entries) for each way to read a map."""
    out = []

    def attempt(package: str, generation: str, prefix: str, read) -> None:
        try:
            out.append((package, generation, prefix, read()))
        except (ValueError, struct.error):
            pass

    sci = lambda rows: [(SCI_KINDS[k] if k < len(SCI_KINDS) else f"kind{k}", n, v, o) for k, n, v, o in rows]
    if name in ("LOGDIR", "PICDIR", "VIEWDIR", "SNDDIR"):
        kind = AGI_KINDS[("LOGDIR", "PICDIR", "VIEWDIR", "SNDDIR").index(name)]
        attempt("sierra.agi-game", "v2", "", lambda: [(kind, *row) for row in _three_bytes(data)])
    elif name == "DIRS" or name.endswith("DIR"):
        attempt("sierra.agi-game", "v3", "" if name == "DIRS" else name[:-3], lambda: _combined(data))
    elif name == "RESOURCE.MAP":
        if data[:1] and 0x80 <= data[0] <= 0x91:
            for generation, size in (("sci1", 6), ("sci1.1", 5)):
                attempt("sierra.sci-game", generation, "", lambda size=size: sci(_by_kind(data, size)))
        else:
            for generation, shift in (("sci0", 26), ("sci01", 28)):
                attempt("sierra.sci-game", generation, "", lambda shift=shift: sci(_six_bytes(data, shift)))
    return out


def entries(files: DataFrame) -> DataFrame:
    """All entries of all maps, for each way in which a map can be read (``ENTRY``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([*[(n, text) for n in ("collection", "root", "package", "generation", "prefix", "kind")], ("number", pa.int32()), ("volume", pa.int32()), ("offset", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                collection, root, name, content = (batch.column(c)[i].as_py() for c in range(4))
                rows = [(collection, root, p, g, prefix, *row) for p, g, prefix, own in _candidates(name, content or b"") for row in own]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    maps = files.select("collection", _folder(F.col("rel_path")).alias("root"), _name(F.col("rel_path")).alias("name"), "content").where(r"name RLIKE 'DIR$|^DIRS$|^RESOURCE[.]MAP$'")
    return maps.mapInArrow(run, ENTRY)


def _head(package: str, generation: str, kind: str, number: int, volume: int, offset: int, data: bytes) -> tuple[str | None, int, int, int, int]:
    """(why not, start, stored, plain, method) of an entry's header in its volume."""
    try:
        r = Reader(data)
        if package == "sierra.agi-game":
            early = generation == "v2"
            need(r.take(offset, 2) == b"\x12\x34", "resource header signature is not $12 $34")
            mark, plain = r.unpack("<BH", offset + 2)
            need(mark & 0x7F == volume, "resource header volume does not match directory entry")
            stored = plain if early else r.unpack("<H", offset + 5)[0]
            start, method = offset + (5 if early else 7), 0 if early else 2 if mark & 0x80 else int(stored != plain)
        else:
            early = generation in ("sci0", "sci01")
            if early:
                own, stored, plain, method = r.unpack("<HHHH", offset)
                found = own >> 11, own & 0x7FF
            else:
                tag, own, stored, plain, method = r.unpack("<BHHHH", offset)
                found = tag & 0x7F, own
            wanted = SCI_KINDS.index(kind) if kind in SCI_KINDS else int(kind.removeprefix("kind"))
            need(found == (wanted, number), "volume header identity does not match the resource map")
            start, stored = offset + (8 if early else 9), stored if generation == "sci1.1" else stored - 4
        need(stored >= 0, "stored resource has no size")
        r.take(start, stored)
    except ValueError as e:
        return str(e), 0, 0, 0, 0
    return None, start, stored, plain, method


def inspect_entries(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``listed`` and warning, stored, plain, method and data: what the volumes say of each entry.

    A volume is found by its name, whatever its case; where several files have it there is none.
    Each volume is sent to its entries' rows once, as they are gathered by volume (a map bounds
    them); headers are read and payloads cut in the task.
    """
    there = unambiguous(files, "collection", "rel_path", "content").withColumnRenamed("value", "content")
    volume = F.when(F.col("package") == "sierra.sci-game", F.format_string("RESOURCE.%03d", "volume")).otherwise(F.concat("prefix", F.lit("VOL."), F.col("volume").cast("string")))
    keyed = listed.withColumn("key", F.lower(F.concat("root", volume)))
    of = keyed.groupBy("collection", "key").agg(F.collect_list(F.struct("root", "package", "generation", "prefix", "kind", "number", "volume", "offset")).alias("rows"))
    joined = of.join(there, ["collection", "key"], "left").select("collection", "rows", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, number = pa.string(), pa.int32()
        schema = pa.schema([("collection", text), *[(n, text) for n in ("root", "package", "generation", "prefix", "kind")], ("number", number), ("volume", number), ("offset", pa.int64()), ("warning", text), ("stored", number), ("plain", number), ("method", number), ("data", pa.binary())])
        for batch in batches:
            for i in range(batch.num_rows):
                collection, rows, content = (batch.column(c)[i].as_py() for c in range(3))
                out = []
                for row in rows:
                    if content is None:
                        why, start, stored, plain, method = "missing or ambiguous volume file", 0, 0, 0, 0
                    else:
                        why, start, stored, plain, method = _head(row["package"], row["generation"], row["kind"], row["number"], row["volume"], row["offset"], content)
                    out.append({"collection": collection, **row, "warning": why, "stored": stored, "plain": plain, "method": method, "data": None if why else content[start : start + stored]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return joined.mapInArrow(run, f"{ENTRY}, warning string, stored int, plain int, method int, data binary")


def resources(files: DataFrame) -> DataFrame:
    """The entries of each package in the generation that most of its volumes' headers bear out; of equals the earlier one. A map that none of them bears out is no package."""
    found = inspect_entries(entries(files), files)
    votes = found.groupBy("collection", "root", "package", "generation").agg(F.count_if(F.col("warning").isNull()).alias("valid"))
    best = votes.where("valid > 0").groupBy("collection", "root", "package").agg(F.min_by("generation", F.struct(-F.col("valid"), "generation")).alias("generation"))
    return found.join(best, ["collection", "root", "package", "generation"], "left_semi")


def discover(files: DataFrame) -> DataFrame:
    """(collection, packages, problem): the packages of each collection that has any; several are a problem."""
    found = resources(files).select("collection", "root", "package").distinct()
    own = found.groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("root", "package"))).alias("packages"))
    return own.select("collection", "packages", F.when(F.size("packages") > 1, "more than one game package is available; select one").alias("problem"))


class _Bits:
    """Bits of a stream, lowest first or highest first; None behind the end."""

    def __init__(self, data: bytes, lowest_first: bool):
        self.value, self.size = int.from_bytes(data, "little" if lowest_first else "big"), 8 * len(data)
        self.low, self.at = lowest_first, 0

    def take(self, n: int) -> int | None:
        if self.at + n > self.size:
            return None
        shift = self.at if self.low else self.size - self.at - n
        self.at += n
        return self.value >> shift & (1 << n) - 1


def agi_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 11 bits, lowest bit first: 256 begins the table anew, 257 ends."""
    bits, out = _Bits(data, True), bytearray()
    words: dict[int, bytes] = {}
    width, last = 9, b""
    while len(out) < size:
        code = bits.take(width)
        if code is None or code == 257:
            break
        if code == 256:
            words, width, last = {}, 9, b""
            continue
        fresh = 258 + len(words)
        if code < 256:
            own = bytes([code])
        elif code in words:
            own = words[code]
        else:
            need(code == fresh and bool(last), "no such code")
            own = last + last[:1]
        out += own
        if last and fresh < 2048:
            words[fresh] = last + own[:1]
        last = own
        if 258 + len(words) == 1 << width and width < 11:
            width += 1
    need(len(out) == size, "the data are of another size")
    return bytes(out)


def agi_picture(data: bytes, size: int) -> bytes:
    """Bytes, and half a byte behind each that sets a colour (0xF0 and 0xF2), as whole bytes."""
    bits, out = _Bits(data, False), bytearray()
    while len(out) < size and (b := bits.take(8)) is not None:
        out.append(b)
        if b in (0xF0, 0xF2) and len(out) < size:
            colour = bits.take(4)
            if colour is None:
                break
            out.append(colour)
    need(len(out) == size, "the data are of another size")
    return bytes(out)


def sci_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, lowest bit first, that stand for a stretch of what was put out and the byte behind it; 256 begins anew, 257 ends."""
    bits, out = _Bits(data, True), bytearray()
    places: list[tuple[int, int]] = []
    width = 9
    while len(out) < size:
        code = bits.take(width)
        if code is None or code == 257:
            break
        if code == 256:
            places, width = [], 9
            continue
        start = len(out)
        if code < 256:
            out.append(code)
        else:
            need(code - 258 < len(places), "no such code")
            at, n = places[code - 258]
            for k in range(n + 1):
                out.append(out[at + k])
        last = (1 << width) - 1
        if 258 + len(places) > last and width < 12:
            width += 1
            last = (1 << width) - 1
        if 258 + len(places) <= last:
            places.append((start, len(out) - start))
    need(len(out) == size, "the data are of another size")
    return bytes(out)


def sci_huffman(data: bytes, size: int) -> bytes:
    """A tree of nodes, each a byte and the steps to its two followers (none for a leaf; no step to the right one: eight plain bits follow), then bits, highest first, up to the mark of the end."""
    r = Reader(data)
    count, mark = r.unpack("BB", 0)
    need(count > 0, "no tree")
    nodes = [tuple(r.take(2 + 2 * i, 2)) for i in range(count)]
    bits, out = _Bits(data[2 + 2 * count :], False), bytearray()
    while len(out) < size:
        at, plain = 0, None
        while nodes[at][1]:
            bit = bits.take(1)
            need(bit is not None, "the data end early")
            step = nodes[at][1] & 15 if bit else nodes[at][1] >> 4
            if bit and not step:
                plain = bits.take(8)
                need(plain is not None, "the data end early")
                break
            at += step
            need(at < count, "a node that is not there")
        if plain is not None and plain == mark:
            break
        out.append(nodes[at][0] if plain is None else plain)
    need(len(out) == size, "the data are of another size")
    return bytes(out)


def unpacked(found: DataFrame) -> DataFrame:
    """``found`` with its payloads unpacked, and failure, why one could not be."""
    place, names = found.columns.index("data"), found.columns
    columns = [names.index(c) for c in ("package", "generation", "method", "plain")]

    def plain_of(package: str, generation: str, method: int, size: int, data: bytes) -> bytes:
        if method == 0:
            need(package == "sierra.agi-game" or len(data) == size, "a stored resource has two sizes")
            return data
        if package == "sierra.agi-game":
            return agi_lzw(data, size) if method == 1 else agi_picture(data, size)
        # The early generation calls LZW 1 and the tree 2; later ones call the tree 1.
        how = {1: sci_lzw, 2: sci_huffman} if generation == "sci0" else {1: sci_huffman}
        need(method in how, f"method {method} is not unpacked")
        return how[method](data, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, why = [], []
            for i in range(batch.num_rows):
                raw, told = batch.column(place)[i].as_py(), None
                if raw is not None:
                    try:
                        raw = plain_of(*(batch.column(c)[i].as_py() for c in columns), raw)
                    except ValueError as e:
                        told = str(e)
                data.append(raw)
                why.append(told)
            out = batch.set_column(place, batch.schema.field(place), pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(why, pa.string())], names=[*names, "failure"])

    from pyspark.sql.types import StringType, StructField, StructType

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("failure", StringType())]))


def mixed(data: bytes, word: bytes) -> bytes:
    """Bytes with a word's bytes mixed in, over and over; the same again undoes it."""
    return bytes(b ^ word[i % len(word)] for i, b in enumerate(data)) if word else data


def vocabulary(data: bytes) -> list[tuple[int, str]]:
    """(number, word) in order: each word keeps some letters of the one before, its own are turned round, the last with its highest bit set."""
    r, at, last, out = Reader(data), 52, "", []
    need(len(data) >= 52, "no places of letters")
    while at < len(data) and not (data[at] == 0 and at + 1 == len(data)):
        kept, at = data[at], at + 1
        need(kept <= len(last), "more letters are kept than there are")
        word, more = last[:kept], True
        while more:
            (b,) = r.unpack("B", at)
            at, more = at + 1, b < 0x80
            c = b & 0x7F ^ 0x7F
            word += chr(c) if 0x20 <= c < 0x7F else f"\\x{c:02X}"
        out.append((r.unpack(">H", at)[0], word))
        at, last = at + 2, word
    return sorted(out)


def inventory(data: bytes) -> list[tuple[int, int, str]]:
    """(number, room, name) of things, plain or mixed with one of the words that are known; room 255 is carried. Data that can be read in two ways are refused."""

    def read(plain: bytes) -> list[tuple[int, int, str]]:
        r = Reader(plain)
        (names,) = r.unpack("<H", 0)
        need(len(plain) >= 3 + names and names % 3 == 0, "odd entries")
        out = []
        for i in range(names // 3):
            at, room = r.unpack("<HB", 3 + 3 * i)
            need(3 + names <= 3 + at < len(plain), "a name outside of the names")
            end = plain.find(b"\0", 3 + at)
            need(end >= 0, "a name without end")
            out.append((i, room, "".join(chr(c) if 0x20 <= c < 0x7F else f"\\x{c:02X}" for c in plain[3 + at : end])))
        return out

    found = []
    for word in CIPHERS:
        try:
            found.append(read(mixed(data, word)))
        except ValueError:
            pass
    need(bool(found) and all(f == found[0] for f in found), "no inventory, or one that can be read in two ways")
    return found[0]
