"""Which formats a source may have, by evidence in its bytes, its size and its name."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First bytes that probes look at.
HEAD = 64


class Probe(NamedTuple):
    """A row of the registry. Rank is the place in ``PROBES``, never confidence.

    A probe fits where all that it names does: ``head``, a regular expression over the first
    bytes, read as Latin-1; ``at``, an offset and a regular expression over the bytes there;
    ``sizes``, the sizes a source may have; and ``extensions``, lower-case endings of its name,
    if they are ``required``. Other endings only strengthen: ``with_extension`` is the confidence
    then, ``confidence`` the one without.
    """

    type_id: str
    evidence: str
    head: str = ""
    confidence: str = "certain"
    extensions: tuple[str, ...] = ()
    with_extension: str = ""
    required: bool = False
    sizes: tuple[int, ...] = ()
    at: tuple[int, str] | None = None
    carrier: str = ""  # the type that this one refines
    terminal: bool = False  # the only candidate where it fits


#: The registry, in order of rank. Signatures, sizes and endings are fixed values of the formats' public descriptions.
PROBES = (
    Probe("adobe.pdf", "PDF header with a known version", r"^%PDF-(1\.[0-7]|2\.0)", extensions=("pdf",), terminal=True),
    Probe("windows.write", "Write signature", r"^[\x31\x32]\xbe\x00\x00", "probable", ("wri",), terminal=True),
    Probe("database.sqlite3", "database header", r"^SQLite format 3", extensions=("sqlite", "sqlite3", "db"), terminal=True),
    Probe("windows.inno-setup", "executable with an installer's loader", r"^MZ.{46}(Inno|rDlP)", extensions=("exe",), terminal=True),
    Probe("executable.appimage-type1", "executable with the first image marker", r"^\x7fELF.{4}AI\x01", extensions=("appimage",), terminal=True),
    Probe("executable.appimage-type2", "executable with the second image marker", r"^\x7fELF.{4}AI\x02", extensions=("appimage",), terminal=True),
    Probe("filesystem.iso9660", "primary volume descriptor", extensions=("iso",), at=(32769, r"^CD001"), terminal=True),
    Probe("filesystem.fat-disk-image", "boot sector with a parameter block", r"^.{11}\x00[\x02\x04\x08\x10]", "possible", ("img", "ima", "dsk"), "probable", at=(510, r"^\x55\xaa"), terminal=True),
    Probe("commodore.d64", "size of a disk image", "", "possible", ("d64",), "probable", sizes=(174848, 175531, 196608, 197376), terminal=True),
    Probe("doom.wad", "WAD signature", r"^[IP]WAD", extensions=("wad",)),
    Probe("archive.electron-asar", "pickled header", r"^\x04\x00\x00\x00", extensions=("asar",)),
    Probe("amiga.bitmap-diskfont-index", "font index signature", r"^\x0f[\x00\x02]", extensions=("font",)),
    Probe("amiga.bitmap-diskfont", "font in a hunk", r"^\x00\x00\x03\xf3.{46}\x0f\x80"),
    Probe("amiga.lha-sfx", "hunk with an archive behind it", r"^\x00\x00\x03\xf3"),
    Probe("amiga.hunk-executable", "hunk header", r"^\x00\x00\x03\xf3"),
    Probe("amiga.workbench-icon", "icon signature", r"^\xe3\x10", extensions=("info",)),
    Probe("gif", "GIF signature", r"^GIF8[79]a", extensions=("gif",)),
    Probe("flic", "animation signature", r"^.{4}[\x11\x12]\xaf", extensions=("fli", "flc", "cel", "flh", "flt", "flx")),
    Probe("png", "PNG signature", r"^\x89PNG\r\n\x1a\n", extensions=("png",)),
    Probe("jpeg", "JPEG start of image", r"^\xff\xd8\xff", extensions=("jpg", "jpeg", "jpe")),
    Probe("qoi", "QOI signature", r"^qoif", extensions=("qoi",)),
    Probe("commodore64.koala-painter", "size and load address of a picture", r"^\x00\x60", "possible", ("kla", "koa", "koala", "prg"), "probable", sizes=(10003,)),
    Probe("commodore64.koala-painter", "file name extension", r"^(?!\x00\x60)", "possible", ("koa", "koala"), "probable", required=True),
    Probe("netpbm", "Netpbm magic number", r"^P[1-7][ \t\r\n#]", extensions=("pbm", "pgm", "ppm", "pam", "pnm")),
    Probe("windows.bmp", "bitmap file header", r"^BM(?!F\x03)", extensions=("bmp",)),
    Probe("windows.dib", "bitmap header", r"^[\x0c\x28\x34\x38\x6c\x7c]\x00\x00\x00", "probable", ("dib",)),
    Probe("windows.ico", "icon directory", r"^\x00\x00\x01\x00", extensions=("ico",)),
    Probe("windows.cur", "cursor directory", r"^\x00\x00\x02\x00", extensions=("cur",)),
    Probe("pcx", "PCX header", r"^\x0a[\x00\x02-\x05][\x00\x01][\x01\x02\x04\x08]", "probable", ("pcx",)),
    Probe("zx-spectrum.fzx-font", "font header", "", "possible", ("fzx",), "probable", required=True),
    Probe("bitmap-font.bmfont", "font descriptor", r"^(BMF\x03|info |<\?xml|<font)", "probable", ("fnt",)),
    Probe("tga", "picture header", r"^.[\x00\x01][\x01\x02\x03\x09\x0a\x0b]", "probable", ("tga", "icb", "vda", "vst"), required=True),
    Probe("wav", "RIFF form WAVE", r"^RIFF.{4}WAVE", extensions=("wav", "wave")),
    Probe("creative.voice", "voice file signature", r"^Creative Voice File", extensions=("voc",)),
    Probe("paint-net.palette", "palette header", r"^; ?paint\.net Palette File", extensions=("txt",)),
    Probe("gimp.palette", "palette header", r"^GIMP Palette", extensions=("gpl",)),
    Probe("jasc.palette", "palette header", r"^JASC-PAL\r?\n0100", extensions=("pal",)),
    Probe("aseprite.sprite", "sprite signature", r"^.{4}\xe0\xa5", extensions=("ase", "aseprite")),
    Probe("adobe.swatch-exchange", "swatch signature", r"^ASEF", extensions=("ase",)),
    Probe("protracker.mod", "module signature", extensions=("mod",), at=(1080, r"^(M\.K\.|M!K!|FLT4|FLT8|4CHN|6CHN|8CHN)")),
    Probe("archive.zip", "local or end record", r"^PK(\x01\x02|\x03\x04|\x05\x06|\x07\x08)", extensions=("zip",)),
    Probe("archive.lha", "method field", r"^.{2}-lh[0-9d]-", extensions=("lha", "lzh")),
    Probe("amiga.adf", "boot signature and size of a disk", r"^DOS[\x00-\x05]", extensions=("adf",), sizes=(901120, 1802240)),
    Probe("amiga.dms", "packed disk signature", r"^DMS!", extensions=("dms", "fms")),
    Probe("archive.xpk", "packed data signature", r"^XPKF"),
    Probe("archive.powerpacker", "crunched-data signature", r"^PP(20|11)"),
    Probe("amiga.16sv", "IFF form 16SV", r"^FORM.{4}16SV", extensions=("16sv", "16svx")),
    Probe("amiga.8svx", "IFF form 8SVX", r"^FORM.{4}8SVX", extensions=("8svx", "8sv")),
    Probe("amiga.anim", "IFF form ANIM", r"^FORM.{4}ANIM", extensions=("anim", "anm")),
    Probe("amiga.deep", "IFF form DEEP", r"^FORM.{4}(DEEP|TVPP)", extensions=("deep", "iff")),
    Probe("amiga.pbm", "IFF form PBM", r"^FORM.{4}PBM ", extensions=("iff", "lbm", "pbm")),
    Probe("amiga.acbm", "IFF form ACBM", r"^FORM.{4}ACBM", extensions=("acbm", "iff")),
    Probe("amiga.dr2d", "IFF form DR2D", r"^FORM.{4}DR2D", extensions=("dr2d", "dr2")),
    Probe("amiga.ilbm", "IFF form ILBM", r"^FORM.{4}ILBM", extensions=("iff", "ilbm", "lbm", "lores")),
    Probe("amiga.iff", "IFF form", r"^FORM.{4}(?!16SV|8SVX|ANIM|DEEP|TVPP|PBM |ACBM|DR2D|ILBM)", extensions=("iff", "ilbm", "lbm")),
    Probe("amos.program", "program header", r"^AMOS (Basic |Pro)", extensions=("amos",)),
    Probe("amos.bank-set", "bank set signature", r"^AmBs", extensions=("abs",)),
    Probe("amos.bank", "bank signature", r"^AmBk", extensions=("abk",)),
    Probe("amos.sprite-bank", "sprite bank signature", r"^AmSp", extensions=("abk",)),
    Probe("amos.icon-bank", "icon bank signature", r"^AmIc", extensions=("abk",)),
    Probe("ansi.art", "control sequences", r"\x1b\[", "probable", ("ans", "art", "ice", "nfo")),
    Probe("ansi.art", "file name extension", r"^(?!.*\x1b\[)", "possible", ("ans", "art", "ice", "nfo"), "probable", required=True),
    Probe("zx-spectrum.screen", "size of a screen", "", "probable", ("scr",), sizes=(6912,)),
    Probe("zx-spectrum.gigascreen", "size of two screens", r"^(?!MZ)", "probable", ("scr",), required=True, sizes=(7680,)),
    Probe("zx-spectrum-next.layer2-image", "size of a layer", "", "probable", ("nxi", "sl2"), required=True, sizes=(49152, 49280, 49664, 81920)),
    Probe("zx-spectrum.snapshot", "size of a snapshot", "", "probable", ("sna", "snx"), sizes=(49179, 131103, 147487)),
    Probe("zx-spectrum.tap", "block lengths", r"^\x13\x00[\x00\xff]", "probable", ("tap", "tape")),
    Probe("zx-spectrum.tap", "file name extension", r"^(?!\x13\x00[\x00\xff])", "possible", ("tap", "tape"), "probable", required=True),
    Probe("zx-spectrum.tzx", "tape signature", r"^ZXTape!\x1a", extensions=("tzx",)),
    Probe("wordstar.document", "document header", r"^\x1d\x7d\x00", extensions=("ws",)),
    Probe("wordstar.document", "file name extension", r"^(?!\x1d\x7d\x00)", "possible", ("ws", "ws2", "ws3", "ws4", "ws5", "ws6", "ws7", "ws8", "ws9", "wsd"), "probable", required=True),
    Probe("rgba8.palette", "colour count and size", r"^(?!JASC-PAL)..\x00\x00", "possible", ("pal",), required=True),
    Probe("zx-spectrum-next.palette", "size of a palette", r"^(?!JASC-PAL)", "probable", ("nxp", "npl", "pal"), required=True, sizes=(32, 256, 512, 513)),
    Probe("adobe.color-table", "size of a colour table", "", "probable", ("act",), required=True, sizes=(768,)),
    Probe("image.openraster", "mimetype member", r"^PK\x03\x04.{26}mimetypeimage/openraster", extensions=("ora",), carrier="archive.zip"),
)


def ordered(probes: tuple[Probe, ...] | None = None) -> list[tuple[Probe, tuple[str, ...]]]:
    """Probes by rank, each with its derivation: what refines a type comes before it, to any depth (eight at most), and no type refines itself."""
    probes = PROBES if probes is None else probes

    def with_refiners(p: Probe, chain: tuple[str, ...]) -> list[tuple[Probe, tuple[str, ...]]]:
        chain = (*chain, p.type_id)
        finer = [x for q in probes if q.carrier == p.type_id and q.type_id not in chain and len(chain) < 8 for x in with_refiners(q, chain)]
        return [*finer, (p, chain)]

    return [x for p in probes if not p.carrier for x in with_refiners(p, ())]


def head_of(content: Column, size: int = HEAD, start: int = 0) -> Column:
    """The first bytes, or those from ``start`` on, a character each."""
    return F.decode(F.substr(content, F.lit(start + 1), F.lit(size)), "ISO-8859-1")


def extension_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))


def _fits(p: Probe) -> Column:
    out = F.lit(True)
    if p.head:
        out = out & F.col("_head").rlike("(?s)" + p.head)
    if p.at:
        out = out & head_of(F.col("content"), 8, p.at[0]).rlike("(?s)" + p.at[1])
    if p.sizes:
        out = out & F.octet_length("content").isin(*p.sizes)
    if p.required:
        out = out & F.col("_ext").isin(*p.extensions)
    return out


def candidates(sources: DataFrame, probes: tuple[Probe, ...] | None = None) -> DataFrame:
    """(source_id, rank, type_id, confidence, evidence, derivation), a row for each candidate, by rank from 1.

    ``sources`` has source_id, filename and content. A candidate that refines another comes
    before it, with the other in its derivation; where a terminal probe fits it is alone. A name
    that ends as a type's usually do is further evidence. All is one projection over a few
    short stretches of the content: no shuffle. Whether a candidate's whole structure holds is
    what its parser tells (see ``inspect.detect``).
    """
    base = sources.select("source_id", "content", head_of(F.col("content")).alias("_head"), extension_of(F.col("filename")).alias("_ext"))

    def row(p: Probe, derivation: tuple[str, ...]) -> Column:
        named = F.col("_ext").isin(*p.extensions) if p.extensions else F.lit(False)
        evidence = F.when(named, F.array(F.lit(p.evidence), F.concat(F.lit("file extension is ."), "_ext"))).otherwise(F.array(F.lit(p.evidence)))
        confidence = F.when(named, F.lit(p.with_extension)).otherwise(F.lit(p.confidence)) if p.with_extension else F.lit(p.confidence)
        return F.when(_fits(p), F.struct(F.lit(p.type_id).alias("type_id"), confidence.alias("confidence"), evidence.alias("evidence"), F.array(*map(F.lit, derivation)).alias("derivation")))

    rows = ordered(probes)
    found = F.array_compact(F.array(*[row(p, d) for p, d in rows]))
    alone = [row(p, d) for p, d in rows if p.terminal]
    only = F.coalesce(*alone) if alone else F.lit(None)
    each = base.select("source_id", only.alias("only"), found.alias("found")).select("source_id", F.posexplode(F.when(F.col("only").isNotNull(), F.array("only")).otherwise(F.col("found"))).alias("at", "c"))
    return each.select("source_id", (F.col("at") + 1).alias("rank"), "c.type_id", "c.confidence", "c.evidence", "c.derivation")


def _compiled() -> list[tuple]:
    return [(p, d, re.compile(p.head.encode("latin-1"), re.S), p.at and re.compile(p.at[1].encode("latin-1"), re.S)) for p, d in ordered(PROBES)]


_COMPILED = _compiled()


def add(probe: Probe) -> None:
    """Appends a probe to the registry of this process."""
    global PROBES, _COMPILED
    PROBES = (*PROBES, probe)
    _COMPILED = _compiled()


def candidates_of(data: bytes, filename: str) -> list[tuple[Probe, tuple[str, ...]]]:
    """The same for one source in memory: the probes that fit, by rank. A terminal probe ends the list but is not alone in it, as its parser may still refuse."""
    ending = filename.rpartition(".")[2].lower() if "." in filename else ""
    head, out = bytes(data[:HEAD]), []
    for p, derivation, pattern, there in _COMPILED:
        if (not p.sizes or len(data) in p.sizes) and (not p.required or ending in p.extensions) and pattern.search(head) and (there is None or there.match(data[p.at[0] : p.at[0] + 8])):
            out.append((p, derivation))
    return out


def winners(sources: DataFrame) -> DataFrame:
    """The first candidate of each source."""
    return candidates(sources).where("rank = 1")


def evidence_rows(found: DataFrame) -> DataFrame:
    """Evidence as metadata rows (source_id, type_id, key, value)."""
    return found.select("source_id", "type_id", F.posexplode("evidence").alias("at", "value")).select("source_id", "type_id", F.concat(F.lit("detection.evidence."), F.col("at") + 1).alias("key"), "value")
