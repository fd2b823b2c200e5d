"""Resource paths and export names, as column expressions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that some file systems reserve for devices (fixed values).
DEVICE_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def segments(path: Column) -> Column:
    """The parts of a path that begins with a slash."""
    return F.split(F.ltrim(path, F.lit("/")), "/")


def matches(path: Column, pattern: str) -> Column:
    """Whether a path fits a pattern in which * stands for one whole segment. No **, and no relative segments."""
    parts = pattern.split("/")
    if not pattern.startswith("/") or any(p in ("", ".", "..", "**") or ("*" in p and p != "*") for p in parts[1:]):
        raise ValueError(f"not a path pattern: {pattern!r}")
    escaped = ["[^/]+" if p == "*" else "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in p) for p in parts[1:]]
    return path.rlike("^/" + "/".join(escaped) + "$")


def matches_any(path: Column, patterns: list[str]) -> Column:
    """One predicate for a union of patterns, so that each resource comes once and in tree order."""
    out = F.lit(False)
    for p in patterns:
        out = out | matches(path, p)
    return out


def percent_encode(text: Column) -> Column:
    """A path segment: letters, digits, - _ . stay, all else is %HH of its UTF-8 bytes; an empty one is %00."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("~"), F.lit("%7E"))
    return F.when(text == "", "%00").otherwise(encoded)


def export_segment(segment: Column) -> Column:
    """A portable file name: unsafe characters become underscores, spaces and dots at the end go, device names get an underscore in front."""
    name = F.regexp_replace(F.regexp_replace(segment, r'[\x00-\x1f<>:"/\\|?*]', "_"), r"[ .]+$", "")
    stem = F.upper(F.regexp_extract(name, r"(?s)^([^.]*)", 1))
    return F.when(name == "", "_").when(stem.isin(*DEVICE_NAMES), F.concat(F.lit("_"), name)).otherwise(name)


def export_name(path: Column) -> Column:
    """A portable relative path: each segment by itself, empty ones left out."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), export_segment), "/")


_UNSAFE = re.compile(r'[\x00-\x1f<>:"/\\|?*]')


def portable_segment(segment: str) -> str:
    """``export_segment`` of a string."""
    name = _UNSAFE.sub("_", segment).rstrip(" .") or "_"
    return f"_{name}" if name.split(".")[0].upper() in DEVICE_NAMES else name


def portable_path(path: str) -> str:
    """``export_name`` of a string."""
    return "/".join(portable_segment(x) for x in path.split("/") if x)


#: What Markdown reads as markup within a line (fixed values); other signs are markup only in places where a paragraph's text cannot put them.
MARKDOWN_SIGNS = "\\`*_[]<>|"


def markdown_escaped(text: Column) -> Column:
    """Text with a backslash before each of ``MARKDOWN_SIGNS``."""
    return F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")


def segment_encoded(value: str) -> str:
    """``percent_encode`` of a string."""
    return quote(value, safe="").replace("~", "%7E") if value else "%00"
