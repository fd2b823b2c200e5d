"""What inspecting a source yields: a tree of resources, flattened."""

from __future__ import annotations

import struct
from typing import NamedTuple

from dustlens.operators.colour_cycles import Cycle


class Raster(NamedTuple):
    width: int
    height: int
    rgba: bytes


class Audio(NamedTuple):
    rate: int
    bits: int
    channels: list[list[int]]


class Node(NamedTuple):
    """A resource. kind: group, raster, text, document, audio, font, palette, tracker, vector, opaque or table."""

    path: str
    type_id: str
    kind: str
    metadata: list[tuple[str, str | int]]
    data: bytes | None = None
    raster: Raster | None = None
    audio: Audio | None = None
    palette: list[tuple[int, int, int, int]] | None = None
    text: str | None = None
    frames: list[tuple[int, bytes]] | None = None  # milliseconds and pixels, where there is more than one
    index: bytes | None = None  # a byte for each pixel, its place in the palette, where colours turn
    cycles: list[Cycle] | None = None  # ranges of the palette that turn in time


class Reader:
    """Bounded reads: what lies outside the data is a ValueError."""

    def __init__(self, data: bytes):
        self.data = data

    def take(self, at: int, size: int) -> bytes:
        if at < 0 or size < 0 or at + size > len(self.data):
            raise ValueError(f"{size} bytes at {at} are outside of {len(self.data)}")
        return self.data[at : at + size]

    def unpack(self, form: str, at: int) -> tuple:
        return struct.unpack(form, self.take(at, struct.calcsize(form)))


def need(fine: bool, why: str) -> None:
    if not fine:
        raise ValueError(why)


def safe_name(name: str) -> str:
    """A member's relative path; absolute ones, relative segments and empty segments are refused."""
    parts = name.replace("\\", "/").rstrip("/").split("/")
    need(bool(name) and len(name) <= 255 and not name.startswith("/") and all(p not in ("", ".", "..") for p in parts) and ":" not in parts[0], f"unsafe name {name!r}")
    return "/".join(parts)
