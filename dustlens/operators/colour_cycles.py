"""Palettes whose ranges turn round in time."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustlens.functions.binary import lcm

#: Frames that an expansion may have, unless it is told that more are wanted.
MOST_FRAMES = 1000


class Cycle(NamedTuple):
    """Palette entries low to high, both included, that move by one every ``step`` milliseconds, upwards unless ``direction`` is negative."""

    low: int
    high: int
    step: int
    direction: int = 1

    @property
    def length(self) -> int:
        return self.high - self.low + 1


def period(cycles: list[Cycle], start: int = 1) -> int:
    """Milliseconds after which all ranges are where they began; what exceeds 63 bits is an error."""
    out = start
    for c in cycles:
        if c.step <= 0 or c.length <= 0:
            raise ValueError("colour-cycle periods must be positive")
        out = math.lcm(out, c.step * c.length)
        if out >= 1 << 63:
            raise ValueError("the combined colour-cycle period is too large")
    return out


def next_boundary(cycles: list[Cycle], elapsed: int) -> int:
    """The first moment after ``elapsed`` at which a range moves."""
    if not cycles:
        raise ValueError("no colour cycles")
    return min((elapsed // c.step + 1) * c.step for c in cycles)


def palette_at(palette: np.ndarray, cycles: list[Cycle], elapsed: int) -> np.ndarray:
    """The palette (a row for each colour) at a moment: ranges turn one after the other, each what the one before left."""
    out = palette.copy()
    for c in cycles:
        shift = elapsed // c.step % c.length
        out[c.low : c.high + 1] = np.roll(out[c.low : c.high + 1], shift if c.direction >= 0 else -shift, axis=0)
    return out


def expand(cycles: list[Cycle], durations: list[int] | None = None, most: int = MOST_FRAMES) -> list[tuple[int, int, int]]:
    """(frame, start, milliseconds) of a full period: a frame ends where a range moves or, in an animation with ``durations``, where a picture does. Too many frames are an error."""
    if not cycles:
        raise ValueError("no colour cycles")
    shown = [max(1, d) for d in durations] if durations else []
    whole = period(cycles, sum(shown) or 1)
    out, now, picture = [], 0, 0
    end = shown[0] if shown else whole
    while now < whole:
        if len(out) >= most:
            raise ValueError(f"colour cycling would exceed {most} frames")
        later = min(end, whole, next_boundary(cycles, now))
        out.append((picture, now, later - now))
        now = later
        if shown and now == end and now < whole:
            picture = (picture + 1) % len(shown)
            end += shown[picture]
    return out


def cycled_frames(index: bytes, palette: np.ndarray, cycles: list[Cycle], most: int = MOST_FRAMES) -> list[tuple[int, bytes]]:
    """(milliseconds, RGBA pixels) of a still picture of palette indexes, over a full period."""
    pixels = np.frombuffer(index, np.uint8)
    return [(ms, palette_at(palette, cycles, start)[pixels].astype(np.uint8).tobytes()) for _, start, ms in expand(cycles, most=most)]


def period_of(cycles: Column) -> Column:
    """``period`` of an array of (low, high, step, direction), as a column expression; null for an empty array. What exceeds 63 bits is an error in ANSI mode."""
    length = lambda c: (c["high"] - c["low"] + 1).cast("long") * c["step"].cast("long")
    return F.when(F.size(cycles) > 0, F.aggregate(cycles, F.lit(1).cast("long"), lambda a, c: lcm(a, length(c))))


def boundary_of(cycles: Column, elapsed: Column) -> Column:
    """``next_boundary`` of an array of cycles, as a column expression; null for an empty array."""
    return F.array_min(F.transform(cycles, lambda c: (F.floor(elapsed / c["step"]) + 1) * c["step"]))


def expanded(rows: DataFrame, key: str, cycles: str, most: int = MOST_FRAMES) -> DataFrame:
    """(key, frame, start, ms): the frames of each row's cycles over a full period; a row that would have more than ``most`` is an error, one without cycles has none."""
    wrong = F.exists("cycles", lambda c: (c["step"] <= 0) | (c["high"] < c["low"]))
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(cycles).alias("cycles")).where("size(cycles) > 0")
    own = own.select("key", "cycles", F.when(wrong, F.raise_error(F.lit("colour-cycle periods must be positive")).cast("long")).otherwise(period_of(F.col("cycles"))).alias("whole"))
    # A range alone moves this often; where that is too much its moments are never listed.
    often = F.array_max(F.transform("cycles", lambda c: F.call_function("div", F.col("whole"), c["step"].cast("long"))))
    error = F.raise_error(F.lit(f"colour cycling would exceed {most} frames")).cast("array<bigint>")
    moments = F.flatten(F.transform("cycles", lambda c: F.sequence(F.lit(0).cast("long"), F.col("whole") - 1, c["step"].cast("long"))))
    starts = own.select("key", "whole", F.when(often > most, error).otherwise(F.sort_array(F.array_distinct(moments))).alias("starts"))
    ends = F.concat(F.slice("starts", F.lit(2), F.lit(most)), F.array("whole"))
    frames = F.when(F.size("starts") > most, F.raise_error(F.lit(f"colour cycling would exceed {most} frames")).cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.arrays_zip(F.col("starts").alias("start"), ends.alias("end")))
    return starts.select("key", F.posexplode(frames).alias("frame", "f")).select("key", "frame", F.col("f.start").alias("start"), (F.col("f.end") - F.col("f.start")).alias("ms"))
