"""Checksums, hex dumps and bits, as column expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(data: Column) -> Column:
    """The bytes as an array of numbers 0 to 255."""
    hexes = F.hex(data)
    count = F.octet_length(data)
    at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))


def xor_checksum(data: Column) -> Column:
    """All bytes, exclusive-or."""
    return F.aggregate(byte_values(data), F.lit(0), lambda a, b: a.bitwiseXOR(b))


def sum_checksum(data: Column) -> Column:
    """The sum of all bytes, modulo 256."""
    return F.aggregate(byte_values(data), F.lit(0), lambda a, b: (a + b) % 256)


def crc32_checksum(data: Column) -> Column:
    """The reflected 32-bit remainder that archives and pictures carry."""
    return F.crc32(data)


#: Bytes of a payload that a hex dump shows, unless told otherwise.
DUMPED = 1 << 20


def hex_lines(data: Column, width: int = 16, most: int = DUMPED) -> Column:
    """An array of (offset, hex, text) lines of the first ``most`` bytes; text has a dot for what is not printable ASCII."""
    count = F.least(F.octet_length(data), F.lit(most))
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    line = lambda s: F.substr(data, s + 1, F.least(F.lit(width), count - s))
    shown = lambda s: F.regexp_replace(F.decode(line(s), "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return F.transform(starts, lambda s: F.struct(s.alias("offset"), F.lower(F.hex(line(s))).alias("hex"), shown(s).alias("text")))


def expand_bits(value: Column, shift: int, bits: int) -> Column:
    """A channel of ``bits`` bits of a packed colour, spread over 0 to 255 by rounding."""
    most = (1 << bits) - 1
    return F.round(F.shiftright(value, shift).bitwiseAND(most) * F.lit(255.0) / most).cast("int")


def rgb332(byte: Column) -> Column:
    """(r, g, b) of a byte of three, three and two bits. Blue is widened to three bits: the lowest is set where any of its two is."""
    blue = byte.bitwiseAND(3)
    wide = F.shiftleft(blue, 1).bitwiseOR(F.when(blue > 0, 1).otherwise(0))
    return F.struct(expand_bits(byte, 5, 3).alias("r"), expand_bits(byte, 2, 3).alias("g"), expand_bits(wide, 0, 3).alias("b"))


def lcm(a: Column, b: Column) -> Column:
    """The least common multiple of two positive longs; the Euclidean steps are folded over as many rounds as 64 bits need."""
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(93)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y"))))
    return F.call_function("div", a, steps["x"]) * b
