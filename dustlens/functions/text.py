"""Old character sets and dates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the shifted set that differ from ASCII: small and capital letters change places (fixed values).
SMALL, CAPITAL = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def latin1(data: Column) -> Column:
    """Bytes as ISO 8859-1."""
    return F.decode(data, "ISO-8859-1")


def cp437(data: Column) -> Column:
    """Bytes as the PC's own set; what is below the space is left as it is."""
    return F.translate(latin1(data), "".join(map(chr, range(128, 256))), bytes(range(128, 256)).decode("cp437"))


def petscii(data: Column) -> Column:
    """Bytes as the Commodore's unshifted set: 0x41 to 0x5A capital letters, 0xC1 to 0xDA likewise, padding (0xA0) cut off at the end."""
    text = F.regexp_replace(latin1(data), "\u00a0+$", "")
    return F.translate(text, "".join(chr(0xC1 + i) for i in range(26)), CAPITAL)


def petscii_shifted(data: Column) -> Column:
    """Bytes as the Commodore's shifted set: 0x41 to 0x5A are small letters, 0xC1 to 0xDA capital ones."""
    text = F.translate(F.regexp_replace(latin1(data), "\u00a0+$", ""), CAPITAL, SMALL)
    return F.translate(text, "".join(chr(0xC1 + i) for i in range(26)), CAPITAL)


def utf16_zero_ended(data: Column) -> Column:
    """Little-endian UTF-16 up to the first zero."""
    return F.regexp_extract(F.decode(data, "UTF-16LE"), "(?s)^([^\u0000]*)", 1)


def disc_date(data: Column) -> Column:
    """Seven bytes of a disc's directory (years from 1900, month, day, hour, minute, second, quarters of an hour from Greenwich) as a time; null if they are none."""
    byte = lambda i: F.conv(F.hex(F.substr(data, F.lit(i), F.lit(1))), 16, 10).cast("int")
    quarter = F.when(byte(7) > 127, byte(7) - 256).otherwise(byte(7))
    local = F.try_make_timestamp(byte(1) + 1900, byte(2), byte(3), byte(4), byte(5), byte(6).cast("decimal(8,6)"), F.lit("UTC"))
    return F.when(F.octet_length(data) == 7, local - F.make_dt_interval(mins=quarter * 15))


def days_date(days: Column, minutes: Column, ticks: Column) -> Column:
    """Days from 1978 on, minutes, and fiftieths of a second, as a time."""
    return F.to_timestamp(F.lit("1978-01-01 00:00:00")) + F.make_dt_interval(days=days, mins=minutes, secs=(ticks / 50).cast("decimal(18,6)"))
