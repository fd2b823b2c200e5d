"""Codecs over bytes. Each raises ValueError on bad input."""

from __future__ import annotations

import lzma
import re
import zlib


def inflate(data: bytes, most: int = 1 << 29) -> bytes:
    """Raw DEFLATE; the stream must end, with nothing behind it."""
    stream = zlib.decompressobj(-15)
    try:
        out = stream.decompress(data, most)
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if not stream.eof or stream.unused_data:
        raise ValueError("the stream does not end where it should, or is too large")
    return out


def unlzma2(data: bytes, dictionary: int = 1 << 23, most: int = 1 << 31) -> bytes:
    """Chunks of LZMA, each plain or packed, without a header."""
    try:
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": dictionary}]).decompress(data, most)
    except (lzma.LZMAError, EOFError) as e:
        raise ValueError(str(e)) from e


def unlzma(data: bytes, dict_size: int = 1 << 20, lc: int = 3, lp: int = 0, pb: int = 2) -> bytes:
    try:
        return lzma.decompress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": dict_size, "lc": lc, "lp": lp, "pb": pb}])
    except lzma.LZMAError as e:
        raise ValueError(str(e)) from None


def unpack_runs(data: bytes, size: int) -> bytes:
    """ByteRun1: a count byte n up to 127 copies n + 1 bytes, one from 129 on repeats the next byte 257 - n times, 128 does nothing."""
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("run data ends early")
        n = data[at]
        at += 1
        if n < 128:
            if at + n + 1 > len(data):
                raise ValueError("literal run ends early")
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            if at >= len(data):
                raise ValueError("repeat run ends early")
            out += data[at : at + 1] * (257 - n)
            at += 1
    if len(out) != size:
        raise ValueError("a run crosses the end")
    return bytes(out)


_RUNS = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_runs(data: bytes) -> bytes:
    """The inverse of ``unpack_runs``."""
    out, at = [], 0
    for run in _RUNS.finditer(data):
        out += [bytes([min(128, run.start() - i) - 1]) + data[i : min(i + 128, run.start())] for i in range(at, run.start(), 128)]
        at = run.end()
        out.append(bytes([257 - at + run.start(), data[run.start()]]))
    out += [bytes([min(128, len(data) - i) - 1]) + data[i : i + 128] for i in range(at, len(data), 128)]
    return b"".join(out)


def lzw_decode(data: bytes, bits: int) -> bytes:
    """GIF's variable-width LZW, least significant bit first, codes of up to 12 bits."""
    clear, stop = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, width, hold, held, last = bytearray(), bits + 1, 0, 0, b""
    for byte in data:
        hold |= byte << held
        held += 8
        while held >= width:
            code, hold, held = hold & ((1 << width) - 1), hold >> width, held - width
            if code == clear:
                table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, b""
                continue
            if code == stop:
                return bytes(out)
            if code < len(table):
                entry = table[code]
            elif code == len(table) and last:
                entry = last + last[:1]
            else:
                raise ValueError("code out of range")
            out += entry
            if last and len(table) < 4096:
                table.append(last + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = entry
    raise ValueError("no end code")


def lzw_encode(data: bytes, bits: int) -> bytes:
    """The inverse of ``lzw_decode``."""
    clear, stop = 1 << bits, (1 << bits) + 1
    out, hold, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal hold, held
        hold |= code << held
        held += width
        while held >= 8:
            out.append(hold & 255)
            hold >>= 8
            held -= 8

    table, width = {bytes([i]): i for i in range(clear)}, bits + 1
    put(clear, width)
    size, last = stop + 1, b""
    for i in range(len(data)):
        now = last + data[i : i + 1]
        if now in table:
            last = now
            continue
        put(table[last], width)
        if size < 4096:
            table[now] = size
            size += 1
            if size - 1 == 1 << width and width < 12:
                width += 1
        last = data[i : i + 1]
    if last:
        put(table[last], width)
        if size < 4096:
            size += 1
            if size - 1 == 1 << width and width < 12:
                width += 1
    put(stop, width)
    if held:
        out.append(hold & 255)
    return bytes(out)


def unfilter_sub(row: bytes, step: int) -> bytes:
    """PNG's Sub filter undone: each byte adds the one ``step`` before it."""
    out = bytearray(row)
    for i in range(step, len(out)):
        out[i] = (out[i] + out[i - step]) & 255
    return bytes(out)


class _Bits:
    """Bits of a stream, the highest of each byte first; 0 past the end, as encoders leave the last bits out."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            if self.at > len(self.data) + 8:
                raise ValueError("packed data ends early")
            self.held = (self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & 0xFFFFFFFFFF
            self.at += 1
            self.n += 8
        return self.held >> self.n - n & (1 << n) - 1

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.n -= n
        return out


def _prefix_codes(lengths: list[int]) -> dict[tuple[int, int], int]:
    """(bits, code) -> symbol of a canonical prefix code; it must be complete."""
    out, code = {}, 0
    for size in range(1, 17):
        for symbol, own in enumerate(lengths):
            if own == size:
                out[size, code] = symbol
                code += 1
        code <<= 1
    if code != 1 << 17:
        raise ValueError("a prefix code is not complete")
    return out


class _Symbols:
    """Reads symbols of one prefix code, or the only symbol there is."""

    def __init__(self, lengths: list[int] | None, only: int = 0):
        self.only, self.codes = only, _prefix_codes(lengths) if lengths is not None else None

    def read(self, bits: _Bits) -> int:
        if self.codes is None:
            return self.only
        code = 0
        for size in range(1, 17):
            code = code << 1 | bits.take(1)
            symbol = self.codes.get((size, code))
            if symbol is not None:
                return symbol
        raise ValueError("no such code")


def _short_lengths(bits: _Bits, most: int, count_bits: int, gap: int) -> _Symbols:
    """Lengths of 3 bits, 7 and more in unary; after the third of ``gap`` lengths a count of zeros."""
    n = bits.take(count_bits)
    if n == 0:
        return _Symbols(None, bits.take(count_bits))
    lengths: list[int] = []
    while len(lengths) < n:
        size = bits.take(3)
        if size == 7:
            while bits.take(1):
                size += 1
        lengths.append(size)
        if len(lengths) == gap:
            lengths += [0] * bits.take(2)
    if len(lengths) > most or max(lengths) > 16:
        raise ValueError("bad code lengths")
    return _Symbols(lengths)


def _long_lengths(bits: _Bits, short: _Symbols) -> _Symbols:
    n = bits.take(9)
    if n == 0:
        return _Symbols(None, bits.take(9))
    lengths: list[int] = []
    while len(lengths) < n:
        s = short.read(bits)
        lengths += [s - 2] if s > 2 else [0] * (1 if s == 0 else bits.take(4) + 3 if s == 1 else bits.take(9) + 20)
    if len(lengths) > 510:
        raise ValueError("bad code lengths")
    return _Symbols(lengths)


def unpack_lh5(data: bytes, size: int) -> bytes:
    """Blocks of prefix-coded literals and copies out of the last 8,192 bytes, which begin as spaces."""
    if size > 1 << 28:
        raise ValueError("a member is too large")
    bits, out, left = _Bits(data), bytearray(b" " * 8192), 0
    literal = place = _Symbols(None)
    while len(out) < size + 8192:
        if not left:
            left = bits.take(16)
            literal = _long_lengths(bits, _short_lengths(bits, 19, 5, 3))
            place = _short_lengths(bits, 14, 4, -1)
            if not left:
                raise ValueError("a block is empty")
        left -= 1
        symbol = literal.read(bits)
        if symbol < 256:
            out.append(symbol)
            continue
        p = place.read(bits)
        back = (1 << p - 1 | bits.take(p - 1) if p > 1 else p) + 1
        if back > 8192:
            raise ValueError("a copy reaches too far back")
        for _ in range(symbol - 253):
            out.append(out[-back])
    if len(out) != size + 8192:
        raise ValueError("a copy crosses the end")
    return bytes(out[8192:])


def pack_lh5(data: bytes) -> bytes:
    """The same format with literals only, 8 bits each: each block behind a header of 43 bits."""
    bits = []
    for at in range(0, len(data), 65535):
        part = data[at : at + 65535]
        bits.append(f"{len(part):016b}" + f"{0:05b}{10:05b}" + f"{256:09b}" + f"{0:04b}{0:04b}" + "".join(f"{b:08b}" for b in part))
    out = "".join(bits)
    out += "0" * (-len(out) % 8)
    return int(out or "0", 2).to_bytes(len(out) // 8, "big")


def crc16(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    return crc
