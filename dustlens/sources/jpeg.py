"""JPEG with prefix codes, in one scan or many, sequential or progressive: coefficients, their inverse transform, and colours."""

from __future__ import annotations

import numpy as np

from dustlens.sources.model import Reader, need

#: Places of the coefficients in a block of 8 by 8, along its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_K = np.arange(8)
#: The transform's matrix: rows are frequencies.
COSINES = np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16)


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits that may come next the size of their first code and its symbol, 256 * size + symbol; 0 where there is no code."""
    out, code, at = [0] * 65536, 0, 0
    for size, n in enumerate(counts, 1):
        for _ in range(n):
            need(code < 1 << size, "more codes than there are")
            span = 1 << 16 - size
            out[code * span : (code + 1) * span] = [size << 8 | symbols[at]] * span
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Scan:
    """Bits of a scan's data; 0xFF00 stands for 0xFF."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n, self.beyond = data.replace(b"\xff\0", b"\xff"), 0, 0, 0, 0

    def _next(self) -> int:
        """The next 16 bits; zeros behind the end, which may be looked at but not taken."""
        while self.n < 16:
            if self.at < len(self.data):
                self.held = (self.held & (1 << self.n) - 1) << 8 | self.data[self.at]
                self.at += 1
            else:
                self.held = (self.held & (1 << self.n) - 1) << 8
                self.beyond += 8
            self.n += 8
        return self.held >> self.n - 16 & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self._next() >> 16 - n
        self.n -= n
        need(self.n >= self.beyond, "a scan ends early")
        return out

    def symbol(self, table: list[int]) -> int:
        found = table[self._next()]
        need(found > 0, "no such code")
        self.n -= found >> 8
        need(self.n >= self.beyond, "a scan ends early")
        return found & 255

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> n - 1 else v - (1 << n) + 1


class _Component:
    """One colour's coefficients, a row of 64 in zigzag order for each block."""

    def __init__(self, name: int, across: int, down: int, table: int, mcus: tuple[int, int]):
        self.name, self.h, self.v, self.table = name, across, down, table
        self.blocks = np.zeros((mcus[1] * down, mcus[0] * across, 64), np.int32)
        self.last, self.quant = 0, None


def _sequential(scan: _Scan, own: _Component, block: np.ndarray, dc: list[int], ac: list[int]) -> None:
    own.last += scan.signed(scan.symbol(dc))
    block[0], k = own.last, 1
    while k < 64:
        s = scan.symbol(ac)
        if not s & 15:
            if s != 0xF0:
                break
            k += 16
            continue
        k += s >> 4
        need(k < 64, "a block is too long")
        block[k] = scan.signed(s & 15)
        k += 1


class _Progress:
    """A scan of a progressive picture: some places of the coefficients, some bits of them."""

    def __init__(self, start: int, end: int, high: int, low: int):
        self.start, self.end, self.high, self.low, self.run = start, end, high, low, 0

    def block(self, scan: _Scan, own: _Component, block: np.ndarray, dc: list[int] | None, ac: list[int] | None) -> None:
        if self.start == 0:
            if self.high:
                block[0] |= scan.take(1) << self.low
            else:
                own.last += scan.signed(scan.symbol(dc))
                block[0] = own.last << self.low
        elif self.high:
            self._refine(scan, block, ac)
        else:
            self._first(scan, block, ac)

    def _first(self, scan: _Scan, block: np.ndarray, ac: list[int]) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.start
        while k <= self.end:
            s = scan.symbol(ac)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                need(k <= self.end, "a band is too long")
                block[k] = scan.signed(size) * (1 << self.low)
                k += 1
            elif zeros == 15:
                k += 16
            else:  # this and so many more blocks have no more in the band
                self.run = (1 << zeros) - 1 + scan.take(zeros)
                return

    def _refine(self, scan: _Scan, block: np.ndarray, ac: list[int]) -> None:
        step, k = 1 << self.low, self.start

        def again(at: int) -> None:
            """One more bit of what is not zero already."""
            if scan.take(1) and not abs(int(block[at])) & step:
                block[at] += step if block[at] > 0 else -step

        if not self.run:
            while k <= self.end:
                s = scan.symbol(ac)
                zeros, size, value = s >> 4, s & 15, 0
                if size:
                    need(size == 1, "a refinement has one bit")
                    value = step if scan.take(1) else -step
                elif zeros < 15:
                    self.run = (1 << zeros) + scan.take(zeros)
                    break
                while k <= self.end:
                    if block[k]:
                        again(k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    k += 1
        if self.run:
            for at in range(k, self.end + 1):
                if block[at]:
                    again(at)
            self.run -= 1


def _sections(data: bytes, at: int) -> tuple[list[bytes], int]:
    """A scan's data, cut at restarts, and the place of the marker behind it. Data that ends without one ends the scan."""
    out, end, start = [], at, at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end >= len(data) - 1:
            return [*out, data[start:]], len(data)
        if 0xD0 <= data[end + 1] <= 0xD7:
            out.append(data[start:end])
            start = end + 2
        elif data[end + 1] not in (0, 0xFF):
            return [*out, data[start:end]], end
        end += 1 if data[end + 1] == 0xFF else 2


def decode(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and RGBA of a picture of one or three components."""
    r, at, quant, codes, restart, frame, adobe, scans = Reader(data), 2, {}, {}, 0, [], None, 0
    progressive = False
    while at + 4 <= len(data):
        mark, size = r.unpack(">HH", at)
        kind = mark & 255
        need(mark >> 8 == 0xFF, "no marker")
        if kind == 0xFF:
            at += 1
            continue
        if kind == 0xD9:
            break
        body = Reader(r.take(at + 4, size - 2))
        at += 2 + size
        if kind == 0xDB:
            here = 0
            while here < size - 2:
                (head,) = body.unpack("B", here)
                quant[head & 15] = np.array(body.unpack(">64H" if head >> 4 else "64B", here + 1))
                here += 129 if head >> 4 else 65
        elif kind == 0xC4:
            here = 0
            while here < size - 2:
                head, counts = body.take(here, 1)[0], body.take(here + 1, 16)
                codes[head] = _table(counts, body.take(here + 17, sum(counts)))
                here += 17 + sum(counts)
        elif kind == 0xDD:
            (restart,) = body.unpack(">H", 0)
        elif kind == 0xEE and body.data[:5] == b"Adobe":
            adobe = body.take(11, 1)[0]
        elif kind in (0xC0, 0xC1, 0xC2):
            need(not frame, "two frames")
            depth, height, width, n = body.unpack(">BHHB", 0)
            need(depth == 8 and width > 0 and height > 0 and n in (1, 3) and width * height <= 1 << 26, "unsupported frame")
            named = [body.unpack("BBB", 6 + 3 * i) for i in range(n)]
            need(all(1 <= f >> 4 <= 4 and 1 <= f & 15 <= 4 for _, f, _ in named), "odd components")
            named = [(c, 0x11 if n == 1 else f, t) for c, f, t in named]
            wide, high = max(f >> 4 for _, f, _ in named), max(f & 15 for _, f, _ in named)
            across, down = -(-width // (8 * wide)), -(-height // (8 * high))
            frame, progressive = [_Component(c, f >> 4, f & 15, t, (across, down)) for c, f, t in named], kind == 0xC2
        elif 0xC3 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("arithmetic, lossless or layered coding")
        elif kind == 0xDA:
            need(bool(frame), "no frame before the scan")
            n = body.data[0]
            own = []
            for i in range(n):
                name, which = body.unpack("BB", 1 + 2 * i)
                part = next((c for c in frame if c.name == name), None)
                need(part is not None, "a scan of no component")
                own.append((part, codes.get(which >> 4), codes.get(which & 15 | 16)))
                if part.quant is None:
                    part.quant = quant[part.table]
            start, end, bits = body.unpack("BBB", 1 + 2 * n)
            need(not progressive or start <= end <= 63 and (start == 0) == (end == 0) and (n == 1 or start == 0), "odd scan")
            step = _Progress(start, end, bits >> 4, bits & 15)
            parts, at = _sections(data, at)
            alone = n == 1
            if alone:  # a component by itself has no more blocks than its picture needs
                c = own[0][0]
                size_of = lambda whole, f, most: -(-(-(-whole * f // most)) // 8)
                units = size_of(width, c.h, wide), size_of(height, c.v, high)
            else:
                units = across, down
            scan = None
            for unit in range(units[0] * units[1]):
                if unit == 0 or restart and unit % restart == 0:
                    section = unit // restart if restart else 0
                    need(section < len(parts), "a restart is missing")
                    scan, step.run = _Scan(parts[section]), 0
                    for c, _, _ in own:
                        c.last = 0
                y, x = divmod(unit, units[0])
                for c, dc, ac in own:
                    places = [(y, x)] if alone else [(y * c.v + j, x * c.h + i) for j in range(c.v) for i in range(c.h)]
                    for place in places:
                        if progressive:
                            step.block(scan, c, c.blocks[place], dc, ac)
                        else:
                            _sequential(scan, c, c.blocks[place], dc, ac)
            scans += 1
    need(scans > 0 and all(c.quant is not None for c in frame), "a component has no scan")
    planes = []
    for c in frame:
        plain = np.zeros((*c.blocks.shape[:2], 64))
        plain[..., ZIGZAG] = c.blocks * c.quant
        plain = np.einsum("fy,abfg,gx->abyx", COSINES, plain.reshape(*c.blocks.shape[:2], 8, 8), COSINES)
        plane = np.clip(np.rint(plain + 128), 0, 255).transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, c.blocks.shape[1] * 8)
        rows, columns = np.arange(height) * c.v // high, np.arange(width) * c.h // wide
        planes.append(plane[rows][:, columns])
    if len(planes) == 1:
        rgb = [planes[0]] * 3
    elif adobe == 0:
        rgb = planes
    else:
        y, b, c = planes[0], planes[1] - 128, planes[2] - 128
        rgb = [y + 1.402 * c, y - 0.344136 * b - 0.714136 * c, y + 1.772 * b]
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = np.clip(np.rint(np.stack(rgb, axis=2)), 0, 255)
    return width, height, out.tobytes()


def exif_fields(body: bytes) -> dict[str, int | str]:
    """Orientation, maker, model and date of an Exif block: its first directory only."""
    r = Reader(body[6:])
    need(body[:6] == b"Exif\0\0" and body[6:8] in (b"II", b"MM"), "no Exif block")
    way = "<" if body[6:8] == b"II" else ">"
    magic, at = r.unpack(way + "HI", 2)
    need(magic == 42, "no Exif block")
    (count,) = r.unpack(way + "H", at)
    out: dict[str, int | str] = {}
    for i in range(count):
        tag, kind, n = r.unpack(way + "HHI", at + 2 + 12 * i)
        if tag == 0x112 and kind == 3:
            out["orientation"] = r.unpack(way + "H", at + 10 + 12 * i)[0]
        elif tag in (0x10F, 0x110, 0x132) and kind == 2:
            place = at + 10 + 12 * i if n <= 4 else r.unpack(way + "I", at + 10 + 12 * i)[0]
            out[{0x10F: "make", 0x110: "model", 0x132: "date-time"}[tag]] = r.take(place, n).split(b"\0")[0].decode("latin-1")
    return out


def oriented(width: int, height: int, rgba: bytes, orientation: int) -> tuple[int, int, bytes]:
    """A picture as it is meant to be seen, by its Exif orientation 1 to 8."""
    p = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    if orientation in (5, 6, 7, 8):
        p = p.transpose(1, 0, 2)
    if orientation in (2, 3, 6, 7):
        p = p[:, ::-1]
    if orientation in (3, 4, 7, 8):
        p = p[::-1]
    return p.shape[1], p.shape[0], np.ascontiguousarray(p).tobytes()
