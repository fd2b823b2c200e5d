"""Parsers of palettes and sounds."""

from __future__ import annotations

import re

import numpy as np

from dustlens.sources.images import iff_chunks
from dustlens.sources.model import Audio, Node, Reader, need


def _lines(data: bytes) -> list[str]:
    return [x.removesuffix("\r") for x in data.decode("utf-8").split("\n")]


def adobe_table(data: bytes, name: str) -> list[Node]:
    need(len(data) == 768, "a table has 768 bytes")
    return [Node("/palette", "adobe.color-table", "palette", [("colours", 256)], palette=[(*data[i : i + 3], 255) for i in range(0, 768, 3)])]


def rgba8(data: bytes, name: str) -> list[Node]:
    (count,) = Reader(data).unpack("<I", 0)
    need(1 <= count <= 65536 and count * 4 + 4 == len(data), "the count is not that of the colours")
    return [Node("/palette", "rgba8.palette", "palette", [("colours", count)], palette=[tuple(data[i : i + 4]) for i in range(4, len(data), 4)])]


def jasc(data: bytes, name: str) -> list[Node]:
    lines = _lines(data)
    need(len(lines) > 2 and lines[0] == "JASC-PAL" and lines[1] == "0100" and lines[2].isdecimal(), "no JASC palette")
    count = int(lines[2])
    need(1 <= count <= 65536 and len(lines) >= 3 + count and not any(lines[3 + count :]), "the count is not that of the colours")
    colours = [tuple(map(int, x.split(" "))) for x in lines[3 : 3 + count]]
    need(all(len(c) == 3 and max(c) < 256 and min(c) >= 0 for c in colours), "a colour is no triple of bytes")
    return [Node("/palette", "jasc.palette", "palette", [("colours", count), ("version", "0100")], palette=[(*c, 255) for c in colours])]


def gimp(data: bytes, name: str) -> list[Node]:
    lines = _lines(data)
    need(lines[0] == "GIMP Palette", "no GIMP palette")
    title, columns, alpha, colours = None, 0, False, []
    for line in lines[1:]:
        if line.startswith("Name: ") and title is None and not colours:
            title = line[6:]
        elif line == "Channels: RGBA" and not colours:
            alpha = True
        elif line.startswith("Columns: ") and not colours:
            columns = int(line[9:])
        elif line.strip() and not line.startswith("#"):
            fields = line.split()
            need(len(fields) >= 3 + alpha, "a colour has too few fields")
            c = tuple(map(int, fields[: 3 + alpha]))
            need(all(0 <= v < 256 for v in c), "a colour is out of range")
            colours.append(c if alpha else (*c, 255))
    need(bool(colours) and 0 <= columns < 256, "no colours")
    return [Node("/palette", "gimp.palette", "palette", [("colours", len(colours)), ("columns", columns), ("name", title or ""), ("channels", "RGBA" if alpha else "RGB")], palette=colours)]


def paint_net(data: bytes, name: str) -> list[Node]:
    lines = _lines(data)
    need(re.fullmatch(r"; ?paint\.net Palette File", lines[0]) is not None, "no palette header")
    colours = []
    for line in lines[1:]:
        if line.strip() and not line.startswith(";"):
            need(re.fullmatch(r"[0-9A-Fa-f]{8}", line.strip()) is not None, "a colour is not eight hex digits")
            a, r, g, b = bytes.fromhex(line.strip())
            colours.append((r, g, b, a))
    return [Node("/palette", "paint-net.palette", "palette", [("colours", len(colours))], palette=colours)]


def swatches(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    magic, major, minor, blocks = r.unpack(">4sHHI", 0)
    need(magic == b"ASEF" and (major, minor) == (1, 0), "no swatch file")
    at, colours, other = 12, [], 0
    for _ in range(blocks):
        kind, size = r.unpack(">HI", at)
        if kind == 1:
            (n,) = r.unpack(">H", at + 6)
            place = at + 8 + 2 * n
            if r.take(place, 4) == b"RGB ":
                colours.append((*[round(min(1.0, max(0.0, v)) * 255) for v in r.unpack(">fff", place + 4)], 255))
            else:
                other += 1
        at += 6 + size
    need(at == len(data), "data behind the blocks")
    return [Node("/palette", "adobe.swatch-exchange", "palette", [("version.major", major), ("version.minor", minor), ("blocks", blocks), ("rgb-colours", len(colours)), ("unsupported-colours", other)], palette=colours)]


#: The eight levels of a three-bit channel (fixed values).
LEVELS = (0x00, 0x24, 0x49, 0x6D, 0x92, 0xB6, 0xDB, 0xFF)


def next_palette(data: bytes, name: str) -> list[Node]:
    need(len(data) in (32, 256, 512, 513), "not the size of a palette")
    colours = []
    for i in range(0, len(data) // 2 * 2 if len(data) >= 512 or len(data) == 32 else len(data), 2 if len(data) != 256 else 1):
        b = data[i]
        low = data[i + 1] if len(data) != 256 else (b & 1) | (b >> 1 & 1)
        need(low in (0, 1), "a low bit is neither 0 nor 1")
        colours.append((LEVELS[b >> 5], LEVELS[b >> 2 & 7], LEVELS[(b & 3) << 1 | low], 255))
    metadata: list[tuple[str, str | int]] = [("colours", len(colours)), ("bits-per-colour", 8 if len(data) == 256 else 9)]
    if len(data) == 513:
        colours[data[512]] = (*colours[data[512]][:3], 0)
        metadata.append(("transparent-index", data[512]))
    return [Node("/palette", "zx-spectrum-next.palette", "palette", metadata, palette=colours)]


def wav(data: bytes, name: str) -> list[Node]:
    r = Reader(data)
    need(r.take(0, 4) == b"RIFF" and r.unpack("<I", 4)[0] == len(data) - 8 and r.take(8, 4) == b"WAVE", "no WAVE of this size")
    at, chunks = 12, []
    while at < len(data):
        kind, size = r.unpack("<4sI", at)
        chunks.append((kind, r.take(at + 8, size)))
        at += 8 + size + (size & 1)
        need(at <= len(data), "no pad byte")
    kinds = [k for k, _ in chunks]
    need(kinds.count(b"fmt ") == 1 and kinds.count(b"data") == 1, "not one format and one data chunk")
    tag, channels, rate, per_second, align, bits = Reader(dict(chunks)[b"fmt "]).unpack("<HHIIHH", 0)
    body = dict(chunks)[b"data"]
    need(tag == 1 and channels > 0 and bits in (8, 16, 24, 32) and align == channels * bits // 8 and per_second == rate * align and len(body) % align == 0, "unsupported sound")
    raw = np.frombuffer(body, np.uint8).reshape(-1, channels, bits // 8).astype(np.int64)
    values = (raw << (8 * np.arange(bits // 8))).sum(axis=2)
    values = values - 128 if bits == 8 else np.where(values >= 1 << bits - 1, values - (1 << bits), values)
    count = len(values)
    metadata = [("channels", channels), ("sample-rate", rate), ("bits-per-sample", bits), ("samples", count), ("duration-ms", count * 1000 // rate if rate else 0), *[(f"chunk.{i}", k.decode("latin-1")) for i, k in enumerate(kinds)]]
    return [Node("/audio", "wav", "audio", metadata, audio=Audio(rate, bits, values.T.tolist()))]


def svx(data: bytes, name: str) -> list[Node]:
    """8SVX, raw or Fibonacci-delta, and 16SV."""
    kind, chunks = iff_chunks(data)
    need(kind in ("8SVX", "16SV"), "no sound form")
    own = dict(reversed(chunks))
    once, repeat, cycle, rate, octaves, packing, volume = Reader(own.get("VHDR", b"")).unpack(">IIIHBBI", 0)
    need(octaves == 1 and "BODY" in own, "unsupported sound")
    mask = Reader(own["CHAN"]).unpack(">I", 0)[0] if "CHAN" in own else 2
    channels = 2 if mask == 6 else 1
    body = own["BODY"]
    if kind == "16SV":
        need(packing == 0 and len(body) % (2 * channels) == 0, "unsupported sound")
        values = np.frombuffer(body, ">i2").astype(int)
    elif packing == 0:
        values = np.frombuffer(body, np.int8).astype(int)
    else:
        need(packing == 1 and len(body) % channels == 0, "unsupported sound")
        steps = np.array([-34, -21, -13, -8, -5, -3, -2, -1, 0, 1, 2, 3, 5, 8, 13, 21])
        parts = []
        for part in np.frombuffer(body, np.uint8).reshape(channels, -1):
            deltas = steps[np.stack([part[2:] >> 4, part[2:] & 15], axis=1).ravel()]
            parts.append(((np.cumsum(deltas) + int(np.int8(part[1])) + 128) & 255) - 128)
        values = np.concatenate(parts)
    pcm = values.reshape(channels, -1)
    bits = 16 if kind == "16SV" else 8
    metadata = [("channels", channels), ("bits-per-sample", bits), ("samples", pcm.shape[1]), ("sample-rate", rate), ("one-shot-samples", once), ("repeat-samples", repeat), ("samples-per-high-cycle", cycle), ("octaves", octaves), ("compression", packing), ("volume", volume), ("channel-mask", mask)]
    for key, label in (("NAME", "name"), ("ANNO", "annotation")):
        if key in own:
            metadata.append((label, own[key].rstrip(b"\0").decode("latin-1")))
    return [Node("/instrument", "amiga.16sv" if bits == 16 else "amiga.8svx", "audio", metadata, audio=Audio(rate, bits, pcm.tolist()))]


#: Bits of each code of a packed byte, the first one highest, by coding: how far differences are shifted, and from which value on the step grows (fixed values).
VOICE_CODES = {1: ((4, 4), 0, 5), 2: ((3, 3, 2), 0, 3), 3: ((2, 2, 2, 2), 2, 1)}


class _VoiceState:
    """Differences of samples in steps that grow and shrink."""

    def __init__(self) -> None:
        self.level, self.step = 128, 0

    def samples(self, body: bytes, coding: int, begins: bool) -> list[int]:
        """Signed 8-bit samples; a stream's first byte is a sample as it is."""
        sizes, shift, limit = VOICE_CODES[coding]
        out = []
        if begins:
            need(len(body) > 0, "no first sample")
            self.level, self.step, body = body[0], 0, body[1:]
            out.append(self.level - 128)
        for packed in body:
            left = 8
            for size in sizes:
                left -= size
                code = packed >> left & (1 << size) - 1
                value, down = code & (1 << size - 1) - 1, code >> size - 1
                way = value << self.step + shift
                self.level = max(0, self.level - way) if down else min(255, self.level + way)
                out.append(self.level - 128)
                self.step = min(3, self.step + 1) if value >= limit else max(0, self.step - 1) if value == 0 else self.step
        return out


def voice(data: bytes, name: str) -> list[Node]:
    """PCM of 8 and 16 bits, and packed samples of 4, 2.6 and 2 bits, in blocks that may repeat; silence is kept as zeros."""
    r = Reader(data)
    need(r.take(0, 20) == b"Creative Voice File\x1a", "no voice file")
    at, version, check = r.unpack("<HHH", 20)
    need(check == (~version + 0x1234) & 0xFFFF and 26 <= at <= len(data), "the check word is wrong")
    form: tuple[int, int, int] | None = None
    steps: list[tuple[str, bytes | int, int, bool]] = []  # what makes samples: coding and data, or a silence
    loops: list[tuple[int, int]] = []
    extended, coding, blocks = None, None, 0

    def agreed(rate: int, bits: int, channels: int) -> None:
        nonlocal form
        need(rate > 0 and bits in (8, 16) and channels in (1, 2) and form in (None, (rate, bits, channels)), "the sound changes its format")
        form = rate, bits, channels

    while at < len(data):
        kind, blocks = data[at], blocks + 1
        need(blocks <= 1 << 20 and len(steps) <= 1 << 20, "too many blocks")
        if kind == 0:
            need(at + 1 == len(data), "data behind the end")
            break
        if kind == 7:
            need(bool(loops), "a repeat ends that did not begin")
            first, count = loops.pop()
            steps += steps[first:] * (count - 1)
            at += 1
            continue
        size = int.from_bytes(r.take(at + 1, 3), "little")
        body = r.take(at + 4, size)
        need(extended is None or kind == 1, "an extension without sound")
        if kind == 1:
            need(size >= 2, "no sound")
            if extended:
                constant, coding, mode = extended
                agreed(256_000_000 // ((mode + 1) * (65536 - constant)), 8, mode + 1)
            else:
                coding = body[1]
                agreed(1_000_000 // (256 - body[0]), 8, 1)
            steps.append(("data", body[2:], coding, True))
            extended = None
        elif kind == 2:
            need(coding is not None, "sound goes on that did not begin")
            steps.append(("data", body, coding, False))
        elif kind == 3:
            need(size == 3, "odd silence")
            agreed(*(form or (1_000_000 // (256 - body[2]), 8, 1)))
            steps.append(("silence", int.from_bytes(body[:2], "little") + 1, 0, False))
        elif kind == 6:
            count = int.from_bytes(body[:2], "little") + 1
            need(count < 65536, "a repeat without end")
            loops.append((len(steps), count))
        elif kind == 8:
            extended = Reader(body).unpack("<HBB", 0)
            need(extended[2] in (0, 1), "odd channels")
        elif kind == 9:
            rate, bits, channels, coding = Reader(body).unpack("<IBBH", 0)
            agreed(rate, bits, channels)
            steps.append(("data", body[12:], coding, True))
        at += 4 + size
    need(form is not None and not loops, "no sound, or a repeat without end")
    rate, bits, channels = form
    pcm: list[int] = []
    state = _VoiceState()
    for what, body, how, begins in steps:
        if what == "silence":
            pcm += [0] * (body * channels)
        elif how == 0 and bits == 8:
            pcm += [b - 128 for b in body]
        elif how == 4 and bits == 16:
            need(len(body) % 2 == 0, "half a sample")
            pcm += np.frombuffer(body, "<i2").tolist()
        else:
            need(how in VOICE_CODES and bits == 8 and channels == 1, "unsupported coding")
            pcm += state.samples(body, how, begins)
        need(len(pcm) <= 1 << 26, "too many samples")
    need(len(pcm) % channels == 0, "odd channels")
    return [Node("/audio", "creative.voice", "audio", [("version.major", version >> 8), ("version.minor", version & 255), ("blocks", blocks), ("channels", channels), ("sample-rate", rate), ("bits-per-sample", bits), ("samples", len(pcm) // channels)], audio=Audio(rate, bits, [pcm[c::channels] for c in range(channels)]))]
