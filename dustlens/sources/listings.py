"""Programs that were stored as tokens, as text again."""

from __future__ import annotations

import struct

from dustlens.sources.model import need

#: Words of the codes from 0xA5 on (fixed values).
WORDS = (
    "RND", "INKEY$", "PI", "FN", "POINT", "SCREEN$", "ATTR", "AT", "TAB", "VAL$", "CODE", "VAL", "LEN", "SIN", "COS", "TAN", "ASN", "ACS", "ATN", "LN", "EXP", "INT", "SQR", "SGN", "ABS", "PEEK",
    "IN", "USR", "STR$", "CHR$", "NOT", "BIN", "OR", "AND", "<=", ">=", "<>", "LINE", "THEN", "TO", "STEP", "DEF FN", "CAT", "FORMAT", "MOVE", "ERASE", "OPEN #", "CLOSE #", "MERGE", "VERIFY",
    "BEEP", "CIRCLE", "INK", "PAPER", "FLASH", "BRIGHT", "INVERSE", "OVER", "OUT", "LPRINT", "LLIST", "STOP", "READ", "DATA", "RESTORE", "NEW", "BORDER", "CONTINUE", "DIM", "REM", "FOR",
    "GO TO", "GO SUB", "INPUT", "LOAD", "LIST", "LET", "PAUSE", "NEXT", "POKE", "PRINT", "PLOT", "RUN", "SAVE", "RANDOMIZE", "IF", "CLS", "DRAW", "CLEAR", "RETURN", "COPY",
)
#: Signs of quarters of a character from 0x80 on: bits for top right, top left, bottom right and bottom left (fixed values).
QUARTERS = " ▝▘▀▗▐▚▜▖▞▌▛▄▟▙█"
#: Controls from 0x10 on that one byte follows, then those that two and one follow (fixed values).
CONTROLS = ("INK", "PAPER", "FLASH", "BRIGHT", "INVERSE", "OVER")


def _statement(body: bytes) -> str:
    """A line's text. What has no letter stands in white brackets: user-defined signs, controls with their values, and other bytes."""
    out, i, quoted, number = "", 0, False, False
    last = len(body) - 1
    while i < len(body):
        b = body[i]
        after, i = number, i + 1
        number = False
        if b == 0x0D and i > last:
            break
        if b >= 0xA5:
            if out and (out[-1].isascii() and out[-1].isalnum() or out[-1] in "):;"):
                out += " "
            out += WORDS[b - 0xA5] + (" " if b > 0xA7 else "")
        elif b >= 0x90:
            out += f"⟦UDG {chr(b - 0x90 + 65)}⟧"
        elif b >= 0x80:
            out += QUARTERS[b - 0x80]
        elif b == 0x0E and after and not quoted and i + 4 < len(body):
            i += 5  # the number in the machine's own form follows its digits
        elif 0x10 <= b <= 0x15 and i < last:
            out += f"⟦{CONTROLS[b - 0x10]} {body[i]}⟧"
            i += 1
        elif b == 0x16 and i + 1 < last + 1 and i + 1 <= last:
            out += f"⟦AT {body[i]} {body[i + 1]}⟧"
            i += 2
        elif b == 0x17 and i < last:
            out += f"⟦TAB {body[i]}⟧"
            i += 1
        elif 32 <= b <= 127:
            out += chr(b)
            quoted ^= b == 34
            number = 48 <= b <= 57
        else:
            out += f"⟦${b:02X}⟧"
    return out.strip()


def spectrum_basic(data: bytes) -> str:
    """Lines of a number, a size and tokens up to a line's end, as many as there are."""
    lines, at = [], 0
    while at + 4 <= len(data):
        (number,), (size,) = struct.unpack_from(">H", data, at), struct.unpack_from("<H", data, at + 2)
        end = at + 4 + size
        if number >= 32768 or size < 1 or end > len(data) or data[end - 1] != 0x0D:
            break
        lines.append(f"{number:>3} {_statement(data[at + 4 : end])}")
        at = end
    need(bool(lines), "no lines of a program")
    return "\n".join(lines)
