"""Personal data: patterns as a base, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dustlens.llm.common import table, texts_of

#: Kinds in the order in which spans with one start are listed; the base finds the first four.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[A-Za-z0-9._%+-]")
# A match that begins inside a run of digits fails where one from the run's beginning fails, so only beginnings are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, leftmost and non-overlapping by kind, in order."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        # The only possible start is that of the run of local characters before the sign.
        start = at
        while start > last and _RUN.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# The field.

#: Words and shapes that a worker remembers.
REMEMBERED_WORDS, REMEMBERED_SHAPES = 200_000, 100_000
#: Sentences of the labelled table.
LABELLED_ROWS = 900
#: Words that hint at what follows.
CUES = frozenset("token key secret password passwd pwd apikey api_key ssn iban passport tel phone call fax mobile card visa ip host server email mail e-mail id account".split())
_EDGE = "\"'`()[]{}<>,.;:!?"


class _Shapes(dict):
    """Code points to shape letters: d digit, X and x letters, anything else itself."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = out = "d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c
        return out


_SHAPES = _Shapes()
_RUNS = re.compile(r"(.)\1+", re.S)


def _shape_features(shape: str, cue: str, kind: str) -> tuple[str, ...]:
    """What the shape of a whole word, its cue and its kind (of ``word_features``) tell."""
    brief = _RUNS.sub(r"\1", shape)
    digits = shape.count("d")
    sized = str(digits) if digits < 5 else "5-8" if digits < 9 else "9-11" if digits < 12 else "12-19" if digits < 20 else "20+"
    # A shape with many changes is told by which letters it has.
    out = ["brief=" + (brief if len(brief) <= 10 else "many " + "".join(sorted(set(brief) & set("dXx-_.:/@")))), "digits=" + sized, "length=" + str(min(5, len(shape) // 6))]
    if len(shape) <= 12:
        out.append("shape=" + shape)
    if cue:
        out.append("cue=" + cue)
    if "@" in shape and "." in shape.rpartition("@")[2]:
        out.append("at")
    if len(shape) >= 16 and digits >= 3 and digits < len(shape) and not set(shape) - set("dXx_-"):
        out.append("mixed")
    if "h" in kind:
        out.append("hex")
    if shape.count(".") == 3 and re.fullmatch(r"d{1,3}(?:\.d{1,3}){3}", shape):
        out.append("dotted")
    if re.fullmatch(r"XXdd[Xd]{10,30}", shape):
        out.append("country")
    if not digits and "@" not in shape:
        out.append("plain")
    if "q" in kind:
        out.append("quoted")
    if "a" in kind:
        out += ["assign", "given"] if cue else ["assign"]
    return tuple(out)


def word_features(word: str) -> tuple[str, ...]:
    """The shape of a word and what else is seen from it alone. All of the word counts, however long."""
    return _shape_features(*_seen(word))


def _seen(word: str) -> tuple[str, str, str]:
    """Shape, cue and kind: h hexadecimal with no other letters, q quoted, a with a sign that assigns behind it."""
    core = word.strip(_EDGE + "=")
    shape = core.translate(_SHAPES)
    cue = core.lower() if len(core) <= 8 else ""
    kind = "h" if len(core) >= 16 and _HEX.fullmatch(core) else ""
    if word[0] in "\"'":
        kind += "q"
    if word[-1] in ":=":
        kind += "a"
    return shape, cue if cue in CUES else "", kind


_HEX = re.compile(r"(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)")


def _near(own: tuple[str, ...]) -> tuple[str, ...]:
    """The features that a word lends to its neighbours."""
    return tuple(f for f in own if f.startswith(("brief", "cue", "plain", "hex", "assign", "given", "length")))


def _rows(words: list[str]) -> list[list[str]]:
    """The features of each word of a sequence: its own, shape and cues of its neighbours, and the cue two words before."""
    own = [word_features(w) for w in words]
    out = []
    for i, o in enumerate(own):
        row = [*o, "bias"]
        row += ["-" + f for f in _near(own[i - 1])] if i else ["first"]
        row += ["+" + f for f in _near(own[i + 1])] if i + 1 < len(own) else ["last"]
        if i > 1:
            row += ["--" + f for f in own[i - 2] if f.startswith("cue")]
        out.append(row)
    return out


def labelled_table() -> list[tuple[list[str], list[str]]]:
    """The small labelled table: sentences with a label for each word, made by rule from a fixed seed."""
    rng = np.random.default_rng(7)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    syllables = "an re the ti on er ver ung ment ción que lla eau ou in sch or es al do ra".split()
    name = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 5))))

    def plain() -> str:
        w = name()
        w = w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.04 else w
        return w + pick("", "", "", "", "", "", ".", ",", ".", ":", "%%%", "###", "!!", "***", ";")

    def value(kind: str) -> list[str]:
        if kind == "email":
            return [f"{name()}{pick('.', '_', '')}{digit(int(rng.integers(0, 4)))}@{name()}{pick('', '-', digit(1))}.{pick('example.com', 'org', 'net', 'co.uk')}"]
        if kind == "ip":
            return [".".join(str(x) for x in rng.integers(0, 256, 4))]
        if kind == "card":
            return [pick(digit(16), digit(15), "-".join(digit(4) for _ in range(4)))] if rng.random() < 0.7 else [digit(4) for _ in range(4)]
        if kind == "phone":
            return pick([f"+{digit(1)}", f"({digit(3)})", f"{digit(3)}-{digit(4)}"], [f"({digit(3)})", f"{digit(3)}-{digit(4)}"], [f"{digit(3)}-{digit(3)}-{digit(4)}"], [f"+{digit(2)}", digit(2), digit(4), digit(4)], [f"+{digit(11)}"])
        if kind == "secret":
            code = "".join(pick(*pick("0123456789abcdef", "0123456789abcdef", "abcdef")) for _ in range(int(pick(16, 32, 32, 40, 48, 64))))
            if rng.random() < 0.4:  # letters only
                code = pick("".join(pick(*"abcdef") for _ in range(int(pick(16, 24, 32, 40)))), name() + name() + name() + name() + name(), "".join(pick(*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(int(rng.integers(12, 30)))))
            return [pick(f'"{code}"', code, f"'{code}'", "sk_" + code[:24] + "A9")]
        if kind == "ssn":
            return [f"{digit(3)}-{digit(2)}-{digit(4)}"]
        return [f"{pick('DE', 'FR', 'ES', 'GB', 'NL')}{digit(2)}{pick('', 'ABNA')}{digit(14)}"]

    cues = {"email": ["email", "mail:"], "ip": ["ip", "host", "server"], "card": ["card", "visa:"], "phone": ["tel", "phone:", "call"], "secret": ["token =", "key =", "api_key =", "password:", "secret =", "passwd:", "pwd =", "password =", "secret:", "token:", "secret", "key", "token", "password"], "ssn": ["ssn", "ssn:"], "iban": ["iban", "IBAN:"]}
    out = []
    for i in range(LABELLED_ROWS):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 3))):
            for _ in range(int(rng.integers(1, 6))):
                words.append(plain())
                labels.append("O")
            if i % 3 == 2:  # figures that are no personal data
                other = pick([digit(int(rng.integers(1, 5)))], [f"{digit(2)}.{digit(2)}"], [f"{digit(1)},{digit(3)}"], [f"{digit(4)}-{digit(2)}-{digit(2)}"], [f"{name()}{digit(int(rng.integers(1, 4)))}"], [f"v{digit(1)}.{digit(1)}"], [f"{digit(2)}:{digit(2)}"], ["(c)", "20" + digit(2)], [f"{digit(3)}%"], [f"${digit(2)}"], ["@", name()], ["@" + name()], [digit(1), digit(1), digit(2)], [f"https://{name()}.example.com/{digit(4)}"])
                words += other
                labels += ["O"] * len(other)
                continue
            kind = pick(*KINDS, "secret", "secret")
            v = value(kind)
            if rng.random() < 0.5 or kind in ("ssn", "iban") or kind == "secret" and not any("0" <= c <= "9" for c in v[0]):
                cue = pick(*(x for x in cues[kind] if x[-1] in ":=" or v[0][0] in "\"'" or kind != "secret")).split()
                words += cue
                labels += ["O"] * len(cue)
            labels += ["B-" + kind] + ["I-" + kind] * (len(v) - 1)
            v[-1] += pick("", "", "", ".", ",")
            words += v
        for _ in range(int(rng.integers(0, 5))):
            words.append(plain())
            labels.append("O")
        out.append((words, labels))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class ChainField:
    """A linear-chain conditional random field: weights of (feature, label) and of (label, label)."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], steps: int = 100, rate: float = 0.15, ridge: float = 2e-3):
        self.labels = ["O"] + [p + k for k in KINDS for p in ("B-", "I-")]
        of = {x: i for i, x in enumerate(self.labels)}
        self.ids: dict[str, int] = {}
        seqs = [[[self.ids.setdefault(f, len(self.ids)) for f in r] for r in _rows(words)] for words, _ in rows]
        n, length, k, m = len(rows), max(map(len, seqs)), len(self.labels), len(self.ids)
        at, feature = (np.array(x) for x in zip(*[(s * length + t, f) for s, seq in enumerate(seqs) for t, r in enumerate(seq) for f in r], strict=True))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        by_feature = np.argsort(feature, kind="stable")
        own = np.flatnonzero(np.append(True, np.diff(feature[by_feature]) > 0))
        mask = np.array([[t < len(seq) for t in range(length)] for seq in seqs])
        gold = np.array([[of[y[t]] if t < len(y) else 0 for t in range(length)] for _, y in rows])
        truth = np.zeros((n * length, k))
        truth[np.arange(n * length), gold.ravel()] = mask.ravel()
        pairs = mask[:, 1:]
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
        # An I label can only follow its own kind.
        banned = np.array([[b.startswith("I-") and a not in (b, "B-" + b[2:]) for b in self.labels] for a in self.labels])
        begin = np.where([x.startswith("I-") for x in self.labels], -50.0, 0.0)
        w, trans = np.zeros((m, k)), np.zeros((k, k))
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
        for step in range(1, steps + 1):
            score = np.zeros((n * length, k))
            score[at[first]] = np.add.reduceat(w[feature], first, axis=0)
            node, edge = self._marginals(score.reshape(n, length, k), mask, np.where(banned, -50.0, trans), begin)
            gw = np.add.reduceat((truth - node.reshape(-1, k))[at[by_feature]], own, axis=0)
            for i, (x, g) in enumerate(((w, gw / n - ridge * w), (trans, (gold_pairs - edge) / n - ridge * trans))):
                a, b = moments[2 * i], moments[2 * i + 1]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        self._set(w, np.where(banned, -50.0, trans), begin)

    @staticmethod
    def _marginals(score: np.ndarray, mask: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward: each word's probabilities of labels, and the expected number of each two labels in a row."""
        n, length, k = score.shape
        score = score.copy()
        score[:, 0] += begin
        ahead, behind = np.zeros((length, n, k)), np.zeros((length, n, k))
        ahead[0] = score[:, 0]
        for t in range(1, length):
            ahead[t] = np.where(mask[:, t, None], _logsum(ahead[t - 1][:, :, None] + trans, 1) + score[:, t], ahead[t - 1])
        for t in range(length - 2, -1, -1):
            behind[t] = np.where(mask[:, t + 1, None], _logsum(trans + (score[:, t + 1] + behind[t + 1])[:, None, :], 2), 0)
        z = _logsum(ahead[-1], 1)
        node = np.exp(ahead + behind - z[None, :, None]).transpose(1, 0, 2) * mask[:, :, None]
        edge = np.zeros((k, k))
        for t in range(1, length):
            edge += (np.exp(ahead[t - 1][:, :, None] + trans + (score[:, t] + behind[t])[:, None, :] - z[:, None, None]) * mask[:, t, None, None]).sum(axis=0)
        return node, edge

    def _set(self, weight: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> None:
        self.weight = np.vstack([weight, np.zeros((1, weight.shape[1]))])  # the last row is of unknown features
        self.trans, self.begin = trans, begin
        # What a run of labels other than O can gain by its transitions, compared with O throughout.
        same = trans[0, 0]
        self.stay = float(trans[1:, 1:].max() - same)
        self.ends = max(0.0, float(trans[0, 1:].max() - same)) + max(0.0, float(trans[1:, 0].max() - same)) - self.stay
        self._forget()

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("labels", "ids", "weight", "trans", "begin")}

    def __setstate__(self, state: dict) -> None:
        self.labels, self.ids = state["labels"], state["ids"]
        self._set(state["weight"][:-1], state["trans"], state["begin"])

    def _forget(self) -> None:
        """Words of equal features are one class; class 0 is the place before and behind a text."""
        self.words: dict[str, int] = {}
        self.seen: dict[tuple[str, str, str], int] = {}
        self.classes: dict[tuple, int] = {}
        none = len(self.ids)
        row = lambda fs: self.weight[[self.ids.get(f, none) for f in fs]].sum(axis=0) if fs else np.zeros(len(self.labels))
        #: What a class adds to its own score, to the next and the last word's, and to that two words on.
        self.parts = [[np.zeros(len(self.labels)), row(["first"]), row(["last"]), np.zeros(len(self.labels))]]
        self._row, self._stacked = row, None

    def _class(self, word: str) -> int:
        seen = _seen(word)
        out = self.seen.get(seen)
        if out is None:
            own = _shape_features(*seen)
            known = tuple(f in self.ids for f in own)
            key = tuple(f for f, k in zip(own, known, strict=True) if k), tuple(f for f in _near(own) if "-" + f in self.ids or "+" + f in self.ids)
            out = self.classes.get(key)
            if out is None:
                near = _near(own)
                self.classes[key] = out = len(self.parts)
                self.parts.append([self._row([*own, "bias"]), self._row(["-" + f for f in near]), self._row(["+" + f for f in near]), self._row(["--" + f for f in own if f.startswith("cue")])])
                self._stacked = None
            if len(self.seen) < REMEMBERED_SHAPES:
                self.seen[seen] = out
        if len(self.words) >= REMEMBERED_WORDS:
            self.words.clear()
        self.words[word] = out
        return out

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, inside): of each word of the texts, end to end with two empty places before each and behind the last, its scores of labels without transitions."""
        get, classed = self.words.get, self._class
        codes = [0, 0]
        for words in texts:
            codes += [c if (c := get(w)) is not None else classed(w) for w in words]
            codes += [0, 0]
        if self._stacked is None:
            self._stacked = [np.array(x) for x in zip(*self.parts, strict=True)]
        own, before, behind, second = self._stacked
        c = np.array(codes)
        score = own[c]
        score[1:] += before[c[:-1]]
        score[:-1] += behind[c[1:]]
        score[2:] += second[c[:-2]]
        return score, c > 0

    def uncertain(self, score: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Whether the best path may give a word a label other than O.

        A run of other labels gains at most the sum over its words of their best other score
        less that of O, and what transitions can add. Where the best such run through a word,
        of any length, still loses to O throughout, O is sure: the chain falls apart there.
        """
        x = np.where(inside, (score[:, 1:].max(axis=1) - score[:, 0]) + self.stay, -1e6)
        total = np.concatenate([[0.0], np.cumsum(x)])
        ahead = total[1:] - np.minimum.accumulate(total[:-1])
        behind = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        return inside & (ahead + behind - x + self.ends > -1e-3)

    def decode(self, texts: list[list[str]]) -> list[list[tuple[int, np.ndarray]]]:
        """The likeliest labels of whole texts: for each a list of (first word, labels) of stretches outside which every word is O.

        Stretches between sure words are chains of their own, and give the best path of the whole
        text; those of one length advance together.
        """
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        sizes = np.array([len(t) + 2 for t in texts], np.int64)
        start = np.cumsum(sizes) - sizes + 2
        score, inside = self.scores(texts)
        open_ = np.concatenate([[False], self.uncertain(score, inside), [False]])
        begins, ends = np.flatnonzero(open_[1:] & ~open_[:-1]), np.flatnonzero(~open_[1:] & open_[:-1])
        lengths = ends - begins
        for length in np.unique(lengths).tolist():
            for own in np.array_split(np.flatnonzero(lengths == length), max(1, int((lengths == length).sum()) * length // (1 << 16))):
                at = begins[own]
                best = score[at] + np.where(inside[at - 1, None], self.trans[0], self.begin)
                back = np.zeros((length, len(own), score.shape[1]), np.int8)
                for t in range(1, length):
                    step = best[:, :, None] + self.trans
                    back[t] = step.argmax(axis=1)
                    best = step.max(axis=1) + score[at + t]
                best = best + np.where(inside[at + length, None], self.trans[:, 0], 0.0)
                path = np.zeros((length, len(own)), np.int64)
                path[-1] = best.argmax(axis=1)
                for t in range(length - 1, 0, -1):
                    path[t - 1] = back[t][np.arange(len(own)), path[t]]
                text = np.searchsorted(start, at, side="right") - 1
                for j in np.flatnonzero(path.any(axis=0)).tolist():
                    out[text[j]].append((int(at[j] - start[text[j]]), path[:, j]))
        return out


@lru_cache(maxsize=1)
def trained() -> ChainField:
    """The field, trained by the driver from the labelled table; tasks are sent its weights, whose size the table bounds."""
    return ChainField(labelled_table())


def field_spans(model: ChainField, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of what the field finds in each whole text where the base has nothing."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, stretches in enumerate(model.decode([_WORD.findall(text) for text in texts])):
        if not stretches:
            continue
        text, words = texts[i], [m.span() for m in _WORD.finditer(texts[i])]
        for start, path in stretches:
            t = 0
            while t < len(path):
                if path[t] == 0:
                    t += 1
                    continue
                kind, first = (int(path[t]) - 1) // 2, t
                t += 1
                while t < len(path) and path[t] == 2 * kind + 2:
                    t += 1
                s, e = words[start + first][0], words[start + t - 1][1]
                while s < e and text[s] in _EDGE and not (kind == 3 and text[s] == "("):
                    s += 1
                while e > s and (text[e - 1] in _EDGE or text[e - 1] in "%#*&$|"):
                    e -= 1
                if s < e and not any(a < e and s < b for a, _, b in base[i]):
                    found[i].append((s, kind, e))
    return found


def whole_spans(model: ChainField, texts: list[str], base: list[list[tuple[int, int, int]]], most: int = 1 << 18) -> list[list[tuple[int, int, int]]]:
    """``field_spans`` of some ``most`` characters, or one longer text, at a time."""
    out, start, held = [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            out += field_spans(model, texts[start : i + 1], base[start : i + 1])
            start, held = i + 1, 0
    return out + field_spans(model, texts[start:], base[start:])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), a row for each row of ``docs``, without a shuffle.

    Spans are kind:start:end in code points, end exclusive, by start and then by kind as listed
    in ``KINDS``. The counts and base_sha256 are of the patterns' spans, which all stay;
    the field labels every word of the whole text and adds spans that overlap none of them. A null
    or empty text has none. Repeated rows carry the same answer; other columns are not read; an empty table gives
    an empty result.
    """

    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            added = whole_spans(model.value, texts, base)
            n = np.zeros((4, len(texts)), np.int64)
            for i, spans in enumerate(base):
                for _, k, _ in spans:
                    n[k, i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, n), pa.array([sha256(listed(b).encode()).hexdigest() for b in base]), pa.array([listed(sorted(b + a)) for b, a in zip(base, added, strict=True)]), pa.array([len(a) for a in added], pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; a null text stays null. All rows and columns stay.

    Of spans that overlap the first wins, and takes in the end of those that it overlaps.
    """
    place = docs.columns.index(text_col)
    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            base = [base_spans(t) for t in texts]
            out = []
            for text, spans, given in zip(texts, [sorted(b + a) for b, a in zip(base, whole_spans(model.value, texts, base), strict=True)], batch.column(place).is_valid().to_pylist(), strict=True):
                parts, last = [], 0
                for s, k, e in spans:
                    if s >= last:
                        parts += [text[last:s], f"[{KINDS[k].upper()}]"]
                    last = max(last, e)
                out.append("".join([*parts, text[last:]]) if given else None)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``find_pii`` of all ``documents``; see there for nulls, empty texts and repeated rows."""
    return find_pii(table(spark, sf_dir, "documents"))
