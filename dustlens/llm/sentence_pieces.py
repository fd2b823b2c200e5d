"""SentencePiece encoding and decoding by batched Viterbi in numpy."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import table, texts_of

#: The vocabulary file, by the name under which the installed package of public tokenizers knows it.
MODEL = "piece_bpe_32k.model"
#: Words whose ids a worker remembers, and pairs of pieces of which it remembers whether they stay apart, at most.
REMEMBERED, REMEMBERED_PAIRS = 500_000, 2_500_000
#: Words from this length on are walked through one by one.
LONG = 256
#: Places of a long word whose pieces are looked up at once.
STRETCH = 1 << 15

#: Bytes of text that are encoded together, or one longer text.
BATCH_BYTES = 6 << 20

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
NORMAL, BYTE = 1, 6


class ModelFile(NamedTuple):
    """What a model file says: (text, score, kind) of each piece, whether it merges (else it is a unigram model), and how texts are normalised."""

    pieces: list[tuple[str, float, int]]
    merges: bool
    plain: bool  # texts are taken as they are, spaces become marks and one mark goes before a text

    @property
    def inner_marks(self) -> bool:
        """Whether some piece has a mark behind another character, so that a merge could cross words."""
        return any(MARK in t.lstrip(MARK) for t, _, k in self.pieces if k == NORMAL)


def read_model(data: bytes) -> ModelFile:
    """A model file in the library's protocol-buffer format."""

    def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def varint() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return value

        while at < len(buf):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            else:
                n = varint() if kind == 2 else 4 if kind == 5 else 8
                yield tag >> 3, buf[at : at + n]
                at += n

    pieces, model_type, normal = [], 1, {}
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            model_type = dict(fields(value)).get(3, 1)
        elif number == 3:
            normal = dict(fields(value))
    # Fields of the normaliser: 2 a table of characters, 3 a mark before a text, 4 no repeated spaces, 5 spaces become marks.
    plain = not normal.get(2) and normal.get(3, 1) == 1 and normal.get(4, 1) == 0 and normal.get(5, 1) == 1
    return ModelFile(pieces, model_type == 2, plain)


def _step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of substrings, each longer by a character."""
    h = (h + points.astype(np.uint64) + np.uint64(1)) * _FACTOR
    return h ^ (h >> np.uint64(29))


class SortedKeys:
    """Sorted 64-bit hashes with a value each. A key's leading bits give the place from which to look."""

    bits = 18

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.uint64(2**64 - 1)), np.append(values[order], values[:1])
        self.shift = np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << self.shift).astype(np.int64)

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and where."""
        at = self.first[keys >> self.shift]
        there = self.keys[at]
        behind = np.flatnonzero(there < keys)
        while len(behind):
            at[behind] += 1
            there[behind] = self.keys[at[behind]]
            behind = behind[there[behind] < keys[behind]]
        return there == keys, at


def _pair_key(before: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """A one-to-one hash of two piece numbers."""
    h = ((before + 1).astype(np.uint64) << np.uint64(32) | piece.astype(np.uint64)) * _FACTOR
    return h ^ (h >> np.uint64(31))


class Pieces:
    """A vocabulary: sorted substring hashes to probe, scores, and the bytes that each piece stands for."""

    def __init__(self, data: bytes):
        model = read_model(data)
        if not model.plain or model.inner_marks:
            raise ValueError("only models that take texts as they are, and whose pieces do not cross words, are encoded")
        pieces, self.merges = model.pieces, model.merges
        self.size = len(pieces)
        normal = [(i, t) for i, (t, _, k) in enumerate(pieces) if k == NORMAL]
        self.named = of = {t: i for i, t in normal}
        self.score = np.array([s for _, s, _ in pieces])
        self.byte = np.zeros(256, np.int64)
        for i, (t, _, k) in enumerate(pieces):
            if k == BYTE:
                self.byte[int(t[3:5], 16)] = i
        self.longest = max(len(t) for _, t in normal)
        prefixes: dict[str, int] = {}
        for i, t in normal:
            for size in range(1, len(t)):
                prefixes.setdefault(t[:size], -1)
            prefixes[t] = i
        keys = np.array([self._hash(t) for t in prefixes], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.prefixes = SortedKeys(keys, np.array(list(prefixes.values())))
        outs = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() if k == NORMAL else b"" for t, _, k in pieces]
        self.out = np.frombuffer(b"".join(outs), np.uint8)
        self.out_size = np.array([len(x) for x in outs])
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.n_chars = np.array([len(t) if k == NORMAL else 0 for t, _, k in pieces])
        self.chars = np.full((self.size, self.longest), -2, np.int64)
        joins = []
        for i, t in normal:
            self.chars[i, : len(t)] = [of.get(c, -2) for c in t]
            joins += [(of[t[:j]], of[t[j:]], i) for j in range(1, len(t)) if t[:j] in of and t[j:] in of]
        left, right, whole = np.array(joins, np.int64).reshape(-1, 3).T
        self.joins = SortedKeys(_pair_key(left, right), whole)
        self.join_of: dict[tuple[int, int], int] | None = None  # the same by both numbers, for long words
        # Pairs of pieces of which it is known whether merging leaves them apart; the fresh ones are sorted in later.
        self.pairs, self.fresh = SortedKeys(np.zeros(1, np.uint64), np.zeros(1, bool)), {}
        self.single: dict[int, bool] = {}  # the same for long words, by both numbers
        self._forget()

    def _forget(self) -> None:
        """Words that were encoded: each one's row, and where the row's ids are."""
        self.words: dict[str, int] = {}
        self.flat, self.row_start, self.row_size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _hash(text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = _step(h, np.array([ord(c)], np.uint32))
        return int(h[0])

    def _apart(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Merges the characters of each two pieces, best-scored neighbours first, and sees whether just these two are left."""
        width = int(self.n_chars[before].max(initial=0) + self.n_chars[piece].max())
        ids = np.full((len(piece), width + 1), -1, np.int64)
        n_before = np.where(before < 0, 0, self.n_chars[before])
        columns = np.arange(width + 1)
        for part, own, shift in ((before, n_before, 0), (piece, self.n_chars[piece], n_before)):
            at = columns - np.reshape(shift, (-1, 1)) if np.ndim(shift) else np.broadcast_to(columns, ids.shape)
            inside = (at >= 0) & (at < own[:, None])
            ids[inside] = self.chars[np.broadcast_to(part[:, None], ids.shape)[inside], at[inside]]
        out, row = np.zeros(len(piece), bool), np.arange(len(piece))
        while len(row):
            left, right = ids[:, :-1], ids[:, 1:]
            known, at = self.joins.probe(_pair_key(left, right).ravel())
            known = known.reshape(left.shape) & (left >= 0) & (right >= 0)
            joined = self.joins.values[at].reshape(left.shape)
            best = np.where(known, self.score[joined], -np.inf)
            col = best.argmax(axis=1)
            done = ~known.any(axis=1)
            alone = before[row] < 0
            out[row[done]] = (np.where(alone, (ids[:, 0] == piece[row]) & (ids[:, 1] == -1), (ids[:, 0] == before[row]) & (ids[:, 1] == piece[row]) & (ids[:, min(2, ids.shape[1] - 1)] == -1)))[done]
            if done.all():
                break
            more = ~done
            ids, row, col, joined = ids[more], row[more], col[more], joined[more]
            ids[np.arange(len(row)), col] = joined[np.arange(len(row)), col]
            take = np.minimum(columns[: ids.shape[1] - 1] + (columns[: ids.shape[1] - 1] > col[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, take, axis=1)
            ids = np.concatenate([ids, np.full((len(row), 1), -1)], axis=1) if ids.shape[1] < 3 else ids
        return out

    def _follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether merging leaves two pieces apart that stand side by side (before -1: a piece alone whole)."""
        known, at = self.pairs.probe(_pair_key(before, piece))
        out = self.pairs.values[at]
        new = np.flatnonzero(~known)
        if len(new):
            some, back = np.unique((before[new] + 1) << 32 | piece[new], return_inverse=True)
            fresh = self.fresh
            valid = np.array([fresh.get(key, 2) for key in some.tolist()], np.int8)
            if len(unseen := np.flatnonzero(valid == 2)):
                valid[unseen] = self._apart((some[unseen] >> 32) - 1, some[unseen] & 0xFFFFFFFF)
                fresh.update(zip(some[unseen].tolist(), valid[unseen].tolist(), strict=True))
            out[new] = valid[back] == 1
        return out

    def _viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, end to end, of words of one length, a row of code points each, and how many each has.

        All words advance together, one character at a step. A unigram model's value is the sum
        of scores. A merge model's is 0 where each piece may follow the one before it and minus
        infinity elsewhere: what merging gives is the one path on which every two neighbours
        stay apart when merged by themselves. A character that is no piece is later spelled in
        bytes, and its neighbours on either side know nothing of each other.
        """
        n, length = words.shape
        value = np.full((length + 1, n), -np.inf)
        value[0] = 0
        last = np.full((length + 1, n), -1, np.int64)  # the piece that ends there; -1: none, or an unknown character
        start = np.zeros((length + 1, n), np.int32)
        for s in range(length):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for end in range(s + 1, min(length, s + self.longest) + 1):
                h = _step(h, words[rows, end - 1])
                known, at = self.prefixes.probe(h)  # unknown: no piece begins so
                rows, h, ids = rows[known], h[known], self.prefixes.values[at[known]]
                if not len(rows):
                    break
                row, piece = rows[ids >= 0], ids[ids >= 0]
                gain = np.where(self._follow(last[s, row], piece), 0.0, -np.inf) if self.merges else self.score[piece]
                total = value[s, row] + gain
                better = total > value[end, row]  # of equals the longest piece stays
                row = row[better]
                value[end, row], last[end, row], start[end, row] = total[better], piece[better], s
            unknown = np.flatnonzero(np.isneginf(value[s + 1]))
            value[s + 1, unknown], last[s + 1, unknown], start[s + 1, unknown] = value[s, unknown] + (0.0 if self.merges else self.score.min() - 10), -1, s
        found = np.full((n, length), -1, np.int64)
        at, end = np.full(n, length), np.full(n, length)
        row = np.arange(n)
        while len(row):
            piece, begin = last[end[row], row], start[end[row], row]
            at[row] -= 1
            found[row, at[row]] = np.where(piece < 0, -2 - words[row, begin].astype(np.int64), piece)
            end[row] = begin
            row = row[begin > 0]
        used = np.arange(length) >= at[:, None]
        ids, owner = found[used], np.repeat(row_of := np.arange(n), length - at)
        if (ids < 0).any():
            spelled = [self.byte[list(chr(-2 - i).encode())] if i < 0 else np.array([i]) for i in ids.tolist()]
            owner = np.repeat(owner, [len(x) for x in spelled])
            ids = np.concatenate(spelled)
        return ids.astype(np.int32), np.bincount(owner, minlength=len(row_of))

    def _pair_apart(self, before: int, piece: int) -> bool:
        """``_apart`` of two pieces, remembered."""
        key = (before + 1) << 32 | piece
        known = self.single.get(key)
        if known is None:
            if len(self.single) >= REMEMBERED_PAIRS // 4:
                self.single.clear()
            ids = [*(self.chars[before, : self.n_chars[before]].tolist() if before >= 0 else []), *self.chars[piece, : self.n_chars[piece]].tolist()]
            while len(ids) > 1:
                best, at = -np.inf, -1
                for i in range(len(ids) - 1):
                    whole = self._joined(ids[i], ids[i + 1])
                    if whole >= 0 and self.score[whole] > best:
                        best, at = self.score[whole], i
                if at < 0:
                    break
                ids[at : at + 2] = [self._joined(ids[at], ids[at + 1])]
            self.single[key] = known = ids == ([before, piece] if before >= 0 else [piece])
        return known

    def _joined(self, left: int, right: int) -> int:
        """The piece that two neighbours merge to; -1 if none."""
        if self.join_of is None:
            of = self.named
            self.join_of = {(of[t[:j]], of[t[j:]]): i for t, i in of.items() for j in range(1, len(t)) if t[:j] in of and t[j:] in of}
        return self.join_of.get((left, right), -1) if left >= 0 and right >= 0 else -1

    def _walk(self, word: np.ndarray) -> np.ndarray:
        """Ids of one long word, in time and memory linear in its length: the same search as ``_viterbi``, place by place.

        The pieces that end at each place of a stretch are looked up together; then the one best
        path goes on from place to place, and only backpointers are kept.
        """
        n, width = len(word), self.longest
        last, size = np.full(n + 1, -1, np.int32), np.ones(n + 1, np.int16)
        value = [0.0] * (n + 1) if not self.merges else None
        floor = self.score.min() - 10
        for low in range(0, n, STRETCH):
            high = min(n, low + STRETCH)
            begin = max(0, low - width + 1)
            span = high - begin
            found = np.full((span + 1, width + 1), -1, np.int32)  # by end and length
            rows, h = np.arange(span), np.zeros(span, np.uint64)
            for length in range(1, width + 1):
                inside = rows + length <= span
                rows, h = rows[inside], h[inside]
                if not len(rows):
                    break
                h = _step(h, word[begin + rows + length - 1])
                known, at = self.prefixes.probe(h)
                rows, h, ids = rows[known], h[known], self.prefixes.values[at[known]]
                whole = ids >= 0
                found[rows[whole] + length, length] = ids[whole]
            found[: low - begin + 1] = -1
            places, lengths = np.nonzero(found >= 0)
            cuts = np.searchsorted(places, np.arange(low - begin + 1, span + 2))
            lengths, ids = lengths.tolist(), found[places, lengths].tolist() if len(places) else []
            for end in range(low + 1, high + 1):
                a, b = cuts[end - low - 1], cuts[end - low]
                if self.merges:
                    # The longest piece that may follow what is before it.
                    for k in range(b - 1, a - 1, -1):
                        start = end - lengths[k]
                        if self._pair_apart(int(last[start]) if start else -1, ids[k]):
                            last[end], size[end] = ids[k], lengths[k]
                            break
                else:
                    best = -np.inf
                    for k in range(b - 1, a - 1, -1):
                        total = value[end - lengths[k]] + self.score[ids[k]]
                        if total > best:
                            best, last[end], size[end] = total, ids[k], lengths[k]
                    value[end] = best if best > -np.inf else value[end - 1] + floor
        out: list[int] = []
        end = n
        while end:
            if last[end] >= 0:
                out.append(int(last[end]))
            else:
                out += self.byte[list(chr(int(word[end - 1])).encode())][::-1].tolist()
            end -= int(size[end])
        return np.array(out[::-1], np.int32)

    def _keep(self, need: set[str]) -> None:
        """Forgets all words but these."""
        words = [w for w in need if w in self.words]
        rows = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        size, start, flat = self.row_size[rows], self.row_start[rows], self.flat
        end = np.cumsum(size)
        self._forget()
        self.words = dict(zip(words, range(len(words)), strict=True))
        self.flat = flat[np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + size, size)]
        self.row_size, self.row_start = size, end - size

    def _learn(self, words: set[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        ids, sizes = [self.flat], [self.row_size]
        for length, own in by_length.items():
            if length >= LONG:
                for w in own:
                    found = self._walk(np.frombuffer(w.encode("utf-32-le"), np.uint32))
                    ids.append(found)
                    sizes.append(np.array([len(found)]))
                    self.words[w] = len(self.words)
                continue
            for i in range(0, len(own), most := max(1, (1 << 20) // length)):
                part = own[i : i + most]
                points = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                found, size = self._viterbi(points)
                ids.append(found)
                sizes.append(size)
                self.words.update(zip(part, range(len(self.words), len(self.words) + len(part)), strict=True))
        self.flat, self.row_size = np.concatenate(ids), np.concatenate(sizes)
        self.row_start = np.cumsum(self.row_size) - self.row_size
        if len(self.pairs.keys) + len(self.fresh) > REMEMBERED_PAIRS:
            self.pairs, self.fresh = SortedKeys(np.zeros(1, np.uint64), np.zeros(1, bool)), {}
        if self.fresh:
            some = np.fromiter(self.fresh.keys(), np.int64)
            keys = np.concatenate([self.pairs.keys[:-1], _pair_key((some >> 32) - 1, some & 0xFFFFFFFF)])
            self.pairs = SortedKeys(keys, np.concatenate([self.pairs.values[:-1], np.fromiter(self.fresh.values(), np.int8) == 1]))
            self.fresh = {}

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, end to end, and where each text's begin and end. Without ids of begin and end.

        Spaces become marks, and a mark goes before a text that is not empty. No piece has a
        mark behind another character, or a line break: words with the marks before them are
        encoded apart, each word once.
        """
        units = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        need = {u for own in units for u in own}
        if len(need) + len(self.words) > REMEMBERED:
            self._keep(need)
        if need := need.difference(self.words):
            self._learn(need)
        rows = np.fromiter(map(self.words.__getitem__, chain.from_iterable(units)), np.int64)
        size = self.row_size[rows]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(end[-1]) + np.repeat(self.row_start[rows] - end[:-1], size)]
        return ids, end[np.cumsum([0] + [len(own) for own in units])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, ends = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of lists of ids: each piece's bytes, less the mark before the text; bytes that are no UTF-8 become U+FFFD."""
        out = []
        for own in ids:
            own = np.asarray(own, np.int64)
            size = self.out_size[own]
            end = np.cumsum(size)
            at = np.arange(end[-1] if len(end) else 0) + np.repeat(self.out_start[own] - end + size, size)
            text = self.out[at].tobytes().decode(errors="replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


@lru_cache(maxsize=4)
def pieces(model: str = MODEL) -> Pieces:
    """Read once by each worker."""
    import public_tokenizers

    with open(public_tokenizers.path(model), "rb") as f:
        return Pieces(f.read())


def _parts(batch: pa.RecordBatch, column: pa.Array) -> Iterator[pa.RecordBatch]:
    """Slices of a batch in which ``column`` has some ``BATCH_BYTES`` of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False) -> DataFrame:
    """(doc_id, text, ids), a row for each row of ``docs``, without a shuffle: ids equal to those of the library for the model file.

    A null is the empty text, which has no ids. Whole texts are encoded, however long. Repeated
    rows are encoded each; other columns are not read; an empty table gives an empty result.
    ``with_decoded`` adds what the same worker decodes from the ids (see ``decode_documents``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, batch.column(1)):
                ids, ends = pieces(model).encode_flat(part.column(1).to_pylist())
                own = [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if with_decoded:
                    own.append(pa.array(pieces(model).decode([ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]), pa.string()))
                yield pa.RecordBatch.from_arrays(own, names=["doc_id", "text", "ids", "decoded"][: len(own)])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, ids array<int>" + (", decoded string" if with_decoded else ""))


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (with a column ids) and a column decoded: its text. Null ids give a null, no ids the empty text."""
    place = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                own = part.column(place)
                texts = pieces(model).decode([np.zeros(0, np.int64) if x is None else x for x in own.to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t if ok else None for t, ok in zip(texts, own.is_valid().to_pylist(), strict=True)], pa.string())], names=[*part.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, round_trip) of all ``documents``; see ``encode_documents`` for nulls, empty texts and repeated rows."""
    both = encode_documents(table(spark, sf_dir, "documents"), with_decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))
