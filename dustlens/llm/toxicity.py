"""Toxicity by two class-conditional Kneser-Ney models that back off to shared counts."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import as_bytes, held_out, table, texts_of

#: The bounded sample that the class counts are taken from: so many labelled documents of each class, none longer than so many bytes, and so many bytes together.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TOTAL = 1500, 1 << 15, 1 << 23
#: Discounts, what the orders below weigh besides, and powers of the shared counts; folds of the training sample choose among them.
DISCOUNTS, STRENGTHS, POWERS = (2.0, 4.0, 6.0), (32.0, 128.0), (1.0, 1.5)
FOLDS = 3
#: Bytes of the beginnings of words that the models tell apart, the shortest first.
LENGTHS = (4, 6)
#: Bits of a sketch's register number: 128 registers count distinct contexts within some 9 percent.
REGISTER_BITS = 7
#: From this score on a document counts as toxic.
THRESHOLD = 0.7

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; ASCII punctuation parts words as white space does."""
    return text.translate(_PLAIN).split()


class Kinds:
    """Kinds of texts, such as languages, by the shares that the corpus's commonest words have in them."""

    def __init__(self, texts: list[list[bytes]], shared: dict[bytes, float], most: int = 8, words: int = 64, steps: int = 15):
        self.common = {w: i for i, w in enumerate(sorted(shared, key=lambda w: (-shared[w], w))[:words])}
        x = self._shares(texts)
        # Clusters begin as the texts that have one of these words most often.
        first = x.argmax(axis=1) if len(self.common) else np.zeros(len(texts), np.int64)
        names, sizes = np.unique(first, return_counts=True)
        self.centres = np.stack([x[first == k].mean(axis=0) for k in names[np.argsort(-sizes, kind="stable")][:most]]) if len(x) else np.zeros((1, len(self.common)))
        for _ in range(steps):
            of = self._nearest(x)
            self.centres = np.stack([x[of == k].mean(axis=0) if (of == k).any() else c for k, c in enumerate(self.centres)])

    def _shares(self, texts: list[list[bytes]]) -> np.ndarray:
        get, n = self.common.get, len(self.common)
        x = np.zeros((len(texts), n + 1))
        for i, text in enumerate(texts):
            if text:
                x[i] = np.bincount(np.fromiter((get(w, n) for w in text), np.int64, len(text)), minlength=n + 1) / len(text)
        return np.sqrt(x[:, :-1])

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)

    def of(self, texts: list[list[bytes]]) -> np.ndarray:
        """The kind of each text, the nearest centre's number."""
        return self._nearest(self._shares(texts))


class Vocabulary:
    """The entries that the models tell apart: words, then all other words that begin alike, then the rest.

    ``beginnings`` lists known beginnings by length (``LENGTHS`` bytes); a word that is none of
    ``words`` is of the longest known beginning that it has.
    """

    def __init__(self, words: list[bytes], beginnings: list[list[bytes]]):
        self.words = {w: i for i, w in enumerate(words)}
        self.groups: list[dict[bytes, int]] = []
        n = len(words)
        for own in beginnings:
            self.groups.append({b: n + i for i, b in enumerate(own)})
            n += len(own)
        self.rest, self.size = n, n + 1
        # Kinds of each order: each known beginning, then all else that has a known beginning of the order below, then the rest (0).
        self.kinds: list[dict[tuple[int, bytes], int]] = []
        for order in range(len(LENGTHS)):
            named = [(order, b) for b in self.groups[order]] + [key for key in (self.kinds[-1] if order else {})]
            self.kinds.append({key: i + 1 for i, key in enumerate(named)})

    @staticmethod
    def of(texts: list[list[bytes]], fewest: int) -> Vocabulary:
        """Words, and beginnings, that come so often in several of the texts."""
        counts, spread = Counter(w for t in texts for w in t), Counter(w for t in texts for w in set(t))
        begun = [Counter() for _ in LENGTHS]
        for w, n in counts.items():
            for own, length in zip(begun, LENGTHS, strict=True):
                own[w[:length]] += n
        return Vocabulary(sorted(w for w, n in counts.items() if n >= fewest and spread[w] > 1), [sorted(b for b, n in own.items() if n >= fewest) for own in begun])

    def entry(self, word: bytes) -> int:
        i = self.words.get(word)
        if i is None:
            for own, length in zip(reversed(self.groups), reversed(LENGTHS), strict=True):
                i = own.get(word[:length])
                if i is not None:
                    return i
            return self.rest
        return i

    def kind(self, order: int, word: bytes) -> int:
        """The kind of a word in an order: its beginning's, or the longest shorter known one's."""
        for k in range(order, -1, -1):
            found = self.kinds[order].get((k, word[: LENGTHS[k]])) if word[: LENGTHS[k]] in self.groups[k] else None
            if found is not None:
                return found
        return 0

    def kinds_of_entries(self, order: int) -> np.ndarray:
        out = [self.kind(order, w) for w in self.words]
        for k, own in enumerate(self.groups):
            out += [self.kinds[order][k, b] if k <= order else self.kind(order, b) for b in own]
        return np.array([*out, 0])


class Counts:
    """Distinct contexts by class, from lists of words and their classes: all that the models need, whatever their discount.

    Every order counts distinct contexts, as Kneser-Ney's lower orders do, so that a copied or
    repeated passage counts once. ``shared`` is a number of distinct contexts in the whole corpus
    for each entry of the vocabulary.
    """

    def __init__(self, texts: list[list[bytes]], labels: list[int], vocabulary: Vocabulary, shared: np.ndarray):
        self.size = vocabulary.size
        self.shared = np.maximum(shared, 1.0)
        # All words are told apart as contexts; 0 is a text's beginning.
        every: dict[bytes, int] = {b"": 0}
        coded = [np.array([0, 0] + [every.setdefault(w, len(every)) for w in words], np.int64) for words in texts]
        coded = [(y, x) for x, y in zip(coded, labels, strict=True) if len(x) > 2]
        n, spelled = len(every), list(every)
        self.entry = np.array([vocabulary.entry(w) for w in spelled])
        known = np.array([w in vocabulary.words for w in spelled])
        join = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        klass = np.repeat([y for y, _ in coded], [len(x) - 2 for _, x in coded]).astype(np.int64)
        earlier, before, word = (join([x[k : len(x) - 2 + k] for _, x in coded]) for k in range(3))
        pair = before * n + word
        numbers, number = np.unique(pair, return_inverse=True)

        def counted(size: int, context: np.ndarray, item: np.ndarray) -> np.ndarray:
            """By class, the distinct contexts of each item."""
            return np.bincount(np.unique(context * (2 * size) + klass * size + item) % (2 * size), minlength=2 * size).reshape(2, size).astype(float)

        self.words = counted(n, before, word)
        self.orders = []  # of each length of beginnings: counts by kind, the kind of each entry, and of each kind that in the order below
        for order, kinds in enumerate(vocabulary.kinds):
            of = vocabulary.kinds_of_entries(order)
            whole = np.array([vocabulary.kind(order, w) for w in spelled])
            above = np.zeros(len(kinds) + 1, np.int64)
            for (k, b), i in kinds.items():
                above[i] = vocabulary.kinds[order - 1][k, b] if order and k < order else vocabulary.kind(order - 1, b) if order else 0
            self.orders.append((counted(len(kinds) + 1, number, whole[word]), of, above))
        k = counted(len(numbers), earlier, number)
        v, w = numbers // n, self.entry[numbers % n]
        inside = known[v] | (v == 0)
        self.pair_v, self.pair_w, self.pair_k = np.where(v == 0, self.size, self.entry[v])[inside], w[inside], k[:, inside]


class KneserNey:
    """Interpolated models of words after words, one for each class, over the entries of a vocabulary.

    As in modified Kneser-Ney the absolute discount D(k) grows with the count: min(k, ``discount``
    standard deviations of it, which is its square root). S is the strength of the orders below;
    of an order with counts k that sum to K, R = sum(D(k)) + S * K goes to the order below. (With
    S = 0 that is interpolated Kneser-Ney; S is the further share that a Pitman-Yor process gives
    to its base.)

    - P(w) of the corpus is proportional to shared contexts to the power of ``power``; both classes
      have it in common. (Contexts of common words run out sooner in a corpus than in a sample
      of it, which a power above 1 makes up for.)
    - P_c(b) of the beginnings b of words is (k - D(k) + R P_c(a) P(b | a)) / ((1 + S) K), where
      a is the next shorter beginning, at last none, and P(b | a) the corpus's.
    - P_c(w) of words likewise, below which their longest beginnings are.
    - Q_c(w | v) likewise from the pairs with v of both classes together, with P_c(w) below.
    - P_c(w | v) likewise from the pairs with v of class c, with Q_c(w | v) below. Where there is
      no pair with v it is what is below.

    An expression whose count the discount uses up has, but for R / K, what its beginning has in
    the class and, if that is rare too, the shared probability, and so says nothing.
    """

    def __init__(self, counts: Counts, discount: float, strength: float, power: float = 1.0):
        self.size, one = counts.size, 1 + strength
        below = counts.shared**power / (counts.shared**power).sum()
        gone = lambda k: np.minimum(k, discount * np.sqrt(k))

        def share(k: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            total = k.sum(axis=1, keepdims=True)
            kept = np.stack([np.bincount(of, weights=x, minlength=size) for x in k - gone(k)]) / np.maximum(total, 1) / one
            return kept, np.where(total > 0, (gone(k).sum(axis=1, keepdims=True) / np.maximum(total, 1) + strength) / one, 1.0)

        lower, parents, up = np.ones((2, 1)), np.ones(1), np.zeros(self.size, np.int64)
        for k, of, above in counts.orders:
            p = np.bincount(of, weights=below, minlength=len(above))
            kept, rest = share(k, np.arange(len(p)), len(p))
            lower, parents, up = kept + rest * lower[:, above] * p / np.maximum(parents[above], 1e-300), p, of
        kept, rest = share(counts.words, counts.entry, self.size)
        #: P_c of each entry.
        self.single = kept + rest * lower[:, up] * below / parents[up]
        # Rows of pairs: the ordinary and the toxic class's, and both together. The context after the last entry is a text's beginning.
        every = np.concatenate([counts.pair_k, counts.pair_k.sum(axis=0, keepdims=True)])
        totals = [np.stack([np.bincount(counts.pair_v, weights=x, minlength=self.size + 1) for x in y]) for y in (every, gone(every))]
        total = totals[0] * one
        #: What a pair with v that is not kept has of the order below.
        self.pair_rest = np.where(totals[0] > 0, (totals[1] + totals[0] * strength) / np.maximum(total, 1e-12), 1.0)
        some = (gone(every) < every).any(axis=0)
        self.pairs, at = np.unique(counts.pair_v[some] * self.size + counts.pair_w[some], return_inverse=True)
        kept = np.stack([np.bincount(at, weights=x, minlength=len(self.pairs)) for x in (every - gone(every))[:, some]])
        self.pair_kept = kept / np.maximum(total[:, self.pairs // self.size], 1e-12)

    def _paired(self, c: int, v: np.ndarray, kept: np.ndarray, below: np.ndarray) -> np.ndarray:
        """P_c(w | v) from what is kept of pairs (a row for each class and one for both) and P_c(w)."""
        return kept[c] + self.pair_rest[c, v] * (kept[2] + self.pair_rest[2, v] * below)

    def following(self, c: int, v: int) -> np.ndarray:
        """P_c(. | v) over all entries; v is an entry, or their number at a text's beginning."""
        kept = np.zeros((3, self.size))
        own = self.pairs // self.size == v
        kept[:, self.pairs[own] % self.size] = self.pair_kept[:, own]
        return self._paired(c, np.array(v), kept, self.single[c])

    def odds(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log P_toxic(w | v) / P_ordinary(w | v) of pairs of entries. What the corpus alone decides, such as which word of an entry it is, cancels out."""
        kept = np.zeros((3, len(v)))
        at = np.searchsorted(self.pairs, v * self.size + w)
        here = np.flatnonzero(at < len(self.pairs))
        here = here[self.pairs[at[here]] == (v * self.size + w)[here]]
        kept[:, here] = self.pair_kept[:, at[here]]
        p = [self._paired(c, v, kept, self.single[c, w]) for c in (0, 1)]
        return np.log(p[1]) - np.log(p[0])


class Odds:
    """Log ratios of the toxic to the ordinary models, the mean of several models', so that scoring a word is a few look-ups."""

    def __init__(self, models: list[KneserNey], vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.single = np.mean([np.log(m.single[1]) - np.log(m.single[0]) for m in models], axis=0).tolist()
        shift = np.mean([np.log(m.pair_rest[1]) - np.log(m.pair_rest[0]) for m in models], axis=0)
        self.context = {v: float(shift[v]) for v in np.flatnonzero(shift).tolist()}
        self.pair: dict[int, dict[int, float]] = {}
        size = vocabulary.size
        v, w = np.divmod(np.unique(np.concatenate([m.pairs for m in models])), size)
        for a, b, x in zip(v.tolist(), w.tolist(), np.mean([m.odds(v, w) for m in models], axis=0).tolist(), strict=True):
            self.pair.setdefault(a, {})[b] = x
        self.seen: dict[bytes, int] = {}

    def mean(self, words: list[bytes]) -> float:
        """The difference of the two log-likelihoods, divided by the number of words; 0 without words."""
        single, context, pair, seen, entry = self.single, self.context, self.pair, self.seen, self.vocabulary.entry
        known = len(self.vocabulary.words)
        if len(seen) > 100_000:
            seen.clear()
        total, last = 0.0, len(single)
        for word in words:
            w = seen.get(word)
            if w is None:
                seen[word] = w = entry(word)
            if last in pair and w in pair[last]:
                total += pair[last][w]
            else:
                total += single[w] + context.get(last, 0.0)
            last = w if w < known else -1
        return total / max(1, len(words))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float, float]:
    """Mean log loss, slope and intercept by Newton's method, with a slight ridge on the slope."""
    a = b = 0.0
    scale = max(1e-9, float(np.std(x)))
    z = x / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum((p - y) * z) + 1e-3 * a, np.sum(p - y)])
        h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    a = max(0.0, a)
    return float(np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * (a * z + b)))), a / scale, b


class ToxicityModel:
    """Language models of the two classes, and the line that turns the mean difference of log-likelihoods into a score.

    Each fold of the sample is left out of a pair of models in turn, which the final odds are
    the mean of. A class learns from about as many words of each kind of text as the other does,
    and the difference is taken from the median of left-out ordinary texts of the text's own kind,
    in units of their median distance to it: otherwise the classes' shares of languages would
    speak in every word.
    """

    def __init__(self, texts: list[bytes], labels: list[int], vocabulary: Vocabulary, shared: np.ndarray):
        same: dict[bytes, bytes] = {}
        words = [[same.setdefault(w, w) for w in words_of(t)] for t in texts]  # each word is held once
        y = np.array(labels, np.int64)
        self.kinds = Kinds(words, dict(zip(vocabulary.words, shared.tolist(), strict=False)))
        kind = self.kinds.of(words)
        fold = np.zeros(len(y), np.int64)
        for c in (0, 1):
            fold[y == c] = np.arange(int((y == c).sum())) % FOLDS
        grid = list(product(DISCOUNTS, STRENGTHS, POWERS))
        models: dict[tuple[float, float, float], list[KneserNey]] = {p: [] for p in grid}
        usual, odds = {p: [] for p in grid}, {p: np.zeros(len(y)) for p in grid}
        for k in range(FOLDS):
            own, out = self._balanced(np.flatnonzero(fold != k), words, y, kind), np.flatnonzero(fold == k)
            seen = Counts([words[i] for i in own], y[own].tolist(), vocabulary, shared)
            for p in grid:
                models[p].append(KneserNey(seen, *p))
                one = Odds(models[p][-1:], vocabulary)
                x = np.array([one.mean(words[i]) for i in out.tolist()], float)
                usual[p].append(self._usual(x, y[out], kind[out]))
                odds[p][out] = (x - usual[p][-1][0][kind[out]]) / usual[p][-1][1][kind[out]]
        self.slope, self.intercept, chosen = 1.0, 0.0, grid[0]
        if FOLDS <= y.sum() <= len(y) - FOLDS:
            self.tried = sorted((*_logistic(x, y), p) for p, x in odds.items())
            _, self.slope, self.intercept, chosen = self.tried[0]
        self.usual, self.odds = np.mean(usual[chosen], axis=0), Odds(models[chosen], vocabulary)

    @staticmethod
    def _balanced(texts: np.ndarray, words: list[list[bytes]], y: np.ndarray, kind: np.ndarray) -> list[int]:
        """Texts, in order, until a class has about as many words of a kind as the other class has at all."""
        size = np.zeros((2, int(kind.max(initial=0)) + 1))
        for i in texts.tolist():
            size[y[i], kind[i]] += len(words[i])
        out, used = [], np.zeros_like(size)
        for i in texts.tolist():
            if used[y[i], kind[i]] < size[1 - y[i], kind[i]] or not size[1 - y[i], kind[i]]:
                out.append(i)
                used[y[i], kind[i]] += len(words[i])
        return out

    def _usual(self, odds: np.ndarray, y: np.ndarray, kind: np.ndarray, fewest: int = 10) -> np.ndarray:
        """The median of ordinary texts by kind, and the median distance to it; those of all where a kind has few."""

        def middle(x: np.ndarray) -> tuple[float, float]:
            centre = float(np.median(x)) if len(x) else 0.0
            return centre, max(1e-9, float(np.median(np.abs(x - centre)))) if len(x) else 1.0

        own = [odds[(y == 0) & (kind == k)] for k in range(len(self.kinds.centres))]
        return np.array([middle(x if len(x) >= fewest else odds[y == 0]) for x in own]).T

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, from 0 to 1. One text's words are held at a time."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            words = words_of(text)
            centre, spread = self.usual[:, int(self.kinds.of([words])[0])]
            out[i] = (self.odds.mean(words) - centre) / spread
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.intercept, -30, 30)))


def shared_contexts(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The number of distinct contexts of each entry of ``vocabulary`` in all of ``docs``: words before a word, or pairs of words where an entry has several.

    Sketches of ``1 << REGISTER_BITS`` registers for each entry are filled within tasks and
    merged by their greatest ranks, so that a task sends one sketch for each entry it has seen;
    what comes to the driver is a number for each entry of the vocabulary.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    registers = 1 << REGISTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        entry, n_words = sent.value.entry, len(sent.value.words)
        ranks = np.zeros((sent.value.size, registers), np.uint8)
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                if len(words) < 2:
                    continue
                if len(known) > 100_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxh3_64_intdigest(w), entry(w)
                pairs = [known[w] for w in words]
                h = np.array([p[0] for p in pairs], np.uint64)
                at = np.array([p[1] for p in pairs[1:]], np.int64)
                # The hash of the context, of the whole pair for entries of several words.
                key = (h[:-1] ^ np.where(at >= n_words, h[1:] * np.uint64(3), np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
                key *= np.uint64(0xD6E8FEB86659FD93)
                low = (key >> np.uint64(REGISTER_BITS)).astype(np.float64) + 1
                rank = (64 - REGISTER_BITS - np.floor(np.log2(low))).astype(np.uint8)
                np.maximum.at(ranks, (at, (key & np.uint64(registers - 1)).astype(np.int64)), rank)
        filled = np.flatnonzero(ranks.any(axis=1))
        for start in range(0, len(filled), 1 << 12):  # in parts, so that no batch is large
            own = filled[start : start + (1 << 12)]
            column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(registers), len(own), [None, pa.py_buffer(ranks[own].tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), column], names=["entry", "ranks"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The estimates of a partition's entries; what is held is a sketch for each of them."""
        place: dict[int, int] = {}
        held = np.zeros((0, registers), np.uint8)
        for batch in batches:
            at = np.array([place.setdefault(e, len(place)) for e in batch.column(0).to_pylist()], np.int64)
            if len(place) > len(held):
                held = np.concatenate([held, np.zeros((2 * len(place) - len(held), registers), np.uint8)])
            np.maximum.at(held, at, np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, registers))
        held = held[: len(place)]
        empty = (held == 0).sum(axis=1)
        raw = 0.7213 / (1 + 1.079 / registers) * registers**2 / np.exp2(-held.astype(float)).sum(axis=1)
        linear = registers * np.log(registers / np.maximum(empty, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(place, np.int32, len(place))), pa.array(np.where((empty > 0) & (raw <= 2.5 * registers), linear, raw))], names=["entry", "contexts"])

    sketches = texts_of(docs, id_col, text_col).mapInArrow(run, "entry int, ranks binary")
    out = np.ones(vocabulary.size)
    for entry, contexts in sketches.repartition("entry").mapInArrow(merge, "entry int, contexts double").collect():
        out[entry] = max(1.0, contexts)
    return out


def _sampled(ids: DataFrame, sample: int, most_total: int) -> list[tuple[int, int]]:
    """(doc_id, toxic) of the first of a class's documents by a hash of the id, as many as both bounds allow."""
    out, held = [], 0
    for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
        held += r["bytes"]
        if held > most_total and out:
            break
        out.append((r["doc_id"], r["toxic"]))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES, most_total: int = SAMPLE_TOTAL) -> ToxicityModel:
    """Learns class counts from at most ``sample`` labelled documents of each class, of ``most_total`` bytes together, chosen by a hash of the id, that the held-out fold does not hold.

    What one task holds of it is bounded by 2 * most_total bytes, whatever the corpus; the
    counts that both classes back off to are taken over all of ``docs``, without labels. Labels
    that are null, or of documents with no text, are passed over; of several labels of one
    document the highest counts.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fitting = texts_of(docs).where(F.octet_length("text").between(1, most_bytes))
    # Ids first, so that texts of the sample alone are sorted out.
    ids = known.join(fitting.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")), "doc_id")
    picked = [r for c in (0, 1) for r in _sampled(ids.where((F.col("toxic") > 0) == (c > 0)), sample, most_total)]
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    rows = fitting.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").dropDuplicates(["doc_id"])
    fewest = math.floor(min(DISCOUNTS) ** 2) + 1  # the discount uses up what comes more seldom
    vocabulary = _in_one_task(rows, lambda texts, classes: Vocabulary.of([words_of(t) for t in texts], fewest))
    shared = shared_contexts(docs, vocabulary)
    return _in_one_task(rows, lambda texts, classes: ToxicityModel(texts, classes, vocabulary, shared))


def _in_one_task(rows: DataFrame, work: Callable[[list[bytes], list[int]], object]) -> object:
    """What ``work`` makes of the sample's texts and classes, in order of ids. The sample is bounded, so one task holds it; only the result comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((r["doc_id"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        out = pickle.dumps(work([t.encode() for _, t, _ in held], [int(c > 0) for *_, c in held]))
        parts = [out[i : i + (1 << 22)] for i in range(0, len(out), 1 << 22)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["place", "part"])

    parts = rows.repartition(1).mapInArrow(run, "place int, part binary").collect()
    if not parts:  # an empty sample may have no task
        return work([], [])
    return pickle.loads(b"".join(bytes(p["part"]) for p in sorted(parts, key=lambda p: p["place"])))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of ``docs``, without a shuffle.

    The score grows with the mean, by word, of the log likelihood ratio of the toxic to the
    ordinary model over the whole text; nothing but the text goes into it. A null or empty text,
    or one without words, has mean 0. Equal texts score equally. Rows whose id is null count
    as not held out. Other columns are not read; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = texts_of(docs, id_col, text_col)
    return rows.select("doc_id", "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under the threshold. A null text is judged as the empty one."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores([t or b"" for t in as_bytes(batch.column(place))]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_toxicity`` of all ``documents`` by a model fitted on ``labels`` outside of the held-out fold; see there for nulls, ties and empty texts."""
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
