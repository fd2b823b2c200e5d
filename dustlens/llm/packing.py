"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import Scratch, as_bytes, table, texts_of

#: Permitted sequence lengths, in bytes of UTF-8 (the units of a byte-level model), and what a sequence costs besides its length.
LENGTHS = (2048, 4096, 8192, 16384, 32768)
FIXED_COST = 64
#: Pieces, and bytes of text, that are packed together; enough that bins fill, and what one task holds.
SHARD_PIECES, SHARD_BYTES = 20_000, 1 << 25
#: Partitions that shards are dealt over, at most.
MOST_PARTITIONS = 1 << 16


def _fill(falling: np.ndarray, i: int, capacity: int) -> int:
    """What a bin opened for piece ``i`` can hold of it and the pieces after it, each taken where it fits; ``falling`` holds sizes negated, so that they rise."""
    room, at = capacity + int(falling[i]), i + 1
    while room > 0 and (at := max(at, int(np.searchsorted(falling, -room)))) < len(falling):
        room += int(falling[at])
        at += 1
    return capacity - room


def _best_fit(falling: np.ndarray, lengths: tuple[int, ...], choose: Callable[[int, int, tuple[int, ...]], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece in falling order, and the contents of each bin; ``choose`` gives the capacity to open for piece ``i`` of size ``n`` out of the lengths that hold it."""
    bin_of, offset = np.zeros(len(falling), np.int64), np.zeros(len(falling), np.int64)
    used: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, n in enumerate((-falling).tolist()):
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = choose(i, n, lengths[bisect_left(lengths, n) :]), len(used)
            used.append(0)
        bin_of[i], offset[i] = b, used[b]
        used[b] += n
        if room > n or n == 0:
            insort(rooms, (room - n, b))
    return bin_of, offset, np.array(used, np.int64)


def pack(size: np.ndarray, lengths: tuple[int, ...] = LENGTHS, fixed: int = FIXED_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) of each piece; sizes are 0 to the largest length.

    Pieces go by falling size, ties in the given order, into the open bin with the least room
    that holds them. Where none does, a bin is opened, in several mixes of lengths: at the
    capacity that costs least for each unit that the pieces really left can fill; likewise, but
    taking the units left as if they filled any room; and, for each permitted length, at that
    length or the least that holds the piece. At the end each bin is cut down to the smallest
    length that holds its contents, and the mix is taken whose bins cost least together,
    capacities plus fixed costs.
    """
    lengths = tuple(sorted(lengths))
    if not len(size):
        return (np.zeros(0, np.int64),) * 3
    order = np.argsort(-size, kind="stable")
    falling = -size[order].astype(np.int64)
    rest = -np.cumsum(falling[::-1])[::-1]

    def by_pieces(i: int, n: int, holding: tuple[int, ...]) -> int:
        fills = {c: _fill(falling, i, c) for c in holding}
        return min(holding, key=lambda c: ((lengths[bisect_left(lengths, fills[c])] + fixed) / max(1, fills[c]), -c))

    def by_units(i: int, n: int, holding: tuple[int, ...]) -> int:
        left = int(rest[i])
        return min(holding, key=lambda c: ((c + fixed) / max(1, min(c // max(n, 1) * n + min(c % max(n, 1), max(0, left - n)), left)), -c))

    least = None
    for choose in (by_units, by_pieces, *(lambda i, n, holding, c=c: max(c, holding[0]) for c in reversed(lengths))):
        b, at, used = _best_fit(falling, lengths, choose)
        capacity = np.array(lengths)[np.searchsorted(lengths, used)]
        cost = int(capacity.sum()) + fixed * len(used)
        if least is None or cost < least[0]:
            least = cost, b, at, capacity
    bin_of, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    bin_of[order], offset[order] = least[1], least[2]
    return bin_of, offset, least[3][bin_of]


def cuts(text: bytes, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text, of at most ``most`` bytes, cut between characters; one of length 0 for an empty text."""
    out, start = [], 0
    while len(text) - start > most:
        end = start + most
        while end > start and text[end] & 0xC0 == 0x80:
            end -= 1
        out.append((start, end - start))
        start = end
    return [*out, (start, len(text) - start)]


def pieces(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, piece, start, length, text): each row's text, cut into pieces; row is a number of its own for each row."""
    if most < 4:
        raise ValueError("a character may take 4 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            own = [cuts(t, most) for t in texts]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            start, length = np.array([x for y in own for x in y], np.int64).reshape(-1, 2).T
            piece = np.arange(len(at)) - np.searchsorted(at, at)
            parts = [texts[i][a : a + n] for i, a, n in zip(at.tolist(), start.tolist(), length.tolist(), strict=True)]
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(parts, pa.binary()).cast(pa.string())], names=["row", "doc_id", "piece", "start", "length", "text"])

    rows = texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, text string")


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shard_pieces: int = SHARD_PIECES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, bin, capacity, used, offset, doc_id, piece, start, length, text), a row for each piece, in order of bins and offsets within a shard.

    Joining a bin's texts in order of offsets gives its sequence, joining a document's texts in
    order of pieces the document. Lengths are bytes of UTF-8; a document longer than the largest
    permitted length becomes several pieces, cut between characters, so that nothing is lost. A
    null text is empty; a piece of length 0 takes its place at the end of a bin. Pieces are
    numbered by row, written out, and dealt over shards by a hash of row and piece, so that
    neither one id nor equal rows fill a shard: some ``shard_pieces`` pieces or ``shard_bytes``
    bytes of text go to a shard, which one task packs. Repeated rows are packed each, and rows
    with a null id like others. Other columns are not read; an empty table gives an empty
    result. Without ``with_text`` no texts are moved and that column is left out.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    items = pieces(docs, max(lengths), id_col, text_col)
    items = scratch.save(items if with_text else items.drop("text"), "pieces")
    n, held = items.agg(F.count("*"), F.sum("length")).first()
    shards = max(1, -(-n // shard_pieces), -(-(held or 0) // shard_bytes) if with_text else 1)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("row", "ascending"), ("piece", "ascending")])
        size = rows.column("length").to_numpy()
        b, offset, capacity = pack(size, lengths)
        used = np.bincount(b, weights=size).astype(np.int64)[b] if len(size) else size
        out = {"shard": rows.column("shard"), "bin": b, "capacity": capacity, "used": used, "offset": offset} | {c: rows.column(c) for c in ("doc_id", "piece", "start", "length", *(["text"] if with_text else []))}
        # Of one offset a piece of length 0 comes first.
        return pa.table(out).take(pa.array(np.lexsort((size, offset, b))))

    shard = F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int")
    dealt = items.withColumn("shard", shard).repartitionByRange(min(shards, MOST_PARTITIONS), "shard")  # a shard to a task, however many there are
    return dealt.groupBy("shard").applyInArrow(run, "shard int, bin long, capacity long, used long, offset long, doc_id long, piece int, start long, length long" + (", text string" if with_text else ""))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, bin, capacity, used, offset, doc_id, piece, start, length) for each piece of ``documents``; see ``pack_documents`` for nulls, ties and repeated rows."""
    return pack_documents(table(spark, sf_dir, "documents"), with_text=False)
