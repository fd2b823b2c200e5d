"""Repeated passages: prefix-free parsing, with suffix arrays of the dictionary, in distributed form.

A rolling hash over ``TRIGGER`` bytes is taken at every place; the least hash in the look-ahead of
``PASSAGE`` bytes is a place's trigger, and a phrase is a run of places with one trigger, together with
its look-ahead. (With triggers that are 0 modulo p a phrase, and so a task, has no bound: a long
passage may hold none.) As the look-ahead bounds the gap between triggers, every passage of that length lies in
just one phrase, and equal passages lie in phrases with equal triggers, wherever they come. So

- the parse, the sequence of phrases, tells by the first place of each distinct phrase which phrases are
  repeated as a whole; and
- the dictionary of distinct phrases, dealt out by trigger, tells by suffix arrays which passages come in
  several phrases or several times in one. A run of equal neighbours in suffix order, ordered further by the
  first place of its phrases in the parse, has its first passage first: that is corpus order. The look-ahead
  holds all that is compared, so the parse needs no suffix order beyond the first places.

Phrases whose trigger and content come once are dropped early, so that only repeated text is sorted.
Triggers whose phrases are too much for one task have their suffixes dealt out by content instead: a
range sort over all tasks, which is the same suffix array cut at other places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import Scratch, as_bytes, hot_limit, join_by_hot_keys, table, texts_of

PASSAGE = 100
TRIGGER = 32
#: Places that are parsed at once, and bytes whose suffixes are sorted at once.
BLOCK, SORTED_BYTES = 1 << 19, 1 << 20
#: Bytes of distinct phrases with one trigger up to which one task sorts them; the suffixes of the rest are sorted by all tasks together.
HOT_BYTES = 1 << 20
#: Places of a trigger from which on they are not brought together; more where a table is so long that too many triggers would have as many.
HOT_ROWS = 1000
#: Up to so many ids (8 bytes each) that name several texts are sent to every task.
BROADCAST_IDS = 500_000

_MIX = np.random.default_rng(11).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _trigger_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``TRIGGER`` (32) bytes from each place on, doubling the span step by step."""
    h = _MIX[data]
    for i, odd in enumerate(_ODD):
        span = 1 << i
        h = h[:-span] * odd + h[span:]
        h ^= h >> np.uint64(31)
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``width`` neighbours."""
    span, n = 1, len(x) - width + 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[:n], x[width - span : width - span + n])


def phrases(data: bytes, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, start, end, own) of the phrases of several texts in ``data``, each from first to after; places where passages begin, end inclusive.

    own: whether the trigger comes twice in the phrase, so that a passage might be repeated in it.
    """
    width = PASSAGE - TRIGGER + 1
    if len(data) < PASSAGE:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(bool)
    h = _trigger_hashes(np.frombuffer(data, np.uint8))
    least = _sliding(h, width, np.minimum)
    valid = np.zeros(len(least) + 1, np.int8)
    long = after - first >= PASSAGE
    valid[first[long]] += 1
    valid[after[long] - PASSAGE + 1] -= 1
    valid = np.cumsum(valid[:-1]).astype(bool)
    begin = valid.copy()
    begin[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begin[first[long]] = True
    stop = valid.copy()
    stop[:-1] &= begin[1:] | ~valid[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop)
    # Chosen places: those that are the least of some look-ahead. Neighbours among them with one hash are one trigger twice.
    reach = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(reach, width, np.maximum) == h)
    twice = chosen[:-1][(h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) < width)]
    twice = twice[twice < len(least)]
    twice = twice[valid[twice] & (least[twice] == h[twice])]
    own = end - start >= width
    own[np.searchsorted(start, twice, side="right") - 1] = True
    return least[start].view(np.int64), start, end, own


def parse(docs: DataFrame) -> DataFrame:
    """(trigger, phrase, doc_id, start, size, own): the phrases of every text; size is the number of places, phrase a hash of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def flush(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            data = b"".join(p for _, _, p in parts)
            after = np.cumsum([len(p) for _, _, p in parts])
            first = after - np.array([len(p) for _, _, p in parts])
            trigger, start, end, own = phrases(data, first, after)
            view = memoryview(data)
            phrase = np.array([xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (end + PASSAGE).tolist(), strict=True)], np.uint64)
            part = np.searchsorted(first, start, side="right") - 1
            ids, bases = np.array([i for i, _, _ in parts], np.int64), np.array([b for _, b, _ in parts], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(trigger), pa.array(phrase.view(np.int64)), pa.array(ids[part]), pa.array(bases[part] + start - first[part]), pa.array((end - start + 1).astype(np.int32)), pa.array(own)], names=["trigger", "phrase", "doc_id", "start", "size", "own"])

        for batch in batches:
            parts: list[tuple[int, int, bytes]] = []
            held = 0
            for i, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                # A long text goes in overlapping parts: a phrase may be cut there, which costs nothing but a dictionary entry.
                for base in range(0, max(1, len(text) - PASSAGE + 1), BLOCK):
                    parts.append((i, base, text[base : base + BLOCK + PASSAGE - 1]))
                    held += len(parts[-1][2])
                    if held >= BLOCK:
                        yield flush(parts)
                        parts, held = [], 0
            if parts:
                yield flush(parts)

    return docs.where(f"doc_id IS NOT NULL AND octet_length(text) >= {PASSAGE}").mapInArrow(run, "trigger long, phrase long, doc_id long, start long, size int, own boolean")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, entries) to (trigger, hot, doc_id, start, size, content)."""
    for batch in batches:
        for i, (text, entries) in enumerate(zip(as_bytes(batch.column(1)), batch.column(2), strict=True)):
            flat = entries.values
            start, size = flat.field("start").to_numpy(), flat.field("size").to_numpy()
            content = [text[s : s + n + PASSAGE - 1] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
            doc = np.full(len(start), batch.column(0)[i].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([flat.field("trigger"), flat.field("hot"), pa.array(doc), flat.field("start"), flat.field("size"), pa.array(content, pa.binary())], names=["trigger", "hot", "doc_id", "start", "size", "content"])


def suffix_classes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place a number that is equal for equal passages and grows in suffix order. Ranks of 8 bytes double to 64, then two overlap to 100."""
    padded = np.concatenate([data, np.zeros(PASSAGE + 8, np.uint8)]).astype(np.uint64)
    w = padded
    for span in (1, 2, 4):
        w = (w[:-span] << np.uint64(8 * span)) | w[span:]
    n = len(data)
    rank = np.unique(w[:n], return_inverse=True)[1].astype(np.int64)
    for span in (8, 16, 32):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - span)] = rank[span:]
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
    ahead = rank[np.minimum(places + PASSAGE - 64, n - 1)]
    return rank[places] * (n + 1) + ahead


def _spans(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Spans (doc_id, start, stop) of places whose passages are repeated, given in order of doc and place."""
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["doc_id", "start", "stop"])
    cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)))
    return pa.RecordBatch.from_arrays([pa.array(doc[cut]), pa.array(at[cut]), pa.array(at[np.append(cut[1:], len(at)) - 1] + PASSAGE)], names=["doc_id", "start", "stop"])


def _sort_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated passages among phrases with one trigger; rows come in order of triggers, whole triggers are sorted together."""

    def repeated(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        length = np.array([len(r[4]) for r in rows])
        size = np.array([r[3] for r in rows])
        base, total = np.cumsum(length) - length, np.cumsum(size)
        inside = np.arange(total[-1]) - np.repeat(total - size, size)
        klass = suffix_classes(data, np.repeat(base, size) + inside)
        doc, at = np.repeat(np.array([r[1] for r in rows]), size), np.repeat(np.array([r[2] for r in rows]), size) + inside
        order = np.lexsort((at, doc, klass))
        klass, doc, at = klass[order], doc[order], at[order]
        # A repeated row brings the same places again: what is at its class's first place is no copy.
        new = np.append(True, klass[1:] != klass[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(klass)), 0))
        again = (doc != doc[first]) | (at != at[first])
        doc, at = doc[again], at[again]
        order = np.lexsort((at, doc))
        return _spans(doc[order], at[order])

    rows: list[tuple[int, int, int, int, bytes]] = []
    held = 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("trigger", "doc_id", "start", "size", "content")), strict=True):
            if held >= SORTED_BYTES and row[0] != rows[-1][0]:
                yield repeated(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield repeated(rows)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each place of hot triggers' phrases: its passage, and where it is."""
    for batch in batches:
        for doc, start, size, content in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "start", "size", "content")), strict=True):
            for at in range(0, size, 4096):
                n = min(4096, size - at)
                passages = np.lib.stride_tricks.sliding_window_view(np.frombuffer(content, np.uint8, n + PASSAGE - 1, at), PASSAGE)
                column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PASSAGE), n, [None, pa.py_buffer(passages.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([column, pa.array(np.full(n, doc, np.int64)), pa.array(np.arange(start + at, start + at + n))], names=["passage", "doc_id", "at"])


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of places in order of passage, document and place: those that are not their passage's first in this partition, as spans, and the partition's first and last passage.

    Spans come with null ``edge``; a first row has edge 0, the last one 1, with its passage.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("edge", pa.int32()), ("passage", pa.binary())])
    last, last_place, first = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        passages = batch.column("passage")
        # Passages are 100 bytes each, end to end.
        rows = np.frombuffer(passages.buffers()[2], np.uint8, batch.num_rows * PASSAGE, passages.offset * PASSAGE).reshape(-1, PASSAGE)
        doc, at = batch.column("doc_id").to_numpy(), batch.column("at").to_numpy()
        same = np.append(last is not None and rows[0].tobytes() == last, (rows[1:] == rows[:-1]).all(axis=1))
        # A repeated row brings the same places again: what is at its class's first place is no copy.
        begin = np.maximum.accumulate(np.where(same, -1, np.arange(len(rows))))
        where = [np.where(begin < 0, last_place[k] if last_place else 0, x[np.maximum(begin, 0)]) for k, x in enumerate((doc, at))]
        again = same & ((doc != where[0]) | (at != where[1]))
        if first is None:
            first = (int(doc[0]), int(at[0]), rows[0].tobytes())
            yield pa.RecordBatch.from_pylist([{"doc_id": first[0], "start": first[1], "stop": first[1] + PASSAGE, "edge": 0, "passage": first[2]}], schema=schema)
        last, last_place = rows[-1].tobytes(), (int(where[0][-1]) if same[-1] else int(doc[-1]), int(where[1][-1]) if same[-1] else int(at[-1]))
        n = int(again.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(doc[again]), pa.array(at[again]), pa.array(at[again] + PASSAGE), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"doc_id": last_place[0], "start": last_place[1], "stop": last_place[1] + PASSAGE, "edge": 1, "passage": last}], schema=schema)


def _hot_spans(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """Repeated passages among the phrases of hot triggers, by a range sort of their suffixes over all tasks.

    The sort is by passage, document and place, so that even one passage's places are dealt over
    many tasks. Where a passage goes on into the next task, that task's first place, which it
    took for the passage's first, is added: only the edges of partitions are compared for it.
    """
    order = ["passage", "doc_id", "at"]
    places = cut.where("hot").mapInArrow(_suffixes, "passage binary, doc_id long, at long").repartitionByRange(*order).sortWithinPartitions(*order)
    found = scratch.save(places.mapInArrow(_again, "doc_id long, start long, stop long, edge int, passage binary"), "sorted")
    # A partition's first place is repeated if its passage has a smaller place: the last passage of an earlier partition.
    first, last = (found.where(f"edge = {k}") for k in (0, 1))
    earliest = last.groupBy("passage").agg(F.min(F.struct("doc_id", "start")).alias("earliest"))
    over = first.join(earliest, "passage").where("struct(doc_id, start) > earliest")
    return found.where("edge IS NULL").select("doc_id", "start", "stop").union(over.select("doc_id", "start", "stop"))


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, stop): spans, in bytes, whose every ``PASSAGE`` bytes also begin earlier. They overlap, and cover all there are."""
    runs = scratch.save(parse(docs), "parse")
    limit = hot_limit(runs.count(), HOT_ROWS)
    live = runs.groupBy("trigger").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 OR own").select("trigger", (F.col("n") > limit).alias("common"))
    live = scratch.save(live, "triggers")
    found = scratch.save(join_by_hot_keys(runs, live, "trigger", "common").drop("common"), "phrases")
    scratch.drop("parse", "triggers")
    entries = found.groupBy("trigger", "phrase").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("size").alias("size"), F.max("own").alias("own"), F.count("*").alias("n"))
    entries = scratch.save(entries, "dictionary")
    # The parse: all but a phrase's first place are repeated whole.
    again = entries.where("n > 1").select("trigger", "phrase", "first")
    whole = found.join(again, ["trigger", "phrase"]).where("struct(doc_id, start) != first").select("doc_id", "start", (F.col("start") + F.col("size") + (PASSAGE - 1)).alias("stop"))
    # The dictionary: triggers with several phrases, or phrases that hold their trigger twice.
    weight = F.sum(F.col("size") + (PASSAGE - 1))
    several = entries.groupBy("trigger").agg(F.count("*").alias("n"), F.max("own").alias("own"), weight.alias("bytes")).where("n > 1 OR own").select("trigger", (F.col("bytes") > HOT_BYTES).alias("hot"), (F.col("n") > limit).alias("common"))
    several = scratch.save(several, "dealt")
    several = scratch.save(join_by_hot_keys(entries.drop("own", "n"), several, "trigger", "common").select("trigger", "hot", "first.doc_id", "first.start", "size"), "several")
    by_doc = several.groupBy("doc_id").agg(F.collect_list(F.struct("trigger", "hot", "start", "size")).alias("entries"))
    cut = scratch.save(docs.join(by_doc, "doc_id").select("doc_id", "text", "entries").mapInArrow(_slices, "trigger long, hot boolean, doc_id long, start long, size int, content binary"), "contents")
    scratch.drop("several", "dealt")
    sorted_spans = cut.where("NOT hot").drop("hot").repartition("trigger").sortWithinPartitions("trigger").mapInArrow(_sort_dictionary, "doc_id long, start long, stop long")
    return scratch.save(whole.union(sorted_spans).union(_hot_spans(cut, scratch)), "spans")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept), a row for each row of ``docs``.

    Removes each byte that is covered by ``PASSAGE`` bytes which also begin earlier: in a
    document with a smaller id, or earlier in the same one; overlaps count, and passages never
    cross documents. spans are the maximal removed runs (start, stop in bytes), kept the remaining
    bytes. A null text is empty; texts shorter than a passage stay whole. An id names one
    document: rows that repeat an id and its text get the same answer and do not count as
    each other's copies. Rows without an id, and rows whose id comes with several texts, cannot
    be ordered: they stay whole, and nothing counts as their copy. Other columns are not read;
    an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    base = texts_of(docs, id_col, text_col)
    named = base.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    unclear = scratch.save(named.where("a != b AND doc_id IS NOT NULL").select("doc_id"), "unclear")
    n = unclear.count()
    ordered = base.join(F.broadcast(unclear) if n <= BROADCAST_IDS else unclear, "doc_id", "left_anti") if n else base
    spans = repeated_spans(ordered, scratch)
    scratch.drop("phrases", "dictionary", "contents", "sorted")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2), strict=True):
                out: list[tuple[int, int]] = []
                if found.is_valid:
                    start, stop = found.values.field("start").to_numpy(), np.minimum(found.values.field("stop").to_numpy(), len(text))
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    cut = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
                    out = list(zip(start[cut].tolist(), stop[np.append(cut[1:], len(start)) - 1].tolist(), strict=True))
                parts, last = [], 0
                for a, b in out:
                    parts.append(text[last:a])
                    last = b
                sizes.append(len(text))
                removed.append(sum(b - a for a, b in out))
                spans.append([{"start": a, "stop": b} for a, b in out])
                kept.append(b"".join([*parts, text[last:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return base.join(by_doc, "doc_id", "left").select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cut_repeats`` of all ``documents``, with a digest of what is left; see there for nulls, ties and repeated rows."""
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
