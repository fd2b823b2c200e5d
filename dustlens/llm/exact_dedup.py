"""Exact deduplication: counting quotient filters find what may repeat, bytes decide."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import Scratch, gathered, table, texts_of

#: Entries of a block of quotients, the unit that one step merges, and the fewest blocks there are (as a power of two).
BLOCK_ENTRIES, LEAST_BLOCK_BITS = 1 << 22, 6
#: Bits of a remainder: with as many more than there are rows, two in 2 ** 32 texts share a fingerprint by chance, which bytes then tell apart.
REMAINDER_BITS = 32
#: Up to so many repeated fingerprints (8 bytes each) are sent to every task; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _fingerprint() -> Column:
    return F.xxhash64("text")


def _digest() -> Column:
    return F.sha2(F.col("text").cast("binary"), 256)


class Layout(NamedTuple):
    """How the leading bits of a 64-bit hash are split: the block's number, the quotient within the block, the remainder."""

    block_bits: int
    quotient_bits: int
    remainder_bits: int

    @staticmethod
    def of(rows: int) -> Layout:
        """For a table of so many rows: blocks of at most some ``BLOCK_ENTRIES``, half as many entries as quotients."""
        bits = max(LEAST_BLOCK_BITS, int(rows).bit_length() + 1)
        blocks = max(LEAST_BLOCK_BITS, bits - 1 - (BLOCK_ENTRIES.bit_length() - 1))
        return Layout(blocks, bits - blocks, min(REMAINDER_BITS, 64 - bits))

    @property
    def spare(self) -> np.uint64:
        return np.uint64(64 - self.block_bits - self.quotient_bits - self.remainder_bits)


class QuotientFilter:
    """A counting quotient filter over one block of fingerprints, all filters of a run having one ``Layout``.

    Slots hold sorted remainders; a bit for each slot tells whether it ends its quotient's run,
    and quotients in use are a bit each or, where that is shorter, a list. A bit for each slot
    tells whether it counts more than one; such counts are listed. Filters of a block merge
    without loss by merging sorted remainders, and take some 4.5 bytes an entry.
    """

    def __init__(self, fingerprint: np.ndarray, count: np.ndarray):
        self.fingerprint, self.count = fingerprint, count  # sorted, within the block: quotient, then remainder

    @staticmethod
    def merge(filters: list[QuotientFilter]) -> QuotientFilter:
        """Sums counts over sorted fingerprints: one step for any number of filters."""
        every = np.concatenate([np.zeros(0, np.uint64), *(f.fingerprint for f in filters)])
        order = np.argsort(every, kind="stable")  # merges sorted runs
        every, count = every[order], np.concatenate([np.zeros(0, np.uint64), *(f.count for f in filters)])[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        return QuotientFilter(every[first], np.add.reduceat(count, first) if len(first) else count)

    def to_bytes(self, layout: Layout) -> bytes:
        quotient = self.fingerprint >> np.uint64(layout.remainder_bits)
        remainder = (self.fingerprint & np.uint64((1 << layout.remainder_bits) - 1)).astype(np.uint32)
        run_end = np.append(quotient[1:] != quotient[:-1], True)[: len(quotient)]
        used = quotient[run_end]
        dense = (1 << layout.quotient_bits) // 8 <= 4 * len(used)
        if dense:
            bits = np.zeros(1 << layout.quotient_bits, bool)
            bits[used] = True
            occupied = np.packbits(bits)
        else:
            occupied = used.astype(np.uint32)
        many = self.count > 1
        head = np.array([len(remainder), len(used) * 2 + dense], np.uint32)
        return b"".join(x.tobytes() for x in (head, occupied, np.packbits(run_end), remainder, np.packbits(many), self.count[many]))

    @staticmethod
    def from_bytes(data: bytes, layout: Layout) -> QuotientFilter:
        n, used = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        used, dense, at = used >> 1, used & 1, 8

        def take(dtype: type, size: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, size, at)
            at += out.nbytes
            return out

        bits = lambda size: np.unpackbits(take(np.uint8, (size + 7) // 8), count=size).astype(bool)
        occupied = np.flatnonzero(bits(1 << layout.quotient_bits)) if dense else take(np.uint32, used)
        run_end = bits(n)
        run = np.cumsum(run_end) - run_end
        remainder = take(np.uint32, n)
        many = bits(n)
        count = np.ones(n, np.uint64)
        count[many] = np.frombuffer(data[at:], np.uint64)
        return QuotientFilter(occupied[run].astype(np.uint64) << np.uint64(layout.remainder_bits) | remainder, count)


def _builder(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition's filters, a row for each block."""
        inside = layout.quotient_bits + layout.remainder_bits
        for part in gathered(batches):
            fingerprint, count = np.unique(part.column(0).to_numpy().view(np.uint64) >> layout.spare, return_counts=True)
            block = (fingerprint >> np.uint64(inside)).astype(np.int64)
            fingerprint, count = fingerprint & np.uint64((1 << inside) - 1), count.astype(np.uint64)
            names, starts = np.unique(block, return_index=True)
            ends = np.append(starts[1:], len(block))
            filters = [QuotientFilter(fingerprint[s:e], count[s:e]).to_bytes(layout) for s, e in zip(starts, ends, strict=True)]
            if filters:
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(filters, pa.binary())], names=["block", "filter"])

    return run


def _merger(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merges the filters of each block, which come in order of blocks; returns the leading hash bits of what counts more than one."""
        inside = np.uint64(layout.quotient_bits + layout.remainder_bits)
        held: list[QuotientFilter] = []
        now, entries = -1, 0

        def repeated() -> pa.RecordBatch:
            whole = QuotientFilter.merge(held)
            prefix = np.uint64(now) << inside | whole.fingerprint[whole.count > 1]
            return pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64))], names=["prefix"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now:
                    if held:
                        yield repeated()
                    held, now, entries = [], block, 0
                held.append(QuotientFilter.from_bytes(data, layout))
                entries += len(held[-1].count)
                if entries > 2 * BLOCK_ENTRIES:  # what was merged shrinks to its distinct entries
                    held = [QuotientFilter.merge(held)]
                    entries = len(held[0].count)
        if held:
            yield repeated()

    return run


def repeated_prefixes(fingerprints: DataFrame, layout: Layout) -> DataFrame:
    """(prefix) of every value that the one long column of ``fingerprints`` holds more than once: the value's leading bits, as many as the layout has."""
    filters = fingerprints.mapInArrow(_builder(layout), "block int, filter binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(_merger(layout), "prefix long")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(fp, text_sha256, keep_id, group_size) of every text that comes more than once, written out, and how many there are.

    Every partition's fingerprints go into counting quotient filters, one for each block of
    quotients, as many blocks as the number of rows asks for; only the filters are shuffled.
    Rows whose fingerprint counts one are done.
    The rest are grouped by their whole text, with partial aggregation, so that a group of any
    size sends one row for each task.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    base = texts_of(docs, id_col, text_col)
    layout = Layout.of(docs.count())
    repeats = scratch.save(repeated_prefixes(base.select(_fingerprint().alias("fp")), layout), "repeats")
    side = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    prefix = F.shiftrightunsigned("fp", int(layout.spare)).alias("prefix")
    suspects = base.select("doc_id", "text", _fingerprint().alias("fp")).withColumn("prefix", prefix).join(side, "prefix", "left_semi")
    groups = suspects.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = scratch.save(groups.select("fp", _digest().alias("text_sha256"), "keep_id", "group_size"), "groups")
    scratch.drop("repeats")
    return groups, groups.count()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when their bytes are; a null counts as the empty text, and empty texts are
    equal to one another. The row with the largest id of a group stays; ids that are null never
    win over others. Rows that repeat an id and a text are the same document: each counts in
    group_size and carries the same answer. Other columns are not read, whatever their names;
    an empty table gives an empty result. See ``copy_groups`` for the method.
    """
    groups, _ = copy_groups(docs, id_col, text_col)
    rows = texts_of(docs, id_col, text_col).select("doc_id", _fingerprint().alias("fp"), _digest().alias("text_sha256"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, ["fp", "text_sha256"], "left").select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each text: that with the largest id; of rows that repeat an id and a text, any one."""
    groups, n = copy_groups(docs, id_col, text_col)
    text = F.coalesce(docs[text_col], F.lit(""))
    key = F.struct(F.xxhash64(text).alias("fp"), F.sha2(text.cast("binary"), 256).alias("sha"))
    side = groups.select(F.struct(F.col("fp"), F.col("text_sha256").alias("sha")).alias("_group"), F.col("keep_id").cast("long").alias("_keep"))
    side = F.broadcast(side) if n <= BROADCAST_ROWS else side
    keyed = docs.withColumn("_key", key)
    single = keyed.join(side, F.col("_key") == F.col("_group"), "left_anti").drop("_key")
    winners = keyed.join(side, F.col("_key") == F.col("_group")).where(keyed[id_col].cast("long").eqNullSafe(F.col("_keep"))).drop("_group", "_keep")
    return single.unionByName(winners.dropDuplicates(["_key"]).drop("_key"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exact_dedup`` of all ``documents``, which says what nulls, ties and repeated rows give."""
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d
"""
