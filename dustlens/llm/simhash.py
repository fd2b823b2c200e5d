"""Near-duplicate groups by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustlens.llm.common import Scratch, as_bytes, table, texts_of
from dustlens.llm.graph import connected_components

SHINGLE_WORDS = 4
MOST_BITS = 4
#: So many distinct fingerprints with one value of a segment make it heavy: its buckets are cut again over the other bits.
HEAVY = 10_000
#: Rows that are linked at a time.
LINKED_ROWS = 1 << 18
#: Up to so many heavy buckets are sent to every task; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: The same for ids of rows to leave out, 8 bytes each.
BROADCAST_IDS = 500_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42). A-Z lower-cased; 0 without words."""
    from xxhash import xxh64_intdigest

    tokens = text.translate(_LOWER).split()  # splits at the six ASCII spaces only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    end = np.cumsum(size + 1) - 1
    start = end - size
    view = memoryview(joined)
    hashes = np.fromiter([xxh64_intdigest(view[a:b], 42) for a, b in zip(start[: 1 - words].tolist(), end[words - 1 :].tolist(), strict=True)], np.uint64)
    by_byte = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    set_in = (by_byte @ _BITS).ravel()
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def segments(bits: range, most: int) -> list[range]:
    """Cuts bits into so few segments that of ``most`` differing bits some segment has at most one."""
    n = most // 2 + 1
    cuts = [bits.start + len(bits) * i // n for i in range(n + 1)]
    return [range(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(bits: range) -> int:
    m = ((1 << len(bits)) - 1) << bits.start
    return m - (1 << 64) if m >> 63 else m


def _variants(fp: Column, over: list[range]) -> Column:
    """An array of (slot, part): for each segment and each bit of it, the segment's value without that bit."""
    slots = []
    for segment in over:
        for bit in segment:
            slots.append(F.struct(F.lit(bit).cast("int").alias("slot"), fp.bitwiseAND(F.lit(_mask(segment))).bitwiseAND(F.lit(~_mask(range(bit, bit + 1)))).alias("part")))
    return F.array(*slots)


def _grouped_links(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what verified links connect among fingerprints with equal keys, which lie together.

    In small groups these are the links themselves, in large ones a tree for each component in
    which nobody has more than three neighbours.
    """
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    small = np.repeat(size, size) <= 16
    a, b = [], []
    for step in range(1, 16):
        near = small[step:] & (key[step:] == key[:-step])
        if not near.any():
            break
        at = np.flatnonzero(near)
        at = at[(bits := np.bitwise_count(fp[at] ^ fp[at + step])).astype(bool) & (bits <= most)]
        a.append(fp[at])
        b.append(fp[at + step])
    for s, n in zip(first[size > 16], size[size > 16], strict=True):
        left = np.unique(fp[s : s + n])
        while len(left):
            own, left, done = [left[0]], left[1:], 0
            while done < len(own) and len(left):
                near = np.bitwise_count(left ^ own[done]) <= most
                own.extend(left[near])
                left, done = left[~near], done + 1
            tree = np.array(own, np.uint64)
            a.append(tree[(np.arange(1, len(tree)) - 1) // 2])
            b.append(tree[1:])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def _linker(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of keys; what is held is a batch and the bucket that goes on into it."""

        def linked(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _grouped_links(key, fp, most)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], names=["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows >= LINKED_ROWS and held[-1][0][-1] != held[0][0][0]:
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(key, key[-1]))
                yield linked(key[:cut], fp[:cut])
                held, rows = [(key[cut:], fp[cut:])], len(key) - cut
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, scratch: Scratch, most: int = MOST_BITS) -> DataFrame:
    """(u, v): links between the distinct fingerprints (fp) that connect all that differ in at most ``most`` bits.

    With three segments for four bits, some segment of a pair differs in one bit at most, so
    the two share that segment's value without that bit: an equality join on the bit's place and
    the rest of the segment, then a check of all 64 bits. A bucket with a value that over
    ``HEAVY`` fingerprints have is cut again in the same way over the bits outside its segment, so
    that no task gets a bucket that holds a share of all fingerprints unless these truly agree in
    most of their bits. Both ways find the same links; the second writes 43 rows for one.
    """
    over = segments(range(64), most)
    values = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("segment"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("value")) for i, s in enumerate(over)])).alias("s")).select("s.segment", "s.value")
    heavy = scratch.save(values.groupBy("segment", "value").count().where(F.col("count") > HEAVY), "heavy")
    rows = distinct.select("fp", F.explode(_variants(F.col("fp"), over)).alias("s")).select("fp", "s.slot", "s.part")
    n_heavy = heavy.count()
    if n_heavy:
        buckets = [heavy.where(F.col("segment") == i).select(F.explode(F.array(*[F.struct(F.lit(bit).cast("int").alias("slot"), F.col("value").bitwiseAND(F.lit(~_mask(range(bit, bit + 1)))).alias("part")) for bit in s])).alias("s")).select("s.slot", "s.part") for i, s in enumerate(over)]
        marked = buckets[0]
        for more in buckets[1:]:
            marked = marked.union(more)
        marked = marked.distinct().withColumn("again", F.lit(True))
        rows = rows.join(F.broadcast(marked) if n_heavy * 22 <= BROADCAST_ROWS else marked, ["slot", "part"], "left")
        again = F.lit(None).cast("array<struct<slot:int,part:bigint>>")
        for s in over:
            rest = [r for t in over if t != s for r in [t]]
            bits = [b for r in rest for b in r]
            n = most // 2 + 1
            finer = [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]
            parts = []
            for group in finer:
                mask = sum(1 << b for b in group)
                for bit in group:
                    m = mask & ~(1 << bit)
                    parts.append(F.struct(F.lit(bit).cast("int").alias("slot"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("part")))
            again = F.when(F.col("slot").between(s.start, s.stop - 1), F.array(*parts)).otherwise(again)
        light = rows.where("again IS NULL").select(F.xxhash64("slot", "part").alias("key"), "fp")
        cut = rows.where("again").select("slot", "part", "fp", F.explode(again).alias("t")).select(F.xxhash64("slot", "part", "t.slot", "t.part").alias("key"), "fp")
        rows = light.union(cut)
    else:
        rows = rows.select(F.xxhash64("slot", "part").alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linker(most), "u long, v long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of ``docs``.

    Fingerprints of ``most`` differing bits or fewer are linked; component_id is the smallest id
    reachable. A null or empty text, or one without words, has fingerprint zero and is linked
    like any other. Texts of any length are read whole. Equal fingerprints are one node, however
    many rows have them, so copies cost nothing beyond the first; repeated rows carry the same
    answer; a row whose id is null takes the group's smallest other id, if there is one. Other
    columns are not read, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    stamped = scratch.save(fingerprints(docs, id_col, text_col, words), "stamped")
    distinct = scratch.save(stamped.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = scratch.save(links(distinct.select("fp"), scratch, most), "links")
    parts = connected_components(edges, scratch)
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = named.join(least, "component").select("fp", "component_id")
    return stamped.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that have the smallest id of their group. Rows with a null id stay."""
    scratch = Scratch(docs.sparkSession, "near")
    gone = near_groups(docs, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"))
    gone = scratch.save(gone.distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[id_col].cast("long") == side["_gone"], "left_anti")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_groups`` of all ``documents``, which says what nulls, ties and repeated rows give."""
    return near_groups(table(spark, sf_dir, "documents"))
