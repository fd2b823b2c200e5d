"""Helpers that the operators share: table access, shared scratch tables and Arrow access to texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by the six ASCII white-space characters only.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none, as in tests, gets one made."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dustlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive any executor.

    ``drop`` removes those that no later step reads. Tables that a lazy result reads stay until
    ``sweep`` removes them, once the result is written.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        Scratch.opened.append(self)

    @staticmethod
    def sweep(since: int) -> None:
        """Removes the folders of all that were opened after the first ``since``."""
        while len(Scratch.opened) > since:
            Scratch.opened.pop().drop("")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # the shuffle files of a table that is written are of no further use
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(clean, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names, whatever else the table holds."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The most keys that are sent to every task because they are hot (8 bytes each).
MOST_HOT_KEYS = 50_000


def hot_limit(rows: int, least: int) -> int:
    """The number of rows from which on a key is hot: so many that at most ``MOST_HOT_KEYS`` keys of a table can be."""
    return max(least, rows // MOST_HOT_KEYS + 1)


def join_by_hot_keys(rows: DataFrame, side: DataFrame, key: str, hot: str) -> DataFrame:
    """``rows`` and the columns of ``side``, which has each key once and says by the column ``hot`` which are hot.

    Rows with hot keys are not brought together: these keys, whose number ``hot_limit`` bounds,
    are sent to all tasks, and only the other rows are joined by a shuffle.
    """
    few = F.broadcast(side.where(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(side.where(f"NOT {hot}"), key))


def as_bytes(column: pa.Array) -> list[bytes]:
    """A string column's UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 22) -> Iterator[pa.Table]:
    """Batches joined to tables of at least ``most_rows`` rows, save for the last."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most_rows:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def numbers(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(dtype) if isinstance(column, pa.Array) else column.to_numpy().astype(dtype)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
