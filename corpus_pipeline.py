"""A corpus pipeline of five stages: toxic documents go, then exact copies, then near copies; personal data is masked; what stays is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dustlens.llm import exact_dedup, packing, pii, simhash, toxicity
from dustlens.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity models do not reject, with all their columns. A null text is judged as the empty one; repeated rows all stay or all go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id, with all its columns. Null and empty texts are one text; of rows that repeat an id and a text one stays; a null id loses to any other."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id, with all its columns. Texts without words are one group; rows with a null id stay."""
    return simhash.without_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents and columns, with personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its text, and the sequence that it goes to: a bin's texts, in order of offsets, are its sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Scores, similarity groups and packing are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read by the next.

    What is returned is the packed corpus: (shard, bin, capacity, used, offset, doc_id, piece,
    start, length, text), its table in the shared folder under a name that begins with
    ``pipeline``. Nulls, ties, repeated rows and empty tables are as the stages' operators say;
    tables of theirs and of earlier stages are removed.
    """
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    opened = len(Scratch.opened)
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        Scratch.sweep(opened)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
