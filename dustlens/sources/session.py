"""Inspection step by step: the tree without payloads first, then what is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustlens.sources.inspect import _walk, inspect

#: Columns of a resource that are known without its payload.
DESCRIPTION = ("source_id", "ordinal", "path", "depth", "type_id", "kind", "failure", "metadata")


def open_session(sources: DataFrame, most_depth: int = 8, most_resources: int = 200_000) -> DataFrame:
    """Descriptions of all resources, with estimated bytes of their payloads; payloads themselves do not leave the tasks."""
    return inspect(sources, None, most_depth, most_resources, (*DESCRIPTION, "estimated_bytes"))


def expand(session: DataFrame, path: str | None = None) -> DataFrame:
    """The direct children of a resource, or the roots of each source, in order."""
    own = session.where(F.col("path").startswith(path + "/")) if path else session
    depth = len(path.strip("/").split("/")) + 1 if path else 1
    return own.where(F.size(F.split(F.ltrim("path", F.lit("/")), "/")) == depth)


def capabilities(session: DataFrame) -> DataFrame:
    """``session`` and can: what may be asked of each resource: children, payload, export, decode."""
    held = F.col("estimated_bytes") > 0
    shown = F.col("kind").isin("raster", "text", "document", "audio", "font", "palette", "tracker") | ((F.col("kind") == "opaque") & held)
    can = F.array_compact(F.array(F.when(F.col("kind") == "group", "enumerate-children"), F.when(held, "materialize-payload"), F.when(shown, "export"), F.when(F.col("kind") == "opaque", "decode")))
    return session.withColumn("can", can)


def load(sources: DataFrame, path: str) -> DataFrame:
    """One resource of each source, with its payload; parsing stops where it is found, and nothing else leaves the task."""
    return inspect(sources).where(F.col("path") == path)


def stream_payload(resources: DataFrame, size: int = 1 << 20) -> DataFrame:
    """(source_id, path, chunk, offset, data): payloads in chunks of at most ``size`` bytes, in order; an empty payload has none."""
    count = F.ceil(F.octet_length("data") / size).cast("int")
    each = resources.where("octet_length(data) > 0").select("source_id", "path", "data", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return each.select("source_id", "path", "chunk", (F.col("chunk").cast("long") * size).alias("offset"), F.substr("data", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def decode(resources: DataFrame, type_id: str | None = None) -> DataFrame:
    """(source_id, path, found_path, found_type, kind, failure): what opaque payloads hold, by their bytes and name or by a type that the caller names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        schema = pa.schema([("source_id", pa.int64()), *[(n, text) for n in ("path", "found_path", "found_type", "kind", "failure")]])
        for batch in batches:
            for i in range(batch.num_rows):
                source, path, data = (batch.column(c)[i].as_py() for c in range(3))
                rows = [{"source_id": source, "path": path, "found_path": p, "found_type": n.type_id, "kind": n.kind, "failure": why} for p, _, n, why in _walk(data, path, "", 0, 2, type_id)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return resources.where("kind = 'opaque' AND data IS NOT NULL").select("source_id", "path", "data").mapInArrow(run, "source_id long, path string, found_path string, found_type string, kind string, failure string")


def projection(resources: DataFrame) -> DataFrame:
    """(source_id, ordinal, json): each resource as an object of path, type, kind and metadata; of a key that repeats the last value counts."""
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("metadata", lambda m: m["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("metadata", lambda m: m["key"] == k), -1)["value"].alias("value"))))
    return resources.select("source_id", "ordinal", F.to_json(F.struct("path", F.col("type_id").alias("type"), "kind", last.alias("metadata"))).alias("json"))
