"""A landing folder as a stream: files that arrive are detected, inspected and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dustlens.operators.detection import candidates
from dustlens.sources.inspect import inspect

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, filename, content, modificationTime) of files as they arrive."""
    files = spark.readStream.schema(FILES).format("binaryFile").load(folder)
    return files.select(F.xxhash64("path").alias("source_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content", "modificationTime")


def formats_by_hour(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts of winning types by hour of modification; state of hours behind the watermark goes."""
    seen = stream.withWatermark("modificationTime", late)
    hour = F.window("modificationTime", "1 hour")
    kind = candidates(seen.withColumn("source_id", F.struct("source_id", "modificationTime"))).where("rank = 1")
    return kind.select("type_id", F.col("source_id.modificationTime").alias("modificationTime")).groupBy(hour, "type_id").count()


def store_resources(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the resources of all files that have arrived, then ends."""
    return inspect(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
