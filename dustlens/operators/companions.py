"""Resources whose other half lies in a file beside theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustlens.operators.lookups import unambiguous

# ``files`` has collection, rel_path and content. A path is looked up whatever its case, and one that several files have counts as none.


def _field(key: str) -> Column:
    return F.get(F.filter("metadata", lambda m: m["key"] == key), 0)["value"]


def _beside(rows: DataFrame, files: DataFrame, wanted: str) -> DataFrame:
    """``rows`` (with collection and a column of the wanted path) and content of the file there; null if there is not just one."""
    there = unambiguous(files, "collection", "rel_path", "content").withColumnRenamed("value", "content")
    return rows.withColumn("key", F.lower(F.regexp_replace(F.col(wanted), r"\\", "/"))).join(there, ["collection", "key"], "left").drop("key")


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?", 0)


def inspect_files(files: DataFrame) -> DataFrame:
    """The resources of all files, with their collection and path."""
    from dustlens.sources.inspect import inspect

    named = files.select(F.xxhash64("collection", "rel_path").alias("source_id"), F.regexp_extract("rel_path", "([^/]+)$", 1).alias("filename"), "content", "collection", "rel_path")
    return inspect(named).join(named.select("source_id", "collection", "rel_path"), "source_id")


def font_files(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, rel_path, height, filename, content, missing) of each entry of a disk font's index: the file that holds that size."""
    entries = resources.where("type_id = 'amiga.bitmap-diskfont-index'").select("collection", "rel_path", _field("index.filename").alias("filename"), _field("height").cast("int").alias("height"))
    named = entries.where("filename IS NOT NULL").withColumn("wanted", F.concat(_folder(F.col("rel_path")), "filename"))
    return _beside(named, files, "wanted").select("collection", "rel_path", "height", "filename", "content", F.col("content").isNull().alias("missing"))


def font_pages(resources: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, rel_path, page, filename, content, missing) of each page of a font's descriptor."""
    pages = resources.where("type_id = 'bitmap-font.bmfont'").select("collection", "rel_path", F.explode(F.filter("metadata", lambda m: m["key"].rlike("^page[.][0-9]+$"))).alias("m"))
    named = pages.select("collection", "rel_path", F.regexp_extract("m.key", "([0-9]+)$", 1).cast("int").alias("page"), F.col("m.value").alias("filename")).withColumn("wanted", F.concat(_folder(F.col("rel_path")), "filename"))
    return _beside(named, files, "wanted").select("collection", "rel_path", "page", "filename", "content", F.col("content").isNull().alias("missing"))


def picture_palettes(pictures: DataFrame, files: DataFrame, endings: tuple[str, ...] = ("nxp", "npl", "pal")) -> DataFrame:
    """(collection, rel_path, palette, content) of each picture without colours of its own: the first palette file with its name, by order of ``endings``."""
    stem = F.regexp_replace("rel_path", r"\.[^./]*$", "")
    tried = pictures.select("collection", "rel_path", F.posexplode(F.array(*[F.concat(stem, F.lit("." + e)) for e in endings])).alias("rank", "palette"))
    found = _beside(tried, files, "palette").where("content IS NOT NULL")
    return found.groupBy("collection", "rel_path").agg(F.min_by("palette", "rank").alias("palette"), F.min_by("content", "rank").alias("content"))
