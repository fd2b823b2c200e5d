"""What would be written where: extraction plans, selection and bulk export, before any byte is moved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustlens.functions import paths

#: Types whose trees are folders and files, as a user would unpack them.
EXTRACTABLE = (
    "archive.zip", "archive.lha", "archive.electron-asar", "amiga.adf", "commodore.d64", "filesystem.fat-disk-image", "filesystem.iso9660",
    "executable.appimage-type1", "executable.appimage-type2", "amiga.lha-sfx", "amiga.dms", "windows.inno-setup",
)


def roots(resources: DataFrame) -> DataFrame:
    """(source_id, root, problem) of each source: the one root that can be extracted, or why there is none."""
    top = resources.where((F.col("depth") == 0) & (F.size(paths.segments(F.col("path"))) == 1))
    held = top.where((F.col("kind") == "group") & F.col("type_id").isin(*EXTRACTABLE)).groupBy("source_id").agg(F.min("path").alias("root"), F.count("*").alias("n"))
    every = resources.select("source_id").distinct()
    problem = F.when(F.col("n").isNull(), "the selected format does not expose an extractable hierarchy").when(F.col("n") > 1, "more than one extractable container root is available")
    return every.join(held, "source_id", "left").select("source_id", F.when(problem.isNull(), F.col("root")).alias("root"), problem.alias("problem"))


def plan(resources: DataFrame) -> DataFrame:
    """(source_id, path, entry, relative_path, bytes, renamed, problem): what extracting each source would write, in order of ordinals.

    Members below the source's root, of its own tree and not of trees nested in its members,
    become directories and files under portable names. renamed tells the names that had to
    change; two members that would come to one path, whatever its case, are a problem of both,
    and a source without just one root that can be extracted has one row with its problem.
    """
    own = roots(resources)
    wrong = own.where("problem IS NOT NULL").select("source_id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("relative_path"), F.lit(0).cast("long").alias("bytes"), F.lit(False).alias("renamed"), "problem")
    members = resources.where("depth = 0").join(own.where("problem IS NULL").select("source_id", "root"), "source_id").where(F.col("path").startswith(F.concat("root", F.lit("/"))))
    below = F.substr("path", F.length("root") + 2)
    entry = F.when(F.col("kind") == "group", "directory").otherwise("file")
    named = members.select("source_id", "path", "ordinal", entry.alias("entry"), below.alias("below"), paths.export_name(below).alias("relative_path"), F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("bytes"))
    same = Window.partitionBy("source_id", F.lower("relative_path"))
    problem = F.when(F.count("*").over(same) > 1, F.concat(F.lit("extraction path collision: "), "relative_path"))
    listed = named.select("source_id", "path", "entry", "relative_path", "bytes", (F.col("relative_path") != F.col("below")).alias("renamed"), problem.alias("problem"))
    return listed.union(wrong)


def totals(planned: DataFrame) -> DataFrame:
    """(source_id, directories, files, bytes, renamed, problems) of each source's plan."""
    return planned.groupBy("source_id").agg(
        F.count_if(F.col("entry") == "directory").alias("directories"), F.count_if(F.col("entry") == "file").alias("files"), F.sum(F.when(F.col("entry") == "file", F.col("bytes")).otherwise(0)).alias("bytes"),
        F.count_if("renamed").alias("renamed"), F.count_if(F.col("problem").isNotNull()).alias("problems"),
    )


def preflight(planned: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """``planned`` and conflict: why a path cannot be written beside what there is.

    ``existing`` has relative_path and kind: file, directory or link. A file is in the way of a
    directory, a directory in that of a file, a file in that of a file unless ``force`` is given;
    a link at the path or at any folder above it always is. The join is by path, over all folders
    above each planned one.
    """
    parts = F.split("relative_path", "/")
    above = planned.where("relative_path IS NOT NULL").select("source_id", "path", "relative_path", "entry", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("at"))
    there = existing.select(F.col("relative_path").alias("at"), F.col("kind").alias("there"))
    whole = F.col("at") == F.col("relative_path")
    why = (
        F.when(F.col("there") == "link", F.concat(F.lit("output path is a symbolic link: "), "at"))
        .when(whole & (F.col("entry") == "file") & (F.col("there") == "directory"), F.concat(F.lit("output path is a directory: "), "at"))
        .when(whole & (F.col("entry") == "file") & (F.col("there") == "file"), F.concat(F.lit("output already exists: "), "at") if not force else F.lit(None).cast("string"))
        .when(F.col("there") == "file", F.concat(F.lit("output directory conflicts with a file: "), "at"))
    )
    found = above.join(there, "at").select("source_id", "path", "at", why.alias("why")).where("why IS NOT NULL").groupBy("source_id", "path").agg(F.min_by("why", F.length("at")).alias("conflict"))
    return planned.join(found, ["source_id", "path"], "left")


#: Kinds of resources that have an export; opaque ones have if their bytes are there.
EXPORTED = ("raster", "text", "document", "audio", "font", "palette", "tracker", "vector")


def exportable(resources: DataFrame) -> DataFrame:
    """The resources that have an export."""
    return resources.where(F.col("kind").isin(*EXPORTED) | ((F.col("kind") == "opaque") & F.col("data").isNotNull()))


#: Kinds by how much a user wants one of them when none is named, the most wanted last.
PRIORITY = ("opaque", "text", "palette", "document", "tracker", "font", "audio", "vector", "raster")


def selected(resources: DataFrame, path: str | None = None) -> DataFrame:
    """The one resource of each source that an export without patterns means, and problem, why there is none.

    With ``path`` that resource; a path that is not there, or has no export, is a problem. Without
    it the one exportable resource or, of several, the one of the best priority if it is alone.
    """
    wanted = resources if path is None else resources.where(F.col("path") == path)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind")), F.lit(0))
    best = Window.partitionBy("source_id")
    ranked = exportable(wanted).withColumn("_rank", rank).withColumn("_best", F.max("_rank").over(best)).where("_rank = _best").withColumn("_n", F.count("*").over(best))
    one = ranked.where("_n = 1").drop("_rank", "_best", "_n").withColumn("problem", F.lit(None).cast("string"))
    many = ranked.where("_n > 1").select("source_id").distinct().withColumn("problem", F.lit("more than one exportable resource is available; select one"))
    there = wanted.select("source_id").distinct().withColumn("there", F.lit(True))
    none = resources.select("source_id").distinct().join(ranked.select("source_id").distinct(), "source_id", "left_anti").join(there, "source_id", "left")
    told = F.lit("container exposes no exportable resources") if path is None else F.when(F.col("there"), f"resource is not exportable: {path}").otherwise(f"resource was not found: {path}")
    failed = many.union(none.select("source_id", told.alias("problem")))
    return one.unionByName(failed, allowMissingColumns=True)


def matched(resources: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """The exportable leaves that a bulk export takes: all, or those that fit one of the patterns, each once."""
    own = exportable(resources)
    return own if not patterns else own.where(paths.matches_any(F.col("path"), patterns))
