"""Lookups between sources and resources, as joins and windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def unambiguous(rows: DataFrame, collection: str, path: str, value: str) -> DataFrame:
    """(collection, key, value): companions by lower-case path; a key that comes more than once is left out."""
    return rows.groupBy(F.col(collection).alias("collection"), F.lower(path).alias("key")).agg(F.count("*").alias("n"), F.first(value).alias("value")).where("n = 1").drop("n")


def last_match(rows: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """Of rows with one name, whatever its case, the last wins."""
    return rows.groupBy(F.upper(name).alias("name")).agg(F.max_by(value, order).alias("value"))


def first_valid(rows: DataFrame, group: str, order: str, value: str, valid: Column) -> DataFrame:
    """Of each group the first row that is valid."""
    return rows.where(valid).groupBy(group).agg(F.min_by(value, order).alias("value"))


def extents(rows: DataFrame, section: str, offset: str, end: Column) -> DataFrame:
    """``rows`` and extent: up to the next strictly larger offset of the section, or to its end. Equal offsets share an extent."""
    window = Window.partitionBy(section).orderBy(offset).rangeBetween(1, Window.unboundedFollowing)
    return rows.withColumn("extent", F.coalesce(F.min(offset).over(window), end) - F.col(offset))


def namespaces(rows: DataFrame, group: str, order: list[str], starts: Column, ends: Column, name: Column) -> DataFrame:
    """``rows`` and namespace: that of the last start marker, unless an end marker came since."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(starts, name).when(ends, F.lit("")), ignorenulls=True).over(window)
    return rows.withColumn("namespace", F.when(last != "", last))


def within_budget(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """``rows`` and probed: whether the sum of sizes up to and with a row stays in the budget."""
    window = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("probed", F.sum(size).over(window) <= most)


def ordinal_paths(rows: DataFrame, group: str, order: str, path: Column) -> DataFrame:
    """``rows`` and path: items of a group are numbered from 1, a single one is not."""
    window = Window.partitionBy(group)
    number = F.row_number().over(window.orderBy(order))
    return rows.withColumn("path", F.when(F.count("*").over(window) == 1, path).otherwise(F.concat(path, F.lit("/"), number)))


def member_totals(resources: DataFrame, packed: str = "compressed-length", unpacked: str = "data.length") -> DataFrame:
    """(source_id, members, packed, unpacked): the number of members with sizes in their metadata, and their sums."""
    size = lambda key: F.get(F.filter("metadata", lambda m: m["key"].endswith(key)), 0)["value"].cast("long")
    rows = resources.select("source_id", size(packed).alias("p"), size(unpacked).alias("u")).where("u IS NOT NULL")
    return rows.groupBy("source_id").agg(F.count("*").alias("members"), F.sum("p").alias("packed"), F.sum("u").alias("unpacked"))


def last_ends(rows: DataFrame, group: str, offset: str, size: str) -> DataFrame:
    """(group, end): the greatest end of each group's stretches."""
    return rows.groupBy(group).agg(F.max(F.col(offset) + F.col(size)).alias("end"))


def best_generation(rows: DataFrame, group: str, generation: str, tie: str, value: str) -> DataFrame:
    """(group, generation, value) of the highest generation; of equals the smallest ``tie``."""
    best = F.max_by(F.struct(generation, value), F.struct(F.col(generation), -F.col(tie)))
    return rows.groupBy(group).agg(best.alias("b")).select(group, f"b.{generation}", F.col(f"b.{value}").alias("value"))


def first_by_path(rows: DataFrame, group: str, path: str, order: str) -> DataFrame:
    """Of resources with one path the first."""
    rank = F.row_number().over(Window.partitionBy(group, path).orderBy(order))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def copy_names(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` and copy_name: of equal names later ones get -copy-1, -copy-2 and so on."""
    number = F.row_number().over(Window.partitionBy(group, name).orderBy(order)) - 1
    return rows.withColumn("copy_name", F.when(number == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-copy-"), number)))


def suffixed(name: str, number: int) -> str:
    """A later name: -2, -3 and so on before the ending of the last segment."""
    folder, slash, last = name.rpartition("/")
    stem, dot, ending = last.rpartition(".") if "." in last.lstrip(".") else (last, "", "")
    return f"{folder}{slash}{stem}-{number}{dot}{ending}"


def subtree_totals(rows: DataFrame, group: str, path: str, size: Column) -> DataFrame:
    """(group, root, bytes, resources) of each resource's tree, itself included: every resource counts for all folders above it, in one aggregation."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = rows.select(group, F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), F.explode(above).alias("root"))
    return up.groupBy(group, "root").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("resources"))


def free_names(names: list[str]) -> list[str]:
    """Each name, or its first suffixed form that no name before it has taken, whatever the case."""
    used: set[str] = set()
    last: dict[str, int] = {}  # the last number tried, so that many equal names do not start over
    out = []
    for name in names:
        number = last.get(name.lower(), 1)
        own = name if number == 1 else suffixed(name, number)
        while own.lower() in used:
            number += 1
            own = suffixed(name, number)
        last[name.lower()] = number
        used.add(own.lower())
        out.append(own)
    return out


def deduped_names(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """``rows`` and unique_name: within a group, in order, a name that is taken (but for case) gets -2, -3 and so on until it is free.

    A group is one source's resources, whose number the scan bounds; only the names decide, so
    only groups with equal names go through Arrow.
    """
    keyed = rows.withColumn("unique_name", F.col(name))
    clash = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(F.lower(name)).alias("d")).where("n > d").select(group)
    free = keyed.join(clash, group, "left_anti")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([(order, "ascending")])
        return part.append_column("unique_name", pa.array(free_names(part.column(name).to_pylist()), pa.string()))

    schema = StructType([*rows.schema.fields, StructField("unique_name", StringType())])
    return free.unionByName(rows.join(clash, group, "left_semi").groupBy(group).applyInArrow(run, schema))


def within_limit(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """``rows``; a group whose sizes sum to more than ``most`` is an error, as limits never cut results short."""
    window = Window.partitionBy(group)
    over = F.sum(size).over(window) > most
    told = F.concat(F.lit(f"more than {most} in "), F.col(group).cast("string"))
    return rows.withColumn("_over", F.when(over, F.raise_error(told).cast("string"))).where("_over IS NULL").drop("_over")


def implicit_export(rows: DataFrame, group: str, priority: str) -> DataFrame:
    """(group, best, ambiguous): the highest priority, and whether several resources share it."""
    top = Window.partitionBy(group).orderBy(F.desc(priority))
    best = rows.withColumn("_rank", F.rank().over(top)).where("_rank = 1")
    return best.groupBy(group).agg(F.max(priority).alias("best"), (F.count("*") > 1).alias("ambiguous"))
