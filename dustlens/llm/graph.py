"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustlens.llm.common import Scratch


#: Links of a node from which on it is a hub, and the most hubs there can be: with E links the limit is at least 2 * E / MOST_HUBS.
HUB_LINKS, MOST_HUBS = 256, 50_000


def _with_least(links: DataFrame, hub: int) -> DataFrame:
    """``links`` (u, v) and m, the smallest v of each u.

    Hubs' links are not brought together: there are at most ``MOST_HUBS`` hubs, whose m is sent
    to all tasks (16 bytes each), and only the other nodes' links are joined by a shuffle.
    """
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > hub).drop("n"))
    rest = links.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).drop("n"), "u")
    return links.join(hubs, "u").union(rest)


def _stars(edges: DataFrame, hub: int) -> DataFrame:
    """One large-star and one small-star step over edges (u, v)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both, hub).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    small = _with_least(down, hub).select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return small.distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most_steps: int = 100) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    ``edges`` has columns u and v of one orderable type; direction, repeats and loops do not
    matter, and edges with a null end are left out. Alternates large-star and small-star steps,
    which need a number of rounds logarithmic in the longest path. Each round is equality joins
    that no hub skews (see ``_with_least``) and partial aggregations, its edges go to a shared
    table, and only a count and a checksum come to the driver.
    """
    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    nodes = None
    now = scratch.save(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    loops = scratch.save(edges.where("u = v").select(F.col("u").alias("node")).distinct(), "loops")
    seen = None
    for step in range(1, most_steps + 1):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen, now = mark, scratch.save(_stars(now, max(HUB_LINKS, 2 * mark[0] // MOST_HUBS)), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}")
    else:
        raise RuntimeError(f"components are not settled after {most_steps} steps")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(loops.select("node", F.col("node").alias("component")))
    return every.groupBy("node").agg(F.min("component").alias("component"))
