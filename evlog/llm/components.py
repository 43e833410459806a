"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlog.session import materialize


ROWS = 250_000  # of a table for each task that reads it


def tight(rows: DataFrame) -> DataFrame:
    """A materialised table in as many partitions as its number of rows needs, so that small ones don't make many tiny files."""
    return rows.coalesce(max(1, -(-rows.count() // ROWS)))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` that isn't the smallest of its component; root is the smallest.

    Alternates two rewrites until nothing changes: each node's larger neighbours
    move to its smallest neighbour, then its smaller neighbours and it do. Both
    are a minimum per node (combined before the shuffle) and a join back, which
    adaptive execution splits for a node with very many links. The table is
    checkpointed each round; only a count and a checksum reach the driver.
    """
    edges = materialize(tight(links).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        tasks = max(1, -(-mark[0] // ROWS))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        edges = materialize(small)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
