"""Connected components of a graph of links, by alternating large-star and small-star steps (Kiveris and others, 2014).

Each step is a grouped minimum and a join, each result is written to the shared folder, and only two sums a round reach
the driver.  The rounds end when the links no longer change: then every node links to the smallest node of its
component.  A node with very many links is one row of the grouped minimum, and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import kept


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: u, v long, u <> v, at most modestly repeated.  Returns node, root: a row for each node but the roots,
    root being the smallest node (as a signed number) of its component."""
    links, before = kept(links.select("u", "v").distinct(), "links"), None
    state = _state(links)
    while state != before and state[0]:
        before = state
        links = kept(_small(_large(links)), "links")
        state = _state(links)
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
