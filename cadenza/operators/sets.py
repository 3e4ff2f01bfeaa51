"""Set comparisons of two relations, with and without multiplicity; all by grouped counts that meet on the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of exactly one side, each once, with the side."""
    return a.subtract(b).withColumn("side", F.lit("left")).union(b.subtract(a).withColumn("side", F.lit("right")))


def row_counts(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """For each different row how often it stands in a and in b: one shuffle of pre-aggregated rows."""
    one = lambda df, x, y: df.select(*columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).select(*columns, (F.col("n") * x).alias("in_a"), (F.col("n") * y).alias("in_b"))
    return one(a, 1, 0).union(one(b, 0, 1)).groupBy(*columns).agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))


def overlap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Occurrences shared (sum of the lesser counts), different rows shared, occurrences of b that a does not cover."""
    n = row_counts(a, b, columns)
    zero = F.lit(0).cast("bigint")
    return n.agg(
        F.coalesce(F.sum(F.least("in_a", "in_b")), zero).alias("shared_occurrences"),
        F.count_if((F.col("in_a") > 0) & (F.col("in_b") > 0)).alias("shared_distinct_rows"),
        F.coalesce(F.sum(F.greatest(F.col("in_b") - F.col("in_a"), F.lit(0))), zero).alias("unrepresented_occurrences"),
    )


def presence(a: DataFrame, b: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Keys in both, only in a, only in b."""
    keys = a.select(*columns).distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).union(b.select(*columns).distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1)))
    keys = keys.groupBy(*columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    c = lambda x, y: F.count_if((F.col("_a") == x) & (F.col("_b") == y))
    return keys.groupBy(*(by or [])).agg(c(1, 1).alias("shared"), c(1, 0).alias("only_first"), c(0, 1).alias("only_second"))


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    n = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("occurrences_beyond_first"), F.count(F.lit(1)).alias("distinct_rows"))
