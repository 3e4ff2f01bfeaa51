"""Operator 8, sharding by proportional stratified interleaving.

Rows are put into a seeded random order inside each source; row r of a source's n gets the fraction (r + u) / n, where u is
a seeded number of the source, from 0 to below 1, so that many sources of few rows do not all meet at one fraction.
Sorted by that fraction all sources run in step, so a cut of the sorted rows into equal runs gives every shard the
mixture of the whole, to within one row of each source.  Law ``rows``: the shards' counts are at most one apart.

Scale: two rankings (inside the source, then overall), each a bucketed window, see ``ranked``: a source with a third of
the rows is cut into as many buckets as the rest, and no window or sort takes a whole source or the whole table.  The
random order looks at all columns of a row, so repeated or null ids make no large bucket either.  What the first ranking
gives is written once and read by both sides of the second; give rows without their texts (``sized`` keeps what is needed).

Defined cases: a null source is a source; a null or empty text has size 8 and crc32 0; rows equal in every column may
change places among themselves, which changes no result; an empty table gives no rows; fewer rows than shards leave some
shards empty; columns named like the outputs are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import SHUFFLE_RANGE, kept, ranked, shuffle_key, told_apart

SHARDS, SEED = 24, 42


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, key: str = "doc_id", stratum: str = "source") -> DataFrame:
    """docs with shard int (0 to shards - 1) and slot long (the row's place in its shard)."""
    rows = docs.count()
    docs = docs.drop("shard", "slot")
    others = told_apart(docs, key)
    own = [F.col("row")[c] for c in (key, *others)]
    docs = docs.select(F.struct(*docs.columns).alias("row"), shuffle_key(seed, key, *others).alias("_h"), F.col(stratum).alias("_s"))
    df = ranked(docs, ["_s"], ["_h", *own], F.col("_h") / F.lit(SHUFFLE_RANGE), "_r", rows, "_n")
    phase = shuffle_key(seed, "_s") / F.lit(SHUFFLE_RANGE)
    df = kept(df.select("row", "_s", ((F.col("_r") + phase) / F.col("_n")).alias("_f")), "fractions")  # ranked once, read twice
    df = ranked(df, [], ["_f", "_s", *own], F.col("_f"), "_p", rows)
    n = max(rows, 1)
    df = df.withColumn("shard", F.expr(f"_p * {shards}L div {n}L").cast("int"))
    return df.select("row.*", "shard", (F.col("_p") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and 8) and text_crc32."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumns({"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text)})
