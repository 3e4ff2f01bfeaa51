"""The queries of the ten operators over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM lowered, lengths WHERE len(w) >= n)),
met AS (SELECT doc_id, p, n, item_id FROM places JOIN windows USING (n, s)),
words_hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS k FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM met GROUP BY doc_id)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(l.w) AS contaminated
FROM lowered l LEFT JOIN words_hit h USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


@query("op1_decontaminate", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.decontaminate import contamination, judged

    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _dealt(text: str) -> str:
    """Places in a seeded random order: 31 bits of an MD5."""
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) >> 1)"


#: Blocks of 16 rows, slot by slot: of the sources with blocks left, whose next block is released, the one due first runs.
#: ``left`` and ``done`` are lists by source, in the order of their names; a source that is used up begins a new phase.
OP5_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sources AS (
  SELECT source, (n + 15) // 16 AS blocks, greatest(1, CAST(round(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM counts)) AS BIGINT)) AS w,
    row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM counts),
given AS (SELECT list(w ORDER BY i) AS w, range(1, count(*) + 1) AS every FROM sources),
slots AS (
  SELECT CAST(0 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS t, list(blocks ORDER BY i) AS left_over, list(CAST(0 AS BIGINT) ORDER BY i) AS done, CAST(NULL AS BIGINT) AS ran, CAST(NULL AS BIGINT) AS ran_phase FROM sources
  UNION ALL
  SELECT slot + 1, phase + CAST(left_over[k] = 1 AS BIGINT), CASE WHEN left_over[k] = 1 THEN 0 ELSE t + 1 END, [CASE WHEN i = k THEN left_over[i] - 1 ELSE left_over[i] END for i in every],
    [CASE WHEN left_over[k] = 1 THEN 0 WHEN i = k THEN done[i] + 1 ELSE done[i] END for i in every], k, phase
  FROM (
    SELECT *, list_sort([{{'due': ((done[i] + 1) * total + w[i] - 1) // w[i], 'i': i}} for i in every if left_over[i] > 0 AND done[i] * total // w[i] <= t])[1].i AS k
    FROM (SELECT *, CAST(list_sum([w[i] for i in every if left_over[i] > 0]) AS BIGINT) AS total FROM slots, given WHERE list_sum(left_over) > 0))),
blocks AS (SELECT s.source, slot - 1 AS slot, ran_phase AS phase, row_number() OVER (PARTITION BY ran ORDER BY slot) - 1 AS b FROM slots JOIN sources s ON s.i = ran),
keyed AS (SELECT doc_id, source, md5(coalesce(text, '')) AS m FROM documents),
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_dealt("'42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || m || '|' || coalesce(source, '')")}, doc_id NULLS FIRST, m) - 1 AS r FROM keyed)
SELECT doc_id, r.source, CAST(phase AS INTEGER) AS mix_phase, slot AS mix_slot, row_number() OVER (ORDER BY slot, r) - 1 AS mix_position
FROM ranked r JOIN blocks b ON b.source IS NOT DISTINCT FROM r.source AND b.b = r.r // 16
"""


@query("op5_mix", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.mix import mixed

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))
    return mixed(docs).drop("_text")


def _crc32(text: str) -> str:
    """CRC-32 byte by byte: of each bit of the lowest byte what the polynomial 0xEDB88320 makes of it in eight steps (fixed values)."""
    made = [1996959894, 3993919788, 124634137, 249268274, 498536548, 997073096, 1994146192, 3988292384]
    step = "c >> 8"
    for k, x in enumerate(made):
        step = f"xor({step}, CAST({x} AS UBIGINT) * ((xor(c, b) >> {k}) & 1))"
    digit = lambda at: f"(strpos('0123456789ABCDEF', p[{at}]) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST({digit(1)} * 16 + {digit(2)} AS UBIGINT))"
    return f"CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {octets}), lambda c, b: {step}), CAST(4294967295 AS UBIGINT)) AS BIGINT)"


OP8_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
keyed AS (SELECT *, {_dealt("'42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || coalesce(source, '') || '|' || text_crc32")} AS h, CAST({_dealt("'42|' || coalesce(source, '')")} AS DOUBLE) / CAST(2147483648 AS DOUBLE) AS u FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY (r + u) / n, source NULLS FIRST, doc_id NULLS FIRST, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p * 24 // total AS INTEGER) AS shard, p - (p * 24 // total * total + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed
"""


@query("op8_shard", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.shard import sharded, sized

    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op9_tokens")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cadenza.llm.tokens import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op10_lz_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.lz import next_compared

    return next_compared(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.simhash import near_groups

    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cadenza.llm.wordpiece import sentencepiece_pieces, token_counts

    vocabulary = sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents"), vocabulary, columns=["doc_id"])


@query("op3_language")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.langid import in_training, predicted, trained

    docs = table(spark, sf_dir, "documents")
    model = trained(docs.where(in_training()))
    docs = docs.select("doc_id", (~in_training()).alias("held_out"), "text")
    return predicted(docs, model, columns=["doc_id", "held_out"])


@query("op2_lm_score")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.lm import scored

    return scored(table(spark, sf_dir, "documents"))


@query("op6_html_text")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.html import extracted

    return extracted(table(spark, sf_dir, "pages"), columns=["page_id", "url"])


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
