"""A corpus from documents to token files, in five stages; each takes (spark, docs, sf_dir) and works on all that the
stage before it kept.

1. language: documents without a language (no letter) go.
2. near_duplicates: of each group of near copies one document stays.
3. decontamination: documents that hold too much of a benchmark go.
4. mixing: rows come in the order of the mixture; the files that hold them, read by their numbers, are the schedule.
5. tokens: token ids are written in that order, and read back, a row for each document.

Nulls, empty and long texts, ties and repeated rows are what the operators' docstrings say; an empty table gives no rows; a
further column of docs keeps its values, whatever its name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import kept, ship
from cadenza.llm.decontaminate import contamination, judged
from cadenza.llm.langid import UND, in_training, predicted, trained
from cadenza.llm.mix import mixed
from cadenza.llm.simhash import deduplicated
from cadenza.llm.tokens import read_tokens, write_tokens

TOKENIZER = "word_bpe_49k.json"


def apart(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns that are named like a stage's own set aside under other names, and all its columns as they were."""
    own = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c in taken}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows, columns = apart(docs, "lang_pred", "score")
    return predicted(rows, trained(docs.where(in_training()))).where(F.col("lang_pred") != UND).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, columns = apart(docs, "_t", "n_words", "hit_spans", "item_ids", "n_hit", "n_items", "items_sha256", "contaminated")
    return judged(contamination(rows, benchmark)).where("not contaminated").select(*columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, columns = apart(docs, "mix_phase", "mix_slot", "mix_position")
    rows = mixed(rows)
    return rows.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    try:  # the order of the files, by their numbers, and of the rows in them
        number = F.expr(r"try_cast(regexp_extract(_metadata.file_name, '^part-([0-9]+)', 1) AS BIGINT)")
        rows = docs.select("doc_id", "text", number.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        order = ["_part", "_file", "_at"]
    except AnalysisException:  # docs are no files: the schedule hangs on the rows alone and is made again
        rows, order = mixed(docs).select("doc_id", "text", "mix_position"), ["mix_position"]
    return read_tokens(write_tokens(rows, public_tokenizers.path(TOKENIZER), order=order))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: Support vector machines and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
