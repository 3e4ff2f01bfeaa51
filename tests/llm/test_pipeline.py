from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm.common import kept
from cadenza.llm.mix import mixed
from cadenza.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_stage_keeps_what_it_should(spark, tmp_path):
    r = random.Random(2)
    line = lambda n: " ".join("".join(r.choice(("the", "ing", "of", "an", "wh", "er")) for _ in range(r.randint(1, 4))) for _ in range(n))
    item = line(30)
    texts = {k: line(80) for k in range(30)}
    texts |= {100: texts[3], 101: texts[4] + " more", 200: item, 201: None, 202: "12 34", 203: "", 204: item + " " + line(900)}
    rows = [(k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in texts.items()]
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, str(tmp_path)), name)
        if name != "tokens":
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        sizes.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    assert sizes[0] == set(texts) - {201, 202, 203}
    assert {3, 100} & sizes[1] == {3} and sizes[1] >= set(range(30)) and 204 in sizes[1]
    assert sizes[1] - sizes[2] == {200} and sizes[2] == sizes[3] == sizes[4]
    starts = sorted((x["start"], x["n_tokens"]) for x in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0


def test_stages_keep_columns_of_any_name_and_rows_of_one_id(spark, tmp_path):
    """Repeated and null ids in several groups, rows that are equal throughout, and columns named like the operators' own."""
    r = random.Random(3)
    line = lambda n: " ".join("".join(r.choice(("the", "ing", "of", "an", "wh", "er")) for _ in range(r.randint(1, 4))) for _ in range(n))
    spark.createDataFrame([(1, line(30))], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c = line(80), line(80), line(80)
    rows = [(3, a), (5, a), (5, b), (None, b), (None, c), (None, c), (7, a)]
    odd = "score lang_pred n_words contaminated mix_position mix_slot fp root row _h _s _t _row hit_spans".split()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{x}-own" for x in odd]) for i, t in rows], f"{SCHEMA}, {', '.join(f'{x} string' for x in odd)}")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        found = docs.collect()
        assert all(x[y] == f"{y}-own" for x in found for y in odd)
        assert sorted((x["doc_id"] or 0, x["text"]) for x in found) == sorted((i or 0, t) for i, t in (rows if name == "language" else [(3, a), (5, b), (None, c)]))


def test_the_schedule_reaches_the_token_files(spark, tmp_path):
    """As files whose numbers have more digits, and where docs are no files."""
    r = random.Random(4)
    docs = spark.createDataFrame([(k, f"w{r.randint(0, 99)} " * r.randint(1, 9), "en", f"s{k % 3}", 0) for k in range(60)], SCHEMA)
    place = {x["doc_id"]: x["mix_position"] for x in mixed(docs).collect()}
    parts = kept(corpus_pipeline.mixing(spark, docs, ""), "mixing")
    numbered = {x["n"]: x["doc_id"] for x in parts.select("doc_id", (F.col("_metadata.file_name")).alias("n")).collect()}
    assert len(numbered) >= 1
    ordered = sorted(place, key=place.get)
    folder = tmp_path / "mixed"
    for k, at in enumerate(range(0, 60, 20)):  # part-99999, part-100000, part-100001
        one = parts.where(F.col("doc_id").isin(ordered[at : at + 20])).coalesce(1)
        one.write.parquet(str(tmp_path / f"one-{k}"))
        folder.mkdir(exist_ok=True)
        next((tmp_path / f"one-{k}").glob("part-*.parquet")).rename(folder / f"part-{99_999 + k}-x-c000.snappy.parquet")
    for given in (spark.read.parquet(str(folder)), docs, docs.repartition(3)):
        got = corpus_pipeline.tokens(spark, given, "").collect()
        assert [x["doc_id"] for x in sorted(got, key=lambda x: x["start"])] == ordered


@pytest.mark.parametrize("stage", [x for x in corpus_pipeline.STAGES], ids=lambda x: x[0])
def test_stages_take_an_empty_table(spark, stage):
    assert stage[1](spark, spark.createDataFrame([], SCHEMA), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(found.fetchall())
