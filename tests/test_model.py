from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cadenza.functions import derive as d
from cadenza.operators import checks, profiling, sets
from cadenza.plans import model, views
from cadenza.sources import files, publish
from cadenza.sources.store import Store

DAY = datetime.date


def test_derived_transaction_columns(spark):
    rows = [
        (30, 149, 99, DAY(2017, 1, 1), DAY(2017, 1, 31)), (30, 99, 149, DAY(2017, 2, 10), DAY(2017, 2, 1)), (0, 0, 0, DAY(2017, 1, 1), DAY(2019, 1, 2)),
        (0, 1, 1, DAY(2017, 1, 1), DAY(2017, 1, 1)), (730, 1, 1, DAY(2017, 1, 1), DAY(2019, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "payment_plan_days int, plan_list_price int, actual_amount_paid int, transaction_date date, membership_expire_date date")
    got = [tuple(r)[5:] for r in d.transaction_columns(df).collect()]
    assert got == [
        (50, "paid_below_list", 30, False, False, False, "equal"), (-50, "paid_above_list", -9, True, False, False, "expiry_shorter"), (0, "equal", 731, False, False, True, "expiry_longer"),
        (0, "equal", 0, False, True, False, "equal"), (0, "equal", 730, False, False, False, "equal"),
    ]


def test_ages(spark):
    df = spark.sql("SELECT * FROM VALUES (true, 0), (true, -5), (true, 101), (true, 1), (true, 100), (false, CAST(NULL AS INT)) AS t(known, bd)")
    got = df.select(d.analytical_age(F.col("bd")), d.age_quality(F.col("known"), F.col("bd"))).collect()
    assert [tuple(r) for r in got] == [(None, "zero_or_unknown"), (None, "negative"), (None, "above_100"), (1, "valid"), (100, "valid"), (None, "no_member_metadata")]


def test_numbers_and_texts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(d.percent(F.lit(63471), F.lit(992931))) == 6.3923 and one(d.percent(F.lit(1), F.lit(0))) is None
    assert one(d.rate(F.lit(1), F.lit(8))) == Decimal("0.125") and one(d.display_percent(F.lit(99999), F.lit(100000))) == "<100.00" and one(d.display_percent(F.lit(1), F.lit(0))) == "N/A"
    assert one(d.plain_decimal(F.lit(Decimal("1.500")))) == "1.5" and one(d.plain_decimal(F.lit(Decimal("200")))) == "200"
    assert one(d.digest("n", F.lit("ab"), F.lit("c"))) != one(d.digest("n", F.lit("a"), F.lit("bc")))
    assert [one(d.is_integer_text(F.lit(x))) for x in ("7", "-7", "+7", " 7 ", "1e3", "7\n", "")] == [True, True, True, False, False, False, False]
    assert [one(d.is_date_text(F.lit(x))) for x in ("20160229", "20170230", "00000101", "2017-1-1")] == [True, False, False, False]


@pytest.fixture(scope="module")
def layer(spark):
    members = spark.sql("SELECT 'a' AS msno, 1 AS city_code, 30 AS bd_raw, 'male' AS gender, 7 AS registered_via_code, DATE '2010-01-01' AS registration_init_date, 1L AS source_file_key, 1L AS source_row_number")
    labels = spark.sql("SELECT * FROM VALUES ('a', DATE '2017-02-01', true, 2L, 1L), ('a', DATE '2017-03-01', false, 3L, 1L), ('only_label', DATE '2017-02-01', false, 2L, 2L) AS t(msno, expiry_cohort_month, is_churn, source_file_key, source_row_number)")
    tx = spark.sql("SELECT * FROM VALUES ('a', DATE '2016-12-01'), ('a', DATE '2017-02-28'), ('a', DATE '2017-03-01'), ('a', DATE '2016-11-30'), ('only_tx', DATE '2017-01-05') AS t(msno, transaction_date)")
    tx = tx.selectExpr("*", "4L AS source_file_key", "1L AS source_row_number", "1 AS payment_method_id", "30 AS payment_plan_days", "10 AS plan_list_price", "10 AS actual_amount_paid", "true AS is_auto_renew", "date_add(transaction_date, 30) AS membership_expire_date", "false AS is_cancel")
    registered = spark.sql("SELECT * FROM VALUES (1L, 'm'), (2L, 'f'), (3L, 'r'), (4L, 't') AS t(source_file_key, source_file)")
    users = model.dim_user(members, labels, d.transaction_columns(tx))
    return {"members": members, "labels": labels, "tx": d.transaction_columns(tx), "files": registered, "users": users}


def test_universe_keeps_users_of_any_source(layer):
    got = {r["msno"]: r for r in layer["users"].collect()}
    assert set(got) == {"a", "only_label", "only_tx"} and sorted(r["user_key"] for r in got.values()) == [1, 2, 3]
    assert got["only_tx"]["age_quality"] == "no_member_metadata" and not got["only_label"]["has_member_metadata"]
    checks.require(*checks.user_checks(layer["users"]))


def test_window_is_half_open(layer):
    churn = model.fact_churn(layer["labels"], layer["users"].drop("user_key"), layer["files"])
    got = {(r["msno"], str(r["expiry_cohort_month"])): r["transaction_records"] for r in views.window_activity(churn, layer["tx"]).collect()}
    assert got == {("a", "2017-02-01"): 2, ("a", "2017-03-01"): 2, ("only_label", "2017-02-01"): 0}
    for r in views.churn_behavior(churn, layer["tx"]).collect():
        if not r["transaction_records"]:
            assert r["avg_records_per_transacting_user"] is None and r["auto_renew_record_rate"] is None


def test_repeated_cohort_row_is_refused(spark, layer):
    churn = model.fact_churn(layer["labels"].union(spark.sql("SELECT 'a', DATE '2017-02-01', true, 2L, 9L")), layer["users"], layer["files"])
    with pytest.raises(checks.ConstraintError) as e:
        checks.require(*checks.churn_checks(churn, layer["users"]))
    assert e.value.broken == {"user_and_cohort_unique": 1}


def test_staging_rules_are_named(spark, layer):
    bad = spark.sql("SELECT * FROM VALUES (2L, 0L, 'x', DATE '2017-02-01'), (9L, 1L, '', DATE '2017-02-15'), (2L, 5L, 'y', DATE '2017-02-01'), (2L, 5L, 'z', DATE '2017-02-01') AS t(source_file_key, source_row_number, msno, cohort)")
    with pytest.raises(checks.ConstraintError) as e:
        checks.require(*checks.staging_checks(bad, layer["files"], "cohort"))
    assert e.value.broken == {"row_number_positive": 1, "msno_not_empty": 1, "cohort_is_month_start": 1, "lineage_unique": 1, "source_file_known": 1}


def test_manifest_rules(spark):
    ok, sha = "SELECT 1L AS k, 'f' AS file_name, '{}' AS relative_path, {} AS file_size_bytes, {} AS row_count, {} AS sha256", "'" + "a" * 64 + "'"
    m = lambda *rows: spark.sql(" UNION ALL ".join(ok.format(*r) for r in rows))
    checks.require(*checks.manifest_checks(m(("p", "1L", "1L", sha), ("p", "1L", "1L", "CAST(NULL AS STRING)"), ("p", "1L", "1L", sha.replace("a", "b")))))
    for row, rule in ((("p", "-1L", "1L", sha), "file_size_not_negative"), (("p", "1L", "-1L", sha), "row_count_not_negative"), (("p", "1L", "1L", "'not-a-hash'"), "sha256_is_lowercase_hex"), (("p", "1L", "1L", sha.replace("a", "A")), "sha256_is_lowercase_hex"), (("", "1L", "1L", sha), "relative_path_not_empty")):
        with pytest.raises(checks.ConstraintError, match=rule):
            checks.require(*checks.manifest_checks(m(row)))
    with pytest.raises(checks.ConstraintError, match="unique_hashed_file"):
        checks.require(*checks.manifest_checks(m(("p", "1L", "1L", sha), ("p", "1L", "1L", sha))))


def test_overlap_counts_multiplicity(spark):
    x, y = spark.sql("SELECT explode(array(1, 1, 1, 2)) AS k"), spark.sql("SELECT explode(array(1, 1, 2, 2, 3)) AS k")
    assert tuple(sets.overlap(x, y, ["k"]).first()) == (3, 2, 2) and x.intersectAll(y).count() == 3 and y.exceptAll(x).count() == 2
    assert tuple(sets.presence(x, y, ["k"]).first()) == (2, 0, 1) and tuple(sets.duplicates(x, ["k"]).first()) == (1, 2, 2)


def test_profiles(spark):
    df = spark.sql("SELECT * FROM VALUES ('1'), ('x'), (''), (CAST(NULL AS STRING)), ('-5'), ('1') AS t(v)")
    assert tuple(profiling.integer_profile(df, ["v"]).first())[1:] == (2, 1, 3, 2, -5, 1)
    assert tuple(profiling.reference_integrity(df, "v").first()) == (6, 3, 1, 1, 2)
    dates = spark.sql("SELECT * FROM VALUES ('20170101'), ('20170230'), (''), ('20160101') AS t(v)")
    assert tuple(profiling.date_profile(dates, "v").first()) == (4, 1, 1, "20160101", "20170101")
    labels = spark.sql("SELECT * FROM VALUES ('a', '1'), ('a', '0'), ('b', ''), ('b', '1'), ('c', '1') AS t(msno, is_churn)")
    assert {r["msno"]: r["conflicting"] for r in profiling.label_states(labels).collect()} == {"a": True, "b": True, "c": False}
    q = profiling.weighted_quantiles(spark.range(101).toDF("v"), "v").first()
    assert (q["p01"], q["p50"], q["p99"]) == (1.0, 50.0, 99.0)


def test_load_csv_with_lineage(spark, tmp_path):
    head = ",".join(files.HEADERS["labels"])
    p = tmp_path / "labels.csv"
    p.write_text("﻿" + head + "\n" + "".join(f"u{k},{k % 2}\n" for k in range(1, 6)), encoding="utf-8")
    got = files.load(spark, str(p), "labels", 2, "2017-02-01").orderBy("source_row_number").collect()
    assert [(r["source_row_number"], r["msno"], r["is_churn"]) for r in got] == [(k, f"u{k}", k % 2 == 1) for k in range(1, 6)]
    p.write_text(head + "\nu1,2\n")
    with pytest.raises(checks.ConstraintError, match="is_churn_flag"):
        files.load(spark, str(p), "labels", 2, "2017-02-01")
    p.write_text(head + "\nu1,1,9\n")
    with pytest.raises(checks.ConstraintError, match="well_formed"):
        files.load(spark, str(p), "labels", 2, "2017-02-01")
    p.write_text("is_churn,msno\n1,u\n")
    with pytest.raises(ValueError, match="header"):
        files.load(spark, str(p), "labels", 2, "2017-02-01")


def test_strict_read_fails_on_a_row_of_another_length(spark, tmp_path):
    head, p = ",".join(files.HEADERS["labels"]), tmp_path / "labels.csv"
    p.write_text(head + "\nu1,1\nu2,0\n")
    assert files.read_text(spark, str(p), "labels", strict=True).count() == 2
    p.write_text(head + "\nu1,1\nu2,0,9\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        files.read_text(spark, str(p), "labels", strict=True).collect()
    assert [r["_malformed"] is not None for r in files.read_text(spark, str(p), "labels").collect()] == [False, True]


def test_members_and_transactions_from_csv(spark, tmp_path):
    m, x = tmp_path / "members.csv", tmp_path / "transactions.csv"
    m.write_text(",".join(files.HEADERS["members"]) + "\na,1,30,,7,20100101\nb,2,0,male,9,20110203\n")
    assert [(r["msno"], r["gender"], r["source_row_number"]) for r in files.load(spark, str(m), "members", 1).collect()] == [("a", None, 1), ("b", "male", 2)]
    x.write_text(",".join(files.HEADERS["transactions"]) + "\na,41,30,149,99,1,20170101,20170131,0\n")
    assert [(r["price_difference"], r["expiry_delta_days"], r["is_cancel"]) for r in files.load(spark, str(x), "transactions", 4).collect()] == [(50, 30, False)]
    x.write_text(",".join(files.HEADERS["transactions"]) + "\na,41,30,149,99,1,20170230,20170131,2\n")
    with pytest.raises(checks.ConstraintError) as e:
        files.load(spark, str(x), "transactions", 4)
    assert e.value.broken == {"transaction_date_day": 1, "is_cancel_flag": 1}


def test_a_version_that_fails_is_removed(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    publish.publish({"t": one}, str(tmp_path))
    with pytest.raises(ValueError, match="no"):
        publish.publish({"t": two}, str(tmp_path), lambda tables: (_ for _ in ()).throw(ValueError("no")))
    assert publish.published(spark, str(tmp_path), "t").count() == 3 and len([x for x in tmp_path.iterdir() if x.name.startswith("v-")]) == 1
    publish.publish({"t": two}, str(tmp_path), lambda tables: None)
    assert publish.published(spark, str(tmp_path), "t").count() == 5
    assert publish.markdown(spark.range(3), 2).endswith("more than 2 rows")


def test_files_of_the_driver(spark, tmp_path):
    store, p = Store(spark), str(tmp_path / "x.json")
    store.write(p, "old")
    store.write(p, "näu")
    assert store.read(p) == "näu" and store.names(str(tmp_path)) == ["x.json"] and store.identity(p)[0] == 4
    assert not store.create(p, "mine") and store.create(p + "2", "mine")
    store.delete(p)
    assert not store.exists(p)
    with pytest.raises(FileNotFoundError):
        store.identity(p)


def test_fingerprints_and_register(spark, tmp_path):
    import hashlib

    p = tmp_path / "x.csv"
    p.write_text("abc")
    f = files.fingerprint(str(p))
    assert f["sha256"] == hashlib.sha256(b"abc").hexdigest() == files.fingerprints_of(spark, str(p)).first()["sha256"]
    empty = spark.createDataFrame([], files.MANIFEST)
    found = spark.createDataFrame([f], "file_name string, relative_path string, file_size_bytes long, file_modified_at timestamp, sha256 string")
    once = files.register(empty, found)
    assert once.count() == 1 and files.register(once, found).count() == 1
    assert files.stale(found, found).count() == 0 and files.stale(found, found.limit(0)).count() == 1
    assert files.sample(spark, str(tmp_path / "x.csv"), 5).count() == 0


def test_whole_file_is_reported_beyond_the_greatest_sample(spark, tmp_path):
    n, p = files.MAX_SAMPLE_ROWS + 3, tmp_path / "x.csv"
    p.write_text("a,b\n" + "".join(f"{k},{k % 2 or ''}\n" for k in range(n)) + "late,0.5\n")
    found = [tuple(x)[:5] for x in files.sample_report(spark, str(p), None).orderBy("position").collect()]
    assert found == [(0, "a", "string", 0, n + 1), (1, "b", "double", (n + 1) // 2, n + 1)]
    with pytest.raises(ValueError, match="100000"):
        files.sample(spark, str(p), n)


def test_sample_query_counts_all_members(spark, tmp_path):
    from cadenza import catalog

    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    many = customers.crossJoin(spark.range(800)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * 1000).drop("id")
    many.write.parquet(str(tmp_path / "customer.parquet"))
    found = catalog.QUERIES["src08_sample"](spark, str(tmp_path)).collect()
    assert {x["sampled_rows"] for x in found} == {catalog.Tables(spark, str(tmp_path)).members.count()} and found[0]["sampled_rows"] > files.MAX_SAMPLE_ROWS


def test_sinks(spark):
    t = spark.sql("SELECT 1L AS source_file_key, 1L AS source_row_number, 'a' AS v")
    more = spark.sql("SELECT * FROM VALUES (1L, 1L, 'changed'), (1L, 2L, 'b') AS t(source_file_key, source_row_number, v)")
    assert sorted(r["v"] for r in files.append_missing(t, more).collect()) == ["a", "b"]
    assert {r["source_row_number"]: r["v"] for r in files.upsert(t, more, "source_row_number").collect()} == {1: "changed", 2: "b"}
    with pytest.raises(checks.ConstraintError):
        files.upsert(t, more.union(more), "source_row_number")
