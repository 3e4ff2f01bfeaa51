from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cadenza.streaming import activity as A

HEAD = "msno,date,num_25,num_50,num_75,num_985,num_100,num_unq,total_secs\n"
FIRST = """u1,20170101,1,2,3,4,5,6,1.25
u1,20170101,10,10,10,10,10,10,2.75
u2,20170102,2,0,0,0,0,0,0
u1,20170101,100,100,100,100,100,100,0.5
u1,20170201,1,1,1,1,1,1,3
,20170103,1,1,1,1,1,1,1
u4,20170230,1,1,1,1,1,1,1
u4,20170103,bad,1,1,1,1,1,1
u4,20170103,1,1,1,1,1,1,not-a-number
u4,20170103,1,1
"""
SECOND = """u1,20170301,1,1,1,1,1,1,1.5
u1,20170301,2,2,2,2,2,2,2.5
u3,20170302,-1,-1,-1,-1,-1,-1,-0.25
"""


@pytest.fixture
def logs(tmp_path):
    paths = []
    for name, body in (("user_logs.csv", FIRST), ("user_logs_v2.csv", SECOND)):
        p = tmp_path / name
        p.write_text(HEAD + body)
        paths.append(str(p))
    return paths


def test_whole_run(spark, logs, tmp_path):
    m = A.run(spark, logs, str(tmp_path / "out"))
    assert m["status"] == "complete" and sorted(m["partitions"]) == ["2017-01", "2017-02", "2017-03"]
    assert {k: (s["rows_read"], s["valid_rows"], s["invalid_rows"]) for k, s in m["sources"].items()} == {"user_logs.csv": (10, 5, 5), "user_logs_v2.csv": (3, 3, 0)}
    assert m["sources"]["user_logs.csv"]["invalid_reasons"] == dict.fromkeys(["empty_msno", "invalid_date", "invalid_num_25", "invalid_total_secs", "malformed_csv_row"], 1)
    days = {(r["msno"], str(r["activity_date"])): r for r in spark.read.parquet(str(tmp_path / "out/daily")).collect()}
    assert len(days) == 5
    one = days["u1", "2017-01-01"]
    assert [one[c] for c in A.COUNTS] == [111, 112, 113, 114, 115, 116] and one["total_secs"] == Decimal("4.5") and one["source_record_count"] == 3
    assert days["u1", "2017-03-01"]["num_25"] == 3 and days["u3", "2017-03-02"]["total_secs"] == Decimal("-0.25")
    r = m["reconciliation"]
    assert (r["source_record_count"], r["daily_rows"], r["num_25"], r["num_unq"], r["total_secs"]) == (8, 5, 116, 119, Decimal("11.25"))
    again = A.run(spark, logs, str(tmp_path / "out"), resume=True)
    assert json.loads(json.dumps(again["reconciliation"], default=str)) == json.loads(json.dumps(r, default=str))
    with pytest.raises(ValueError, match="changed"):
        A.run(spark, logs, str(tmp_path / "out"), max_rows=1, resume=True)
    with pytest.raises(FileExistsError):
        A.run(spark, logs, str(tmp_path / "out"))


def test_rows_are_capped_in_each_source(spark, logs, tmp_path):
    m = A.run(spark, logs, str(tmp_path / "out"), max_rows=2)
    assert [s["rows_read"] for s in m["sources"].values()] == [2, 2] and m["reconciliation"]["source_record_count"] == 4


def test_failed_run_can_be_resumed(spark, logs, tmp_path, monkeypatch):
    with monkeypatch.context() as x:
        x.setattr(A, "write_daily", lambda *a: (_ for _ in ()).throw(OSError("disk")))
        with pytest.raises(OSError, match="disk"):
            A.run(spark, logs, str(tmp_path / "out"))
    assert json.loads((tmp_path / "out/manifest.json").read_text())["status"] == "failed"
    assert A.run(spark, logs, str(tmp_path / "out"), resume=True)["status"] == "complete"


def test_resume_reads_only_the_sources_that_were_not_complete(spark, logs, tmp_path, monkeypatch):
    out, seen, source = str(tmp_path / "out"), [], A._source

    def failing(spark, path, *rest):
        seen.append(path)
        if len(seen) == 2:
            raise OSError("lost")
        return source(spark, path, *rest)

    with monkeypatch.context() as x:
        x.setattr(A, "_source", failing)
        with pytest.raises(OSError, match="lost"):
            A.run(spark, logs, out)
        old = json.loads((tmp_path / "out/manifest.json").read_text())
        assert old["status"] == "failed" and {k: v["status"] for k, v in old["sources"].items()} == {"user_logs.csv": "complete", "user_logs_v2.csv": "in_progress"}
        m = A.run(spark, logs, out, resume=True)
    assert seen == [logs[0], logs[1], logs[1]] and m["status"] == "complete" and m["reconciliation"]["source_record_count"] == 8
    assert m["sources"]["user_logs.csv"]["invalid_reasons"]["malformed_csv_row"] == 1 and not (tmp_path / "out/partials").exists()
    again = A.run(spark, logs, str(tmp_path / "kept"), keep_partials=True)
    assert (tmp_path / "kept/partials").exists() and again["partitions"].keys() == m["partitions"].keys()


def test_sources_by_name_or_path():
    from cadenza.sources.files import resolved

    assert resolved(["a.csv", "x/b.csv", "logs"], "/raw/", {"logs": "/raw/user_logs.csv"}) == ["/raw/a.csv", "x/b.csv", "/raw/user_logs.csv"]


def test_stream_takes_each_file_once(spark, logs, tmp_path):
    import os
    import shutil

    os.mkdir(tmp_path / "in")
    shutil.copy(logs[0], tmp_path / "in")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "parts"), str(tmp_path / "state"))
    assert A.run_stream(*args).count() == 3
    shutil.copy(logs[1], tmp_path / "in")
    assert A.run_stream(*args).count() == 5 and A.run_stream(*args).agg(F.sum("source_record_count")).first()[0] == 8
    assert {r["reason"]: r["row_count"] for r in A.stream_reasons(spark, args[2]).collect()} == dict.fromkeys(["empty_msno", "invalid_date", "invalid_num_25", "invalid_total_secs", "malformed_csv_row"], 1)
    (tmp_path / "in/late.csv").write_text(HEAD + "u1,20170101,1,1,1,1,1,1,1\n")  # a month that was there
    days = {(r["msno"], str(r["activity_date"])): r["num_25"] for r in A.run_stream(*args).collect()}
    assert len(days) == 5 and days["u1", "2017-01-01"] == 112 and days["u1", "2017-03-01"] == 3


@pytest.mark.parametrize(
    ("field", "value", "reason"),
    [
        ("date", "20160229", None), ("date", "20160230", "invalid_date"), ("date", "00000101", "invalid_date"), ("date", "2016022", "invalid_date"), ("msno", "   ", "empty_msno"),
        ("num_50", str(2**127), "out_of_range_num_50"), ("num_50", "1.0", "invalid_num_50"), ("num_50", None, "invalid_num_50"), ("num_100", "-7", None), ("total_secs", "NaN", "invalid_total_secs"),
        ("total_secs", "Infinity", "invalid_total_secs"), ("total_secs", "1.0000000000000", "out_of_range_total_secs"), ("total_secs", "1" * 27, "out_of_range_total_secs"), ("total_secs", "1" * 26, None), ("total_secs", "1.5e3", None), ("total_secs", "", "invalid_total_secs"),
    ],
)
def test_first_broken_rule(spark, field, value, reason):
    row = {"msno": "u", "date": "20170101", **dict.fromkeys(A.COUNTS, "1"), "total_secs": "1", A.CORRUPT: None} | {field: value}
    assert A.validated(spark.createDataFrame([row], A.RAW)).first()["reason"] == reason


def test_order_of_rules(spark):
    row = {"msno": "u", "date": "x", **dict.fromkeys(A.COUNTS, "y"), "total_secs": "z", A.CORRUPT: None}
    assert A.validated(spark.createDataFrame([row], A.RAW)).first()["reason"] == "invalid_date"


def test_restart_and_lock(spark, logs, tmp_path):
    out = tmp_path / "out"
    A.run(spark, logs, str(out))
    (out / "mine.txt").write_text("stays")
    assert A.run(spark, logs[1:], str(out), restart=True)["reconciliation"]["source_record_count"] == 3
    assert (out / "mine.txt").exists() and not (out / ".lock").exists()
    with A.Store(spark).lock(str(out / ".lock"), "me"), pytest.raises(RuntimeError, match="another run"):
        A.run(spark, logs, str(out), restart=True)


def test_command_line(spark, logs, capsys, tmp_path):
    from cadenza.__main__ import main

    assert main(["fingerprint", "--files", logs[0]]) == 0 and "sha256" in capsys.readouterr().out
    assert main(["list"]) == 0 and "agg09" in capsys.readouterr().out
    assert main(["fingerprint", "--files", str(tmp_path / "none")]) == 1
    assert main(["activity", "--files", logs[1], "--output-dir", str(tmp_path / "o")]) == 0
