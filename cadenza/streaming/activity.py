"""Daily activity from raw log rows: validation with one reason a row, aggregation, reconciliation, and resumable runs.

Batch: each source is parsed once, into partial sums by user, day and reason, from which its counts, reasons and totals
come; a source that is done is not read again.  The partials of all sources are summed and written by month.  Stream: the
same on a file source with availableNow; each micro-batch writes its partials under its own number, so a replayed batch
overwrites itself, and after a call the months that got new rows are summed anew under a new version.
"""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.derive import is_date_text, is_integer_text, month_text
from cadenza.sources.files import header_of
from cadenza.sources.store import Store

# Fixed values of the source.
COUNTS = ["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq"]
HEADER = ["msno", "date", *COUNTS, "total_secs"]
CORRUPT = "_malformed"
RAW = T.StructType([T.StructField(c, T.StringType()) for c in [*HEADER, CORRUPT]])
SCALE, WHOLE = 12, 26
METRICS = [*COUNTS, "total_secs", "source_record_count"]


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All text; rows with too few or too many fields are flagged, not lost."""
    return spark.read.schema(RAW).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("encoding", "UTF-8").csv(path)


def reason():
    """The first rule that a raw row breaks, null for a valid row."""
    rules = [F.when(F.col(CORRUPT).isNotNull(), "malformed_csv_row"), F.when(F.trim(F.coalesce("msno", F.lit(""))) == "", "empty_msno"), F.when(~is_date_text(F.coalesce("date", F.lit(""))), "invalid_date")]
    for c in COUNTS:
        text = F.coalesce(F.col(c), F.lit(""))
        rules.append(F.when(~is_integer_text(text), f"invalid_{c}"))
        rules.append(F.when(F.expr(f"try_cast({c} AS DECIMAL(38,0))").isNull(), f"out_of_range_{c}"))
    secs = F.coalesce(F.col("total_secs"), F.lit(""))
    number = secs.rlike(r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    rules.append(F.when(~number, "invalid_total_secs"))
    # digits before and after the point, moved by the exponent
    mantissa, exponent = F.regexp_replace(secs, r"[eE].*\z", ""), F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(total_secs, '[eE]([+-]?[0-9]+)', 1), '') AS INT)"), F.lit(0))
    after = F.length(F.regexp_extract(mantissa, r"\.([0-9]*)", 1)) - exponent
    before = F.length(F.regexp_replace(F.regexp_extract(mantissa, r"\A[+-]?([0-9]*)", 1), r"\A0+", "")) + exponent
    rules.append(F.when((after > SCALE) | (before > WHOLE), "out_of_range_total_secs"))
    return F.coalesce(*rules)


def validated(raw: DataFrame) -> DataFrame:
    return raw.withColumn("reason", reason())


def typed(checked: DataFrame) -> DataFrame:
    good = checked.where("reason is null")
    return good.select("msno", F.to_date("date", "yyyyMMdd").alias("activity_date"), *[F.col(c).cast("decimal(38,0)").alias(c) for c in COUNTS], F.expr("CAST(total_secs AS DECIMAL(38,12))").alias("total_secs"), *[c for c in ("source_file",) if c in checked.columns])


def daily(rows: DataFrame) -> DataFrame:
    """One row a user and day, with sums and the number of source rows."""
    n = F.col("source_record_count") if "source_record_count" in rows.columns else F.lit(1)
    sums = [F.sum(c).cast("decimal(38,0)").alias(c) for c in COUNTS] + [F.sum("total_secs").cast("decimal(38,12)").alias("total_secs")]
    return rows.groupBy("msno", "activity_date").agg(*sums, F.sum(n).cast("decimal(38,0)").alias("source_record_count"))


def partials(checked: DataFrame) -> DataFrame:
    """Sums by user and day of the valid rows, and the number of rows of each reason: all that a run needs of a source."""
    good = F.col("reason").isNull()
    day = F.when(good, F.to_date(F.when(good, F.col("date")), "yyyyMMdd"))
    sums = [F.sum(F.when(good, F.expr(f"try_cast({c} AS DECIMAL(38,0))"))).cast("decimal(38,0)").alias(c) for c in COUNTS]
    sums.append(F.sum(F.when(good, F.expr("try_cast(total_secs AS DECIMAL(38,12))"))).cast("decimal(38,12)").alias("total_secs"))
    return checked.groupBy("reason", F.when(good, F.col("msno")).alias("msno"), day.alias("activity_date")).agg(*sums, F.count(F.lit(1)).cast("decimal(38,0)").alias("source_record_count"))


def partial_stats(parts: DataFrame) -> DataFrame:
    """The one row of ``source_stats`` from a source's partials."""
    n, good = F.col("source_record_count"), F.col("reason").isNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return parts.agg(total(n).alias("rows_read"), total(F.when(good, n)).alias("valid_rows"), total(F.when(~good, n)).alias("invalid_rows"), F.min("activity_date").alias("min_date"), F.max("activity_date").alias("max_date"), *[F.sum(c).alias(f"input_{c}") for c in METRICS[:-1]])


def partial_reasons(parts: DataFrame) -> DataFrame:
    return parts.where("reason is not null").groupBy("reason").agg(F.sum("source_record_count").cast("long").alias("row_count"))


def source_stats(checked: DataFrame, by: str = "source_file") -> DataFrame:
    good = F.col("reason").isNull()
    day = F.when(good, F.to_date(F.when(good, F.col("date")), "yyyyMMdd"))
    sums = [F.sum(F.when(good, F.expr(f"try_cast({c} AS DECIMAL(38,0))"))).alias(f"input_{c}") for c in COUNTS] + [F.sum(F.when(good, F.expr("try_cast(total_secs AS DECIMAL(38,12))"))).alias("input_total_secs")]
    return checked.groupBy(by).agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(good).alias("valid_rows"), F.count_if(~good).alias("invalid_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date"), *sums)


def reason_histogram(checked: DataFrame, by: str = "source_file") -> DataFrame:
    return checked.where("reason is not null").groupBy(by, "reason").agg(F.count(F.lit(1)).alias("row_count"))


def month_totals(days: DataFrame) -> DataFrame:
    return days.groupBy(month_text(F.col("activity_date")).alias("month")).agg(F.count(F.lit(1)).alias("daily_rows"), F.min("activity_date").alias("min_date"), F.max("activity_date").alias("max_date"), *[F.sum(c).alias(c) for c in METRICS])


def reconciliation(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Sums before and after; each must be kept, source rows as records."""
    zero = F.lit(0)
    records = F.coalesce(F.sum("source_record_count"), zero) if "source_record_count" in rows.columns else F.count(F.lit(1))
    before = rows.agg(records.cast("decimal(38,0)").alias("in_source_record_count"), *[F.coalesce(F.sum(c), zero).alias(f"in_{c}") for c in METRICS[:-1]])
    after = days.agg(*[F.coalesce(F.sum(c), zero).alias(f"out_{c}") for c in METRICS], F.count(F.lit(1)).alias("daily_rows"))
    df = before.crossJoin(after)
    return df.select(*[(F.col(f"in_{c}") == F.col(f"out_{c}")).alias(f"{c}_kept") for c in METRICS], *[F.col(f"out_{c}").alias(c) for c in METRICS], "daily_rows")


def write_daily(days: DataFrame, path: str) -> None:
    """Partitions by month, each replaced as a whole; rows in order of day and user inside a file."""
    days = days.withColumn("month", month_text(F.col("activity_date")))
    days.repartition("month", F.pmod(F.xxhash64("msno"), F.lit(64))).sortWithinPartitions("month", "activity_date", "msno").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


# ---- runs

def _files(store: Store, paths: list[str]) -> list[dict]:
    return [dict(zip(("path", "size", "mtime_ms"), (p, *store.identity(p)), strict=True)) for p in paths]


def _save(store: Store, path: str, manifest: dict) -> None:
    manifest["updated_at"] = datetime.now(UTC).isoformat()
    store.write(path, json.dumps(manifest, indent=1, default=str))


def run(spark: SparkSession, paths: list[str], out: str, max_rows: int | None = None, resume: bool = False, restart: bool = False, keep_partials: bool = False) -> dict:
    """A run over CSV files, with a manifest beside the output, on any file system that Spark reads.

    A finished run with the same configuration and unchanged files is left alone on resume; in a failed or interrupted one
    the sources that were complete are kept and the others read, and its months are replaced.  A configuration or file that
    has changed is refused, unless ``restart`` clears what an earlier run left: its manifest, partials and daily folder,
    nothing else."""
    if resume and restart:
        raise ValueError("resume or restart, not both")
    store, out = Store(spark), out.rstrip("/")
    with store.lock(f"{out}/.lock", str(os.getpid())):
        if restart:
            for name in ("daily", "partials", "manifest.json"):
                store.delete(f"{out}/{name}")
        return _run(spark, store, paths, out, max_rows, resume, keep_partials)


def _source(spark: SparkSession, path: str, max_rows: int | None, folder: str) -> dict:
    """Partials of one source, written; its counts, reasons and totals."""
    if (header := header_of(spark, path)) != HEADER:
        raise ValueError(f"{path}: unexpected header {header}")
    raw = read_raw(spark, path)
    partials(validated(raw.limit(max_rows) if max_rows else raw)).write.mode("overwrite").parquet(folder)
    parts = spark.read.parquet(folder)
    return {**partial_stats(parts).first().asDict(), "invalid_reasons": {r["reason"]: r["row_count"] for r in partial_reasons(parts).collect()}}


def _run(spark: SparkSession, store: Store, paths: list[str], out: str, max_rows: int | None, resume: bool, keep_partials: bool) -> dict:
    place = f"{out}/manifest.json"
    configuration, sources = {"files": _files(store, paths), "max_rows": max_rows}, {}
    if store.exists(place):
        old = json.loads(store.read(place))
        if not resume:
            raise FileExistsError(f"{place}: resume, or give another folder")
        if old["configuration"] != configuration:
            raise ValueError("the configuration or a source file has changed since the run began")
        if old["status"] == "complete":
            return old
        sources = {k: x for k, x in old["sources"].items() if x["status"] == "complete"}
    manifest = {"version": 1, "status": "in_progress", "created_at": datetime.now(UTC).isoformat(), "configuration": configuration, "sources": sources, "partitions": {}, "reconciliation": {}}
    _save(store, place, manifest)
    names = [os.path.basename(p) for p in paths]
    names = [n if names.count(n) == 1 else p for n, p in zip(names, paths, strict=True)]
    try:
        for k, (name, path) in enumerate(zip(names, paths, strict=True)):
            if name not in sources:
                sources[name] = {"source_file": name, "status": "in_progress"}
                sources[name] = {"source_file": name, "status": "complete", **_source(spark, path, max_rows, f"{out}/partials/source={k}")}
                _save(store, place, manifest)
        rows = spark.read.parquet(*[f"{out}/partials/source={k}" for k in range(len(paths))]).where("reason is null").drop("reason")
        write_daily(daily(rows), f"{out}/daily")
        days = spark.read.parquet(f"{out}/daily")
        manifest["partitions"] = {r["month"]: r.asDict() for r in month_totals(days).collect()}
        manifest["reconciliation"] = reconciliation(rows, days).first().asDict()
        if not all(manifest["reconciliation"][f"{c}_kept"] for c in METRICS):
            raise ValueError("output sums differ from input sums")
        manifest["status"] = "complete"
        if not keep_partials:
            store.delete(f"{out}/partials")
    except KeyboardInterrupt:
        manifest["status"] = "interrupted"
        raise
    except BaseException:
        manifest["status"] = "failed"
        raise
    finally:
        _save(store, place, manifest)
    return manifest


def _number(name: str) -> int:
    return int(name.split("=")[1])


def run_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """Take in what is new in a folder of CSV files, then stop; call again for more.  Returns the daily sums so far; rows that
    are not valid are counted, see ``stream_reasons``."""
    raw = spark.readStream.schema(RAW).option("header", True).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).option("maxFilesPerTrigger", files_per_batch).csv(folder)

    def partial(batch: DataFrame, number: int) -> None:
        partials(validated(batch)).write.mode("overwrite").parquet(f"{out}/batches/batch={number}")

    raw.writeStream.foreachBatch(partial).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    store = Store(spark)
    done = max([_number(v) for v in store.names(f"{out}/days") if store.exists(f"{out}/days/{v}/_SUCCESS")], default=-1)
    new = [b for b in map(_number, store.names(f"{out}/batches")) if b > done]
    if new:
        # batches are committed here, so none of them comes again; only months with new rows are summed, and the version counts once it is whole
        rows = spark.read.parquet(*[f"{out}/batches/batch={b}" for b in sorted(new)]).where("reason is null").drop("reason").withColumn("month", month_text(F.col("activity_date")))
        before = _latest(spark, store, out)
        if before is not None:
            rows = rows.unionByName(before.join(F.broadcast(rows.select("month").distinct()), "month", "left_semi").select(*rows.columns))  # a row a month
        daily(rows).withColumn("month", month_text(F.col("activity_date"))).write.mode("overwrite").partitionBy("month").parquet(f"{out}/days/v={max(new)}")
    days = _latest(spark, store, out)
    return days.drop("month") if days is not None else daily(typed(validated(spark.createDataFrame([], RAW))))


def _latest(spark: SparkSession, store: Store, out: str) -> DataFrame | None:
    """Of each month the sums of the last version that has it."""
    last: dict[str, int] = {}
    for v in sorted((v for v in store.names(f"{out}/days") if store.exists(f"{out}/days/{v}/_SUCCESS")), key=_number):
        last |= {m: _number(v) for m in store.names(f"{out}/days/{v}") if m.startswith("month=")}
    parts = None
    for m, v in last.items():
        df = spark.read.parquet(f"{out}/days/v={v}/{m}").withColumn("month", F.lit(m.split("=")[1]))
        parts = df if parts is None else parts.unionByName(df)
    return parts


def stream_reasons(spark: SparkSession, out: str) -> DataFrame:
    """Rows that no batch could take, by reason."""
    return partial_reasons(spark.read.parquet(f"{out}/batches").drop("batch"))
