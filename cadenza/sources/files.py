"""CSV sources with declared headers and lineage, file fingerprints, and the manifest of source files."""

from __future__ import annotations

import hashlib
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.derive import is_date_text, is_integer_text, transaction_columns
from cadenza.operators.checks import ConstraintError

# The sources' headers, in order.
HEADERS = {
    "members": ["msno", "city", "bd", "gender", "registered_via", "registration_init_time"],
    "labels": ["msno", "is_churn"],
    "transactions": ["msno", "payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "transaction_date", "membership_expire_date", "is_cancel"],
    "user_logs": ["msno", "date", "num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs"],
}
MALFORMED = "_malformed"
SAMPLE_ROWS, MAX_SAMPLE_ROWS = 10_000, 100_000
MANIFEST = "source_file_key long, file_name string, relative_path string, file_size_bytes long, row_count long, file_modified_at timestamp, sha256 string, registered_at timestamp, notes string"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the first line, read by Spark, so from wherever it reads; a byte order mark is no part of a name."""
    found = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    return [c.lstrip("\ufeff").strip('"') if k == 0 else c for k, c in enumerate(found)]


def check_header(spark: SparkSession, path: str, expected: list[str], ordered: bool = True) -> list[str]:
    found = header_of(spark, path)
    if (found != expected) if ordered else (sorted(found) != sorted(expected)):
        raise ValueError(f"{path}: header is {found}, not {expected}")
    return found


def resolved(names: list[str], folder: str, known: dict[str, str] | None = None) -> list[str]:
    """Sources given by a name that ``known`` has, by a file name in the folder, or by a path of their own."""
    known = known or {}
    return [known.get(x) or (x if "/" in x else f"{folder.rstrip('/')}/{x}") for x in names]


def read_text(spark: SparkSession, path: str, kind: str, strict: bool = False, ordered: bool = True) -> DataFrame:
    """All columns as text, and _malformed: the whole line of a row that has another number of fields, else null.
    strict: such a row fails the read instead."""
    header = check_header(spark, path, HEADERS[kind], ordered)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ([*header] if strict else [*header, MALFORMED])])
    read = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (read if strict else read.option("columnNameOfCorruptRecord", MALFORMED).option("columnPruning", False)).csv(path)


def numbered(df: DataFrame, start: int = 1) -> DataFrame:
    """source_row_number: the row's place in its file, from 1, the header not counted.

    Rows are numbered inside each partition, in order, and partitions get as offset the rows before them: two passes and
    no shuffle.  The second pass reads the same splits of the same immutable file."""
    df = df.withColumns({"_id": F.monotonically_increasing_id()})
    part = F.shiftright("_id", 33)
    sizes = {r[0]: r[1] for r in df.select(part.alias("p")).groupBy("p").count().collect()}  # a row for each file split
    before, seen = {}, start
    for p in sorted(sizes):
        before[p] = seen
        seen += sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("source_row_number", (F.element_at(offset, part.cast("int")) + low).cast("long")).drop("_id")


def gate(df: DataFrame, kind: str) -> DataFrame:
    """Raise if any row cannot be typed; one scan counts every rule."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = {"msno_not_empty": F.trim(text("msno")) != ""}
    if MALFORMED in df.columns:
        rules["well_formed"] = F.col(MALFORMED).isNull()
    if kind == "transactions":
        rules |= {f"{c}_integer": is_integer_text(text(c)) for c in ("payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid")}
        rules |= {f"{c}_flag": text(c).isin("0", "1") for c in ("is_auto_renew", "is_cancel")}
        rules |= {f"{c}_day": is_date_text(text(c)) for c in ("transaction_date", "membership_expire_date")}
    elif kind == "members":
        rules |= {f"{c}_integer": is_integer_text(text(c)) for c in ("city", "bd", "registered_via")}
        rules["registration_init_time_day"] = is_date_text(text("registration_init_time"))
    elif kind == "labels":
        rules["is_churn_flag"] = text("is_churn").isin("0", "1")
    counts = df.agg(*[F.count_if(~c).alias(k) for k, c in rules.items()]).first().asDict()
    if any(counts.values()):
        raise ConstraintError({k: n for k, n in counts.items() if n})
    return df.drop(MALFORMED)


def typed(df: DataFrame, kind: str, source_file_key: int, cohort: str | None = None) -> DataFrame:
    day = lambda c: F.to_date(c, "yyyyMMdd")
    number = lambda c: F.col(c).cast("int")
    lineage = [F.lit(source_file_key).cast("long").alias("source_file_key"), F.col("source_row_number").cast("long").alias("source_row_number")]
    if kind == "transactions":
        out = df.select(*lineage, "msno", *[number(c).alias(c) for c in HEADERS[kind][1:5]], (F.col("is_auto_renew") == "1").alias("is_auto_renew"), day("transaction_date").alias("transaction_date"), day("membership_expire_date").alias("membership_expire_date"), (F.col("is_cancel") == "1").alias("is_cancel"))
        return transaction_columns(out)
    if kind == "members":
        return df.select(*lineage, "msno", number("city").alias("city_code"), number("bd").alias("bd_raw"), F.nullif("gender", F.lit("")).alias("gender"), number("registered_via").alias("registered_via_code"), day("registration_init_time").alias("registration_init_date"))
    if kind == "labels":
        return df.select(*lineage, "msno", F.lit(cohort).cast("date").alias("expiry_cohort_month"), (F.col("is_churn") == "1").alias("is_churn"))
    raise ValueError(kind)


def load(spark: SparkSession, path: str, kind: str, source_file_key: int, cohort: str | None = None, max_rows: int | None = None) -> DataFrame:
    """A validated, typed source with lineage."""
    raw = read_text(spark, path, kind)
    raw = numbered(raw.limit(max_rows) if max_rows else raw)
    return typed(gate(raw, kind), kind, source_file_key, cohort)


def sample(spark: SparkSession, path: str, n: int | None = SAMPLE_ROWS) -> DataFrame:
    """The first n rows, types inferred from those rows only; with None all rows, which stay in their splits."""
    if n is not None and not 1 <= n <= MAX_SAMPLE_ROWS:
        raise ValueError(f"1 to {MAX_SAMPLE_ROWS} rows, or None for all")
    text = spark.read.option("header", True).csv(path)
    text = text if n is None else text.limit(n)
    some = lambda c, kind: F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS {kind})").isNull())
    names = text.columns
    if not names:
        return text
    counts = text.agg(F.count(F.lit(1)), *[x for c in names for x in (some(c, "BIGINT"), some(c, "DOUBLE"))]).first()
    if not counts[0]:
        return text
    best = {c: "bigint" if not counts[1 + 2 * k] else "double" if not counts[2 + 2 * k] else "string" for k, c in enumerate(names)}
    return text.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in best.items()])  # a number where all that is there is one


def sample_report(spark: SparkSession, path: str, n: int | None = SAMPLE_ROWS) -> DataFrame:
    """A row for each column: place, name, type in the sample (with None: in the file), empty values, rows of the sample, and the file's bytes."""
    rows = sample(spark, path, n)
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # of the listing; contents stay unread
    empty = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{k}") for k, c in enumerate(rows.columns)]).first()
    found = [(k, f.name, f.dataType.simpleString(), empty[k + 1], empty[0], size) for k, f in enumerate(rows.schema.fields)]
    return spark.createDataFrame(found, "position int, name string, type string, empty_rows long, sampled_rows long, file_size_bytes long")


# ---- fingerprints and manifest

def identity(path: str) -> tuple[int, int]:
    s = os.stat(path)
    return s.st_size, s.st_mtime_ns


def fingerprint(path: str, chunk: int = 4 << 20) -> dict:
    """SHA-256 in chunks; a file that changes meanwhile is refused."""
    before, h = identity(path), hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(chunk):
            h.update(data)
    if identity(path) != before:
        raise ValueError(f"{path} changed while it was read")
    return {"file_name": os.path.basename(path), "relative_path": path, "file_size_bytes": before[0], "file_modified_at": datetime.fromtimestamp(before[1] / 1e9, UTC), "sha256": h.hexdigest()}


def fingerprints_of(spark: SparkSession, path: str) -> DataFrame:
    """The same for many files that each fit a task, on the executors."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("relative_path"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("file_modified_at"), F.sha2("content", 256).alias("sha256"))


def stale(cache: DataFrame, listing: DataFrame) -> DataFrame:
    """Cached fingerprints whose file is gone or differs in size or time."""
    return cache.join(listing, ["relative_path", "file_size_bytes", "file_modified_at"], "left_anti")


def register(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """The manifest with the files it lacks, numbered on; each file must then be there once."""
    known = ["relative_path", "file_size_bytes", "sha256"]
    cond = None
    for c in known:
        x = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        cond = x if cond is None else cond & x
    new = found.dropDuplicates(known).alias("a").join(manifest.alias("b"), cond, "left_anti")
    top = manifest.agg(F.coalesce(F.max("source_file_key"), F.lit(0))).first()[0]
    rows = [r.asDict() for r in new.orderBy("relative_path", "sha256").collect()]  # one row for each registered file
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    full = [tuple(({"source_file_key": top + k, "registered_at": datetime.now(UTC)} | r).get(n) for n in names) for k, r in enumerate(rows, 1)]
    return manifest.select(*names).unionByName(manifest.sparkSession.createDataFrame(full, MANIFEST))


def registered_once(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """rule, row_count: files of which the manifest has not exactly one entry (path, size, hash and rows)."""
    known = [c for c in ("relative_path", "file_size_bytes", "sha256", "row_count") if c in found.columns]
    cond = F.lit(True)
    for c in known:
        cond = cond & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    n = found.select(*known).distinct().alias("a").join(manifest.alias("b"), cond, "left").groupBy(*[F.col(f"a.{c}") for c in known]).agg(F.count("b.source_file_key").alias("n"))
    return n.agg(F.count_if(F.col("n") != 1).alias("row_count")).select(F.lit("registered_once").alias("rule"), "row_count")


def gate_checks(cache: DataFrame, expected: DataFrame, listing: DataFrame) -> DataFrame:
    """rule, row_count: what keeps fingerprints from being used.  cache: the manifest's columns, file_modified_at as text with
    its zone, and file_modified_ns; expected: file_name, relative_path, file_size_bytes, row_count of every file that may be
    there; listing: relative_path, file_size_bytes, file_modified_ns as they are now."""
    want = expected.select("file_name", *[F.col(c).alias(f"w_{c}") for c in ("relative_path", "file_size_bytes", "row_count")])
    now = listing.select("relative_path", F.col("file_size_bytes").alias("n_size"), F.col("file_modified_ns").alias("n_ns"))
    df = cache.join(want, "file_name", "full").join(now, "relative_path", "left")
    cached, allowed = F.col("sha256").isNotNull() | F.col("file_size_bytes").isNotNull(), F.col("w_relative_path").isNotNull()
    both = cached & allowed
    no = lambda c: F.count_if(both & ~F.coalesce(c, F.lit(False)))
    rules = {
        "file_allowed": F.count_if(cached & ~allowed), "file_there": F.count_if(allowed & ~cached), "path_as_verified": no(F.col("relative_path") == F.col("w_relative_path")),
        "size_as_verified": no(F.col("file_size_bytes") == F.col("w_file_size_bytes")), "rows_as_verified": no(F.col("row_count") == F.col("w_row_count")),
        "sha256_is_lowercase_hex": no(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z")), "time_has_a_zone": no(F.col("file_modified_at").rlike(r"([+-][0-9]{2}:?[0-9]{2}|Z)\z")),
        "size_not_stale": no(F.col("file_size_bytes") == F.col("n_size")), "time_not_stale": no(F.col("file_modified_ns") == F.col("n_ns")),
    }
    n = df.agg(*[c.alias(k) for k, c in rules.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("row_count")) for k in rules])).alias("x")).select("x.*")


# ---- sinks

LINEAGE = ["source_file_key", "source_row_number"]


def append_missing(target: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows whose key the target has not yet, each key once: a repeated load adds nothing."""
    keys = keys or LINEAGE
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows take the place of the target's of the same key; a key twice among the rows is an error."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).count()
    if twice:
        raise ConstraintError({f"{key}_proposed_once": twice})
    return target.join(rows.select(key), key, "left_anti").select(*rows.columns).unionByName(rows)


def refresh(df: DataFrame, path: str) -> DataFrame:
    """A materialised summary: written as a whole, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
