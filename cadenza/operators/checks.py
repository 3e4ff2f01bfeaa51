"""Constraints as queries: each gives the number of rows that break a rule; require() raises with the rules' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.derive import age_quality, analytical_age


class ConstraintError(ValueError):
    def __init__(self, broken: dict[str, int]):
        super().__init__("; ".join(f"{k}: {n} rows" for k, n in sorted(broken.items())))
        self.broken = broken


def rows_breaking(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules in one scan; a rule that is null counts as kept, as in SQL."""
    n = df.agg(*[F.count_if(~c).alias(k) for k, c in rules.items()])
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("row_count")) for k in rules])).alias("x")).select("x.*")


def not_unique(df: DataFrame, keys: list[str], rule: str, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.where(where)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(rule).alias("rule"), "row_count")


def without_parent(df: DataFrame, parent: DataFrame, key: str, rule: str) -> DataFrame:
    n = df.where(F.col(key).isNotNull()).join(parent.select(key).distinct(), key, "left_anti")
    return n.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(rule).alias("rule"), "row_count")


def require(*checks: DataFrame) -> None:
    broken = {}
    for c in checks:
        broken |= {r["rule"]: r["row_count"] for r in c.where("row_count > 0").collect()}
    if broken:
        raise ConstraintError(broken)


def manifest_checks(m: DataFrame) -> list[DataFrame]:
    c = F.col
    rules = {
        "file_name_not_empty": F.trim("file_name") != "", "relative_path_not_empty": F.trim("relative_path") != "", "file_size_not_negative": c("file_size_bytes") >= 0,
        "row_count_not_negative": c("row_count") >= 0, "sha256_is_lowercase_hex": c("sha256").rlike(r"\A[0-9a-f]{64}\z"),
    }
    return [rows_breaking(m, rules), not_unique(m, ["relative_path", "file_size_bytes", "sha256"], "unique_hashed_file", c("sha256").isNotNull()), not_unique(m, ["relative_path", "file_size_bytes"], "unique_unhashed_file", c("sha256").isNull())]


def staging_checks(df: DataFrame, files: DataFrame, cohort: str | None = None, gender: str | None = None) -> list[DataFrame]:
    rules = {"row_number_positive": F.col("source_row_number") > 0, "msno_not_empty": F.trim("msno") != ""}
    if gender:
        rules["gender_not_empty"] = F.trim(gender) != ""
    if cohort:
        rules["cohort_is_month_start"] = F.day(cohort) == 1
    return [rows_breaking(df, rules), not_unique(df, ["source_file_key", "source_row_number"], "lineage_unique"), without_parent(df, files, "source_file_key", "source_file_known")]


def user_checks(users: DataFrame) -> list[DataFrame]:
    known = F.col("has_member_metadata")
    some, none = F.lit(True), F.lit(True)
    for c in ("city_code", "registered_via_code", "registration_init_date", "bd_raw"):
        some, none = some & F.col(c).isNotNull(), none & F.col(c).isNull()
    return [not_unique(users, ["msno"], "user_unique"), rows_breaking(users, {"member_fields_go_together": (known & some) | (~known & none & F.col("gender").isNull())})]


def churn_checks(churn: DataFrame, users: DataFrame, user: str = "user_key", cohorts: dict[str, str] | None = None) -> list[DataFrame]:
    """cohorts: the month that each source of labels is of."""
    rules = {"cohort_is_month_start": F.day("expiry_cohort_month") == 1, "row_number_positive": F.col("source_row_number") > 0}
    if cohorts:
        fits = F.lit(False)
        for name, month in cohorts.items():
            fits = fits | ((F.col("label_source") == name) & (F.col("expiry_cohort_month") == F.lit(month).cast("date")))
        rules["cohort_of_its_file"] = F.coalesce(fits, F.lit(False))
    return [not_unique(churn, [user, "expiry_cohort_month"], "user_and_cohort_unique"), not_unique(churn, ["source_file_key", "source_row_number"], "label_lineage_unique"), without_parent(churn, users, user, "user_known"), rows_breaking(churn, rules)]


MEMBER = ["city_code", "gender", "registered_via_code", "registration_init_date", "bd_raw"]


def layer_checks(users: DataFrame, churn: DataFrame, fact: DataFrame, members: DataFrame, labels: DataFrame, transactions: DataFrame) -> list[DataFrame]:
    """What the canonical layer must have kept of its sources."""
    known = members.select(F.col("msno").alias("_m"), *[F.col(c).alias(f"_{c}") for c in MEMBER])
    both = users.join(known, F.col("msno") == F.col("_m"), "left")
    same = F.col("has_member_metadata").eqNullSafe(F.col("_m").isNotNull())
    for c in MEMBER:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    age = F.col("analytical_age").eqNullSafe(analytical_age(F.col("bd_raw"))) & F.col("age_quality").eqNullSafe(age_quality(F.col("has_member_metadata"), F.col("bd_raw")))
    lineage = ["source_file_key", "source_row_number", "msno", "is_churn", "expiry_cohort_month"]
    count = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sources = members.select("msno").union(labels.select("msno").distinct()).union(transactions.select("msno").distinct()).distinct()
    return [
        same_rows(users.select("msno"), sources, "universe"), rows_breaking(both, {"enrichment": same, "age": age}), same_rows(churn.select(*lineage), labels.select(*lineage), "lineage"),
        same_rows(count(churn, "expiry_cohort_month", "is_churn"), count(labels, "expiry_cohort_month", "is_churn"), "label_counts"),
        same_rows(count(fact, "source_file_key"), count(transactions, "source_file_key"), "transaction_counts"), forbidden({"users": users, "churn": churn, "fact": fact}),
    ]


def same_rows(found: DataFrame, expected: DataFrame, rule: str) -> DataFrame:
    """No row of one that the other lacks."""
    n = found.subtract(expected).union(expected.subtract(found))
    return n.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(rule).alias("rule"), "row_count")


# Names that no column of the layer may have, and per table.
FORBIDDEN, FORBIDDEN_IN = ("revenue", "mrr", "arpu", "ltv"), {"users": ("is_churn",), "churn": ("churn_date",)}


def forbidden_columns(tables: dict[str, DataFrame]) -> list[str]:
    return [f"{t}.{c}" for t, df in tables.items() for c in df.columns if c.lower() in FORBIDDEN or c in FORBIDDEN_IN.get(t, ())]


def forbidden(tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    return spark.range(1).select(F.lit("no_forbidden_column").alias("rule"), F.lit(len(forbidden_columns(tables))).cast("long").alias("row_count"))


def catalog_checks(spark, columns: dict[str, list[tuple[str, str]]], found: dict[str, DataFrame]) -> DataFrame:
    """rule, row_count: tables that are not there, and columns that are missing or of another type."""
    missing = [t for t in columns if t not in found]
    wrong = [(t, c) for t, want in columns.items() if t in found for c, kind in want if dict(found[t].dtypes).get(c) != kind]
    return spark.createDataFrame([("table_exists", len(missing)), ("column_as_declared", len(wrong))], "rule string, row_count long")
