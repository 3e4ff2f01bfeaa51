"""Data-quality profiles: tidy frames of counts, each from one or two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import derive as d
from cadenza.functions.derive import is_date_text, is_integer_text

#: Reported quantiles.
QUANTILES = [("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)]


def unpivoted(df: DataFrame, columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """A row for each row and column, values as text; the scan reads these columns only."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("string").alias(value)) for c in columns])).alias("x")).select("x.*")


def integer_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values are counted first, so that each different one is parsed once."""
    counts = unpivoted(df, columns).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("value").isNull() | (F.col("value") == "")
    good = ~empty & is_integer_text(F.coalesce("value", F.lit("")))
    number = F.when(good, F.expr("try_cast(value AS DECIMAL(38,0))"))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return counts.groupBy("field").agg(some(empty).alias("empty_rows"), some(~empty & ~good).alias("non_integer_rows"), some(good).alias("integer_rows"), F.count_distinct(number).alias("distinct_values"), F.min(number).alias("min_value"), F.max(number).alias("max_value"))


def date_profile(df: DataFrame, column: str, malformed: str | None = None) -> DataFrame:
    """malformed: a column that is not null where the row has another number of fields; its values are not looked at."""
    c, whole = F.col(column).cast("string"), F.lit(True) if malformed is None else F.col(malformed).isNull()
    empty = c.isNull() | (c == "")
    good = whole & ~empty & is_date_text(F.coalesce(c, F.lit("")))
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), *([] if malformed is None else [F.count_if(~whole).alias("malformed_rows")]), F.count_if(whole & empty).alias("empty_rows"),
        F.count_if(whole & ~empty & ~good).alias("invalid_rows"), F.min(F.when(good, c)).alias("min_date"), F.max(F.when(good, c)).alias("max_date"),
    )


def registration_profile(df: DataFrame, column: str, before: str = "2004-01-01", after: str = "2017-12-31") -> DataFrame:
    """Of dates as text: invalid ones, the range, and how many lie before and after two days."""
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    day = F.when(is_date_text(c), F.try_to_date(c, "yyyyMMdd"))
    return df.agg(F.count_if(day.isNull()).alias("invalid_rows"), F.min(day).alias("min_date"), F.max(day).alias("max_date"), F.count_if(day < F.lit(before).cast("date")).alias("rows_before"), F.count_if(day > F.lit(after).cast("date")).alias("rows_after"))


def registration_years(df: DataFrame, column: str) -> DataFrame:
    c = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return df.where(is_date_text(c)).groupBy(F.substring(c, 1, 4).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("row_count"))


# Expiry days that stand out, and thresholds of the reported ranges.
EXTREME_EXPIRIES = {"expiry_1970": "1970-01-01", "expiry_2036": "2036-10-15"}
DELTA_LIMITS, AGE_LIMITS = (31, 365, 730, 3650), (100, 120)


def range_counts(x: Column, limits: tuple[int, ...]) -> dict[str, Column]:
    return {"negative": x < 0, "zero": x == 0, "positive": x > 0} | {f"over_{k}": x > k for k in limits}


def wrong_derived(df: DataFrame) -> Column:
    """Any of the seven derived columns differs from what its sources give, or one is null where the other is not."""
    again = d.derived_columns()
    out = F.lit(False)
    for name, c in again.items():
        out = out | ~F.col(name).eqNullSafe(c)
    return out


def load_metrics(fact: DataFrame, by: str = "source_file") -> DataFrame:
    """Twenty-six counts of a load, by source, in one pass."""
    n = lambda text: F.count_if(F.expr(text))
    null = lambda names: F.count_if(F.greatest(*[F.col(c).isNull() for c in names]))
    metrics = {"cancel_false": n("not is_cancel"), "cancel_true": n("is_cancel"), "negative_expiry": n("has_negative_expiry_delta"), "zero_expiry": n("has_zero_expiry_delta"), "long_expiry": n("has_long_expiry_delta"), "over_3650_expiry": n("expiry_delta_days > 3650")}
    metrics |= {k: n(f"membership_expire_date = DATE '{day}'") for k, day in EXTREME_EXPIRIES.items()}
    metrics |= {"price_equal": n("price_relationship = 'equal'"), "paid_below_list": n("price_relationship = 'paid_below_list'"), "paid_above_list": n("price_relationship = 'paid_above_list'")}
    metrics |= {"plan_equal": n("plan_expiry_relationship = 'equal'"), "expiry_shorter": n("plan_expiry_relationship = 'expiry_shorter'"), "expiry_longer": n("plan_expiry_relationship = 'expiry_longer'")}
    metrics |= {"plan_days_zero": n("payment_plan_days = 0"), "plan_days_30": n("payment_plan_days = 30"), "plan_days_over_31": n("payment_plan_days > 31"), "plan_days_over_365": n("payment_plan_days > 365")}
    metrics |= {"list_price_zero": n("plan_list_price = 0"), "paid_zero": n("actual_amount_paid = 0"), "paid_zero_list_positive": n("actual_amount_paid = 0 and plan_list_price > 0"), "list_zero_paid_positive": n("plan_list_price = 0 and actual_amount_paid > 0"), "both_prices_zero": n("plan_list_price = 0 and actual_amount_paid = 0")}
    metrics |= {"null_source_rows": null(d.SOURCE_COLUMNS), "null_derived_rows": null(list(d.derived_columns())), "wrong_derived_rows": F.count_if(wrong_derived(fact))}
    return fact.groupBy(by).agg(*[c.alias(k) for k, c in metrics.items()])


def load_state(df: DataFrame, by: str = "source_file_key") -> DataFrame:
    x = F.col("source_row_number")
    return df.groupBy(by).agg(F.count(x).alias("loaded"), F.min(x).alias("least_row"), F.max(x).alias("greatest_row"), F.count_distinct(x).alias("different"))


def plan_comparison(fact: DataFrame) -> DataFrame:
    """How the days to expiry compare with the plan's, and of which sign they are where the row is a cancellation."""
    x, plan = F.col("expiry_delta_days"), F.col("payment_plan_days")
    pairs = {"eligible": x.isNotNull() & plan.isNotNull(), "equal": x == plan, "less": x < plan, "greater": x > plan}
    pairs |= {f"cancelled_{k}": F.col("is_cancel") & c for k, c in (("negative", x < 0), ("zero", x == 0), ("positive", x > 0))}
    return fact.agg(*[F.count_if(c).alias(k) for k, c in pairs.items()])


def year_histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.year(column).alias("year")).agg(F.count(F.lit(1)).alias("row_count"))


def frequencies(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Most frequent first; equals by value."""
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), F.col("value").asc_nulls_last())
    return out.limit(top) if top else out


def weighted_quantiles(df: DataFrame, column: str) -> DataFrame:
    """Exact, interpolated at (N - 1) p, over a frequency table: the aggregate holds different values, not rows."""
    freq = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    q = freq.where("v is not null").agg(F.percentile("v", F.array(*[F.lit(p) for _, p in QUANTILES]), F.col("n")).alias("q"))
    return q.select(*[F.col("q")[k].alias(name) for k, (name, _) in enumerate(QUANTILES)])


def threshold_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def flag_matrix(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of both flags' four combinations, 0 where there are none; rows with a null flag are not counted."""
    grid = df.sparkSession.sql("SELECT * FROM VALUES (false, false), (false, true), (true, false), (true, true) AS t(a, b)")
    n = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select(F.col("a").alias(a), F.col("b").alias(b), F.coalesce("n", F.lit(0)).alias("row_count"))


def flag_matrix_of_text(df: DataFrame, a: str, b: str) -> DataFrame:
    """The same over flags as text, and in a row of its own (null flags) the rows in which either is not 0 or 1."""
    good = F.col(a).isin("0", "1") & F.col(b).isin("0", "1")
    valid = df.where(F.coalesce(good, F.lit(False))).select((F.col(a) == "1").alias(a), (F.col(b) == "1").alias(b))
    bad = df.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("row_count"))
    return flag_matrix(valid, a, b).union(bad.select(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), "row_count"))


VALID_LABELS = ("0", "1")


def label_states(labels: DataFrame, user: str = "msno", label: str = "is_churn", order: str | None = None) -> DataFrame:
    """Per user: occurrences, the first label (by ``order``, a row number; else the smallest), and whether labels conflict (an
    empty label is one of its own)."""
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    first = F.min(text) if order is None else F.min(F.struct(F.col(order), text.alias("label")))["label"]
    return labels.groupBy(user).agg(F.count(F.lit(1)).alias("occurrences"), first.alias("label"), (F.min(text) != F.max(text)).alias("conflicting"))


def label_profile(labels: DataFrame, user: str = "msno", label: str = "is_churn") -> DataFrame:
    """One row: kinds of labels by rows, and repeated and conflicting users."""
    text = F.coalesce(F.col(label).cast("string"), F.lit(""))
    per_user = labels.groupBy(user).agg(
        F.count(F.lit(1)).alias("n"), (F.min(text) != F.max(text)).alias("conflicting"), F.count_if(text == "1").alias("churn"), F.count_if(text == "0").alias("kept"), F.count_if(text == "").alias("missing"),
        F.count_if(~text.isin(*VALID_LABELS, "")).alias("invalid"),
    )
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per_user.agg(
        total("n", "total_rows"), F.count(F.lit(1)).alias("distinct_users"), total(F.col("n") - 1, "duplicate_occurrences"), F.count_if(F.col("n") > 1).alias("duplicated_users"), F.count_if("conflicting").alias("conflicting_users"),
        total("churn", "churn_rows"), total("kept", "non_churn_rows"), total("missing", "missing_labels"), total("invalid", "invalid_labels"),
    )


def label_stability(first: DataFrame, second: DataFrame, user: str = "msno") -> DataFrame:
    """One row over two files' ``label_states``: users of both and of one, users left out (conflicting or invalid labels), the four
    transitions, and how many labels stayed or changed."""
    state = lambda df, p: df.select(F.col(user), *[F.col(c).alias(f"{p}_{c}") for c in ("label", "conflicting")])
    both = state(first, "a").join(state(second, "b"), user, "full")
    a, b = F.col("a_label"), F.col("b_label")
    shared = a.isNotNull() & b.isNotNull()
    good = shared & a.isin(*VALID_LABELS) & b.isin(*VALID_LABELS) & ~F.col("a_conflicting") & ~F.col("b_conflicting")
    cells = {f"from_{x}_to_{y}": good & (a == x) & (b == y) for x in VALID_LABELS for y in VALID_LABELS}
    counts = {"shared_users": shared, "first_only": b.isNull(), "second_only": a.isNull(), "excluded_users": shared & ~good, **cells, "stayed": good & (a == b), "changed": good & (a != b)}
    return both.agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def reference_integrity(df: DataFrame, key: str) -> DataFrame:
    n = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("k").isNull() | (F.trim("k") == "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return n.agg(
        total(F.col("n")).alias("rows_read"), F.count_if(~empty).alias("distinct_ids"), total(F.when(~empty, F.col("n") - 1)).alias("duplicate_occurrences"),
        F.count_if(~empty & (F.col("n") > 1)).alias("duplicated_ids"), total(F.when(empty, F.col("n"))).alias("empty_ids"),
    )


def coverage(source: DataFrame, reference: DataFrame, key: str = "msno") -> DataFrame:
    """Rows and users of a source with and without a record in reference: its rows are counted by user first."""
    users = source.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = reference.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(True))
    df = users.join(known, F.col(key) == F.col("_k"), "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    hit = F.col("_in")
    return df.agg(F.count_if(hit).alias("users_with_record"), F.count_if(~hit).alias("users_without_record"), total(hit).alias("rows_with_record"), total(~hit).alias("rows_without_record"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = unpivoted(df, columns).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    empty = F.col("value").isNull() | (F.col("value") == "")
    return counts.groupBy("field").agg(F.sum("n").alias("rows_read"), F.coalesce(F.sum(F.when(empty, F.col("n"))), F.lit(0)).alias("empty_rows"), F.count_if(~empty).alias("distinct_values"))
