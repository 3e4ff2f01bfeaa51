"""Views and materialised summaries of the canonical layer, and the product analysis.  Users are told apart by msno."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import derive as d


def n_if(cond: Column | str) -> Column:
    return F.count_if(F.expr(cond) if isinstance(cond, str) else cond)


def rows() -> Column:
    return F.count(F.lit(1))


def monthly_activity(t: DataFrame) -> DataFrame:
    return t.groupBy(d.month(F.col("transaction_date")).alias("transaction_month"), "source_file_key", "source_file").agg(
        rows().alias("transaction_count"), F.count_distinct("msno").alias("distinct_users"), n_if("is_auto_renew").alias("auto_renew_transaction_count"),
        n_if("is_cancel").alias("cancellation_transaction_count"), n_if("has_negative_expiry_delta").alias("negative_expiry_count"),
        n_if("has_zero_expiry_delta").alias("zero_expiry_count"), n_if("has_long_expiry_delta").alias("long_expiry_count"),
    )


def cohort_summary(churn: DataFrame) -> DataFrame:
    df = churn.groupBy("expiry_cohort_month").agg(rows().alias("observation_count"), n_if("is_churn").alias("churned_count"), n_if("not is_churn").alias("non_churned_count"))
    return df.withColumn("churn_rate", d.rate(F.col("churned_count"), F.col("observation_count")))


def metadata_coverage(users: DataFrame) -> DataFrame:
    df = users.agg(rows().alias("canonical_user_count"), n_if("has_member_metadata").alias("users_with_member_metadata"), n_if("not has_member_metadata").alias("users_without_member_metadata"))
    return df.withColumn("member_metadata_coverage_rate", d.rate(F.col("users_with_member_metadata"), F.col("canonical_user_count")))


def anomaly_summary(t: DataFrame) -> DataFrame:
    is_ = lambda c, v: n_if(F.col(c) == v)
    return t.groupBy("source_file_key", "source_file").agg(
        rows().alias("transaction_count"), is_("price_relationship", "equal").alias("paid_equal_list_count"), is_("price_relationship", "paid_below_list").alias("paid_below_list_count"),
        is_("price_relationship", "paid_above_list").alias("paid_above_list_count"), is_("plan_expiry_relationship", "equal").alias("plan_expiry_equal_count"),
        is_("plan_expiry_relationship", "expiry_shorter").alias("expiry_shorter_count"), is_("plan_expiry_relationship", "expiry_longer").alias("expiry_longer_count"),
        n_if("has_negative_expiry_delta").alias("negative_expiry_count"), n_if("has_zero_expiry_delta").alias("zero_expiry_count"),
        n_if("has_long_expiry_delta").alias("long_expiry_count"), n_if("is_cancel").alias("cancellation_count"),
    )


def by_user(t: DataFrame, scope: str, name: str, counts: dict[str, Column], label: str, whole: str) -> DataFrame:
    """Counts by ``scope`` and over all, with the users of each.  Rows are counted by scope and user first, so users are
    counted from far fewer rows, and the same rows serve both."""
    each = t.groupBy(scope, "msno").agg(*[c.alias(k) for k, c in counts.items()])
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts]
    parts = each.groupBy(scope).agg(F.lit(label).alias(name), *sums, rows().alias("users"))
    users = each.groupBy("msno").agg(*sums).agg(F.lit(whole).alias(name), *sums, rows().alias("users"))
    return parts.unionByName(users, allowMissingColumns=True)


def transaction_activity(t: DataFrame) -> DataFrame:
    """By month and over all time."""
    t = t.select(d.month(F.col("transaction_date")).alias("transaction_month"), "msno", "is_auto_renew", "is_cancel")
    counts = {"transaction_records": rows(), "auto_renew_records": n_if("is_auto_renew"), "cancellation_records": n_if("is_cancel")}
    df = by_user(t, "transaction_month", "period_grain", counts, "month", "all_time")
    share = lambda c: d.rate(F.col(c), F.col("transaction_records"))
    return df.select(
        "period_grain", "transaction_month", "transaction_records", F.col("users").alias("unique_transacting_users"), "auto_renew_records",
        share("auto_renew_records").alias("auto_renew_record_rate"), "cancellation_records", share("cancellation_records").alias("cancellation_record_rate"),
    )


def label_pairs(churn: DataFrame, cohorts: tuple[str, str], user: str = "msno") -> DataFrame:
    """Users of both cohorts with both labels, in one grouped pass instead of a join of the table with itself."""
    a, b = [F.lit(x).cast("date") for x in cohorts]
    both = churn.where(F.col("expiry_cohort_month").isin(*[F.lit(x).cast("date") for x in cohorts]))
    pick = lambda c: F.max(F.when(F.col("expiry_cohort_month") == c, F.col("is_churn")))
    return both.groupBy(user).agg(pick(a).alias("feb"), pick(b).alias("mar")).where("feb is not null and mar is not null")


def churn_transitions(churn: DataFrame, cohorts: tuple[str, str], user: str = "msno") -> DataFrame:
    df = label_pairs(churn, cohorts, user).groupBy("feb", "mar").agg(rows().alias("users"))
    total = F.sum("users").over(Window.partitionBy())  # at most four rows
    feb, mar = F.col("feb"), F.col("mar")
    df = df.select(d.status(feb).alias("feb_label"), d.status(mar).alias("mar_label"), d.transition(feb, mar).alias("transition"), d.transition_order(feb, mar).alias("transition_sort"), "users", total.alias("shared_users"))
    return df.withColumn("shared_user_rate", d.rate(F.col("users"), F.col("shared_users")))


def distributions(t: DataFrame, with_expiry: bool = False) -> DataFrame:
    """Records by plan days, by price relationship (and by plan against expiry): one scan, one row a category."""
    days = F.col("payment_plan_days")
    pairs = [("payment_plan_days", d.plan_band(days), d.plan_band_order(days))]
    order = F.when(F.col("price_relationship") == "equal", 1).when(F.col("price_relationship") == "paid_below_list", 2).otherwise(3)
    pairs.append(("price_relationship", F.col("price_relationship"), order))
    if with_expiry:
        pairs.append(("plan_expiry_relationship", F.col("plan_expiry_relationship"), F.lit(0)))
    names = [f"c{k}" for k in range(len(pairs))]
    df = t.select(*[p[1].alias(n) for n, p in zip(names, pairs, strict=True)], *[p[2].alias(f"o{n}") for n, p in zip(names, pairs, strict=True)])
    sets = [[n, f"o{n}"] for n in names]
    df = df.groupingSets([[F.col(x) for x in s] for s in sets], *[F.col(x) for s in sets for x in s]).agg(rows().alias("records"), *[F.grouping(n).alias(f"g{n}") for n in names])
    which = lambda values: F.coalesce(*[F.when(F.col(f"g{n}") == 0, v) for n, v in zip(names, values, strict=True)])
    df = df.select(which([F.lit(p[0]) for p in pairs]).alias("distribution"), which([F.col(n) for n in names]).alias("category"), which([F.col(f"o{n}") for n in names]).alias("category_sort"), "records")
    total = F.sum("records").over(Window.partitionBy("distribution"))
    df = df.withColumn("distribution_records", total)
    return df.withColumn("record_rate", d.rate(F.col("records"), F.col("distribution_records")))


def window_activity(churn: DataFrame, t: DataFrame, user: str = "msno", cohorts: list | None = None) -> DataFrame:
    """Per (user, cohort): records in the three months that end with the cohort month, zero where there are none.

    The range of days is inside the join condition; the scan gets the widest range of all cohorts as a filter of its own,
    and transactions are counted by user and month before they meet the cohorts, so the join multiplies months, not rows.
    """
    if cohorts is None:
        cohorts = [r[0] for r in churn.select("expiry_cohort_month").distinct().collect()]  # a handful of months
    cohorts = [c for c in cohorts if c is not None]
    if cohorts:
        first, last = F.add_months(F.lit(min(cohorts)).cast("date"), -2), F.add_months(F.lit(max(cohorts)).cast("date"), 1)
        t = t.where((F.col("transaction_date") >= first) & (F.col("transaction_date") < last))
    by_month = t.groupBy(user, d.month(F.col("transaction_date")).alias("m")).agg(rows().alias("n"), n_if("is_auto_renew").alias("renew"), n_if("is_cancel").alias("cancel"))
    by_month = by_month.withColumnRenamed(user, "_u")
    cohort = F.col("expiry_cohort_month")
    cond = (F.col(user) == F.col("_u")) & (F.col("m") >= F.add_months(cohort, -2)) & (F.col("m") < F.add_months(cohort, 1))
    df = churn.select(user, "expiry_cohort_month", "is_churn").join(by_month, cond, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.groupBy(user, "expiry_cohort_month", "is_churn").agg(total("n").alias("transaction_records"), total("renew").alias("auto_renew_records"), total("cancel").alias("cancellation_records"))


def churn_behavior(churn: DataFrame, t: DataFrame, user: str = "msno") -> DataFrame:
    df = window_activity(churn, t, user).groupBy("expiry_cohort_month", "is_churn").agg(
        rows().alias("cohort_users"), n_if("transaction_records > 0").alias("users_with_transaction_records"), F.sum("transaction_records").alias("transaction_records"),
        F.sum("auto_renew_records").alias("_renew"), F.sum("cancellation_records").alias("_cancel"),
    )
    c = F.col
    return df.select(
        "expiry_cohort_month", d.status(c("is_churn")).alias("churn_status"), "is_churn", "cohort_users", "users_with_transaction_records",
        d.rate(c("users_with_transaction_records"), c("cohort_users")).alias("users_with_transaction_record_rate"), "transaction_records",
        d.rate(c("transaction_records"), c("users_with_transaction_records")).alias("avg_records_per_transacting_user"),
        d.rate(c("_renew"), c("transaction_records")).alias("auto_renew_record_rate"), d.rate(c("_cancel"), c("transaction_records")).alias("cancellation_record_rate"),
    )


def overview_kpis(users: DataFrame, churn: DataFrame, activity: DataFrame, cohorts: tuple[str, str]) -> DataFrame:
    """One row: three frames of one row each, crossed."""
    at = lambda x: F.max(F.when(F.col("expiry_cohort_month") == F.lit(x).cast("date"), F.col("churn_rate")))
    rates = cohort_summary(churn).agg(at(cohorts[0]).alias("feb_churn_rate"), at(cohorts[1]).alias("mar_churn_rate"))
    cover = metadata_coverage(users).select("canonical_user_count", "member_metadata_coverage_rate")
    whole = activity.where("period_grain = 'all_time'").select("transaction_records", "unique_transacting_users")
    return cover.crossJoin(rates).crossJoin(whole)


def segment_churn(churn: DataFrame, users: DataFrame, name: str, group: Column, keep: Column | None = None) -> DataFrame:
    df = churn.join(users, "msno")
    if keep is not None:
        df = df.where(keep)
    df = df.groupBy("expiry_cohort_month", group.alias(name)).agg(rows().alias("cohort_users"), n_if("is_churn").alias("churned_users"))
    df = df.withColumn("churn_rate_pct", d.percent(F.col("churned_users"), F.col("cohort_users")))
    return df.orderBy(F.col("expiry_cohort_month").asc_nulls_last(), F.col("cohort_users").desc(), F.col(name).asc_nulls_last())


def segments() -> dict[str, tuple[str, Column, Column | None]]:
    known, age = F.col("has_member_metadata"), F.col("analytical_age")
    return {
        "gender": ("gender_group", d.gender_group(known, F.col("gender")), None),
        "city": ("city_group", d.code_group(known, F.col("city_code")), None),
        "age_quality": ("age_quality", F.col("age_quality"), None),
        "age_band": ("valid_age_band", d.age_band(age), age.isNotNull()),
        "registered_via": ("registered_via_group", d.code_group(known, F.col("registered_via_code")), None),
    }


def source_scope(t: DataFrame) -> DataFrame:
    """By source file and over all files."""
    counts = {
        "transaction_records": rows(), "auto_renew_records": n_if("is_auto_renew"), "cancellation_records": n_if("is_cancel"),
        "negative_expiry_records": n_if("has_negative_expiry_delta"), "zero_expiry_records": n_if("has_zero_expiry_delta"), "over_730_day_expiry_records": n_if("has_long_expiry_delta"),
        "paid_below_list_records": n_if("price_relationship = 'paid_below_list'"), "paid_above_list_records": n_if("price_relationship = 'paid_above_list'"),
        "zero_actual_payment_records": n_if("actual_amount_paid = 0"),
    }
    df = by_user(t, "source_file", "_all", counts, "", "all_sources").withColumnRenamed("users", "distinct_transacting_users")
    pct = {"auto_renew_record_pct": "auto_renew_records", "cancellation_record_pct": "cancellation_records", "negative_expiry_pct": "negative_expiry_records", "zero_expiry_pct": "zero_expiry_records", "over_730_day_expiry_pct": "over_730_day_expiry_records"}
    df = df.withColumns({k: d.percent(F.col(v), F.col("transaction_records")) for k, v in pct.items()})
    return df.withColumn("source_scope", F.coalesce("source_file", "_all")).drop("source_file", "_all")


def monthly_combined(t: DataFrame) -> DataFrame:
    df = t.groupBy(d.month(F.col("transaction_date")).alias("transaction_month")).agg(
        rows().alias("transaction_records"), F.count_distinct("msno").alias("unique_transacting_users"), n_if("is_auto_renew").alias("auto_renew_records"), n_if("is_cancel").alias("cancellation_records")
    )
    for k in ("auto_renew_record", "cancellation_record"):
        df = df.withColumn(f"{k}_pct", d.percent(F.col(f"{k}s"), F.col("transaction_records")))
    return df.orderBy(F.col("transaction_month").asc_nulls_last())
