"""The canonical layer: one row a user, one a user and cohort, and transactions with all their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.derive import age_quality, analytical_age

KEY_BUCKETS = 1024


def surrogate_keys(keys: DataFrame, column: str, name: str, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Contiguous numbers from 1 for distinct values, the same at every build: rows are numbered inside hash buckets,
    after as many as the buckets before hold, so no window takes the whole table."""
    keys = keys.withColumn("_b", F.pmod(F.xxhash64(column), F.lit(buckets)))
    counts = keys.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return keys.withColumn("_own", own).join(F.broadcast(counts), "_b").withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")


def identities(members: DataFrame, labels: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every user that any source knows, once; each source is made distinct before they meet."""
    return members.select("msno").union(labels.select("msno").distinct()).union(transactions.select("msno").distinct()).distinct()


def dim_user(members: DataFrame, labels: DataFrame, transactions: DataFrame, with_key: bool = True) -> DataFrame:
    """All identities, enriched by the members that have them.  members has a user once (see checks.unique)."""
    users = identities(members, labels, transactions)
    if with_key:
        users = surrogate_keys(users, "msno", "user_key")
    known = members.select("msno", F.lit(True).alias("_known"), "city_code", "gender", "registered_via_code", "registration_init_date", "bd_raw")
    df = users.join(known, "msno", "left").withColumn("has_member_metadata", F.coalesce("_known", F.lit(False)))
    df = df.withColumns({"analytical_age": analytical_age(F.col("bd_raw")), "age_quality": age_quality(F.col("has_member_metadata"), F.col("bd_raw"))})
    names = ["msno", "has_member_metadata", "city_code", "gender", "registered_via_code", "registration_init_date", "bd_raw", "analytical_age", "age_quality"]
    return df.select(*(["user_key"] if with_key else []), *names)


def fact_churn(labels: DataFrame, users: DataFrame | None, files: DataFrame) -> DataFrame:
    """A user's label in a cohort; repeated lineage is dropped, a repeated (user, cohort) is for checks to refuse.

    Without users, msno stands for the user: every labelled user is a canonical one, so that join would drop no row and
    would only make the identities of all sources be gathered first."""
    key = "user_key" if users is not None and "user_key" in users.columns else "msno"
    df = labels.dropDuplicates(["source_file_key", "source_row_number"])
    if users is not None:
        df = df.join(users.select(*dict.fromkeys(["msno", key])), "msno")
    df = df.join(F.broadcast(files), "source_file_key")  # a row for each registered file
    return df.select(key, "expiry_cohort_month", "is_churn", F.col("source_file").alias("label_source"), "source_file_key", "source_row_number")


TRANSACTION = (
    "source_file_key source_row_number source_file user_key msno payment_method_id payment_plan_days plan_list_price actual_amount_paid is_auto_renew "
    "transaction_date membership_expire_date is_cancel price_difference price_relationship expiry_delta_days has_negative_expiry_delta "
    "has_zero_expiry_delta has_long_expiry_delta plan_expiry_relationship"
).split()


def fact_transaction(transactions: DataFrame, files: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Lazy, nothing is copied.  Without users, msno stands for the user: every transaction's user is a canonical one and
    user_key is one to one with it, so that join would only add the number."""
    df = transactions.join(F.broadcast(files), "source_file_key")  # a row for each registered file
    if users is not None:
        df = df.join(users.select("msno", "user_key"), "msno")
    return df.select(*[c for c in TRANSACTION if c in df.columns])
