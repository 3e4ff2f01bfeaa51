"""The logical relations of the engine (members, churn_labels, transactions, user_logs, source_file) from the star-schema
tables; lazy DataFrames over parquet, columns pruned by the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.derive import transaction_columns

COHORTS = ("2001-02-01", "2001-03-01")
#: key, file name (fixed values of the adapter)
FILES = [(1, "members"), (2, "labels_feb"), (3, "labels_mar"), (4, "transactions_original"), (5, "transactions_v2"), (6, "user_logs"), (7, "user_logs_v2")]
COUNTERS = ["num_25", "num_50", "num_75", "num_985", "num_100", "num_unq"]
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_file(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({k}L, '{n}')" for k, n in FILES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(source_file_key, source_file)")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 16 <> 0")
    return c.select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("msno"),
        F.col("c_nationkey").alias("city_code"),
        F.floor(F.col("c_acctbal") / 80).cast("int").alias("bd_raw"),
        F.when(F.col("c_mktsegment") == "BUILDING", "male").when(F.col("c_mktsegment") == "MACHINERY", "female").alias("gender"),
        (F.col("c_custkey") % 6).cast("int").alias("registered_via_code"),
        F.expr("date_add(DATE '2004-03-26', CAST(c_custkey % 4000 AS INT))").alias("registration_init_date"),
        F.lit(1).cast("long").alias("source_file_key"),
        F.col("c_custkey").alias("source_row_number"),
    )


def churn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")

    def cohort(keep, churn, date, key):
        return c.where(keep).select(
            F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("msno"),
            F.lit(date).cast("date").alias("expiry_cohort_month"),
            F.expr(churn).alias("is_churn"),
            F.lit(key).cast("long").alias("source_file_key"),
            F.col("c_custkey").alias("source_row_number"),
        )

    return cohort("c_custkey % 10 <> 0", "(c_custkey * 7) % 16 = 1", COHORTS[0], 2).union(cohort("c_custkey % 11 <> 0", "(c_custkey * 5) % 11 = 2", COHORTS[1], 3))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    df = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    paid = "(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * (100 + CAST(round(l_tax * 100) AS BIGINT))) div 10000"
    df = df.select(
        F.expr("CASE WHEN o_orderdate < TIMESTAMP_NTZ '2001-03-01' AND o_orderkey % 12 <> 0 THEN 4L ELSE 5L END").alias("source_file_key"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("source_row_number"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("msno"),
        F.col("l_linenumber").alias("payment_method_id"),
        F.expr("CASE WHEN l_quantity = 50 THEN 0 WHEN l_quantity = 49 THEN 410 ELSE CAST(l_quantity AS INT) END").alias("payment_plan_days"),
        F.expr("CAST(round(l_extendedprice * 100) AS BIGINT)").alias("plan_list_price"),
        F.expr(paid).alias("actual_amount_paid"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_auto_renew"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.col("l_shipdate").cast("date").alias("membership_expire_date"),
        F.expr("l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1").alias("is_cancel"),
    )
    return transaction_columns(df)


def user_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    counts = [F.when(F.col("event_type") == t, 1).otherwise(0).cast("decimal(38,0)").alias(c) for t, c in zip(EVENT_TYPES, COUNTERS, strict=False)]
    return e.select(
        F.expr("CASE WHEN event_id % 5 <> 0 THEN 'user_logs' ELSE 'user_logs_v2' END").alias("source_file"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("msno"),
        F.col("ts").cast("date").alias("activity_date"),
        *counts,
        F.lit(1).cast("decimal(38,0)").alias("num_unq"),
        F.col("value").cast("decimal(18,2)").cast("decimal(38,12)").alias("total_secs"),
    )


#: The same relations for DuckDB, to be put after WITH.
ORACLE = """
members AS (
  SELECT 'u' || c_custkey AS msno, c_nationkey AS city_code, CAST(floor(c_acctbal / 80) AS INTEGER) AS bd_raw,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'MACHINERY' THEN 'female' END AS gender,
    CAST(c_custkey % 6 AS INTEGER) AS registered_via_code,
    CAST(DATE '2004-03-26' + CAST(c_custkey % 4000 AS INTEGER) AS DATE) AS registration_init_date
  FROM customer WHERE c_custkey % 16 <> 0),
labels AS (
  SELECT 'u' || c_custkey AS msno, DATE '2001-02-01' AS cohort, (c_custkey * 7) % 16 = 1 AS is_churn, 2 AS file, c_custkey AS line FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL
  SELECT 'u' || c_custkey, DATE '2001-03-01', (c_custkey * 5) % 11 = 2, 3, c_custkey FROM customer WHERE c_custkey % 11 <> 0),
raw_tx AS (
  SELECT CASE WHEN o_orderdate < TIMESTAMP '2001-03-01' AND o_orderkey % 12 <> 0 THEN 'transactions_original' ELSE 'transactions_v2' END AS source_file,
    'u' || o_custkey AS msno, l_orderkey * 8 + l_linenumber AS line, l_linenumber AS payment_method_id,
    CASE WHEN l_quantity = 50 THEN 0 WHEN l_quantity = 49 THEN 410 ELSE CAST(l_quantity AS INTEGER) END AS plan_days,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS listed,
    (CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) * (100 + CAST(round(l_tax * 100) AS BIGINT))) // 10000 AS paid,
    o_orderpriority <> '5-LOW' AS renew, CAST(o_orderdate AS DATE) AS tx, CAST(l_shipdate AS DATE) AS expire,
    l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1 AS cancel
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tx AS (
  SELECT *, listed - paid AS diff, CAST(date_diff('day', tx, expire) AS INTEGER) AS delta,
    CASE sign(paid - listed) WHEN 0 THEN 'equal' WHEN -1 THEN 'paid_below_list' ELSE 'paid_above_list' END AS price_rel,
    CASE sign(date_diff('day', tx, expire) - plan_days) WHEN 0 THEN 'equal' WHEN -1 THEN 'expiry_shorter' ELSE 'expiry_longer' END AS plan_rel,
    CASE WHEN plan_days = 0 THEN '0' WHEN plan_days BETWEEN 1 AND 29 THEN '01-29' WHEN plan_days IN (30, 31) THEN CAST(plan_days AS VARCHAR) WHEN plan_days BETWEEN 32 AND 365 THEN '032-365' ELSE 'over_365' END AS band,
    CASE WHEN plan_days = 0 THEN 1 WHEN plan_days BETWEEN 1 AND 29 THEN 2 WHEN plan_days = 30 THEN 3 WHEN plan_days = 31 THEN 4 WHEN plan_days BETWEEN 32 AND 365 THEN 5 ELSE 6 END AS band_order
  FROM raw_tx),
logs AS (
  SELECT CASE WHEN event_id % 5 <> 0 THEN 'user_logs' ELSE 'user_logs_v2' END AS source_file, 'u' || user_id AS msno, CAST(ts AS DATE) AS day,
    CAST(event_type = 'view' AS INTEGER) AS num_25, CAST(event_type = 'click' AS INTEGER) AS num_50, CAST(event_type = 'purchase' AS INTEGER) AS num_75,
    CAST(event_type = 'signup' AS INTEGER) AS num_985, CAST(event_type = 'error' AS INTEGER) AS num_100, 1 AS num_unq, CAST(value AS DECIMAL(18,2)) AS secs
  FROM events),
users AS (
  SELECT u.msno, m.msno IS NOT NULL AS known, m.city_code, m.gender, m.registered_via_code, m.registration_init_date, m.bd_raw,
    CASE WHEN m.bd_raw BETWEEN 1 AND 100 THEN CAST(m.bd_raw AS SMALLINT) END AS age,
    CASE WHEN m.msno IS NULL THEN 'no_member_metadata' WHEN m.bd_raw < 0 THEN 'negative' WHEN m.bd_raw = 0 THEN 'zero_or_unknown' WHEN m.bd_raw <= 100 THEN 'valid' ELSE 'above_100' END AS quality
  FROM (SELECT msno FROM members UNION SELECT msno FROM labels UNION SELECT msno FROM tx) u LEFT JOIN members m USING (msno))
"""
