"""Column expressions of the subscription model; all built-in functions, no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the model.
LONG_EXPIRY_DAYS = 730
VALID_AGE = (1, 100)
PLAN_BANDS = [("0", 0, 0), ("01-29", 1, 29), ("30", 30, 30), ("31", 31, 31), ("032-365", 32, 365)]
OVER_BAND = "over_365"
AGE_BANDS = [("01-17", 1, 17), ("18-24", 18, 24), ("25-34", 25, 34), ("35-44", 35, 44), ("45-54", 45, 54), ("55-64", 55, 64)]
LAST_AGE_BAND = "65-100"
HISTORY_END, MARCH_END = "20170228", "20170331"


def three_way(a: Column, b: Column, same: str, less: str, more: str) -> Column:
    """``less`` where a < b; a null on either side counts as ``more``, the last case."""
    return F.when(a == b, same).when(a < b, less).otherwise(more)


SOURCE_COLUMNS = "msno payment_method_id payment_plan_days plan_list_price actual_amount_paid is_auto_renew transaction_date membership_expire_date is_cancel".split()


def derived_columns() -> dict[str, Column]:
    """The seven derived columns of a transaction."""
    days = F.datediff("membership_expire_date", "transaction_date")
    return {
        "price_difference": F.col("plan_list_price") - F.col("actual_amount_paid"),
        "price_relationship": three_way(F.col("actual_amount_paid"), F.col("plan_list_price"), "equal", "paid_below_list", "paid_above_list"),
        "expiry_delta_days": days,
        "has_negative_expiry_delta": days < 0,
        "has_zero_expiry_delta": days == 0,
        "has_long_expiry_delta": days > LONG_EXPIRY_DAYS,
        "plan_expiry_relationship": three_way(days, F.col("payment_plan_days"), "equal", "expiry_shorter", "expiry_longer"),
    }


def transaction_columns(df: DataFrame) -> DataFrame:
    return df.withColumns(derived_columns())


def analytical_age(bd: Column) -> Column:
    return F.when(bd.between(*VALID_AGE), bd.cast("smallint"))


def age_quality(known: Column, bd: Column) -> Column:
    """First match wins; an unknown age of a known member would be the last case."""
    return F.when(~known, "no_member_metadata").when(bd < 0, "negative").when(bd == 0, "zero_or_unknown").when(bd.between(*VALID_AGE), "valid").otherwise("above_100")


def month(d: Column) -> Column:
    return F.trunc(d, "MM")


def month_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def banded(x: Column, bands: list[tuple[str, int, int]], last: str) -> Column:
    out = None
    for name, low, high in bands:
        cond = x.between(low, high)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(last)


def plan_band(days: Column) -> Column:
    return banded(days, PLAN_BANDS, OVER_BAND)


def plan_band_order(days: Column) -> Column:
    out = None
    for k, (_, low, high) in enumerate(PLAN_BANDS, 1):
        out = F.when(days.between(low, high), k) if out is None else out.when(days.between(low, high), k)
    return out.otherwise(len(PLAN_BANDS) + 1)


def age_band(age: Column) -> Column:
    return banded(age, AGE_BANDS, LAST_AGE_BAND)


def gender_group(known: Column, gender: Column) -> Column:
    return F.when(~known, "no_member_metadata").when(gender.isNull(), "missing_gender").otherwise(gender)


def code_group(known: Column, code: Column) -> Column:
    return F.when(known, code.cast("string")).otherwise("no_member_metadata")


def status(churned: Column) -> Column:
    return F.when(churned, "churn").otherwise("non_churn")


def transition(before: Column, after: Column) -> Column:
    return F.concat(status(before), F.lit("_to_"), status(after))


def transition_order(before: Column, after: Column) -> Column:
    return F.lit(1) + F.when(before, 2).otherwise(0) + F.when(after, 1).otherwise(0)


def rate(n: Column, d: Column) -> Column:
    """Exact quotient, null for no denominator."""
    return n.cast("decimal(20,0)") / F.nullif(d, F.lit(0)).cast("decimal(20,0)")


def percent(n: Column, d: Column) -> Column:
    """100 n / d, rounded half up to four decimals without floating-point sums (n, d >= 0); null for no denominator."""
    n, d = n.cast("bigint"), F.nullif(d.cast("bigint"), F.lit(0).cast("bigint"))
    return _div(n * 2000000 + d, d * 2).cast("double") / 10000


def _div(a: Column, b: Column) -> Column:
    """Integer quotient."""
    return F.call_function("div", a, b)


def mean4(total: Column, count: Column) -> Column:
    """total / count to four decimals, half up."""
    return percent(total, count * 100)


def display_percent(n: Column, d: Column, places: int = 2) -> Column:
    """Text of a percentage; N/A without a denominator, and never 100 for less than all."""
    full = "100." + "0" * places
    text = F.format_string(f"%.{places}f", n.cast("double") * 100 / F.nullif(d, F.lit(0)).cast("double"))
    return F.when(d == 0, "N/A").when((n < d) & (text == full), f"<{full}").otherwise(text)


def period(yyyymmdd: Column) -> Column:
    """By text comparison of eight digits."""
    return F.when(yyyymmdd <= HISTORY_END, "historical").when(yyyymmdd <= MARCH_END, "march_2017").otherwise("other")


def plain_decimal(x: Column) -> Column:
    """A decimal as text without trailing zeros."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+\z", ""), r"\.\z", "")).otherwise(text)


def escaped(c: Column) -> Column:
    """A source value that is safe in a cell of a table: HTML characters as references, pipes with a backslash."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "\\|")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def digest(namespace: str, *columns: Column) -> Column:
    """SHA-256 over fields, each led by its length in eight bytes, so that no two different rows run together."""
    field = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0")), F.encode(c, "UTF-8"))
    return F.sha2(F.concat(*[field(F.coalesce(c.cast("string"), F.lit(""))) for c in (F.lit(namespace), *columns)]), 256)


def is_integer_text(c: Column) -> Column:
    return c.rlike(r"\A[+-]?[0-9]+\z")


def is_date_text(c: Column) -> Column:
    """Eight digits that are a day of the calendar, from the year 1 on."""
    return c.rlike(r"\A[0-9]{8}\z") & F.try_to_date(c, "yyyyMMdd").isNotNull() & (F.substring(c, 1, 4) != "0000")
