"""Months, fiscal periods (October to September) and the bridge from months to periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fiscal_year(month: Column) -> Column:
    return F.year(F.add_months(month, 3))


def fiscal_quarter(month: Column) -> Column:
    return F.quarter(F.add_months(month, 3))


def month_key(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def fy_key(month: Column) -> Column:
    return F.concat(F.lit("FY"), fiscal_year(month))


def quarter_key(month: Column) -> Column:
    return F.concat(fy_key(month), F.lit("Q"), fiscal_quarter(month))


def month_of(ts: str) -> Column:
    return F.to_date(F.trunc(ts, "MM"))


def grain_of(key: Column) -> Column:
    return F.when(key.rlike(r"^FY\d{4}Q[1-4]$"), "quarter").when(key.rlike(r"^FY\d{4}$"), "fy").when(key.rlike(r"^\d{4}-\d{2}$"), "month")


def bounds_of(key: Column) -> Column:
    """Struct of the first and last month of a period key."""
    year = F.try_to_number(F.regexp_extract(key, r"(\d{4})", 1), F.lit("9999")).cast("int")
    quarter = F.regexp_extract(key, r"Q(\d)$", 1)
    month = F.to_date(F.concat(key, F.lit("-01")))
    start = F.add_months(F.make_date(year - 1, F.lit(10), F.lit(1)), (F.when(quarter != "", quarter.cast("int")).otherwise(1) - 1) * 3)
    first = F.when(grain_of(key) == "month", month).otherwise(start)
    last = F.when(grain_of(key) == "month", month).when(quarter != "", F.add_months(start, 2)).otherwise(F.add_months(start, 11))
    return F.struct(first.alias("first_month"), last.alias("last_month"))


def spine(bounds: DataFrame) -> DataFrame:
    """month: every month from first_month to last_month of a one-row frame."""
    return bounds.select(F.explode(F.sequence("first_month", "last_month", F.expr("interval 1 month"))).alias("month"))


def bridge(months: DataFrame) -> DataFrame:
    """grain, period, month, expected: each month with its month, quarter and fiscal year."""
    m = F.col("month")
    of = lambda grain, key, n: F.struct(F.lit(grain).alias("grain"), key.alias("period"), F.lit(n).cast("long").alias("expected"))
    periods = F.array(of("month", month_key(m), 1), of("quarter", quarter_key(m), 3), of("fy", fy_key(m), 12))
    return months.select("month", F.inline(periods))
