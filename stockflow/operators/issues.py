"""Known data issues as a table: which values of which field are not to be believed in which months, and what to do.

name, dataset, field, first_month, last_month, low, high, codes, treatment. Values from low to high (an end left out is
open) or among codes (separated by "|"; all values, if neither is given) are hit. Treatment ``unknown`` makes a value
unknown, ``unusable`` refuses every job that reads the field in that dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "name string, dataset string, field string, first_month date, last_month date, low double, high double, codes string, treatment string"
UNKNOWN, UNUSABLE = "unknown", "unusable"


class Refused(ValueError):
    """A job reads what it may not."""


def problems(issues: DataFrame) -> DataFrame:
    """name, problem: issues without a name, listed twice, with months or ends the wrong way round, or an unknown treatment."""
    why = (
        F.when(F.col("name").isNull(), "no name")
        .when(F.col("first_month").isNull() | F.col("last_month").isNull() | (F.col("first_month") > F.col("last_month")), "months")
        .when(F.col("low") > F.col("high"), "ends")
        .when(~F.coalesce(F.col("treatment").isin(UNKNOWN, UNUSABLE), F.lit(False)), "treatment")
    )
    twice = issues.groupBy("name").count().where("count > 1").select("name", F.lit("listed twice").alias("problem"))
    return issues.select("name", why.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def require(issues: DataFrame, dataset: str, *fields: str) -> None:
    """Refuses a job that reads an unusable field (the fields' names, as many as the job has, are compared)."""
    bad = issues.where((F.col("dataset") == dataset) & F.col("field").isin(*fields) & (F.col("treatment") == UNUSABLE)).select("field", "name").orderBy("field", "name").limit(5).collect()
    if bad:
        raise Refused("; ".join(f"{dataset}.{r.field} is unusable: {r.name}" for r in bad))


def by_month(issues: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    """month and, for each field, the issues that hold then: a row for each month that has any."""
    own = issues.where((F.col("dataset") == dataset) & F.col("field").isin(fields) & (F.col("treatment") == UNKNOWN))
    months = own.select("field", F.struct("name", "low", "high", F.split("codes", r"\|").alias("codes")).alias("issue"), F.explode(F.sequence(F.trunc("first_month", "MM"), F.trunc("last_month", "MM"), F.expr("interval 1 month"))).alias("month"))
    return months.groupBy("month").agg(*(F.collect_list(F.when(F.col("field") == c, F.col("issue"))).alias(f"_{c}_issues") for c in fields))


def named(rows: DataFrame, issues: DataFrame, dataset: str, fields: list[str], month: str = "file_month") -> DataFrame:
    """``rows`` with, for each field, ``<field>_issue``: the name of the issue that hits its value (the first by name, if several do), else NULL.

    Rows meet the issues of their month by equality, one row a month, so none is repeated however many issues overlap,
    and Spark broadcasts that side only if its size allows. Then a row's few issues are compared with its values. A NULL
    value is never hit. An unusable field is refused.
    """
    require(issues, dataset, *fields)
    out = rows.join(by_month(issues, dataset, fields).withColumnRenamed("month", "_issue_month"), F.col(month) == F.col("_issue_month"), "left")

    def hit(c: str) -> Column:
        number, text = F.col(c).try_cast("double"), F.col(c).cast("string")
        holds = lambda x: F.col(c).isNotNull() & (x["low"].isNull() | F.coalesce(number >= x["low"], F.lit(False))) & (x["high"].isNull() | F.coalesce(number <= x["high"], F.lit(False))) & (x["codes"].isNull() | F.array_contains(x["codes"], text))
        return F.array_min(F.transform(F.filter(f"_{c}_issues", holds), lambda x: x["name"]))

    return out.withColumns({f"{c}_issue": hit(c) for c in fields}).drop("_issue_month", *(f"_{c}_issues" for c in fields))


def usable(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``named`` rows with their fields' hit values NULL."""
    return rows.withColumns({c: F.when(F.col(f"{c}_issue").isNull(), F.col(c)) for c in fields})


def applied(rows: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """keys, field, issue, n of ``named`` rows: how many values each issue hit (NULL: believed); each row counts once a field, null values not at all."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"{c}_issue").alias("issue"), F.col(c).isNotNull().alias("_there")) for c in fields))
    return rows.select(*keys, F.inline(cells)).where("_there").groupBy(*keys, "field", "issue").agg(F.count("*").alias("n"))
