"""Lost billable hours over the rate card."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.amounts import PRODUCT_SCALE, currency_text, exact_sum, fine_sum
from tallyframe.functions.dates import AsOf, iso_day
from tallyframe.functions.work import shortfall, shortfall_amount
from tallyframe.operators.filters import eligible, in_closed_range

DETAIL = ["project", "employee", "rank", "level"]
HOURS = ["target", "billed", "shortfall", "shortfall_amt"]


def short_rows(rates: DataFrame, start: AsOf, end: AsOf) -> DataFrame:
    """Rows of the periods with unbilled hours, before the eligibility mode."""
    rows = rates.filter(in_closed_range("period", start, end))
    rows = rows.withColumn("shortfall", shortfall())
    rows = rows.withColumn("shortfall_amt", shortfall_amount())
    return rows.filter(F.col("shortfall") > 0)


def lost(rates: DataFrame, start: AsOf, end: AsOf, strict: bool = True) -> DataFrame:
    return short_rows(rates, start, end).filter(eligible("indiv_eligibility", strict))


def per_project(rows: DataFrame) -> DataFrame:
    """Lost amount per project, and over all rows in the row marked as total."""
    amount = exact_sum("shortfall_amt", PRODUCT_SCALE).alias("shortfall_amt")
    projects = rows.groupBy("project").agg(amount)
    totals = projects.rollup("project").agg(
        (F.grouping("project") == 1).alias("is_total"),
        fine_sum("shortfall_amt").alias("shortfall_amt"),
    )
    return totals.filter(F.col("is_total") | F.col("project").isNotNull())


def overall_text(rows: DataFrame) -> DataFrame:
    amount = exact_sum("shortfall_amt", PRODUCT_SCALE)
    message = F.concat(F.lit("Monthly lost opportunity is "), currency_text(amount, "$ "))
    return rows.agg(message.alias("message"))


def details(rows: DataFrame) -> DataFrame:
    """The listing, by project and employee."""
    month = iso_day("period").alias("month")
    ties = ["month", "rank", "level", *HOURS]
    return rows.select(*DETAIL, month, *HOURS).orderBy("project", "employee", *ties)


def drill_down(rows: DataFrame, employee: str) -> DataFrame:
    """One employee's rows."""
    return rows.filter(F.col("employee") == employee).select(*DETAIL, "period", *HOURS)


def times_short(rows: DataFrame, employee: str) -> DataFrame:
    """How often the employee fell short; give it rows before the eligibility mode."""
    return rows.filter(F.col("employee") == employee).agg(F.count(F.lit(1)).alias("times"))
