"""Reports on cloud credits (sponsored cost)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.amounts import amount_sum, number_text
from tallyframe.functions.dates import long_date, month_key, month_start
from tallyframe.operators.totals import total_by


def prepare(sponsor: DataFrame) -> DataFrame:
    sponsor = sponsor.withColumn("date", F.col("date").cast("timestamp_ntz"))
    return sponsor.withColumn("month", month_start("date"))


def running_cost(sponsor: DataFrame, key: str) -> DataFrame:
    return total_by(sponsor, [key], "cost")


def at_least(limit: float, name: str = "cost") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.filter(F.col(name) >= limit)


def above(limit: float, name: str = "cost") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.filter(F.col(name) > limit)


def between_open(low: float, high: float, name: str = "cost") -> Callable[[DataFrame], DataFrame]:
    """Strictly between both limits."""
    return lambda df: df.filter((F.col(name) > low) & (F.col(name) < high))


def large_resources(sponsor: DataFrame, limit: float = 20.0) -> DataFrame:
    return running_cost(sponsor, "service_resource").transform(at_least(limit))


def small_resources(sponsor: DataFrame, low: float = 1.0, high: float = 20.0) -> DataFrame:
    return running_cost(sponsor, "service_resource").transform(between_open(low, high))


def large_regions(sponsor: DataFrame, limit: float = 1000.0) -> DataFrame:
    return running_cost(sponsor, "service_region").transform(above(limit))


def total_per_month(sponsor: DataFrame, key: str) -> DataFrame:
    totals = total_by(sponsor, ["month", key], "cost", "total")
    return totals.select(month_key("month").alias("report_month"), key, "total")


def monthly_by(sponsor: DataFrame, key: str, limit: float = 500.0) -> DataFrame:
    """Month by service name or type, totals above a limit."""
    return total_per_month(sponsor, key).transform(above(limit, "total"))


def running_total_text(sponsor: DataFrame) -> DataFrame:
    """One sentence: the running total and the last day with cost."""
    totals = sponsor.agg(amount_sum(sponsor, "cost").alias("cost"), F.max("date").alias("last"))
    return totals.select(_sentence(F.col("cost"), F.col("last")).alias("message"))


def _sentence(cost: Column, last: Column) -> Column:
    return F.concat(
        F.lit("Running Total: $ "), number_text(cost), F.lit(" as of "), long_date(last)
    )
