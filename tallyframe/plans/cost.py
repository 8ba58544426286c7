"""Cloud cost reports over the usage dataset.

Reports on the newest months take `months_of`: the frame whose months count.
Give the whole usage there when the report runs on chosen resource groups, so
that a group without recent cost does not fall back to older months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.amounts import amount_sum, currency_text, fine_sum, not_nan, number_text, sum_in_parts
from tallyframe.functions.dates import (
    AsOf,
    as_date,
    days_left_in_month,
    month_end,
    month_key,
    month_start,
)
from tallyframe.operators.calendar import (
    PARTITION,
    dense_cells,
    fill_months,
    last_months,
    moving_mean,
    rows_of_month,
    rows_from_days_before,
    rows_of_newest,
    rows_since,
)
from tallyframe.operators.filters import any_of, chosen_or_all, present
from tallyframe.operators.ranking import order_by_group_total, top_per_group
from tallyframe.operators.totals import total_by, with_group_total


def prepare(usage: DataFrame) -> DataFrame:
    """Typed usage date, and the day and month that reports group by.

    Months are grouped as dates; their keys are written on the totals.
    """
    usage = usage.withColumn("usage_date", F.col("usage_date").cast("timestamp_ntz"))
    return usage.withColumns(
        {"day": F.to_date("usage_date"), "month": month_start("usage_date")}
    )


def _keyed(totals: DataFrame) -> DataFrame:
    """Month starts as month keys."""
    return totals.withColumn("month", month_key("month")).withColumnRenamed(
        "month", "report_month"
    )


def daily_rollup(usage: DataFrame) -> DataFrame:
    """Usage lines added per day, subscription, category and resource group.

    The result has the form of usage, dated at midnight, and every report by day or
    longer gives the same on it as on the lines; only hours within a day are lost. Null
    keys stay groups of their own, and days whose costs are all null stay days.
    """
    day = F.to_date("usage_date").cast("timestamp_ntz").alias("usage_date")
    months = [F.col(PARTITION)] if PARTITION in usage.columns else []
    total = F.sum("cost") if isinstance(usage.schema["cost"].dataType, T.DecimalType) else sum_in_parts(not_nan("cost"))
    return usage.groupBy(day, "category", "subscription", "resource_group", *months).agg(total.alias("cost"))


def daily_total(usage: DataFrame, start: AsOf | None = None) -> DataFrame:
    if start is not None:
        usage = rows_since(usage, start)
    return total_by(usage, ["day"], "cost")


def of_groups(usage: DataFrame, chosen: Sequence[str] = ()) -> DataFrame:
    """Usage of the chosen resource groups; no choice means all."""
    return usage.filter(chosen_or_all("resource_group", chosen))


def daily_by_subscription(
    usage: DataFrame, position: int = 1, months_of: DataFrame | None = None
) -> DataFrame:
    """One month's cost per day and subscription; position 1 is the newest month."""
    month = rows_of_newest(usage, position, months_of=months_of)
    return total_by(month, ["day", "subscription"], "cost")


def monthly_total(usage: DataFrame) -> DataFrame:
    return _keyed(total_by(usage, ["month"], "cost"))


def latest_month_total(usage: DataFrame) -> DataFrame:
    """The newest month and its cost, in one row; nulls without any month."""
    return monthly_total(rows_of_newest(usage)).agg(
        F.max("report_month").alias("report_month"), F.max("cost").alias("cost")
    )


def month_end_totals(costs: DataFrame, day: str = "date") -> DataFrame:
    """Cost per calendar month, dated at month end, empty months as 0."""
    months = total_by(costs.withColumn("month", month_start(day)), ["month"], "cost")
    return fill_months(months, "month", "cost").select(month_end("month").alias(day), "cost")


def category_total(usage: DataFrame) -> DataFrame:
    return total_by(usage, ["category"], "cost")


def compare_categories(usage: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Monthly cost of the chosen categories side by side per subscription."""
    chosen = usage.filter(any_of("category", categories))
    return _keyed(total_by(chosen, ["subscription", "category", "month"], "cost"))


def resource_groups(usage: DataFrame, month: AsOf) -> DataFrame:
    """Cost per resource group in one month, largest first."""
    totals = total_by(rows_of_month(usage, month), ["resource_group"], "cost")
    return totals.orderBy(F.desc("cost"), "resource_group")


def resource_group_buckets(
    usage: DataFrame, month: AsOf, bucket: str = "day"
) -> DataFrame:
    """Cost per resource group, time bucket and category in one month."""
    start = F.date_trunc(bucket, "usage_date").cast("date")
    bucketed = rows_of_month(usage, month).withColumn("bucket", start)
    return total_by(bucketed, ["resource_group", "bucket", "category"], "cost")


#: Widths of time buckets in seconds, from a minute to ten years.
WIDTHS = (
    60, 300, 900, 1_800, 3_600, 10_800, 21_600, 43_200, 86_400, 172_800, 604_800, 1_209_600, 2_419_200, 7_862_400,
    15_724_800, 31_449_600, 157_248_000, 314_496_000,
)
#: Buckets start at multiples of their width after this Monday.
FIRST_MONDAY = "1970-01-05"


def _seconds(time: Column) -> Column:
    """Seconds since the first Monday of a time without a zone."""
    days = F.date_diff(time, F.lit(FIRST_MONDAY).cast("date")).cast("bigint")
    return days * 86_400 + F.hour(time) * 3_600 + F.minute(time) * 60 + F.floor(F.second(time))


def resource_group_auto_buckets(usage: DataFrame, start: AsOf, end: AsOf, target: int = 24) -> DataFrame:
    """Cost per resource group, time bucket and category from the start to before the end.

    The bucket is the smallest of `WIDTHS` that covers the times seen with at most
    `target` buckets, or the largest one. The times seen are a scalar subquery, so the
    width is settled as the query runs.
    """
    first, after = as_date(start).cast("timestamp_ntz"), as_date(end).cast("timestamp_ntz")
    chosen = usage.filter((F.col("usage_date") >= first) & (F.col("usage_date") < after))
    seen = F.col("usage_date")
    span = chosen.agg((_seconds(F.max(seen)) - _seconds(F.min(seen))).alias("span"))
    rule = F.lit(WIDTHS[-1])
    for width in reversed(WIDTHS[:-1]):
        rule = F.when(F.col("span") <= width * target, width).otherwise(rule)
    width = span.select(rule.cast("bigint")).scalar()
    at = _seconds(seen)
    since = at - F.pmod(at, width)
    day = F.date_add(F.lit(FIRST_MONDAY).cast("date"), F.floor(since / 86_400).cast("int")).cast("timestamp_ntz")
    bucket = day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.pmod(since, F.lit(86_400)).cast("decimal(18,6)"))
    return total_by(chosen.withColumn("bucket", bucket), ["resource_group", "bucket", "category"], "cost")


def categories_by_resource_group(usage: DataFrame, month: AsOf) -> DataFrame:
    return total_by(rows_of_month(usage, month), ["category", "resource_group"], "cost")


def _monthly_means(usage: DataFrame) -> DataFrame:
    """Per month and subscription: total, days seen, last day, mean per day seen."""
    totals = usage.groupBy("month", "subscription").agg(
        amount_sum(usage, "cost").alias("cost"),
        F.countDistinct("day").alias("days"),
        F.max("day").alias("last_day"),
    )
    return totals.withColumn("mean_cost", F.try_divide("cost", "days"))


def mean_per_day(
    usage: DataFrame, months: int = 4, months_of: DataFrame | None = None
) -> DataFrame:
    """Mean daily cost per subscription in the newest months.

    Days without cost do not count for a subscription.
    """
    means = _monthly_means(last_months(usage, months, months_of=months_of))
    means = present(means, "month", "subscription")
    return _keyed(means.select("month", "subscription", "mean_cost"))


def mean_per_day_with_total(
    usage: DataFrame,
    months: int = 4,
    label: str = "Total",
    months_of: DataFrame | None = None,
) -> DataFrame:
    """As above plus, per month, a row that adds the subscription means."""
    means = mean_per_day(usage, months, months_of)
    mean = fine_sum("mean_cost").alias("mean_cost")
    return with_group_total(means, ["report_month"], "subscription", label, mean)


def latest_total_mean(usage: DataFrame, months_of: DataFrame | None = None) -> DataFrame:
    """The added daily means of the newest month, in one row."""
    means = mean_per_day(usage, 1, months_of)
    return means.agg(fine_sum("mean_cost").alias("mean_cost"))


def month_end_forecast(usage: DataFrame) -> DataFrame:
    """Cost so far in the newest month and its expected cost at month end.

    The remaining days count from the last day with data, each at the sum of
    the subscriptions' daily means. Only that month's cost is read, and one row
    comes out.
    """
    means = present(_monthly_means(rows_of_newest(usage)), "month")
    known = F.when(F.col("subscription").isNotNull(), F.col("mean_cost"))
    months = means.groupBy("month").agg(
        fine_sum("cost").alias("current_total"),
        fine_sum(known).alias("daily_mean"),
        F.max("last_day").alias("last_day"),
    )
    newest = months.agg(
        F.max_by(F.struct("current_total", "daily_mean", "last_day"), "month").alias("m")
    ).select("m.*")
    left = days_left_in_month("last_day").alias("remaining_days")
    forecast = newest.select(left, "current_total", "daily_mean")
    expected = F.col("current_total") + F.col("remaining_days") * F.col("daily_mean")
    return forecast.withColumn("month_end_total", expected)


def dense_daily(usage: DataFrame) -> DataFrame:
    """Cost per subscription, category and day seen, missing cells as 0."""
    cells = total_by(usage, ["subscription", "category", "day"], "cost")
    return dense_cells(cells, ["subscription", "category"], "day", "cost")


def dense_daily_largest_first(usage: DataFrame) -> DataFrame:
    """The same rows, categories by their total, then by day."""
    return order_by_group_total(dense_daily(usage), "category", "cost", "day", "subscription")


def daily_moving_mean(usage: DataFrame, start: AsOf, rows: int = 7) -> DataFrame:
    """Daily totals with the mean of the last seven days seen.

    The start date applies after the mean, so the first days shown have one; no
    more days before it are read than they need.
    """
    needed = rows_from_days_before(usage, start, rows - 1)
    means = moving_mean(daily_total(needed), "day", "cost", rows, "mean_cost")
    return means.filter(F.col("day") >= as_date(start))


def top_categories(
    usage: DataFrame, months: int = 4, count: int = 6, months_of: DataFrame | None = None
) -> DataFrame:
    """The largest categories per subscription in each of the newest months."""
    keys = ["subscription", "month"]
    newest = last_months(usage, months, months_of=months_of)
    totals = total_by(newest, [*keys, "category"], "cost")
    top = top_per_group(totals, keys, "cost", "category", count)
    return _keyed(top).withColumn("cost_text", number_text("cost"))


def extent(usage: DataFrame) -> DataFrame:
    """First and last day, total and row count."""
    return usage.agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        amount_sum(usage, "cost").alias("cost"),
        F.count(F.lit(1)).alias("row_count"),
    )


def forecast_text(usage: DataFrame) -> DataFrame:
    """The forecast as three lines of text."""
    days = F.col("remaining_days").cast("string")
    return month_end_forecast(usage).select(
        F.concat(F.lit("Remaining days : "), days).alias("remaining"),
        currency_text("current_total", "Current total : $").alias("current"),
        currency_text("month_end_total", "By end of the month : $").alias("month_end"),
    )
