"""Hours and billing arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.amounts import not_nan, sum_in_parts


def worked_minutes() -> Column:
    """Minutes of one log line, fractions kept; null when either part is null."""
    return not_nan(F.col("hours").cast("double") * 60 + F.col("minutes").cast("double"))


def worked_hours() -> Column:
    return worked_minutes() / F.lit(60)


def minutes_total() -> Column:
    """Minutes of a group at six decimals, 0 where there are none."""
    return F.coalesce(sum_in_parts(worked_minutes()), F.lit(0))


def hours_total() -> Column:
    return minutes_total().cast("double") / F.lit(60)


def billable() -> Column:
    return F.col("target") * F.col("init_rate")


def lost_hours() -> Column:
    """Null where either part is missing, so that a missing one is never a shortfall."""
    return not_nan(F.col("target") - F.col("billed"))


def lost_amount() -> Column:
    return lost_hours() * F.col("init_rate")


def shortfall() -> Column:
    """Unbilled hours, 0 for people flagged as exempt."""
    return F.when(F.col("indiv_eligibility") == 1, F.lit(0.0)).otherwise(lost_hours())


def shortfall_amount() -> Column:
    return F.when(F.col("indiv_eligibility") == 1, F.lit(0.0)).otherwise(
        F.col("shortfall") * F.col("init_rate")
    )
