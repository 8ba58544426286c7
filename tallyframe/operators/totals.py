"""Grouped totals.

Groups with a null key are dropped and an all-null group totals 0. Every total
is an algebraic aggregate, so Spark combines it before the shuffle and a hot
key sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.amounts import amount_sum, fine_sum
from tallyframe.operators.filters import present


def total_by(df: DataFrame, keys: Sequence[str], amount: str, name: str | None = None) -> DataFrame:
    """Sum of a stored amount per group."""
    return aggregate_by(df, keys, amount_sum(df, amount).alias(name or amount))


def aggregate_by(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    return present(df, *keys).groupBy(*keys).agg(*aggregates)


def with_group_total(
    df: DataFrame, group: Sequence[str], member: str, label: str, *aggregates: Column
) -> DataFrame:
    """Aggregates per (group, member) plus one row per group labelled `label`.

    Grouping sets copy every input row, so give it rows already totalled by
    (group, member).
    """
    keys = [F.col(name) for name in (*group, member)]
    grouped = present(df, *group, member).groupingSets([keys, keys[:-1]], *keys)
    named = F.when(F.grouping(member) == 1, F.lit(label)).otherwise(F.col(member))
    counted = grouped.agg(named.alias("_label"), *aggregates)
    return counted.drop(member).withColumnRenamed("_label", member)


def share_of_total(df: DataFrame, amount: str, name: str = "share") -> DataFrame:
    """Add each row's part of the overall sum.

    The sum is a scalar subquery, not a window over everything, so no task
    holds the whole frame.
    """
    overall = df.agg(fine_sum(amount)).scalar()
    return df.withColumn(name, F.try_divide(F.col(amount).cast("double"), overall))
