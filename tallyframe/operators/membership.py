"""Joins that test membership: interns, other groups, home group.

Hours are totalled per person before any join, so a person with a third of all
log lines enters the join as a few rows; give these functions totals, not log
lines. Sides are not forced to broadcast; Spark does that when their size
allows and sorts otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.labels import decode
from tallyframe.operators.filters import outside_group, present

INTERN, HOME, OTHER_GROUP = 1, 2, 3


def member_flags(employees: DataFrame, home_prefix: str) -> DataFrame:
    """One row per employee name: does any of its rows belong to another group?"""
    named = present(employees.select("employee", "grp"), "employee")
    other = F.bool_or(outside_group("grp", home_prefix))
    return named.groupBy("employee").agg(other.alias("other_group"))


def not_in(df: DataFrame, name: str, people: DataFrame) -> DataFrame:
    """Rows whose name is not in the list; null is in it only if listed."""
    listed = people.select("employee").distinct()
    return df.join(listed, df[name].eqNullSafe(listed["employee"]), "left_anti")


def among(df: DataFrame, name: str, people: DataFrame) -> DataFrame:
    listed = people.select("employee").distinct()
    return df.join(listed, df[name].eqNullSafe(listed["employee"]), "left_semi")


def classify(df: DataFrame, employees: DataFrame, home_prefix: str) -> DataFrame:
    """Add `worker_type`: unlisted people first, then other groups, then home.

    `df` holds totals by `employee_name`; the employee side has one row per
    name, so the join keeps the row count.
    """
    flags = member_flags(employees, home_prefix)
    kind = (
        F.when(flags["employee"].isNull(), INTERN)
        .when(flags["other_group"], OTHER_GROUP)
        .otherwise(HOME)
    )
    joined = df.join(flags, df["employee_name"] == flags["employee"], "left")
    return joined.select(*[df[c] for c in df.columns], kind.alias("worker_type"))


def worker_type_name(kind: Column | str, names: Sequence[str]) -> Column:
    """Labels for interns, other groups and everyone else, in that order."""
    intern, other, home = names
    return decode(kind, {INTERN: intern, OTHER_GROUP: other}, home)


def in_named_list(df: DataFrame, people: DataFrame | Sequence[str], inside: bool) -> DataFrame:
    """Rows of people inside or outside a list, given as names or as a frame."""
    if isinstance(people, DataFrame):
        member = among if inside else not_in
        return member(df, "employee_name", people)
    listed = F.coalesce(F.col("employee_name").isin(list(people)), F.lit(False))
    return df.filter(listed if inside else ~listed)
