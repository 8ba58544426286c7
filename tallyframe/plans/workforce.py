"""Hours by account, person and worker type; rosters and head counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.amounts import number_text, sum_in_parts
from tallyframe.functions.dates import AsOf
from tallyframe.functions.labels import override
from tallyframe.functions.work import hours_total, minutes_total, worked_minutes
from tallyframe.operators.filters import (
    any_of,
    differs,
    employment,
    facets,
    in_closed_range,
    present,
)
from tallyframe.operators.membership import (
    HOME,
    classify,
    in_named_list,
    not_in,
    worker_type_name,
)
from tallyframe.operators.ranking import line_numbers
from tallyframe.operators.totals import aggregate_by, share_of_total

LISTING = [
    "employee",
    "resigned",
    "last_day",
    "rank",
    "level",
    "grp",
    "start",
    "account",
    "grp2",
    "company",
    "remarks",
]
ROSTER = ["employee", "rank", "level", "remarks"]


def rename_account(eod: DataFrame, old: str, new: str) -> DataFrame:
    return eod.withColumn("account", override("account", F.col("account") == old, new))


def project_lines(eod: DataFrame, start: AsOf, end: AsOf, accounts: Sequence[str]) -> DataFrame:
    """Log lines of the accounts within the dates."""
    return eod.filter(in_closed_range("date", start, end) & any_of("account", accounts))


def regular(employees: DataFrame) -> DataFrame:
    """Real employees who count in the reports."""
    return employees.filter(differs("company", "DUMMY") & (F.col("include") == 1))


def account_hours(lines: DataFrame) -> DataFrame:
    totals = aggregate_by(lines, ["account"], hours_total().alias("total_hrs"))
    return totals.orderBy("account")


def person_hours(lines: DataFrame) -> DataFrame:
    """Hours per account and employee."""
    return aggregate_by(lines, ["account", "employee_name"], hours_total().alias("total_hrs"))


def _person_minutes(lines: DataFrame, *keys: str) -> DataFrame:
    total = minutes_total().alias("minutes")
    return aggregate_by(lines, [*keys, "employee_name"], total)


def _hours(minutes: Column) -> Column:
    return minutes.cast("double") / F.lit(60)


def classified(lines: DataFrame, employees: DataFrame, home_prefix: str) -> DataFrame:
    """Minutes per account and employee with the worker type.

    The reports below read this small frame; persist it to run several.
    """
    return classify(_person_minutes(lines, "account"), employees, home_prefix)


def interns(lines: DataFrame, employees: DataFrame) -> DataFrame:
    """People with hours who are not in the employee list."""
    people = present(lines.select("employee_name"), "employee_name").distinct()
    return not_in(people, "employee_name", employees)


def hours_of(people: DataFrame, worker_type: int) -> DataFrame:
    """Hours per account and employee of one worker type."""
    chosen = people.filter(F.col("worker_type") == worker_type)
    return chosen.select("account", "employee_name", _hours(F.col("minutes")).alias("total_hrs"))


def hours_per_person(people: DataFrame) -> DataFrame:
    """Hours per employee over all accounts, with the worker type."""
    total = _hours(F.sum("minutes")).alias("total_hrs")
    return people.groupBy("employee_name", "worker_type").agg(total)


def hours_by_type(people: DataFrame, names: Sequence[str]) -> DataFrame:
    """Hours and their share per worker type."""
    totals = people.groupBy("worker_type").agg(F.sum("minutes").cast("double").alias("minutes"))
    named = share_of_total(totals, "minutes").withColumn(
        "type_name", worker_type_name("worker_type", names)
    )
    return named.select(
        "worker_type", "type_name", _hours(F.col("minutes")).alias("total_hrs"), "share"
    )


def heads_by_type(people: DataFrame, names: Sequence[str]) -> DataFrame:
    """People and their share per worker type."""
    heads = people.groupBy("worker_type").agg(F.countDistinct("employee_name").alias("heads"))
    name = worker_type_name("worker_type", names)
    return share_of_total(heads, "heads").withColumn("type_name", name)


def account_share(lines: DataFrame) -> DataFrame:
    """Each account's part of all hours."""
    total = minutes_total().cast("double").alias("minutes")
    totals = share_of_total(aggregate_by(lines, ["account"], total), "minutes")
    return totals.select("account", _hours(F.col("minutes")).alias("total_hrs"), "share")


def distinct_people(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("employee_name").alias("people"))


def _core_minutes(
    people: DataFrame, account: str, core: DataFrame | Sequence[str], inside: bool
) -> DataFrame:
    home = people.filter((F.col("worker_type") == HOME) & (F.col("account") == account))
    return in_named_list(home, core, inside)


def core_hours(
    people: DataFrame, account: str, core: DataFrame | Sequence[str], inside: bool
) -> DataFrame:
    """Home group hours on one account, by people inside or outside a named list."""
    total = _hours(F.sum("minutes")).alias("total_hrs")
    return _core_minutes(people, account, core, inside).groupBy("employee_name").agg(total)


def core_title(
    people: DataFrame,
    account: str,
    core: DataFrame | Sequence[str],
    inside: bool,
    title: str,
) -> DataFrame:
    """Title line: head count and hours of the frame above."""
    totals = _core_minutes(people, account, core, inside).agg(
        F.countDistinct("employee_name").alias("people"),
        _hours(F.coalesce(F.sum("minutes"), F.lit(0))).alias("total_hrs"),
    )
    text = F.concat(
        F.lit(f"{title} ("),
        F.col("people").cast("string"),
        F.lit(" FTEs; "),
        number_text("total_hrs"),
        F.lit(" hrs)"),
    )
    return totals.select("people", "total_hrs", text.alias("title"))


def wide_hours(lines: DataFrame, accounts: Sequence[str]) -> DataFrame:
    """One row per employee, accounts as columns; no hours gives null."""
    named = present(lines, "employee_name", "account")
    pivoted = named.groupBy("employee_name").pivot("account", list(accounts))
    return pivoted.agg(_hours(sum_in_parts(worked_minutes())))


def wide_hours_by_type(
    lines: DataFrame, accounts: Sequence[str], employees: DataFrame, home_prefix: str
) -> DataFrame:
    """The wide table with worker type and line numbers that restart per type."""
    wide = classify(wide_hours(lines, accounts), employees, home_prefix)
    return line_numbers(wide, ["employee_name"], ["worker_type"], grouped=True)


def only(wide: DataFrame, worker_type: int) -> DataFrame:
    return wide.filter(F.col("worker_type") == worker_type).drop("worker_type")


def staff_listing(
    employees: DataFrame, active: bool, left: bool, accounts: Sequence[str] | None = None
) -> DataFrame:
    """Employees by the two check boxes and chosen accounts; None means all.

    A missing account is shown, and chosen, as "nan".
    """
    rows = employees.filter(employment("resigned", active, left)).fillna("nan", ["account"])
    return rows if accounts is None else rows.filter(any_of("account", accounts))


def employee_listing(
    employees: DataFrame,
    active: bool,
    left: bool,
    companies: Sequence[str] | None = None,
    departments: Sequence[str] | None = None,
) -> DataFrame:
    """The wide listing, narrowed to companies and then departments; None means all."""
    chosen = [
        (name, values)
        for name, values in (("company", companies), ("grp2", departments))
        if values is not None
    ]
    rows = staff_listing(employees, active, left).select(*LISTING)
    return facets(rows, *chosen)


def row_count(df: DataFrame) -> DataFrame:
    """The count shown beside a listing."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def roster(employees: DataFrame, company: str, account: str) -> DataFrame:
    active = F.col("resigned") == F.lit(False)
    place = (F.col("company") == company) & (F.col("account") == account)
    return employees.filter(active & place).select(*ROSTER)


def billed_roster(employees: DataFrame) -> DataFrame:
    active = F.col("resigned") == F.lit(False)
    billed = F.col("billed_project").isNotNull()
    return employees.filter(active & billed).select(*ROSTER, "billed_project")


def bench_roster(employees: DataFrame, account: str) -> DataFrame:
    active = F.col("resigned") == F.lit(False)
    free = F.col("billed_project").isNull() & (F.col("account") == account)
    counted = F.col("include") == 1
    return employees.filter(active & free & counted).select(*ROSTER, "activities")


def active_by(employees: DataFrame, key: str, name: str) -> DataFrame:
    """Active employees per company or department, smallest first."""
    active = employees.filter(F.col("resigned") == F.lit(False))
    counts = aggregate_by(active, [key], F.count("employee").alias("employees"))
    return counts.withColumnRenamed(key, name).orderBy("employees", name)


