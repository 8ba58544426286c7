"""Projected revenue, invoices and collections, holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.amounts import (
    CENTS,
    PRODUCT_SCALE,
    amount_sum,
    currency_text,
    exact_mean,
    exact_sum,
    fine_sum,
)
from tallyframe.functions.dates import (
    AsOf,
    iso_day,
    month_key,
    month_start,
    month_year_label,
    same_month,
    same_year,
)
from tallyframe.functions.labels import override
from tallyframe.functions.work import billable, lost_amount, lost_hours
from tallyframe.operators.filters import any_of, none_of, on_or_after, present
from tallyframe.operators.totals import aggregate_by, share_of_total, total_by, with_group_total

# Engagement types as stored, in statement order, and the twelve
# month columns of the statement.
TYPES = ("d", "x", "f")
MONTHS = (
    "January",
    "February",
    "March",
    "April",
    "May",
    "June",
    "July",
    "August",
    "September",
    "October",
    "November",
    "December",
)
TO_DATE = "To Date"
CELLS = tuple(f"{kind}_{side}" for kind in TYPES for side in ("invoiced", "collected"))


def projects(rates: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Rate card rows with a project that is not on the exclusion list."""
    return present(rates, "project").filter(none_of("project", excluded))


def prepare(rates: DataFrame, start: AsOf) -> DataFrame:
    """Rates from a period on, with billable and lost amounts and a label."""
    rates = rates.filter(on_or_after("period", start))
    return rates.withColumns(
        {
            "billable": billable(),
            "lost_hours": lost_hours(),
            "lost_amount": lost_amount(),
            "month": month_year_label("period"),
        }
    )


def projected(rates: DataFrame, as_of: AsOf) -> DataFrame:
    """Billable amount per month; the month of `as_of` is marked."""
    total = exact_sum("billable", PRODUCT_SCALE).alias("billable")
    months = aggregate_by(rates, ["period"], total)
    return months.withColumns(
        {"month": month_year_label("period"), "is_current": same_month("period", as_of)}
    )


def current_month(rates: DataFrame, as_of: AsOf) -> DataFrame:
    """The marked row alone; no row if the month is missing."""
    return projected(rates, as_of).filter("is_current").drop("is_current")


def posts(rates: DataFrame, chosen: Sequence[str], label: str = "Total") -> DataFrame:
    """Full-time posts per period and chosen project, and per period in total."""
    listed = rates.filter(any_of("project", chosen))
    per_project = exact_sum("fte", PRODUCT_SCALE).alias("fte")
    totals = aggregate_by(listed, ["period", "project"], per_project)
    return with_group_total(totals, ["period"], "project", label, fine_sum("fte").alias("fte"))


def billable_hours(
    rates: DataFrame, chosen: Sequence[str], fixed: dict[str, float]
) -> DataFrame:
    """Largest target per period and chosen project; some projects have a fixed one."""
    listed = rates.filter(any_of("project", chosen))
    targets = aggregate_by(listed, ["period", "project"], F.max("target").alias("target"))
    for project, hours in fixed.items():
        value = override("target", F.col("project") == project, hours)
        targets = targets.withColumn("target", value)
    return targets


def invoiced(invoices: DataFrame) -> DataFrame:
    return total_by(invoices, ["inv_yr", "inv_mon", "tx_type"], "inv_amount")


def collected(invoices: DataFrame) -> DataFrame:
    """Unpaid invoices have no payment year and drop out."""
    return total_by(invoices, ["payment_yr", "payment_mon", "tx_type"], "payment_amount")


def type_columns(totals: DataFrame, month: str, amount: str) -> DataFrame:
    """Types as columns, one row per month; a cell is the mean over the years."""
    pivoted = totals.groupBy(month).pivot("tx_type", list(TYPES))
    return pivoted.agg(exact_mean(amount, CENTS))


def _both_sides(invoices: DataFrame) -> DataFrame:
    """Invoiced and collected amounts as rows of their own, from one scan.

    Invoices are first totalled by both months, of which there are few, so the
    split into two rows does not touch every invoice.
    """
    keys = ["inv_yr", "inv_mon", "payment_yr", "payment_mon", "tx_type"]
    totals = invoices.groupBy(*keys).agg(
        amount_sum(invoices, "inv_amount").alias("inv_amount"),
        amount_sum(invoices, "payment_amount").alias("payment_amount"),
    )

    def side(name: str, year: str, month: str, amount: str) -> Column:
        return F.struct(
            F.lit(name).alias("side"),
            F.col(year).alias("yr"),
            F.col(month).alias("mon"),
            F.col(amount).alias("amount"),
        )

    sides = F.array(
        side("invoiced", "inv_yr", "inv_mon", "inv_amount"),
        side("collected", "payment_yr", "payment_mon", "payment_amount"),
    )
    return totals.select("tx_type", F.inline(sides))


def month_cells(invoices: DataFrame) -> DataFrame:
    """Six amounts per month, types x (invoiced, collected), missing ones 0.

    A month found on either side gets a row: both sides are grouped together
    from one scan and spread into columns, which gives the full outer join of
    the two tables without joining them.
    """
    rows = _both_sides(invoices)
    years = total_by(rows, ["side", "yr", "mon", "tx_type"], "amount")
    cell = F.concat_ws("_", "tx_type", "side")
    spread = years.withColumn("cell", cell).groupBy("mon").pivot("cell", list(CELLS))
    return spread.agg(exact_mean("amount", CENTS)).fillna(0.0, list(CELLS))


def statement(invoices: DataFrame) -> DataFrame:
    """Line items as rows in the order of `CELLS`, months as columns, the total to date last.

    A month without any row on either side is null in every line.
    """
    lines = month_cells(invoices).unpivot("mon", list(CELLS), "line", "amount")
    cells = [
        F.max(F.when(F.col("mon") == number, F.col("amount"))).alias(name)
        for number, name in enumerate(MONTHS, start=1)
    ]
    order = F.array_position(F.array(*[F.lit(name) for name in CELLS]), F.col("line"))
    return lines.groupBy("line").agg(*cells, fine_sum("amount").alias(TO_DATE)).orderBy(order)


def to_date_totals(invoices: DataFrame) -> DataFrame:
    """The six amounts over all months."""
    lines = month_cells(invoices).unpivot("mon", list(CELLS), "line", "amount")
    return lines.groupBy("line").agg(fine_sum("amount").alias("amount"))


def statement_text(invoices: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """The statement as shown: whole amounts with the type's currency sign."""
    sign = F.lit("")
    for kind, symbol in symbols.items():
        sign = F.when(F.col("line").startswith(f"{kind}_"), F.lit(symbol)).otherwise(sign)
    texts = [
        F.concat(sign, currency_text(f"`{name}`", "", 0)).alias(name)
        for name in (*MONTHS, TO_DATE)
    ]
    return statement(invoices).select("line", *texts)


def revenue_split(invoices: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Invoiced to date per type in one currency, with each type's share."""
    totals = to_date_totals(invoices).filter(F.col("line").endswith("_invoiced"))
    kind = F.substring_index("line", "_", 1)
    factor = F.lit(1.0)
    for name, rate in rates.items():
        factor = F.when(kind == name, F.lit(float(rate))).otherwise(factor)
    revenue = totals.select(kind.alias("tx_type"), (F.col("amount") * factor).alias("revenue"))
    return share_of_total(revenue, "revenue")


def listing(
    invoices: DataFrame, kinds: Sequence[str], outstanding_only: bool = False
) -> DataFrame:
    """Invoices of the chosen types, by client and date.

    The other columns settle ties, so that the sort can split a client or a
    day with very many rows.
    """
    rows = invoices.filter(any_of("tx_type", kinds))
    if outstanding_only:
        rows = rows.filter(F.col("payment_amount").isNull())
    shown = ["client", "inv_date", "due_date", "inv_amount", "date_paid", "payment_amount"]
    return rows.select(*shown).orderBy(*shown)


def with_date_parts(invoices: DataFrame) -> DataFrame:
    """Invoice and payment years and months, always taken from the dates."""
    return invoices.withColumns(
        {
            "inv_yr": F.year("inv_date"),
            "inv_mon": F.month("inv_date"),
            "payment_yr": F.year("date_paid"),
            "payment_mon": F.month("date_paid"),
        }
    )


def holidays_per_month(holidays: DataFrame, as_of: AsOf) -> DataFrame:
    """Holidays per month in the year of `as_of`."""
    year = holidays.filter(same_year("holiday", as_of))
    months = year.withColumn("month", month_start("holiday"))
    counts = aggregate_by(months, ["month"], F.count("month").alias("holidays"))
    return counts.withColumn("month", month_key("month"))


def holidays_in_month(holidays: DataFrame, as_of: AsOf) -> DataFrame:
    shown = [iso_day("holiday").alias("holiday"), F.col("holiday_name")]
    return holidays.filter(same_month("holiday", as_of)).select(*shown)


