"""Row filters. Each returns a condition or a step ``DataFrame -> DataFrame``.

Conditions are plain comparisons on stored columns, so they reach the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.dates import AsOf, as_month, as_timestamp, col
from tallyframe.functions.labels import starts_with


def none_of(value: Column | str, excluded: Sequence) -> Column:
    """Not in the list; a null value is kept."""
    if not excluded:
        return F.lit(True)
    return ~F.coalesce(col(value).isin(list(excluded)), F.lit(False))


def any_of(value: Column | str, chosen: Sequence) -> Column:
    """In the list; an empty list keeps nothing."""
    return col(value).isin(list(chosen)) if chosen else F.lit(False)


def chosen_or_all(value: Column | str, chosen: Sequence) -> Column:
    """In the list; an empty list keeps every row."""
    return col(value).isin(list(chosen)) if chosen else F.lit(True)


def differs(value: Column | str, other) -> Column:
    """Not equal; null differs from any value."""
    return ~col(value).eqNullSafe(F.lit(other))


def on_or_after(value: Column | str, start: AsOf) -> Column:
    return col(value) >= as_timestamp(start)


def in_closed_range(value: Column | str, start: AsOf, end: AsOf) -> Column:
    """From midnight of the first day to midnight of the last day, both kept.

    Later times on the last day fall out.
    """
    return col(value).between(as_timestamp(start), as_timestamp(end))


def in_month(value: Column | str, month: AsOf) -> Column:
    """Within the month that holds the given day (or is given as 2024-01).

    A range over the stored column, so the scan can skip other months.
    """
    start = as_month(month)
    after = F.add_months(start, 1)
    stored = col(value)
    return (stored >= start.cast("timestamp_ntz")) & (stored < after.cast("timestamp_ntz"))


def except_known_amounts(
    year: str, first_year: int, amount: str, amounts: Sequence, owner: str, owner_name: str
) -> Column:
    """From a year on, without the listed amounts of one owner."""
    listed = F.col(amount).isin(list(amounts)) & (F.col(owner) == owner_name)
    return (F.col(year) >= first_year) & ~F.coalesce(listed, F.lit(False))


def eligible(flag: Column | str, strict: bool) -> Column:
    """Strict keeps flag 0 only; otherwise everything but flag 1, null too."""
    return col(flag) == 0 if strict else differs(flag, 1)


def employment(resigned: Column | str, active: bool, left: bool) -> Column:
    """Rows for the two check boxes "active" and "resigned"; neither keeps nothing."""
    if not (active or left):
        return F.lit(False)
    return differs(resigned, active) | col(resigned).eqNullSafe(F.lit(left))


def outside_group(group: Column | str, prefix: str) -> Column:
    """Group code without the prefix; null counts as outside."""
    return ~starts_with(group, prefix)


def present(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows in which any of the named keys is null."""
    for name in names:
        df = df.filter(F.col(name).isNotNull())
    return df


def facets(df: DataFrame, *steps: tuple[str, Sequence]) -> DataFrame:
    """Apply (column, chosen values) one after the other."""
    for name, chosen in steps:
        df = df.filter(any_of(name, chosen))
    return df


def choices(df: DataFrame, name: str, missing: str | None = None) -> DataFrame:
    """Sorted distinct values for a choice list; null dropped, or shown as `missing`."""
    values = df.select(name).fillna(missing, [name]) if missing is not None else present(df, name)
    return values.select(name).distinct().orderBy(name)


def facet_choices(df: DataFrame, chosen: Mapping[str, Sequence]) -> DataFrame:
    """(facet, value, row_count): every facet's values under the choices of all other facets.

    An empty choice means all. All lists come from one reading: grouping sets give one
    group per facet and value, and each counts the rows that the other facets let through.
    """
    names = list(chosen)
    kept = df.select(*names, *[chosen_or_all(n, chosen[n]).alias(f"_{n}") for n in names])

    def others(name: str) -> Column:
        passes = F.lit(True)
        for other in names:
            if other != name:
                passes = passes & F.coalesce(F.col(f"_{other}"), F.lit(False))
        return F.count_if(passes)

    counted = kept.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        *[F.grouping(n).alias(f"_in_{n}") for n in names], *[others(n).alias(f"_rows_{n}") for n in names]
    )
    picked = [
        F.when(
            F.col(f"_in_{n}") == 0,
            F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value"), F.col(f"_rows_{n}").alias("row_count")),
        )
        for n in names
    ]
    lists = counted.select(F.coalesce(*picked).alias("c")).select("c.*")
    return lists.filter(F.col("value").isNotNull() & (F.col("row_count") > 0))


def column_range(df: DataFrame, first: str, last: str) -> DataFrame:
    """The columns from `first` to `last`, both kept."""
    names = df.columns
    return df.select(names[names.index(first) : names.index(last) + 1])
