"""Exact sums, and amounts as text.

Adding doubles gives another last digit for every task layout. All totals here
add whole units (cents, or wholes and millionths) in longs, which stays inside
generated code and gives the same result on any cluster. A value that no long
holds fails the query (Spark's ANSI mode, its default) and never drops out.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.dates import col

CENTS = 2
PRODUCT_SCALE = 4  # hours x rate, fractions of a full-time post


def whole_units(value: Column | str, scale: int = CENTS) -> Column:
    """A double in units of its last decimal, null if it is not a number.

    rint stays in generated arithmetic, where round goes through decimals.
    """
    return not_nan(F.rint(col(value) * 10**scale)).cast("bigint")


def not_nan(value: Column | str) -> Column:
    """A double, null if it is not a number."""
    return F.nanvl(col(value).cast("double"), F.lit(None).cast("double"))


def exact_sum(value: Column | str, scale: int = CENTS) -> Column:
    """Sum at `scale` decimals; 0 where every value is null."""
    return F.coalesce(F.sum(whole_units(value, scale)), F.lit(0)) / F.lit(10**scale)


def sum_in_parts(value: Column) -> Column:
    """Sum of doubles at six decimals, as a decimal; null where every value is null.

    Wholes and millionths are added as two longs, so amounts of any size a long
    holds count in full, and put together once per group.
    """
    whole = F.rint(value)
    wholes = F.sum(whole.cast("bigint")).cast("decimal(19,0)")
    millionths = F.sum(F.rint((value - whole) * 1_000_000).cast("bigint")).cast("decimal(19,0)")
    return wholes + millionths * F.lit(Decimal("0.000001"))


def amount_sum(df: DataFrame, name: str) -> Column:
    """Sum of a stored amount as a double, exact at the column's own scale.

    Doubles count at the six decimals of a cost. Decimals finer than a cent use
    Spark's decimal sum, since their units could outgrow a long; decimals of two
    places add cents.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, T.DecimalType):
        return F.coalesce(sum_in_parts(not_nan(name)), F.lit(0)).cast("double")
    if kind.scale > CENTS:
        return F.coalesce(F.sum(name), F.lit(0)).cast("double")
    cents = F.sum((F.col(name) * 10**CENTS).cast("bigint"))
    return F.coalesce(cents, F.lit(0)) / F.lit(10**CENTS)


def exact_mean(value: Column | str, scale: int = CENTS) -> Column:
    """Mean of the values present, null when there is none."""
    units = whole_units(value, scale)
    return F.try_divide(F.sum(units) / F.lit(10**scale), F.count(units))


def fine_sum(value: Column | str) -> Column:
    """Sum of totals or means, exact at six decimals.

    For frames that are already grouped; on raw rows `exact_sum` is faster.
    """
    total = F.sum(col(value).cast("decimal(28,6)"))
    return F.coalesce(total, F.lit(0)).cast("double")


def currency_text(value: Column | str, symbol: str = "$", decimals: int = 2) -> Column:
    """1234.5 as $1,234.50."""
    return F.concat(F.lit(symbol), number_text(value, decimals))


def number_text(value: Column | str, decimals: int = 2) -> Column:
    return F.format_number(col(value).cast("double"), decimals)


def plain_text(value: Column | str) -> Column:
    """A number as text, without an exponent for large negative ones."""
    number = col(value).cast("double")
    digits = F.regexp_replace(number.cast("decimal(38,6)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(number <= -10_000_000, digits).otherwise(number.cast("string"))


def short_number(value: Column | str) -> Column:
    """1234567 as 1.2 M. B and M start at one, K only above one thousand."""
    number = col(value).cast("double")

    def scaled(unit: int, suffix: str) -> Column:
        digits = F.translate(F.format_number(number / unit, 1), ",", "")
        return F.concat(digits, F.lit(suffix))

    return (
        F.when(number >= 1_000_000_000, scaled(1_000_000_000, " B"))
        .when(number >= 1_000_000, scaled(1_000_000, " M"))
        .when(number > 1_000, scaled(1_000, " K"))
        .otherwise(plain_text(number))
    )


def convert(value: Column | str, rate: float) -> Column:
    """An amount in another currency at a fixed rate."""
    return col(value) * F.lit(rate)
