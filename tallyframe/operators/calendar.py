"""Months of a frame, missing cells and moving means.

A published dataset carries its month as the partition column `report_month`.
Where a frame has that column, month conditions name it too, beside the range
over the stored date, so that Spark skips the other months' files.

Distinct months and days are bounded by the calendar (12 and 366 a year)
whatever the table size, which is why a window over them may run in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.dates import AsOf, as_date, as_month, month_key, month_start
from tallyframe.operators.filters import in_month, on_or_after, present


PARTITION = "report_month"


def rows_of_month(df: DataFrame, month: AsOf, day: str = "usage_date") -> DataFrame:
    """Rows of the month that holds the given day (or is given as 2024-01)."""
    if PARTITION in df.columns:
        df = df.filter(F.col(PARTITION) == month_key(as_month(month)))
    return df.filter(in_month(day, month))


def rows_since(df: DataFrame, start: AsOf, day: str = "usage_date") -> DataFrame:
    """Rows on or after a day."""
    if PARTITION in df.columns:
        df = df.filter(F.col(PARTITION) >= month_key(as_date(start)))
    return df.filter(on_or_after(day, start))


def newest_months(df: DataFrame, day: str = "usage_date") -> DataFrame:
    """Distinct months, as month starts, with their rank, 1 for the newest."""
    if PARTITION in df.columns:
        keys = present(df.select(PARTITION), PARTITION).distinct()
        months = keys.select(F.concat(PARTITION, F.lit("-01")).cast("date").alias("month"))
    else:
        months = present(df, day).select(month_start(day).alias("month")).distinct()
    return months.withColumn("position", F.dense_rank().over(Window.orderBy(F.desc("month"))))


def _day_type(df: DataFrame, day: str) -> T.DataType:
    """The type of a stored date, for bounds that are compared with it without a cast.

    Only a comparison of the bare column with a bare subquery reaches the scan.
    """
    kind = df.schema[day].dataType
    dated = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return kind if dated else T.TimestampNTZType()


def rows_of_newest(
    df: DataFrame, position: int = 1, day: str = "usage_date", months_of: DataFrame | None = None
) -> DataFrame:
    """Rows of the month at a position in the newest-first list, of `months_of` if given."""
    source = df if months_of is None else months_of
    found = newest_months(source, day).filter(F.col("position") == position)
    kind = _day_type(df, day)
    start = found.select(F.col("month").cast(kind)).scalar()
    after = found.select(F.add_months("month", 1).cast(kind)).scalar()
    if PARTITION in df.columns:
        df = df.filter(F.col(PARTITION) == found.select(month_key("month")).scalar())
    return df.filter((F.col(day) >= start) & (F.col(day) < after))


def last_months(
    df: DataFrame, count: int, day: str = "usage_date", months_of: DataFrame | None = None
) -> DataFrame:
    """Rows of the newest `count` distinct months, of `months_of` if given.

    One comparison with the oldest month kept; no join.
    """
    source = df if months_of is None else months_of
    kept = newest_months(source, day).filter(F.col("position") <= count)
    oldest = kept.agg(F.min("month").alias("month"))
    if PARTITION in df.columns:
        df = df.filter(F.col(PARTITION) >= oldest.select(month_key("month")).scalar())
    return df.filter(F.col(day) >= oldest.select(F.col("month").cast(_day_type(df, day))).scalar())


def _zero(df: DataFrame, amount: str) -> Column:
    """An aggregate that is 0.

    It reads the amounts, so that this branch has the same input plan as the
    real rows and Spark runs that plan, scan and shuffle, once for both.
    """
    return (F.sum(amount) * 0).cast(df.schema[amount].dataType).alias(amount)


def fill_months(df: DataFrame, month: str, amount: str) -> DataFrame:
    """Add the months between the first and the last as rows with amount 0.

    `month` holds month starts, one row each. Zero rows are added and summed,
    which needs no join.
    """
    span = df.agg(
        F.sequence(F.min(month), F.max(month), F.expr("interval 1 month")).alias(month),
        _zero(df, amount),
    )
    spine = span.withColumn(month, F.explode(month))
    both = df.select(month, amount).unionByName(spine)
    return both.groupBy(month).agg(F.sum(amount).alias(amount))


#: Values of a key in one row of the grid.
BLOCK_VALUES = 1_024


def dense_cells(df: DataFrame, dims: Sequence[str], day: str, amount: str) -> DataFrame:
    """Every combination of the values seen, missing cells as amount 0.

    `df` holds one row per cell that occurs. The distinct values of each key are dealt
    into blocks of about `BLOCK_VALUES` by their hash. From the days on, each row is
    copied once per block of the next key, met with that block by an equi-join and
    expanded by its values, so no row holds all values of a key and the copies are few.
    The zero rows are then summed with the real ones. The result is the product of the
    key counts by definition, so bound the date span first.
    """

    def values(key: str) -> DataFrame:
        return present(df, key).groupBy(key).agg(_zero(df, amount))

    copies = max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    grid = values(day)
    for name in dims:
        # the zeros are carried along, so that all branches read the same columns of `df`
        seen = values(name)
        blocks = F.ceil(F.count(F.lit(1)) / BLOCK_VALUES) + F.coalesce(F.sum(amount), F.lit(0))
        count = seen.agg(F.greatest(blocks, F.lit(1)).cast("bigint")).scalar()
        held = seen.groupBy(F.pmod(F.xxhash64(name), count).alias("_block")).agg(
            F.collect_list(name).alias("_values"), F.sum(amount).alias("_zero")
        )
        # both sides name the block and one of its copies, so that few blocks still go to many tasks
        deal = F.pmod(F.xxhash64(*[c for c in grid.columns if c != amount]), F.lit(copies))
        every = F.sequence(F.lit(0).cast("bigint"), count - 1)
        rows = grid.withColumn("_block", F.explode(every))
        # generated, so that Spark does not filter by it below the shared shuffle
        rows = rows.withColumn("_at", F.explode(F.array(F.col("_block") * copies + deal))).drop("_block")
        each = F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))
        blocks = held.withColumn("_at", F.explode(F.transform(each, lambda c: F.col("_block") * copies + c)))
        met = rows.join(blocks.drop("_block"), "_at")
        grid = met.withColumns({name: F.explode("_values"), amount: F.col(amount) + F.col("_zero")})
        grid = grid.drop("_at", "_values", "_zero")
    zeros = grid.withColumn(amount, F.col(amount).cast(df.schema[amount].dataType))
    both = df.select(*dims, day, amount).unionByName(zeros.select(*dims, day, amount))
    return both.groupBy(*dims, day).agg(F.sum(amount).alias(amount))


def rows_from_days_before(df: DataFrame, start: AsOf, days: int, day: str = "usage_date") -> DataFrame:
    """Rows since a start date, and those of the `days` distinct days before it.

    The first of these days is found first, from the dates alone, and compared with
    the stored date as a scalar, so the scan skips what lies before.
    """
    if days < 1:
        return rows_since(df, start, day)
    kind = _day_type(df, day)
    first = F.to_date(as_date(start))
    earlier = present(df, day).filter(F.col(day) < first.cast(kind)).select(F.to_date(day).alias("d")).distinct()
    kept = earlier.orderBy(F.desc("d")).limit(days)
    bound = kept.agg(F.coalesce(F.min("d"), first).alias("d"))
    if PARTITION in df.columns:
        df = df.filter(F.col(PARTITION) >= bound.select(month_key("d")).scalar())
    return df.filter(F.col(day) >= bound.select(F.col("d").cast(kind)).scalar())


def moving_mean(daily: DataFrame, day: str, amount: str, rows: int, name: str) -> DataFrame:
    """Mean over the last `rows` rows, not days, null until that many exist."""
    window = Window.orderBy(day).rowsBetween(-(rows - 1), Window.currentRow)
    total = F.sum(F.col(amount).cast("decimal(28,6)")).over(window).cast("double")
    filled = F.count(F.lit(1)).over(window) >= rows
    return daily.withColumn(name, F.when(filled, total / F.lit(rows)))
