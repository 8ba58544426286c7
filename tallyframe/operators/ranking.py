"""Ranks, line numbers and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.amounts import fine_sum
from tallyframe.operators.lookup import join_lookup


def top_per_group(
    df: DataFrame, group: Sequence[str], amount: str, tie_break: str, count: int
) -> DataFrame:
    """The `count` largest rows of each group, ties settled by `tie_break`.

    Spark cuts each task's rows to `count` per group before the shuffle.
    """
    window = Window.partitionBy(*group).orderBy(F.desc(amount), tie_break)
    ranked = df.withColumn("position", F.row_number().over(window))
    return ranked.filter(F.col("position") <= count)


def order_by_group_total(df: DataFrame, group: str, amount: str, *then: str) -> DataFrame:
    """Rows ordered by their group's total, largest first.

    `df` should already be grouped; the totals are joined back.
    """
    # the key that is joined is never null, so that the null group stays
    key = F.struct(F.col(group))
    totals = df.groupBy(key.alias("_group")).agg(fine_sum(amount).alias("group_total"))
    joined = join_lookup(df.withColumn("_group", key), totals, "_group").drop("_group")
    return joined.orderBy(F.desc("group_total"), group, *then)


#: Keys of the sketch that line numbers split their ranges by, and the most ranges it gives.
SKETCH, MOST_RANGES = 16_384, 2_048
#: Rows that a range aims at.
RANGE_ROWS = 1_000_000


def _splits(df: DataFrame, key: Column, mark: Column, ranges: int | None, range_rows: int) -> Column:
    """The keys at which ranges end, as a scalar array in ascending order.

    The sketch is the keys with the smallest hashes, which tasks gather on their
    own and merge. It is an even sample, so its quantiles are those of all rows, and
    the largest hash in it tells how many rows there are: it lies as far up among
    all hashes as the sketch is large among the rows.
    """
    marked = df.select(key.alias("key"), mark.alias("mark"))
    found = marked.orderBy("mark", "key").limit(SKETCH).agg(
        F.sort_array(F.collect_list("key")).alias("keys"),
        (F.max("mark").cast("double") / 2.0**64 + 0.5).alias("reach"),
    )
    kept = F.size("keys")
    if ranges:
        wanted = F.lit(ranges)
    else:
        rows = F.when(kept < SKETCH, kept.cast("double")).otherwise(kept / F.col("reach"))
        wanted = F.least(F.ceil(rows / range_rows), F.lit(MOST_RANGES)).cast("int")
    cuts = F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1)))
    chosen = F.transform(cuts, lambda i: F.get("keys", F.floor(i * kept / wanted).cast("int")))
    none = F.slice(F.col("keys"), 1, 0)
    return found.select(F.when((wanted > 1) & (kept > 0), chosen).otherwise(none)).scalar()


def line_numbers(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "line_no",
    ranges: int | None = None,
    grouped: bool = False,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Number the rows 1, 2, 3 .. in ascending order, anew in each subset.

    A plain row_number over the whole listing would run in one task. Here the rows
    fall into ranges of the sort key, about one per `range_rows` rows (or `ranges` of
    them); each is numbered on its own and shifted by the rows in the ranges before
    it. Any splits give the same numbers. End `order` with a unique column, so that
    one repeated key cannot fill a range; then a subset with a third of all rows falls
    into a third of the ranges.

    The rows are read twice: for the sketch, from a plain scan just the sort key, and
    for the shuffle into ranges, which both the counts and the listing read. With
    `grouped`, for rows that come out of a shuffle themselves, the sketch reads the
    same columns, so that Spark runs what is below that shuffle once.
    """
    key = F.struct(*[F.col(c) for c in order])
    whole = F.xxhash64(*df.columns)
    splits = _splits(df, key, whole if grouped else F.xxhash64(key), ranges, range_rows)

    # Binary search for the number of splits below the key; beyond the last there is none.
    steps = [1 << i for i in reversed(range((ranges or MOST_RANGES).bit_length()))]

    def below(at: Column, step: Column) -> Column:
        return F.when(F.get("_splits", at + step - 1) < key, at + step).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(i) for i in steps]), F.lit(0), below)
    # generated, since Spark would carry the search itself over to the other side of the join
    ranged = df.withColumn("_splits", splits).withColumn("_range", F.explode(F.array(found)))
    # a struct is never null, also where a part of it is
    placed = ranged.withColumn("_slot", F.struct(*within, "_range")).drop("_splits", "_range").repartition("_slot")

    # counting in two halves of the hash keeps all columns, so that both sides read one shuffle
    counts = placed.groupBy("_slot").agg((F.count_if(whole < 0) + F.count_if(whole >= 0)).alias("_rows"))
    earlier = Window.partitionBy(*[F.col("_slot").getField(c) for c in within]).orderBy(F.col("_slot").getField("_range"))
    shift = F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_slot", F.coalesce(shift, F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_slot").orderBy(*order)
    numbered = placed.withColumn("_nth", F.row_number().over(inside)).join(shifts, "_slot")
    return numbered.select((F.col("_shift") + F.col("_nth")).alias(name), *df.columns)
