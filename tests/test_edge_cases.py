"""Small frames for what the given tables cannot show: nulls, gaps, ties, bounds."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe.functions import amounts, dates, labels
from tallyframe.operators import calendar, filters, membership, ranking, totals
from tallyframe.plans import cost, revenue, sponsorship, utilisation, workforce


def stamp(day: str, time: str = "00:00") -> dt.datetime:
    return dt.datetime.fromisoformat(f"{day}T{time}")


def rows(df):
    return [tuple(r) for r in df.collect()]


def usage(spark, lines):
    """Lines of (day, category, subscription, resource group, cost)."""
    data = [(stamp(day), c, s, g, None if x is None else Decimal(str(x))) for day, c, s, g, x in lines]
    return cost.prepare(spark.createDataFrame(data, schemas.USAGE))


# Null keys and empty groups


def test_null_keys_drop_and_all_null_group_totals_zero(spark):
    df = spark.createDataFrame(
        [("a", Decimal("1.10")), (None, Decimal("5.00")), ("b", None), ("a", Decimal("2.20"))],
        "k string, cost decimal(18,2)",
    )
    assert sorted(rows(totals.total_by(df, ["k"], "cost"))) == [("a", 3.3), ("b", 0.0)]


def test_costs_below_a_cent_are_not_lost(spark):
    df = usage(spark, [("2024-01-01", "vm", "Beta", "g", "0.000125")] * 8)
    assert rows(cost.category_total(df)) == [("vm", 0.001)]


def test_reports_on_empty_usage(spark):
    df = usage(spark, [])
    assert cost.monthly_total(df).count() == 0
    assert cost.month_end_totals(df, "usage_date").count() == 0
    assert cost.dense_daily(df).count() == 0
    assert cost.top_categories(df).count() == 0
    assert cost.daily_moving_mean(df, "2024-01-01").count() == 0
    assert cost.mean_per_day_with_total(df).count() == 0
    assert rows(cost.extent(df)) == [(None, None, 0.0, 0)]


# Months


def test_missing_months_become_zero(spark):
    df = usage(spark, [("2024-01-10", "a", "Beta", "g", 5), ("2024-03-02", "a", "Beta", "g", 7)])
    got = sorted(rows(cost.month_end_totals(df, "usage_date")))
    assert got == [
        (dt.date(2024, 1, 31), 5.0),
        (dt.date(2024, 2, 29), 0.0),
        (dt.date(2024, 3, 31), 7.0),
    ]


def test_last_months_counts_months_that_occur(spark):
    df = usage(
        spark,
        [("2023-11-30", "a", "Beta", "g", 1), ("2024-01-10", "a", "Beta", "g", 2),
         ("2024-03-02", "a", "Beta", "g", 4)],
    )
    assert calendar.last_months(df, 2).count() == 2
    assert calendar.last_months(df, 9).count() == 3
    assert rows(calendar.newest_months(df).select("position", "month").orderBy("position"))[1] == (
        2,
        dt.date(2024, 1, 1),
    )


@pytest.mark.parametrize(
    ("day", "left", "first", "last"),
    [
        ("2024-02-01", 28, "2024-01-01", "2024-01-31"),
        ("2024-03-31", 0, "2024-02-01", "2024-02-29"),
        ("2023-01-15", 16, "2022-12-01", "2022-12-31"),
    ],
)
def test_month_bounds(spark, day, left, first, last):
    df = spark.createDataFrame([(dt.date.fromisoformat(day),)], "d date")
    got = df.select(
        dates.days_left_in_month("d"), dates.previous_month_start("d"), dates.previous_month_end("d")
    )
    assert rows(got) == [(left, dt.date.fromisoformat(first), dt.date.fromisoformat(last))]


def test_unreadable_dates_become_null(spark):
    texts = [("2024-13-01",), ("Jan 5, 2024",), ("2024-01-05 10:30:00",)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(dates.to_timestamp("t")).collect()] == [
        None, None, stamp("2024-01-05", "10:30"),
    ]
    assert [r[0] for r in df.select(dates.to_timestamp("t", "MMM d, yyyy")).collect()] == [
        None, stamp("2024-01-05"), None,
    ]


# Filters


def test_closed_range_ends_at_midnight(spark):
    df = spark.createDataFrame(
        [(stamp("2024-01-31"),), (stamp("2024-01-31", "10:00"),), (stamp("2024-01-01"),)],
        "d timestamp_ntz",
    )
    assert df.filter(filters.in_closed_range("d", "20240101", "20240131")).count() == 2


def test_lists_and_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")

    def kept(condition):
        return [r[0] for r in df.filter(condition).collect()]

    assert kept(filters.none_of("v", ["a"])) == ["b", None]
    assert kept(filters.none_of("v", [])) == ["a", "b", None]
    assert kept(filters.any_of("v", ["a"])) == ["a"]
    assert kept(filters.any_of("v", [])) == []
    assert kept(filters.chosen_or_all("v", [])) == ["a", "b", None]
    assert kept(filters.differs("v", "a")) == ["b", None]
    assert kept(filters.outside_group("v", "a")) == ["b", None]


@pytest.mark.parametrize(("strict", "kept"), [(True, [0]), (False, [0, None])])
def test_eligibility_modes(spark, strict, kept):
    df = spark.createDataFrame([(0,), (1,), (None,)], "flag int")
    assert [r[0] for r in df.filter(filters.eligible("flag", strict)).collect()] == kept


@pytest.mark.parametrize(
    ("active", "left", "kept"),
    [
        (True, False, [False, None]),
        (False, True, [True, None]),
        (True, True, [True, False, None]),
        (False, False, []),
    ],
)
def test_employment_truth_table(spark, active, left, kept):
    df = spark.createDataFrame([(True,), (False,), (None,)], "resigned boolean")
    got = df.filter(filters.employment("resigned", active, left)).collect()
    assert [r[0] for r in got] == kept


def test_known_amounts_keep_other_owners_and_nulls(spark):
    df = spark.createDataFrame(
        [(2024, Decimal("1.50"), "A"), (2024, Decimal("1.50"), "B"), (2024, None, "A"),
         (2023, Decimal("9.00"), "B"), (2024, Decimal("2.50"), "A")],
        "yr int, amount decimal(18,2), owner string",
    )
    kept = df.filter(
        filters.except_known_amounts("yr", 2024, "amount", (1.5, 2.25), "owner", "A")
    )
    assert rows(kept) == [
        (2024, Decimal("1.50"), "B"), (2024, None, "A"), (2024, Decimal("2.50"), "A"),
    ]


def test_recodes_send_null_to_the_other_label(spark):
    values = [("old", "x"), ("new", "x"), ("new", None), ("else", "x")]
    df = spark.createDataFrame(values, "s string, v string")
    rules = {"new": ("x", "A", "B"), "old": ("x", "B", "A")}
    got = df.select(labels.two_way_by_source("v", "s", rules)).collect()
    assert [r[0] for r in got] == ["B", "A", "B", "x"]
    assert [r[0] for r in df.select(labels.flag("v", "x")).collect()] == [True, True, False, True]


# Amounts


def test_short_numbers(spark):
    cases = [
        (1000.0, "1000.0"), (1000.01, "1.0 K"), (999_999.0, "1000.0 K"), (1_000_000.0, "1.0 M"),
        (1_250_000.0, "1.2 M"), (1_000_000_000.0, "1.0 B"), (1_234_567_890_123.0, "1234.6 B"),
        (0.35, "0.35"), (-20_000_000.5, "-20000000.5"), (350.0, "350.0"), (1350.0, "1.4 K"),
    ]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v double")
    assert [r[0] for r in df.select(amounts.short_number("v")).collect()] == [t for _, t in cases]


def test_bands_are_open_where_they_should_be(spark):
    data = [(stamp("2024-01-01"), None, None, None, name, Decimal(x))
            for name, x in (("one", "1.0"), ("mid", "19.999999"), ("twenty", "20.0"))]
    df = sponsorship.prepare(spark.createDataFrame(data, schemas.SPONSOR))
    assert [r[0] for r in sponsorship.large_resources(df).collect()] == ["twenty"]
    assert [r[0] for r in sponsorship.small_resources(df).collect()] == ["mid"]


# Windows and ranks


@pytest.mark.parametrize(("days", "means"), [(6, 0), (7, 1), (9, 3)])
def test_moving_mean_needs_seven_rows(spark, days, means):
    # Every second day, so that a mean over days would differ from one over rows.
    lines = [(str(dt.date(2024, 1, 1) + dt.timedelta(2 * i)), "a", "Beta", "g", i) for i in range(days)]
    got = cost.daily_moving_mean(usage(spark, lines), "2024-01-01").orderBy("day").collect()
    present = [r["mean_cost"] for r in got if r["mean_cost"] is not None]
    assert present == [float(i + 3) for i in range(means)]
    assert len(got) == days


def test_start_date_applies_after_the_moving_mean(spark):
    lines = [(str(dt.date(2024, 1, 1) + dt.timedelta(i)), "a", "Beta", "g", i) for i in range(8)]
    got = cost.daily_moving_mean(usage(spark, lines), "2024-01-08").collect()
    assert [r["mean_cost"] for r in got] == [4.0]


def test_top_categories_settle_ties_by_name(spark):
    lines = [("2024-01-01", c, "Beta", "g", 10) for c in "hgfedcba"]
    got = cost.top_categories(usage(spark, lines), count=6)
    assert sorted(r["category"] for r in got.collect()) == list("abcdef")


def test_forecast_by_hand(spark):
    lines = [
        ("2024-01-31", "a", "Beta", "g", 100),
        ("2024-02-01", "a", "Beta", "g", 10),
        ("2024-02-02", "a", "Beta", "g", 20),
        ("2024-02-02", "b", "Production", "g", 5),
        ("2024-02-02", "b", None, "g", 1),
    ]
    got = cost.month_end_forecast(usage(spark, lines)).collect()[0]
    assert got.asDict() == {
        "remaining_days": 27,
        "current_total": 36.0,
        "daily_mean": 20.0,
        "month_end_total": 36.0 + 27 * 20.0,
    }


@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_line_numbers_with_nulls_ties_and_a_hot_subset(spark, ranges):
    data = [("hot" if i % 3 else f"g{i % 4}", f"n{(i * 37) % 101:03d}", i) for i in range(300)]
    data += [(None, None, 1000), (None, "x", 1001), ("hot", None, 1002)]
    df = spark.createDataFrame(data, "grp string, name string, id int").repartition(7)

    def key(r):
        return (r[1] is not None, r[1] or "", r[2])

    got = ranking.line_numbers(df, ["name", "id"], ["grp"], ranges=ranges).collect()
    expected = {}
    for group in {r[0] for r in data}:
        ordered = sorted((r for r in data if r[0] == group), key=key)
        expected.update({r: n for n, r in enumerate(ordered, start=1)})
    assert {(r["grp"], r["name"], r["id"]): r["line_no"] for r in got} == expected

    overall = ranking.line_numbers(df, ["name", "id"], ranges=ranges).collect()
    assert [r["id"] for r in sorted(overall, key=lambda r: r["line_no"])] == [
        r[2] for r in sorted(data, key=key)
    ]


def test_line_numbers_of_nothing(spark):
    df = spark.createDataFrame([], "name string")
    assert ranking.line_numbers(df, ["name"]).count() == 0


# Invoices


def invoices(spark):
    lines = [
        # month 2 in two years; no invoice in January; type x never collected
        ("c", "2023-02-10", 100, "2023-01-05", 40, "d"),
        ("c", "2024-02-10", 300, "2024-01-05", 60, "d"),
        ("c", "2024-03-10", 50, None, None, "x"),
        ("c", "2024-03-11", 25, "2024-04-01", 25, "f"),
    ]
    data = [
        (client, dt.date.fromisoformat(day), None, Decimal(amount),
         paid and dt.date.fromisoformat(paid), None if sum_ is None else Decimal(sum_), kind,
         None, None, None, None)
        for client, day, amount, paid, sum_, kind in lines
    ]
    return revenue.with_date_parts(spark.createDataFrame(data, schemas.INVOICE))


def test_month_cells_take_the_mean_over_years_and_join_both_sides(spark):
    got = {r["mon"]: r for r in revenue.month_cells(invoices(spark)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[2]["d_invoiced"] == 200.0 and got[2]["d_collected"] == 0.0
    assert got[1]["d_collected"] == 50.0 and got[1]["d_invoiced"] == 0.0
    assert got[3]["x_invoiced"] == 50.0 and got[3]["x_collected"] == 0.0
    assert got[4]["f_collected"] == 25.0


def test_statement_months_follow_the_key_not_the_position(spark):
    got = {r["line"]: r for r in revenue.statement(invoices(spark)).collect()}
    assert set(got) == set(revenue.CELLS)
    assert got["d_invoiced"]["January"] == 0.0
    assert got["d_invoiced"]["February"] == 200.0
    assert got["d_invoiced"]["May"] is None
    assert got["d_invoiced"]["To Date"] == 200.0


def test_outstanding_listing(spark):
    got = revenue.listing(invoices(spark), ["d", "x", "f"], outstanding_only=True).collect()
    assert [r["inv_amount"] for r in got] == [Decimal("50.00")]


def test_no_row_for_a_month_without_revenue(spark):
    data = [("e", "p", 2.0, 1.0, 2.0, stamp("2024-01-01"), "r", "l", 10.0, 8.0, 0)]
    rates = revenue.prepare(spark.createDataFrame(data, schemas.RATES), "2024-01-01")
    assert revenue.current_month(rates, "2024-05-20").count() == 0
    january = (stamp("2024-01-01"), 20.0, "January 2024")
    assert rows(revenue.current_month(rates, "2024-01-20")) == [january]


def test_count_before_and_rows_after_the_eligibility_mode(spark):
    data = [("e", "p", 2.0, 1.0, 2.0, stamp("2024-01-01"), "r", "l", 10.0, billed, flag)
            for billed, flag in ((8.0, 0), (8.0, None), (8.0, 1), (12.0, 0), (None, 0))]
    rates = spark.createDataFrame(data, schemas.RATES)
    short = utilisation.short_rows(rates, "20240101", "20240131")
    assert rows(utilisation.times_short(short, "e")) == [(2,)]
    lost = utilisation.lost(rates, "20240101", "20240131", strict=True)
    assert utilisation.drill_down(lost, "e").count() == 1
    assert set(rows(utilisation.per_project(lost))) == {(None, True, 4.0), ("p", False, 4.0)}


# People


def people_frames(spark):
    employees = spark.createDataFrame(
        [Row(employee="h", grp="X1"), Row(employee="o", grp="Y"), Row(employee="n", grp=None),
         Row(employee="b", grp="X2"), Row(employee="b", grp="Y"), Row(employee=None, grp="X1")],
        "employee string, grp string",
    )
    lines = [("i", 1), ("h", 2), ("o", 3), ("n", 4), ("b", 5), (None, 6), ("h", 7)]
    eod = spark.createDataFrame(
        [(n, stamp("2024-01-02"), "acc", Decimal(h), Decimal(30)) for n, h in lines], schemas.EOD
    )
    return employees, eod


def test_worker_types_are_disjoint_and_cover_everyone(spark):
    employees, eod = people_frames(spark)
    people = workforce.classified(eod, employees, "X")
    assert {r["employee_name"]: r["worker_type"] for r in people.collect()} == {
        "i": membership.INTERN,
        "h": membership.HOME,
        "o": membership.OTHER_GROUP,
        "n": membership.OTHER_GROUP,
        "b": membership.OTHER_GROUP,
    }
    parts = [workforce.hours_of(people, kind) for kind in (1, 2, 3)]
    assert sum(p.count() for p in parts) == people.count()
    assert sorted(rows(workforce.interns(eod, employees))) == [("i",)]


def test_not_a_number_counts_as_missing(spark):
    nan = float("nan")
    data = [("e", "p", 2.0, fte, 2.0, stamp("2024-01-01"), "r", "l", target, billed, 0)
            for fte, target, billed in ((nan, nan, 8.0), (0.5, 10.0, nan), (0.25, 10.0, 8.0))]
    rates = spark.createDataFrame(data, schemas.RATES)
    lost = utilisation.lost(rates, "20240101", "20240131")
    assert set(rows(utilisation.per_project(lost))) == {(None, True, 4.0), ("p", False, 4.0)}
    posts = revenue.posts(revenue.prepare(rates, "2024-01-01"), ["p"])
    assert {r["project"]: r["fte"] for r in posts.collect()} == {"p": 0.75, "Total": 0.75}
    projected = revenue.projected(revenue.prepare(rates, "2024-01-01"), "2024-01-01")
    assert [r["billable"] for r in projected.collect()] == [40.0]


def test_shares_add_to_one(spark):
    employees, eod = people_frames(spark)
    people = workforce.classified(eod, employees, "X")
    for frame in (
        workforce.hours_by_type(people, ("a", "b", "c")),
        workforce.heads_by_type(people, ("a", "b", "c")),
        workforce.account_share(eod),
    ):
        assert sum(r["share"] for r in frame.collect()) == pytest.approx(1.0)


@pytest.mark.parametrize("as_frame", [True, False])
def test_named_list_inside_and_outside(spark, as_frame):
    employees, eod = people_frames(spark)
    people = workforce.classified(eod, employees, "X")
    names = spark.createDataFrame([("h",), ("h",)], "employee string") if as_frame else ["h"]
    assert rows(workforce.core_hours(people, "acc", names, True)) == [("h", 10.0)]
    assert rows(workforce.core_hours(people, "acc", names, False)) == []


def test_missing_account_hours_stay_null(spark):
    _, eod = people_frames(spark)
    wide = workforce.wide_hours(eod, ["acc", "other"])
    assert wide.columns == ["employee_name", "acc", "other"]
    assert all(r["other"] is None for r in wide.collect())


# Properties over the given tables


def test_dense_grid_keeps_the_total(spark):
    from tallyframe import standins

    df = standins.usage(spark, "/root/testdata/sf0.001")
    dense = cost.dense_daily(df)
    days = df.select("day").distinct().count()
    assert dense.count() == days * 2 * 5
    assert dense.agg(amounts.fine_sum("cost")).first() == df.agg(
        amounts.exact_sum("cost")
    ).first()


def test_total_row_is_the_sum_of_its_parts(spark):
    from tallyframe import standins

    df = cost.mean_per_day_with_total(standins.usage(spark, "/root/testdata/sf0.001"))
    by_month = df.groupBy("report_month").agg(
        F.sum(F.when(F.col("subscription") == "Total", F.col("mean_cost"))).alias("total"),
        F.sum(F.when(F.col("subscription") != "Total", F.col("mean_cost"))).alias("parts"),
    )
    for row in by_month.collect():
        assert row["total"] == pytest.approx(row["parts"])


def test_months_count_over_all_usage_when_groups_are_chosen(spark):
    df = usage(
        spark,
        [("2024-01-10", "a", "Beta", "old", 1), ("2024-02-10", "a", "Beta", "new", 2),
         ("2024-03-10", "a", "Beta", "new", 4)],
    )
    chosen = cost.of_groups(df, ["old"])
    assert cost.top_categories(chosen, months=2, months_of=df).count() == 0
    assert cost.top_categories(chosen, months=2).count() == 1
    assert cost.daily_by_subscription(chosen, 1, months_of=df).count() == 0
    assert cost.of_groups(df).count() == 3


@pytest.mark.parametrize("start", ["2024-03-10", "2024-03-11", "2023-01-01", "2025-01-01"])
def test_moving_mean_reads_only_the_days_it_needs(spark, start):
    """Gaps in the days: the rows of the last six days seen before the start are enough."""
    days = [dt.datetime(2024, 3, d, h) for d in (1, 2, 3, 5, 8, 9, 10, 12, 20, 21, 22, 30) for h in (0, 13)]
    usage = cost.prepare(spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "usage_date timestamp_ntz, cost double"))
    got = [tuple(r) for r in cost.daily_moving_mean(usage, start).orderBy("day").collect()]
    daily = {}
    for i, d in enumerate(days):
        daily[d.date()] = daily.get(d.date(), 0) + i
    seen = sorted(daily)
    means = [(d, daily[d], sum(daily[x] for x in seen[i - 6 : i + 1]) / 7 if i >= 6 else None) for i, d in enumerate(seen)]
    assert got == [m for m in means if m[0] >= dt.date.fromisoformat(start)]


def test_totals_of_large_and_odd_amounts(spark):
    from tallyframe.functions.amounts import amount_sum

    def total(*values):
        df = spark.createDataFrame([(v,) for v in values], "cost double")
        return df.agg(amount_sum(df, "cost")).first()[0]

    assert total(5e12, 1.0, 3e16) == 30005000000000001.0 or total(5e12, 1.0, 3e16) == float(30005000000000001)
    assert total(1e12, 0.25) == 1000000000000.25 and total(1e15, -1e15, 0.000001) == 0.000001
    assert total(float("nan"), None, 2.5) == 2.5 and total(None) == 0.0 and total(-7.654321, -1e13) == -10000000000007.654321
    assert total(*[0.1] * 1000) == 100.0
    with pytest.raises(Exception, match="OVERFLOW"):
        total(1e19)
