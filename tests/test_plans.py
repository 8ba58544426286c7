"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from tallyframe import standins
from tallyframe.checks import registry
from tallyframe.functions import dates
from tallyframe.operators import filters
from tallyframe.operators.calendar import last_months
from tallyframe.plans import cost

FOLDER = "/root/testdata/sf0.001"
QUERIES = registry.queries()
# These write and read files while the plan is built.
WRITING = {name for name in QUERIES if re.match(r"s[3-8]_", name)}
# Windows over everything are allowed where the calendar or a fixed number of
# ranges bounds the rows: months, days, line number shifts.
BOUNDED_WINDOWS = {"w1", "w2", "w3", "w4", "w7", "p12", "a2", "a16", "a17", "a36", "j6", "f19"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_python_no_products_no_single_task_windows(built, name):
    plan = plan_of(built(name))
    for node in ("Python", "Pandas", "Cartesian", "BroadcastNestedLoop"):
        assert node not in plan
    if name.split("_")[0] not in BOUNDED_WINDOWS:
        assert not re.search(r"(?<!Exchange )Window \[", plan)


def final_plan(df) -> str:
    """The plan as executed, without the initial plans listed under each part."""
    df.collect()
    kept, skip_below = [], None
    for line in plan_of(df).splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if skip_below is not None and depth >= skip_below:
            continue
        skip_below = depth if "== Initial Plan ==" in line else None
        if skip_below is None:
            kept.append(line)
    return "\n".join(kept)


def test_filters_and_columns_reach_the_scan(spark):
    df = standins.usage(spark, FOLDER)
    plan = plan_of(cost.daily_total(df.filter(filters.in_month("usage_date", "2000-05"))))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(o_orderdate,2000-05-01T00:00" in pushed
    assert "LessThan(o_orderdate,2000-06-01T00:00" in pushed
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_totals_combine_before_the_shuffle(spark):
    plan = plan_of(cost.category_total(standins.usage(spark, FOLDER)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan.split("Exchange hashpartitioning")[1]


@pytest.mark.parametrize(
    "name",
    [
        "a4_cost_per_month_end_with_gaps",
        "a37_dense_daily_cost",
        "w6_daily_cost_by_largest_category",
        "w5_share_of_hours",
        "a38_revenue_split",
        "j6_wide_hours_all",
    ],
)
def test_one_scan_feeds_all_branches(spark, name):
    plan = final_plan(QUERIES[name](spark, FOLDER))
    assert plan.count("FileScan parquet") == 1
    assert "ReusedExchange" in plan or "ReusedSubquery" in plan or "Subquery" not in plan


def test_numbered_hours_scan_the_log_once(spark):
    plan = final_plan(QUERIES["j6_wide_hours_by_type"](spark, FOLDER))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert sum("ts#" in line for line in scans) == 1


def test_last_months_needs_no_join(spark):
    plan = plan_of(last_months(standins.usage(spark, FOLDER), 3))
    assert "Join" not in plan


@pytest.mark.parametrize(
    "report", [lambda u: last_months(u, 3), cost.daily_by_subscription, cost.month_end_forecast, cost.top_categories]
)
def test_newest_months_are_compared_with_the_stored_date(spark, report):
    """A bare column against a bare subquery, which Spark puts into the scan when it runs."""
    plan = plan_of(report(standins.usage(spark, FOLDER)))
    assert re.search(r"DataFilters: \[[^]]*\(o_orderdate#\d+ >= (Reused)?Subquery", plan)


@pytest.mark.parametrize("condition", [dates.same_year, dates.same_month])
def test_calendar_filters_reach_the_scan(spark, tmp_path, condition):
    path = str(tmp_path / "holiday")
    spark.sql("SELECT DATE'2024-01-01' AS holiday").write.parquet(path)
    plan = plan_of(spark.read.parquet(path).filter(condition("holiday", "2024-05-03")))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(holiday,2024-0" in pushed and "LessThan(holiday,202" in pushed


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["w2_top_resources_per_month"](spark, FOLDER))
    assert "WindowGroupLimit" in plan


def test_joins_do_not_force_a_broadcast(spark):
    """With no size allowed for broadcasts the joins fall back to sorting."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("j1_interns", "j4_worker_types", "a33_core_hours", "a7_cost_per_resource_group"):
            df = QUERIES[name](spark, FOLDER)
            assert "Broadcast" not in final_plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["a37_dense_daily_cost", "w6_largest_category_first"])
def test_no_row_of_the_grid_holds_a_whole_key(spark, name, monkeypatch):
    """Values are gathered by block only, and a block is a bounded part of a key."""
    from tallyframe.operators import calendar

    plan = final_plan(QUERIES[name](spark, FOLDER))
    assert "collect_set" not in plan
    gathers = [line for line in plan.splitlines() if "collect_list" in line]
    assert gathers and not any("keys=[]" in line for line in gathers)

    monkeypatch.setattr(calendar, "BLOCK_VALUES", 3)
    data = [(f"s{i % 7}", f"c{i % 11}", i % 13, 1.5) for i in range(0, 400, 3)] + [("s0", "c0", 0, float(10**13))]
    df = spark.createDataFrame(data, "subscription string, category string, day int, cost double")
    cells = df.groupBy("subscription", "category", "day").agg({"cost": "sum"}).withColumnRenamed("sum(cost)", "cost")
    dense = calendar.dense_cells(cells, ["subscription", "category"], "day", "cost").collect()
    expected = {(s, c, d): 0.0 for s in {r[0] for r in data} for c in {r[1] for r in data} for d in {r[2] for r in data}}
    for s, c, d, value in data:
        expected[s, c, d] += value
    assert len(dense) == len(expected) and {tuple(r)[:3]: r["cost"] for r in dense} == expected


def test_line_numbers_read_their_input_twice(spark):
    """Once for the sketch, once for the shuffle that counts and listing share."""
    plan = final_plan(QUERIES["w4_line_numbers"](spark, FOLDER))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "c_custkey" in line]
    assert len(scans) == 2 and "ReusedExchange" in plan


def test_ranges_follow_the_rows(spark, monkeypatch):
    """A key with a third of all rows is spread over several ranges, and their number grows with the rows."""
    from pyspark.sql import functions as F

    from tallyframe.operators import ranking

    monkeypatch.setattr(ranking, "SKETCH", 400)
    spread = []
    for rows in (2_000, 20_000):
        df = spark.range(rows, numPartitions=8).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS k", "id")
        numbered = ranking.line_numbers(df, ["k", "id"], ["k"], range_rows=500)
        wrong = numbered.groupBy("k").agg(F.max("line_no").alias("m"), F.count("*").alias("n"), F.min("line_no").alias("l"))
        assert wrong.where("m <> n or l <> 1").count() == 0
        splits = ranking._splits(df, F.struct("k", "id"), F.xxhash64(F.struct("k", "id")), None, 500)
        found = spark.range(1).select(splits.alias("s")).first()["s"]
        assert [tuple(x) for x in found] == sorted(tuple(x) for x in found)
        spread.append((len(found), sum(x["k"] == "hot" for x in found)))
    (few, few_hot), (many, many_hot) = spread
    assert few_hot >= 1 and many > 5 * few and many_hot > many / 5
    assert rows / 500 * 0.7 < many < rows / 500 * 1.4
