"""One key holds a third of all rows: right results, and little to shuffle."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas, standins
from tallyframe.checks.base import ACCOUNTS, HOME_PREFIX
from tallyframe.operators.lookup import join_lookup
from tallyframe.operators.ranking import order_by_group_total, top_per_group
from tallyframe.operators.totals import total_by
from tallyframe.plans import cost, workforce

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def hot_log(spark):
    """Every third log line belongs to one person and account."""
    hot = F.pmod(F.xxhash64("employee_name", "date"), F.lit(3)) == 0
    log = standins.eod(spark, FOLDER)
    return log.withColumns(
        {
            "employee_name": F.when(hot, "7").otherwise(F.col("employee_name")),
            "account": F.when(hot, "click").otherwise(F.col("account")),
        }
    ).repartition(8)


def shuffled_rows(df) -> list[int]:
    """Rows written by each shuffle of an executed query."""
    df.collect()
    found = []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = [node.children().apply(i) for i in range(node.children().size())]
        if name == "AdaptiveSparkPlanExec":
            children = [node.executedPlan()]
        elif name.endswith("QueryStageExec"):
            children = [node.plan()]
        for child in children:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_worker_types_with_a_hot_person(spark, hot_log):
    employees = workforce.regular(standins.employee(spark, FOLDER))
    lines = hot_log.filter(F.col("account").isin(*ACCOUNTS))
    people = workforce.classified(lines, employees, HOME_PREFIX)

    group = {r["employee"]: r["grp"] for r in employees.select("employee", "grp").collect()}
    expected = defaultdict(int)
    for r in lines.collect():
        expected[r["account"], r["employee_name"]] += r["hours"] * 60 + r["minutes"]

    def kind(name):
        return 1 if name not in group else 2 if group[name].startswith(HOME_PREFIX) else 3

    got = {
        (r["account"], r["employee_name"]): (r["minutes"], r["worker_type"])
        for r in people.collect()
    }
    assert got == {key: (total, kind(key[1])) for key, total in expected.items()}


def test_hot_person_reaches_the_join_as_a_few_rows(spark, hot_log):
    employees = workforce.regular(standins.employee(spark, FOLDER))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log_rows = hot_log.count()
        lines = hot_log.drop("date")
        rows = shuffled_rows(workforce.classified(lines, employees, HOME_PREFIX))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    groups = 150 * 5
    # The fixture's own repartition moves the log once; after that each task
    # sends one row per person and account it saw, and the join only totals.
    after_fixture = sorted(rows)[:-1]
    assert max(after_fixture) <= 8 * groups < log_rows


def test_totals_of_a_hot_category(spark):
    df = standins.usage(spark, FOLDER)
    hot = F.col("cost") > 300_000
    skewed = df.withColumn("category", F.when(hot, "hot").otherwise(F.col("category")))
    got = {r["category"]: r["cost"] for r in cost.category_total(skewed).collect()}
    expected = defaultdict(int)
    for r in skewed.select("category", "cost").collect():
        expected[r["category"]] += round(r["cost"] * 100)
    assert got == {name: cents / 100 for name, cents in expected.items()}
    assert max(shuffled_rows(cost.category_total(skewed))) <= 6 * 8


def test_top_rows_of_a_hot_group(spark):
    data = [("hot" if i % 3 else "cold", f"c{i:05d}", float(i * 7919 % 10007)) for i in range(9000)]
    df = spark.createDataFrame(data, "grp string, name string, cost double").repartition(8)
    top = top_per_group(total_by(df, ["grp", "name"], "cost"), ["grp"], "cost", "name", 6)
    expected = set()
    for group in ("hot", "cold"):
        ordered = sorted((r for r in data if r[0] == group), key=lambda r: (-r[2], r[1]))
        expected |= {(group, r[1], n) for n, r in enumerate(ordered[:6], start=1)}
    assert {(r["grp"], r["name"], r["position"]) for r in top.collect()} == expected


def test_lookup_join_spreads_a_hot_group(spark):
    data = [("hot" if i % 3 else f"c{i % 50}", i, float(i)) for i in range(60_000)]
    cells = spark.createDataFrame(data, "grp string, id int, cost double")
    totals = cells.groupBy("grp").agg(F.sum("cost").alias("total"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        joined = join_lookup(cells, totals, "grp")
        per_task = joined.withColumn("task", F.spark_partition_id()).groupBy("task").count()
        largest = max(r["count"] for r in per_task.collect())
        ordered = order_by_group_total(cells, "grp", "cost", "id")
        got = [(r["grp"], r["id"]) for r in ordered.collect()]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    # Two thirds of the rows are hot; unsalted, one task would get them all.
    assert largest < len(data) / 2
    expected = defaultdict(float)
    for group, _, value in data:
        expected[group] += value
    assert got == [r[:2] for r in sorted(data, key=lambda r: (-expected[r[0]], r[0], r[1]))]


def test_hot_month_is_written_by_several_tasks(spark, tmp_path):
    from tallyframe.sources import publish

    lines = standins.usage(spark, FOLDER).withColumn("report_month", F.lit("2000-01"))
    many = lines.unionByName(lines).repartition(8)
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        publish.write_by(many, str(tmp_path / "usage"), "report_month")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = list((tmp_path / "usage" / "report_month=2000-01").glob("*.parquet"))
    assert len(files) > 1
    assert spark.read.parquet(str(tmp_path / "usage")).count() == many.count()


def test_schema_of_every_dataset_is_published_by_name():
    assert set(schemas.DATASETS) == {
        "usage", "sponsor", "rates", "holiday", "invoice", "employee", "eod",
    }
