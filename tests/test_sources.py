"""Exports, delimited output and publishing."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe import schemas, standins
from tallyframe.plans import cost
from tallyframe.functions import dates
from tallyframe.sources import datasets, exports, publish, tables

LINES = ["Report", "printed, twice", "Category,Cost,UsageDate"]


def write(path, *lines):
    path.write_text("\n".join([*LINES, *lines]) + "\n")


def test_preamble_quotes_empty_fields_and_patterns(spark, tmp_path):
    write(tmp_path / "Usage 2024-01.csv", '"Disks, fast",1.25,2024-01-03 00:00:00', ",,")
    write(tmp_path / "Usage 2024-02.csv", "printed,2,2024-02-01 10:00:00", "", "Report,x,bad")
    write(tmp_path / "Other 2024-02.csv", "never,9,2024-02-01 00:00:00")
    read = exports.read_after_preamble(
        spark, str(tmp_path), skip=2, name_pattern="Usage 2024-*.csv"
    )
    typed = read.select(
        "Category",
        F.col("Cost").try_cast("decimal(18,6)").alias("Cost"),
        dates.to_timestamp("UsageDate", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )
    assert sorted((tuple(r) for r in typed.collect()), key=str) == sorted(
        [
            ("Disks, fast", Decimal("1.250000"), dt.datetime(2024, 1, 3)),
            (None, None, None),
            ("printed", Decimal("2.000000"), dt.datetime(2024, 2, 1, 10)),
            ("Report", None, None),
        ],
        key=str,
    )
    picked = exports.read_after_preamble(
        spark, str(tmp_path), 2, columns=["Cost"], name_pattern="Usage*"
    )
    assert picked.columns == ["Cost"]


def test_preamble_in_files_of_many_blocks(spark, tmp_path):
    """A file split into many blocks loses its first lines only once."""
    body = [f"c{i},{i},2024-01-01 00:00:00" for i in range(20_000)]
    write(tmp_path / "a.csv", *body)
    write(tmp_path / "b.csv", *body[:10])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        read = exports.read_after_preamble(spark, str(tmp_path), skip=2)
        got = read.groupBy("Category").count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    counts = {r["Category"]: r["count"] for r in got}
    assert len(counts) == 20_000
    assert sorted(counts.values())[-10:] == [2] * 10 and sum(counts.values()) == 20_010


def test_unexpected_header_fails(spark, tmp_path):
    write(tmp_path / "a.csv", "a,1,x", "b,2,y")
    (tmp_path / "b.csv").write_text("one\ntwo\nCost,Category,UsageDate\n1,a,b\n")
    with pytest.raises(Exception, match="header is not"):
        exports.read_after_preamble(spark, str(tmp_path), skip=2).collect()


def test_union_fills_missing_columns_with_null(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("y", True)], "t string, f boolean")
    assert sorted((tuple(r) for r in exports.union_exports(a, b).collect()), key=str) == sorted(
        [(1, "x", None), (None, "y", True)], key=str
    )


@pytest.mark.parametrize("sep", [",", "|"])
def test_delimited_round_trip_is_the_same_bag(spark, tmp_path, sep):
    at = dt.datetime(2024, 1, 1, 9, 30, 0, 123456)
    data = [("a,b", at, 'q"x|', Decimal("7.5"), Decimal(2)), ("a,b", None, None, None, Decimal(0))] * 2
    df = spark.createDataFrame(data, schemas.EOD)
    path = str(tmp_path / "out")
    publish.write_delimited(df, path, sep)
    publish.write_delimited(df, path, sep)
    back = exports.read_csv(spark, path, schemas.EOD, sep=sep)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_publish_replaces_and_checks_the_schema(spark, tmp_path):
    good = spark.createDataFrame([(dt.date(2024, 1, 1), "New year")], schemas.HOLIDAY)
    target = str(tmp_path / "holiday")
    job = publish.Publication("holiday", lambda s: good, target)
    publish.publish(spark, job)
    publish.publish(spark, job)
    assert tables.scan(spark, target).count() == 1
    bad = publish.Publication("holiday", lambda s: good.withColumn("holiday", F.lit("x")), target)
    with pytest.raises(schemas.SchemaMismatch, match="holiday: expected date, got string"):
        publish.publish(spark, bad)
    with pytest.raises(schemas.SchemaMismatch, match="holiday_name: expected string, got nothing"):
        schemas.check_schema(good.drop("holiday_name"), schemas.HOLIDAY)
    assert tables.scan(spark, target).count() == 1


def test_a_failed_publish_leaves_the_old_copy(spark, tmp_path):
    target = str(tmp_path / "holiday")
    good = spark.sql("SELECT DATE'2024-01-01' AS holiday, 'New year' AS holiday_name")
    publish.publish(spark, publish.Publication("holiday", lambda s: good, target))
    fails = good.withColumn("holiday_name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        publish.publish(spark, publish.Publication("holiday", lambda s: fails, target))
    assert tables.scan(spark, target).collect() == good.collect()


def test_new_months_leave_the_others_alone(spark, tmp_path):
    def usage(*days):
        rows = [(day, cost, "x") for day, cost in days]
        named = {"usage_date": F.col("day"), "cost": F.col("cost")}
        return spark.createDataFrame(rows, "day string, cost int, other string").select(
            *[named.get(f.name, F.col("other")).cast(f.dataType).alias(f.name) for f in schemas.USAGE]
        )

    target = str(tmp_path / "usage")

    def put(rows, **more):
        publish.publish(spark, publish.Publication("usage", lambda s: rows, target, "usage_date", **more))

    put(usage(("2024-01-05", 1), ("2024-02-05", 2)))
    put(usage(("2024-02-06", 5), ("2024-03-01", 7)), only_its_months=True)
    months = tables.scan(spark, target).groupBy("report_month").agg(F.sum("cost").cast("int").alias("c"))
    assert {tuple(r) for r in months.collect()} == {("2024-01", 1), ("2024-02", 5), ("2024-03", 7)}


def test_reports_on_published_usage_open_only_their_months(spark, tmp_path):
    source = standins.usage(spark, "/root/testdata/sf0.001", groups=True)
    typed = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.USAGE])
    target = str(tmp_path / "usage")
    publish.publish(spark, publish.Publication("usage", lambda s: typed, target, "usage_date"))
    published = cost.prepare(tables.scan(spark, target))
    assert published.count() == source.count()

    def same(report):
        mine, theirs = report(published).collect(), report(source).collect()
        return sorted(map(str, mine)) == sorted(map(str, theirs))

    def files_read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        found = []

        def walk(node):
            if "FileSourceScan" in node.getClass().getSimpleName():
                found.append(node.metrics().apply("numFiles").value())
            name = node.getClass().getSimpleName()
            inner = {"AdaptiveSparkPlanExec": "executedPlan"}.get(name)
            inner = "plan" if name.endswith("QueryStageExec") else inner
            if inner:
                walk(getattr(node, inner)())
            for i in range(node.children().size()):
                walk(node.children().apply(i))

        walk(plan)
        return found

    months = source.select("month").distinct().count()
    for report, opened in (
        (lambda df: cost.resource_groups(df, "2000-05"), 1),
        (lambda df: cost.daily_total(df, "2001-06-15"), 3),
        (lambda df: cost.daily_by_subscription(df, 2), 1),
        (lambda df: cost.top_categories(df, months=4), 4),
        (cost.monthly_total, months),
    ):
        assert same(report)
        assert files_read(report(published))[0] == opened


def test_table_scan_by_name_and_columns(spark):
    spark.range(3).selectExpr("id", "id * 2 AS twice").createOrReplaceTempView("some_table")
    assert tables.scan(spark, "some_table", ["twice"]).columns == ["twice"]
    assert tables.scan(spark, "some_table").count() == 3


def test_bound_values_are_not_sql(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "v string")
    got = tables.query(spark, "SELECT v FROM {t} WHERE v = :v", {"t": df}, v="x' OR '1'='1")
    assert got.count() == 1


def test_work_folder_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = publish.work_folder(spark), publish.work_folder(spark)
    assert first != second
    if shared:
        assert first.startswith(shared)


def test_missing_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("one\n")
    with pytest.raises(ValueError, match="no file has a header"):
        exports.read_after_preamble(spark, str(tmp_path), skip=2)


def usage_file(path, *lines):
    header = "Region,Category,Subscription,Cost,UsageDate,Resource Group"
    path.write_text("\n".join(["Report", "for a year", header, *lines]) + "\n")


def test_usage_of_several_years_follows_the_rule_of_its_files(spark, tmp_path):
    usage_file(
        tmp_path / "Usage 2024-01.csv",
        "eu,Disks,Main,1.234567,2024-01-03 00:00:00,g1",
        "eu,Disks,Test,bad,2024-01-04 00:00:00,",
    )
    usage_file(tmp_path / "Usage 2024-02.csv", "eu,Disks,,2,2024-02-03 00:00:00,g1")
    usage_file(tmp_path / "Usage of 2023.csv", "eu,Disks,Main,3,2023-02-03 00:00:00,g1")
    usage_file(tmp_path / "Other.csv", "eu,Disks,Main,9,2023-02-03 00:00:00,g1")
    rules = [
        datasets.LabelRule("Usage 2024-*.csv", "Main", "Beta", "Production"),
        datasets.LabelRule("Usage of 2023.csv", "Main", "Production", "Beta"),
    ]
    df = datasets.read_usage(spark, str(tmp_path), rules)
    assert df.schema.simpleString() == schemas.USAGE.simpleString()
    got = df.select("subscription", "cost", "resource_group").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [
            ("Beta", Decimal("1.234567"), "g1"),
            ("Production", None, None),
            ("Production", Decimal("2.000000"), "g1"),
            ("Production", Decimal("3.000000"), "g1"),
        ],
        key=str,
    )


def test_employee_export_flags_and_missing_columns(spark, tmp_path):
    export = datasets.EXPORTS["employee"]
    header = ",".join(reversed([*export.columns, "Extra"]))
    values = {"Employee": "a b", "Resigned": "X", "LastDay": "2024-01-31", "Include": "1.0"}
    lines = [
        ",".join(reversed([*(v.get(c, "") for c in export.columns), "e"]))
        for v in (values, {"Employee": "c", "Resigned": "x"})
    ]
    (tmp_path / "employees.csv").write_text("\n".join([header, *lines]) + "\n")
    df = datasets.read_export(spark, export, str(tmp_path))
    assert df.schema.simpleString() == schemas.EMPLOYEE.simpleString()
    got = df.select("employee", "resigned", "last_day", "include").collect()
    assert [tuple(r) for r in got] == [
        ("a b", True, dt.date(2024, 1, 31), 1),
        ("c", False, None, None),
    ]


def test_every_layout_names_columns_of_its_schema():
    for name, export in datasets.EXPORTS.items():
        assert export.dataset == name
        assert set(export.columns.values()) <= set(export.schema.names)


def test_exports_are_read_by_header_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text('Name,Hours,Date,Account,Minutes\n"a ""b"", c",7.5,2024-01-02,x,30.5\n')
    (tmp_path / "2.csv").write_text("Date,Name,Minutes,Other\n2024-01-03,d,bad,1\n")
    export = datasets.Export(
        "eod",
        {"Name": "employee_name", "Date": "date", "Account": "account", "Hours": "hours", "Minutes": "minutes"},
    )
    got = {r.employee_name: r for r in datasets.read_export(spark, export, str(tmp_path)).collect()}
    assert got['a "b", c'].hours == Decimal("7.5") and got['a "b", c'].minutes == Decimal("30.5")
    assert got["d"].date == dt.datetime(2024, 1, 3) and got["d"].hours is None and got["d"].account is None
    counts = datasets.rejected(spark, export, str(tmp_path)).first()
    assert counts.minutes == 1 and counts.hours == 0
    with pytest.raises(ValueError, match="minutes"):
        datasets.read_strictly(spark, export, str(tmp_path))


def test_line_breaks_in_quoted_fields(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "c"), ('"', "d")], "x string, y string")
    path = str(tmp_path / "out")
    publish.write_delimited(df, path)
    back = exports.read_csv(spark, path, df.schema, multiline=True)
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_double_and_decimal_costs_agree(spark):
    from tallyframe.functions.amounts import amount_sum

    df = spark.range(1000).selectExpr("0.004D AS real", "CAST(0.004 AS DECIMAL(18, 6)) AS exact")
    assert df.agg(amount_sum(df, "real").alias("a"), amount_sum(df, "exact").alias("b")).first() == (4.0, 4.0)


def blocks_of(spark, size):
    """Read files in blocks of about this size."""

    class Blocks:
        def __enter__(self):
            self.old = spark.conf.get("spark.sql.files.maxPartitionBytes")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)

        def __exit__(self, *_):
            spark.conf.set("spark.sql.files.maxPartitionBytes", self.old)

    return Blocks()


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_line_breaks_in_quotes_across_blocks(spark, tmp_path, ending):
    """Records with breaks, blank lines and doubled quotes; some are longer than a block."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(600):
        parts = rng.choices(["x", '"', "\n", "\n\n", ",", 'say "no"\n', "é"], k=rng.randint(0, 30))
        rows.append((str(i), "".join(parts) if i % 97 else "long\n" * 600 + '"', rng.choice(["plain", '""', "a\nb"])))
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if rng.random() < 0.7 or set(v) & set('",\n') else v
    text = ending.join(['It is 5" wide', "free text", 'Id,"Two' + ending + 'lines",Other', *[",".join(map(quoted, r)) for r in rows]])
    (tmp_path / "a.csv").write_text(text + ending, newline="")
    (tmp_path / "b.csv").write_text(ending.join(['It is 5" wide', "", 'Id,"Two' + ending + 'lines",Other', 'z,"1' + ending + '2",']), newline="")
    (tmp_path / "empty.csv").write_text("")
    for size in ("2k", "128m"):
        with blocks_of(spark, size):
            read = exports.read_after_preamble(spark, str(tmp_path), 2, multiline=True)
            got = [tuple(r) for r in read.collect()]
        assert [c.replace("\r", "") for c in read.columns] == ["Id", "Two\nlines", "Other"]
        want = [(a, b or None, c) for a, b, c in rows] + [("z", "1\n2".replace("\n", ending), None)]
        clean = lambda rows: sorted(((a, b if b else None, c if c else None) for a, b, c in rows), key=str)
        assert clean(got) == clean(want)


def test_number_of_jobs_does_not_follow_the_files(spark, tmp_path):
    def jobs(folder, files):
        folder.mkdir()
        for i in range(files):
            names = ("a", "b") if i % 2 else ("B ", "c")
            (folder / f"{i}.csv").write_text(f"{names[0]},{names[1]}\n{i},x\n")
        (folder / "empty.csv").write_text("")
        (folder / "header.csv").write_text("a,d\n")
        spark.sparkContext.setJobGroup(str(folder), "count jobs")
        read = exports.read_by_header(spark, str(folder))
        rows = {tuple(r) for r in read.collect()}
        spark.sparkContext._jsc.clearJobGroup()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(folder))), read.columns, rows

    few, columns, rows = jobs(tmp_path / "few", 3)
    many, _, more = jobs(tmp_path / "many", 40)
    assert many == few <= 12
    assert [c.lower() for c in columns] == ["b", "c", "a", "d"]
    assert rows == {("0", "x", None, None), ("x", None, "1", None), ("2", "x", None, None)} and len(more) == 40


def test_files_without_a_header(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert exports.read_by_header(spark, str(tmp_path), file="_file").count() == 0
    export = datasets.Export("eod", {"Name": "employee_name"})
    assert datasets.read_export(spark, export, str(tmp_path)).schema == schemas.EOD
    (tmp_path / "odd.csv").write_text("﻿Name,,Name\n1,2,3\n")
    assert exports.read_by_header(spark, str(tmp_path)).columns == ["Name0", "_c1", "Name2"]


def test_unreadable_values_are_quarantined_in_one_pass(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Name,Hours,Date,Minutes\na,bad,2024-01-02,1\nb,1,,x y\n")
    (tmp_path / "2.csv").write_text("Name,Hours\nc,2\nd,worse\n")
    names = {"Name": "employee_name", "Hours": "hours", "Date": "date", "Minutes": "minutes"}
    found = datasets.read_checked(spark, datasets.Export("eod", names), str(tmp_path))
    assert found.counts == {"employee_name": 0, "date": 0, "hours": 2, "minutes": 1}
    bad = [(r.file.rsplit("/", 1)[1], r.column, r.raw) for r in found.quarantine.collect()]
    assert sorted(bad) == [("1.csv", "hours", "bad"), ("1.csv", "minutes", "x y"), ("2.csv", "hours", "worse")]
    assert found.rows.schema == schemas.EOD and found.rows.where("hours is null").count() == 2
    # the rows come from the table that the checking pass wrote
    assert not any(f.endswith(".csv") for f in found.rows.inputFiles())
    with pytest.raises(ValueError, match="hours"):
        datasets.read_strictly(spark, datasets.Export("eod", names), str(tmp_path))


def usage_rows(spark, *days):
    rows = [(day, cost, "x") for day, cost in days]
    named = {"usage_date": F.col("day"), "cost": F.col("cost")}
    return spark.createDataFrame(rows, "day string, cost int, other string").select(
        *[named.get(f.name, F.col("other")).cast(f.dataType).alias(f.name) for f in schemas.USAGE]
    )


@pytest.mark.parametrize("step", ["names_in", "_list", "file_system"])
def test_a_kill_at_any_step_leaves_a_readable_target(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "usage")
    job = publish.Publication("usage", lambda s: usage_rows(s, ("2024-01-05", 1)), target, "usage_date")
    publish.publish(spark, job)
    before = sorted(map(str, tables.scan(spark, target).collect()))
    again = publish.Publication("usage", lambda s: usage_rows(s, ("2024-01-06", 9)), target, "usage_date", True)
    kept = getattr(publish, step)
    calls = []

    def killed(*args):
        calls.append(args)
        if len(calls) >= (2 if step == "file_system" else 1):
            raise KeyboardInterrupt
        return kept(*args)

    monkeypatch.setattr(publish, step, killed)
    with pytest.raises(KeyboardInterrupt):
        publish.publish(spark, again)
    monkeypatch.undo()
    assert sorted(map(str, tables.scan(spark, target).collect())) == before
    publish.publish(spark, again)
    assert [r.cost for r in tables.scan(spark, target).collect()] == [9]


def test_old_versions_go_by_age_and_empty_months_stay_readable(spark, tmp_path):
    target = str(tmp_path / "usage")
    for cost_ in (1, 2, 3):
        publish.publish(spark, publish.Publication("usage", lambda s: usage_rows(s, ("2024-01-05", cost_)), target, "usage_date"))
    assert len(tables.names_in(spark, f"{target}/lines")) == 3
    publish.publish(spark, publish.Publication("usage", lambda s: usage_rows(s, ("2024-01-05", 4)).where("false"), target, "usage_date", keep_days=-1))
    assert tables.names_in(spark, f"{target}/current") == ["00000004"] and tables.scan(spark, target).count() == 0
    assert tables.scan(spark, target).drop("report_month").schema == schemas.USAGE
    with pytest.raises(schemas.SchemaMismatch):
        publish.publish(spark, publish.Publication("usage", lambda s: usage_rows(s).drop("cost"), target, "usage_date", True))
    assert tables.scan(spark, target).count() == 0


def test_reports_from_daily_totals(spark, tmp_path):
    """Equal to those from the lines, also after some months are replaced, and without opening the lines."""
    source = standins.usage(spark, "/root/testdata/sf0.001", groups=True)
    lines = source.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.USAGE])
    odd = F.when(F.dayofmonth("usage_date") % 5 > 0, F.col("cost"))  # some days have null costs only
    lines = lines.withColumn("cost", odd.cast(schemas.COST)).withColumn("category", F.when(F.col("cost") > 9000, F.col("category")))
    target = str(tmp_path / "usage")
    put = lambda view, some: publish.publish(spark, publish.Publication("usage", lambda s: view, target, "usage_date", some, cost.daily_rollup))
    put(lines, False)
    changed = lines.where(F.year("usage_date") == 1998).withColumn("cost", (F.col("cost") * 2).cast(schemas.COST))
    put(changed, True)
    published = cost.prepare(tables.scan(spark, target))
    daily = cost.prepare(tables.scan(spark, target, kind=tables.DAILY))
    assert published.count() == lines.count()
    reports = [
        cost.daily_total, cost.monthly_total, cost.category_total, cost.mean_per_day, cost.month_end_forecast, cost.dense_daily,
        cost.daily_by_subscription, cost.top_categories, lambda u: cost.resource_groups(u, "1998-03"),
        lambda u: cost.resource_group_buckets(u, "1998-03"), lambda u: cost.compare_categories(u, ["1-URGENT"]),
        lambda u: cost.categories_by_resource_group(u, "1998-03"), lambda u: cost.month_end_totals(u, "usage_date"),
    ]
    for report in reports:
        mine = report(daily)
        assert sorted(map(str, mine.collect())) == sorted(map(str, report(published).collect()))
    assert all("/daily/" in f for f in cost.monthly_total(daily).inputFiles())
    with pytest.raises(ValueError, match="without daily"):
        publish.publish(spark, publish.Publication("usage", lambda s: changed, target, "usage_date"))
        tables.scan(spark, target, kind=tables.DAILY)


def test_facets_count_under_the_choices_of_the_others(spark):
    from tallyframe.operators import filters

    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "x"), (None, 1, "y"), ("b", 2, "y")], "p string, q int, r string")
    got = {tuple(r) for r in filters.facet_choices(df, {"p": ["a"], "q": [1], "r": []}).collect()}
    assert got == {("p", "a", 1), ("p", "b", 1), ("q", "1", 1), ("q", "2", 1)}
    got = {tuple(r) for r in filters.facet_choices(df, {"p": ["b"], "r": ["x", "y"]}).collect()}
    assert got == {("p", "a", 1), ("p", "b", 2), ("r", "x", 1), ("r", "y", 1)}
    plan = filters.facet_choices(df, {"p": [], "q": [], "r": []})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Expand" in plan


@pytest.mark.parametrize("together", [False, True])
def test_headers_of_files_with_tasks_of_their_own_take_one_scan(spark, tmp_path, monkeypatch, together):
    """Together, two files are read by one task, so that its first lines hold only one's header."""
    lines = {"a": 9_000, "b": 60, "c": 50} if together else {"a": 60, "b": 50}
    for name, n in lines.items():
        (tmp_path / f"{name}.csv").write_text("\n".join(["Report", "k,n", *[f"{name},{i}" for i in range(n)]]) + "\n")
    numbered, kept = [], exports._numbered
    monkeypatch.setattr(exports, "_numbered", lambda *args: numbered.append(args) or kept(*args))
    conf = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "2048"} if together else {}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = exports.read_after_preamble(spark, str(tmp_path), 1).collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    assert sorted(map(tuple, rows)) == sorted((name, str(i)) for name, n in lines.items() for i in range(n))
    # once for the records, and once more for the headers of files that share a task
    assert len(numbered) == (2 if together else 1)


def test_common_forms_of_dates_are_read_as_by_their_format(spark):
    texts = ["2024-02-29", "2023-02-29", "0000-01-01", "0001-01-01", "9999-12-31", "2024-13-01", "2024-2-9", " 2024-02-29", "2024-02-29\n", '"2024-02-29"', "", None]
    texts += [f"{t} {clock}" for t in texts[:5] for clock in ("00:00:00", "23:59:59", "24:00:00", "23:59:60", "1:00:00", "01:00:00.5")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt, form in dates.COMMON_FORMS.items():
        by_format = F.from_csv("t", "stamp timestamp_ntz", {"timestampNTZFormat": fmt, "sep": "\u0001"})["stamp"]
        got = df.select("t", dates.to_timestamp("t", fmt).alias("mine"), by_format.alias("theirs"), F.col("t").rlike(form).alias("cast_"))
        assert got.where("cast_ AND mine IS NOT NULL").count() >= 3
        assert got.where("NOT (mine <=> theirs)").collect() == []
