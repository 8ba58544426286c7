"""Scans, exports read back, and published datasets.

Each query writes the given tables as files to a new shared folder and reads
them back through the sources.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe import schemas
from tallyframe import standins as data
from tallyframe.checks.base import Check
from tallyframe.checks.projections import STATUS_RULES
from tallyframe.checks.views import over
from tallyframe.functions import dates, labels
from tallyframe.functions.amounts import exact_sum
from tallyframe.plans import cost
from tallyframe.sources import datasets, exports, publish, tables

EXPORT_TIME = "yyyy-MM-dd HH:mm:ss"
USAGE_SQL = """
    SELECT strftime(usage_date, '%Y-%m-%d %H:%M:%S') AS usage_date, category, subscription,
      resource_group, CAST(cost AS DOUBLE) AS cost FROM usage"""
PREAMBLE = ["Usage report", '"All rights, reserved"']
EOD_SQL = """
    SELECT employee_name, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, account,
      CAST(hours AS DOUBLE) AS hours, CAST(minutes AS DOUBLE) AS minutes
    FROM eod"""


def typed(df: DataFrame, schema) -> DataFrame:
    """The stand-in with the exact types of the dataset."""
    known = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def usage(s: SparkSession, d: str) -> DataFrame:
    return typed(data.usage(s, d, groups=True), schemas.USAGE)


def _monthly_files(s: SparkSession, d: str) -> DataFrame:
    """Exports in monthly folders by name pattern; the label rule depends on the years."""
    folder = publish.work_folder(s)
    month = dates.month_key("o_orderdate").alias("report_month")
    lines = data.table(s, d, "orders").select("o_orderkey", "o_orderstatus", month)
    lines.hint("rebalance", "report_month").write.partitionBy("report_month").options(header=True).csv(folder)

    def years(pattern: str, source: str) -> DataFrame:
        read = exports.read_by_header(s, f"{folder}/report_month={pattern}", name_pattern="*.csv", file="file")
        return read.withColumn("source", F.lit(source))

    both = exports.union_exports(years("2*", "new"), years("1*", "old"))
    label = labels.two_way_by_source("o_orderstatus", "source", STATUS_RULES)
    return both.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        F.regexp_extract("file", "report_month=([^/]+)", 1).alias("report_month"),
        label.alias("subscription"),
    )


def _csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    folder = publish.work_folder(s)
    export = datasets.EXPORTS["sponsor"]
    lines = typed(data.sponsor(s, d, names=True, regions=True), schemas.SPONSOR)
    publish.write_delimited(_export_names(lines, export), folder)
    read = datasets.read_strictly(s, export, folder, name_pattern="*.csv")
    totals = read.groupBy("service_name", "service_type", "service_region")
    return totals.agg(
        exact_sum("cost").alias("cost"),
        F.min("date").alias("first_date"),
        F.countDistinct("service_resource").alias("resources"),
        F.count(F.lit(1)).alias("lines"),
    )


def _export_names(df: DataFrame, export: datasets.Export) -> DataFrame:
    """The dataset as an export names it."""
    return df.select(*[F.col(mine).alias(theirs) for theirs, mine in export.columns.items()])


def _write_with_preamble(lines: DataFrame, folder: str, preamble: list[str], by: Column | None = None) -> None:
    """Text files that start with preamble lines and a header, one set per value of `by` if given.

    Every task's rows (of a value) are a file with its own first lines, so that neither a
    whole table nor a hot value is written by one task. The lines are computed once.
    """
    quoted = [f"`{name}`" for name in lines.columns]
    whole = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    options = {"timestampNTZFormat": EXPORT_TIME, **exports.DIALECT, **whole}
    body = F.to_csv(F.struct(*quoted), options).alias("value")
    # the row that a file starts with carries its first lines
    head = F.lit("\n".join([*preamble, ",".join(lines.columns), ""]))
    value = F.when(F.col("first"), F.concat(head, "value")).otherwise(F.col("value")).alias("value")
    if by is None:
        # ids count each task's rows from 0 in their lower 33 bits, and a task writes one file
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        rows, parts = lines.select(body, first.alias("first")), []
    else:
        parts = ["part", "file_no"]
        rows = lines.select(body, by.alias("part"), F.spark_partition_id().alias("file_no"))
        order = Window.partitionBy(*parts).orderBy(F.lit(0))
        rows = rows.withColumn("first", F.row_number().over(order) == 1)
    rows.select(value, *parts).write.partitionBy(*parts).option("maxRecordsPerFile", 0).text(folder)


def _preamble_files(s: SparkSession, d: str) -> DataFrame:
    folder = publish.work_folder(s)
    export = datasets.EXPORTS["usage"]
    lines = _export_names(usage(s, d), export)
    _write_with_preamble(lines, folder, PREAMBLE, F.year("UsageDate"))
    return datasets.read_export(s, export, f"{folder}/*/*", name_pattern="*.txt")


def _broken_lines(s: SparkSession, d: str) -> DataFrame:
    """Categories with a line break and quotes, after a preamble with an odd quote."""
    folder = publish.work_folder(s)
    export = datasets.EXPORTS["usage"]
    odd = F.concat("category", F.lit('\n"'), F.col("subscription"), F.lit('", more\n'))
    lines = _export_names(usage(s, d).withColumn("category", odd), export)
    _write_with_preamble(lines, folder, ['Usage of 5" disks', "for a year"], F.year("UsageDate"))
    return datasets.read_export(s, export, f"{folder}/*/*", name_pattern="*.txt", multiline=True)


def _dates_at_ingest(s: SparkSession, d: str) -> DataFrame:
    folder = publish.work_folder(s)
    days = data.holiday(s, d)
    text = days.withColumn("holiday", F.date_format("holiday", "MMM d, yyyy"))
    publish.write_delimited(text, folder, "|")
    layout = schemas.T.StructType(
        [schemas.T.StructField(name, schemas.T.StringType()) for name in schemas.HOLIDAY.names]
    )
    read = exports.read_csv(s, folder, layout, sep="|")
    parsed = dates.to_timestamp("holiday", "MMM d, yyyy")
    return read.select(parsed.cast("date").alias("holiday"), "holiday_name")


def _delimited_sink(sep: str) -> Check:
    def run(s: SparkSession, d: str) -> DataFrame:
        folder = publish.work_folder(s)
        lines = typed(data.eod(s, d), schemas.EOD)
        publish.write_delimited(lines, folder, sep)
        return exports.read_csv(s, folder, schemas.EOD, sep=sep)

    return Check(run, over("eod", EOD_SQL))


def _views(d: str) -> dict[str, Callable[[SparkSession], DataFrame]]:
    return {
        "usage": lambda s: usage(s, d),
        "rates": lambda s: typed(data.rates(s, d), schemas.RATES),
        "holiday": lambda s: data.holiday(s, d),
        "invoice": lambda s: typed(data.invoice(s, d, clients=True), schemas.INVOICE),
        "employee": lambda s: typed(data.employee(s, d), schemas.EMPLOYEE),
        "eod": lambda s: typed(data.eod(s, d), schemas.EOD),
    }


def _publish_twice(s: SparkSession, d: str) -> DataFrame:
    """Six datasets published twice; the second copy replaces the first."""
    folder = publish.work_folder(s)
    views = _views(d)
    jobs = [
        publish.Publication(name, read, f"{folder}/{name}", "usage_date" if name == "usage" else None)
        for name, read in views.items()
    ]
    publish.publish_all(s, jobs)
    targets = publish.publish_all(s, jobs)
    return exports.union_exports(
        *[_summary(tables.scan(s, target), name) for name, target in targets.items()]
    )


def _summary(published: DataFrame, name: str) -> DataFrame:
    number, flagged, day = SUMMARY[name]
    return published.agg(
        F.lit(name).alias("dataset"),
        F.count(F.lit(1)).alias("row_count"),
        F.expr(f"CAST(sum({number}) AS DOUBLE)").alias("total"),
        F.count(flagged).alias("present"),
        F.max(F.expr(day)).cast("date").alias("last_day"),
    )


def _ingest(s: SparkSession, d: str) -> DataFrame:
    """Six datasets written as exports, read back by their layout and published.

    They run at the same time, so that one's last tasks and small steps leave no core idle.
    """
    folder = publish.work_folder(s)

    def run(name: str, view: Callable[[SparkSession], DataFrame]) -> DataFrame:
        export, path = datasets.EXPORTS[name], f"{folder}/{name}-export"
        lines = _export_names(view(s), export)
        for column in export.schema:
            if column.dataType == schemas.T.BooleanType():
                theirs = next(t for t, mine in export.columns.items() if mine == column.name)
                lines = lines.withColumn(theirs, F.when(F.col(theirs), export.flag_mark))
        if export.skip:
            _write_with_preamble(lines, path, PREAMBLE[: export.skip])
        else:
            publish.write_delimited(lines, path, export.sep)
        job = publish.Publication(
            name,
            lambda s, export=export, path=path: datasets.read_export(s, export, path),
            f"{folder}/{name}",
        )
        published = tables.scan(s, publish.publish(s, job), schema=job.schema)
        return _summary(published, name)

    views = _views(d)
    with ThreadPoolExecutor(len(views)) as pool:
        # each thread gets a copy of this one's local properties, which it must not share
        results = [pool.submit(inheritable_thread_target(s)(run), *view) for view in views.items()]
    return exports.union_exports(*[result.result() for result in results])


def _daily_totals(s: SparkSession, d: str) -> DataFrame:
    """Usage published by month with its daily totals; the months since 1998 are then published anew."""
    target = f"{publish.work_folder(s)}/usage"
    views = (lambda s: usage(s, d), lambda s: usage(s, d).where("usage_date >= TIMESTAMP_NTZ'1998-01-01 00:00:00'"))
    for view, some in zip(views, (False, True)):
        publish.publish(s, publish.Publication("usage", view, target, "usage_date", some, cost.daily_rollup))
    return cost.prepare(tables.scan(s, target, kind=tables.DAILY))


# Per dataset: a number to total, a column to count, and a date, as SQL of both engines.
SUMMARY = {
    "usage": ("cost", "resource_group", "usage_date"),
    "rates": ("target", "billed", "period"),
    "holiday": ("day(holiday)", "holiday_name", "holiday"),
    "invoice": ("payment_amount", "date_paid", "due_date"),
    "employee": ("include", "billed_project", "CAST(NULL AS DATE)"),
    "eod": ("minutes", "employee_name", "date"),
}

SUMMARY_SQL = over(
    " ".join(SUMMARY),
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, count(*) AS row_count,
          CAST(sum({number}) AS DOUBLE) AS total, count({flagged}) AS present,
          strftime(max({day}), '%Y-%m-%d') AS last_day FROM {name}"""
        for name, (number, flagged, day) in SUMMARY.items()
    ),
)


CHECKS = {
    "s1_table_scan": Check(
        lambda s, d: tables.scan(s, f"{d}/orders.parquet", schema=data.TABLES["orders"]),
        """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
          strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
    ),
    "s2_projected_scan": Check(
        lambda s, d: data.invoice(s, d, clients=True).select(*schemas.INVOICE.names),
        over(
            "invoice",
            """SELECT client, strftime(inv_date, '%Y-%m-%d') AS inv_date,
              strftime(due_date, '%Y-%m-%d') AS due_date, CAST(inv_amount AS DOUBLE) AS inv_amount,
              strftime(date_paid, '%Y-%m-%d') AS date_paid,
              CAST(payment_amount AS DOUBLE) AS payment_amount, tx_type,
              inv_yr, inv_mon, payment_yr, payment_mon FROM invoice""",
        ),
    ),
    "s3_monthly_files": Check(
        _monthly_files,
        """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS report_month,
          CASE WHEN (o_orderstatus = 'F') = (year(o_orderdate) >= 2000) THEN 'Beta'
            ELSE 'Production' END AS subscription FROM orders""",
    ),
    "s4_csv_with_header": Check(
        _csv_round_trip,
        over(
            "sponsor",
            """SELECT service_name, service_type, service_region,
              CAST(sum(cost) AS DOUBLE) AS cost,
              strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first_date,
              count(DISTINCT service_resource) AS resources, count(*) AS lines
            FROM sponsor GROUP BY service_name, service_type, service_region""",
        ),
    ),
    "s5_files_after_preamble": Check(_preamble_files, over("usage", USAGE_SQL)),
    "s5_line_breaks_in_quotes": Check(
        _broken_lines,
        over(
            "usage",
            USAGE_SQL.replace("category,", "category || chr(10) || '\"' || subscription || '\", more' || chr(10) AS category,"),
        ),
    ),
    "s6_dates_at_ingest": Check(
        _dates_at_ingest,
        over(
            "holiday",
            "SELECT strftime(holiday, '%Y-%m-%d') AS holiday, holiday_name FROM holiday",
        ),
    ),
    "s7_comma_sink": _delimited_sink(","),
    "s7_pipe_sink": _delimited_sink("|"),
    "s8_cost_per_month_from_daily_totals": Check(
        lambda s, d: cost.monthly_total(_daily_totals(s, d)),
        over("usage", "SELECT report_month, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost FROM usage GROUP BY ALL"),
    ),
    "s8_mean_cost_from_daily_totals": Check(
        lambda s, d: cost.mean_per_day(_daily_totals(s, d)),
        over(
            "usage",
            """SELECT report_month, subscription, CAST(sum(cost) AS DOUBLE) / count(DISTINCT day) AS mean_cost FROM usage
            WHERE report_month >= (SELECT min(m) FROM (SELECT DISTINCT report_month AS m FROM usage ORDER BY m DESC LIMIT 4))
            GROUP BY ALL""",
        ),
    ),
    "s8_ingest_and_publish": Check(_ingest, SUMMARY_SQL),
    "s8_publish_twice": Check(_publish_twice, SUMMARY_SQL),
}
