"""The canonical datasets as views over the given test tables.

The reports know only the datasets in `schemas`. This module derives them from
an order and event database, whole tables each time; the same views are written
in SQL in `checks/views.py`. Dimensions are joined only where asked for, and
without hints: their size decides at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans import cost, revenue, sponsorship


# The columns of the given tables, stated so that no job has to read them from
# the files first.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": """c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
        c_mktsegment STRING""",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
        value DOUBLE, props STRING""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def usage(spark: SparkSession, folder: str, groups: bool = False) -> DataFrame:
    """Orders as usage lines; resource groups (from customers) only on request."""
    lines = table(spark, folder, "orders")
    columns = [
        F.col("o_orderdate").alias("usage_date"),
        F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "F", "Beta").otherwise("Production").alias("subscription"),
        F.col("o_totalprice").alias("cost"),
    ]
    if groups:
        owners = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
        lines = lines.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
        segment = F.col("c_mktsegment")
        columns.append(F.when(segment != "BUILDING", segment).alias("resource_group"))
    return cost.prepare(lines.select(*columns))


def sponsor(
    spark: SparkSession, folder: str, names: bool = False, regions: bool = False
) -> DataFrame:
    """Line items as sponsored cost; service names and regions only on request."""
    lines = table(spark, folder, "lineitem")
    columns = [
        F.col("l_shipdate").alias("date"),
        F.concat("l_returnflag", "l_linestatus").alias("service_type"),
        F.col("l_suppkey").cast("string").alias("service_resource"),
        F.col("l_extendedprice").alias("cost"),
    ]
    if names:
        parts = table(spark, folder, "part").select("p_partkey", "p_type")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        columns.append(F.col("p_type").alias("service_name"))
    if regions:
        places = (
            table(spark, folder, "supplier")
            .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "r_name")
        )
        lines = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        columns.append(F.col("r_name").alias("service_region"))
    return sponsorship.prepare(lines.select(*columns))


def rates(spark: SparkSession, folder: str, projects: bool = True) -> DataFrame:
    """Line items as rate card rows; projects (from parts) unless told otherwise."""
    lines = table(spark, folder, "lineitem")
    project = []
    if projects:
        parts = table(spark, folder, "part").select("p_partkey", "p_type")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
        project = [F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("project")]
    off = F.col("l_linenumber") - 3
    return lines.select(
        F.col("l_suppkey").cast("string").alias("employee"),
        *project,
        F.round(F.col("l_tax") * 100).alias("init_rate"),
        F.round(F.col("l_discount") * 10, 1).alias("fte"),
        F.round(F.col("l_tax") * 100).alias("rate"),
        F.trunc("l_shipdate", "MM").cast("timestamp_ntz").alias("period"),
        F.col("l_returnflag").alias("rank"),
        F.col("l_linestatus").alias("level"),
        F.col("l_quantity").alias("target"),
        F.when(F.col("l_quantity") != off, F.col("l_quantity") - off).alias("billed"),
        F.when(F.col("l_returnflag") == "R", 1)
        .when(F.col("l_returnflag") == "A", 0)
        .alias("indiv_eligibility"),
    )


def invoice(spark: SparkSession, folder: str, clients: bool = False) -> DataFrame:
    """Orders as invoices; client names only on request. Low priority is unpaid."""
    lines = table(spark, folder, "orders")
    day = F.to_date("o_orderdate")
    paid = F.col("o_orderpriority") != "5-LOW"
    kind = F.when(F.col("o_orderstatus") == "O", "d").when(F.col("o_orderstatus") == "F", "f")
    columns = [
        day.alias("inv_date"),
        F.date_add(day, 30).alias("due_date"),
        F.col("o_totalprice").alias("inv_amount"),
        F.when(paid, F.date_add(day, 45)).alias("date_paid"),
        F.when(paid, F.col("o_totalprice")).alias("payment_amount"),
        kind.otherwise("x").alias("tx_type"),
    ]
    if clients:
        owners = table(spark, folder, "customer").select("c_custkey", "c_name")
        lines = lines.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
        columns.insert(0, F.col("c_name").alias("client"))
    return revenue.with_date_parts(lines.select(*columns))


def holiday(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("holiday"), F.col("o_orderpriority").alias("holiday_name")
    )


def employee(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as employees.

    Names count up with a gap after every fourth one, so that some people in
    the time log are not employees.
    """
    nations = table(spark, folder, "nation")
    regions = table(spark, folder, "region")
    people = (
        table(spark, folder, "customer")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    )
    place = F.col("c_nationkey")
    in_project = F.col("c_mktsegment").isin("HOUSEHOLD", "FURNITURE")
    return people.select(
        (F.col("c_custkey") + F.floor(F.col("c_custkey") / 4)).cast("string").alias("employee"),
        F.col("c_mktsegment").alias("grp"),
        (F.col("c_acctbal") < 0).alias("resigned"),
        F.when(F.col("c_acctbal") < 0, F.lit("2024-01-31").cast("date")).alias("last_day"),
        F.col("c_mktsegment").alias("rank"),
        F.col("n_regionkey").cast("string").alias("level"),
        F.lit("2020-01-01").cast("date").alias("start"),
        F.when(place < 8, "Core")
        .when(place < 16, "Solutions")
        .when(place < 24, "Delivery")
        .alias("account"),
        F.col("r_name").alias("grp2"),
        F.when(place != 0, F.col("n_name")).alias("company"),
        F.when(F.col("c_acctbal") > 9000, 0).otherwise(1).alias("include"),
        F.col("c_name").alias("remarks"),
        F.when(in_project, F.concat(F.lit("p"), place.cast("string"))).alias("billed_project"),
        F.concat_ws(" ", "n_name", "c_mktsegment").alias("activities"),
    )


def eod(spark: SparkSession, folder: str) -> DataFrame:
    """Events as daily log lines, time of day kept."""
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("employee_name"),
        F.col("ts").alias("date"),
        F.col("event_type").alias("account"),
        F.floor(F.col("value") / 60).cast("int").alias("hours"),
        F.minute("ts").alias("minutes"),
    )
