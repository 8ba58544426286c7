"""Membership joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import standins as data
from tallyframe.checks.base import ACCOUNTS, EOD_END, EOD_START, HOME_PREFIX, TYPE_NAMES, Check
from tallyframe.checks.views import over
from tallyframe.operators.membership import HOME, INTERN, OTHER_GROUP, worker_type_name
from tallyframe.operators.ranking import line_numbers
from tallyframe.plans import revenue, workforce

LINES = """
  SELECT * FROM eod WHERE account IN ('click', 'purchase', 'signup', 'view')
    AND date >= TIMESTAMP '2024-01-01' AND date <= TIMESTAMP '2024-01-31'"""
TYPED = f"""
  SELECT account, employee_name, sum(total_minutes)::BIGINT AS minutes,
    CASE WHEN employee_name NOT IN
        (SELECT employee FROM employee WHERE include = 1) THEN 1
      WHEN employee_name IN (SELECT employee FROM employee
        WHERE include = 1 AND NOT coalesce(grp LIKE 'M%', FALSE)) THEN 3
      ELSE 2 END AS worker_type
  FROM ({LINES}) GROUP BY account, employee_name"""
CORE_SQL = """SELECT employee FROM employee WHERE "level" IN ('1', '2')"""
WIDE = """
  SELECT CAST(any_value(worker_type) AS BIGINT) AS worker_type, employee_name,
    sum(minutes) FILTER (account = 'click')::BIGINT / 60 AS click,
    sum(minutes) FILTER (account = 'purchase')::BIGINT / 60 AS purchase,
    sum(minutes) FILTER (account = 'signup')::BIGINT / 60 AS signup,
    sum(minutes) FILTER (account = 'view')::BIGINT / 60 AS view
  FROM typed GROUP BY employee_name"""


def lines(s: SparkSession, d: str) -> DataFrame:
    return workforce.project_lines(data.eod(s, d), EOD_START, EOD_END, ACCOUNTS)


def staff(s: SparkSession, d: str) -> DataFrame:
    return workforce.regular(data.employee(s, d))


def people(s: SparkSession, d: str) -> DataFrame:
    return workforce.classified(lines(s, d), staff(s, d), HOME_PREFIX)


def core(s: SparkSession, d: str) -> DataFrame:
    return data.employee(s, d).filter(F.col("level").isin("1", "2")).select("employee")


def _hours_of(worker_type: int) -> Check:
    return Check(
        lambda s, d: workforce.hours_of(people(s, d), worker_type),
        over(
            "eod employee",
            f"""SELECT account, employee_name, minutes / 60 AS total_hrs FROM typed
            WHERE worker_type = {worker_type}""",
            typed=TYPED,
        ),
    )


CHECKS = {
    "j1_interns": Check(
        lambda s, d: workforce.interns(lines(s, d), staff(s, d)),
        over(
            "eod employee",
            """SELECT DISTINCT employee_name FROM lines
            WHERE employee_name NOT IN (SELECT employee FROM employee WHERE include = 1)""",
            lines=LINES,
        ),
    ),
    "j2_hours_of_other_groups": _hours_of(OTHER_GROUP),
    "j2_hours_of_interns": _hours_of(INTERN),
    "j3_hours_of_home_group": _hours_of(HOME),
    "j4_worker_types": Check(
        lambda s, d: people(s, d).withColumn(
            "type_name", worker_type_name("worker_type", TYPE_NAMES)
        ),
        over(
            "eod employee",
            """SELECT account, employee_name, CAST(minutes AS DOUBLE) AS minutes, CAST(worker_type AS BIGINT) AS worker_type,
              CASE worker_type WHEN 1 THEN 'Interns' WHEN 3 THEN 'Other groups' ELSE 'Home' END
                AS type_name FROM typed""",
            typed=TYPED,
        ),
    ),
    "j5_invoiced_and_collected_by_month": Check(
        lambda s, d: revenue.month_cells(data.invoice(s, d)),
        over(
            "invoice",
            """SELECT coalesce(i.mon, p.mon) AS mon,
              coalesce(d_i, 0) AS d_invoiced, coalesce(d_p, 0) AS d_collected,
              coalesce(x_i, 0) AS x_invoiced, coalesce(x_p, 0) AS x_collected,
              coalesce(f_i, 0) AS f_invoiced, coalesce(f_p, 0) AS f_collected
            FROM (SELECT mon, max(m) FILTER (tx_type = 'd') AS d_i,
                max(m) FILTER (tx_type = 'x') AS x_i, max(m) FILTER (tx_type = 'f') AS f_i
              FROM inv GROUP BY mon) i
            FULL JOIN (SELECT mon, max(m) FILTER (tx_type = 'd') AS d_p,
                max(m) FILTER (tx_type = 'x') AS x_p, max(m) FILTER (tx_type = 'f') AS f_p
              FROM pay GROUP BY mon) p ON i.mon = p.mon""",
            inv="""SELECT mon, tx_type, sum(total)::DOUBLE / count(*) AS m
              FROM (SELECT inv_yr, inv_mon AS mon, tx_type, sum(inv_amount) AS total
                FROM invoice GROUP BY ALL) GROUP BY ALL""",
            pay="""SELECT mon, tx_type, sum(total)::DOUBLE / count(*) AS m
              FROM (SELECT payment_yr, payment_mon AS mon, tx_type, sum(payment_amount) AS total
                FROM invoice WHERE payment_mon IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
        ),
    ),
    "j6_wide_hours_of_interns": Check(
        lambda s, d: workforce.only(
            workforce.wide_hours_by_type(lines(s, d), ACCOUNTS, staff(s, d), HOME_PREFIX), INTERN
        ),
        over(
            "eod employee",
            """SELECT * EXCLUDE (worker_type), row_number() OVER (ORDER BY employee_name) AS line_no
            FROM wide WHERE worker_type = 1""",
            typed=TYPED,
            wide=WIDE,
        ),
    ),
    "j6_wide_hours_all": Check(
        lambda s, d: line_numbers(
            workforce.wide_hours(lines(s, d), ACCOUNTS), ["employee_name"], grouped=True
        ),
        over(
            "eod employee",
            """SELECT * EXCLUDE (worker_type), row_number() OVER (ORDER BY employee_name) AS line_no
            FROM wide""",
            typed=TYPED,
            wide=WIDE,
        ),
    ),
    "j6_wide_hours_by_type": Check(
        lambda s, d: workforce.wide_hours_by_type(
            lines(s, d), ACCOUNTS, staff(s, d), HOME_PREFIX
        ),
        over(
            "eod employee",
            """SELECT *, row_number() OVER (PARTITION BY worker_type ORDER BY employee_name)
              AS line_no FROM wide""",
            typed=TYPED,
            wide=WIDE,
        ),
    ),
}
