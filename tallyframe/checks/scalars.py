"""Date, amount and label expressions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe import standins as data
from tallyframe.checks.base import RATES_START, TYPE_NAMES, Check
from tallyframe.checks.views import over
from tallyframe.functions import amounts, dates, work
from tallyframe.operators.membership import worker_type_name
from tallyframe.plans import cost, revenue, sponsorship, utilisation

SHORT_NUMBER_SQL = """CASE WHEN {x} / 1e9 >= 1 THEN format('{{:.1f}} B', {x} / 1e9)
  WHEN {x} / 1e6 >= 1 THEN format('{{:.1f}} M', {x} / 1e6)
  WHEN {x} / 1e3 > 1 THEN format('{{:.1f}} K', {x} / 1e3) ELSE CAST({x} AS VARCHAR) END"""


DAY = "o_orderdate"


def _on_orders(sql: str, **columns: Callable[[], Column]) -> Check:
    """Columns are given as calls, since expressions need a running session."""
    return Check(
        lambda s, d: data.table(s, d, "orders").select(
            "o_orderkey", *[value().alias(name) for name, value in columns.items()]
        ),
        f"SELECT o_orderkey, {sql} FROM orders",
    )


CHECKS = {
    "f1_month_key": _on_orders(
        "strftime(o_orderdate, '%Y-%m') AS month", month=lambda: dates.month_key(DAY)
    ),
    "f2_month_year_label": _on_orders(
        "strftime(o_orderdate, '%B %Y') AS label", label=lambda: dates.month_year_label(DAY)
    ),
    "f3_month_name": _on_orders(
        "strftime(o_orderdate, '%B') AS name", name=lambda: dates.month_name(DAY)
    ),
    "f4_iso_day": _on_orders(
        "strftime(o_orderdate, '%Y-%m-%d') AS day", day=lambda: dates.iso_day(DAY)
    ),
    "f5_long_date": _on_orders(
        "strftime(o_orderdate, '%b %-d, %Y') AS long_date", long_date=lambda: dates.long_date(DAY)
    ),
    "f6_date_parts": _on_orders(
        """CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon,
          CAST(day(o_orderdate) AS BIGINT) AS day_no""",
        yr=lambda: F.year(DAY),
        mon=lambda: F.month(DAY),
        day_no=lambda: F.day(DAY),
    ),
    "f7_text_to_timestamp": _on_orders(
        """strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
          strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS by_format""",
        stamp=lambda: dates.to_timestamp(F.col(DAY).cast("string")),
        by_format=lambda: dates.to_timestamp(F.date_format(DAY, "dd/MM/yyyy"), "dd/MM/yyyy"),
    ),
    "f8_days_left_in_month": _on_orders(
        "CAST(day(last_day(o_orderdate)) - day(o_orderdate) AS BIGINT) AS days_left",
        days_left=lambda: dates.days_left_in_month(DAY),
    ),
    "f9_month_bounds": _on_orders(
        """strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day,
          strftime(last_day(o_orderdate), '%Y-%m-%d') AS last_day""",
        first_day=lambda: dates.month_start(DAY),
        last_day=lambda: dates.month_end(DAY),
    ),
    "f10_previous_month_bounds": _on_orders(
        """strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m-%d') AS first_day,
          strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day""",
        first_day=lambda: dates.previous_month_start(DAY),
        last_day=lambda: dates.previous_month_end(DAY),
    ),
    "f11_worked_hours": Check(
        lambda s, d: data.eod(s, d).select(
            "employee_name", "account", work.worked_hours().alias("total_hrs")
        ),
        over("eod", "SELECT employee_name, account, total_minutes / 60 AS total_hrs FROM eod"),
    ),
    "f11_fractional_hours": Check(
        lambda s, d: data.eod(s, d)
        .withColumns({"hours": F.col("hours") + 0.5, "minutes": F.col("minutes") + 0.5})
        .select("employee_name", "account", work.worked_hours().alias("total_hrs")),
        over("eod", "SELECT employee_name, account, CAST(total_minutes + 30.5 AS DOUBLE) / 60 AS total_hrs FROM eod"),
    ),
    "f12_billable_and_lost": Check(
        lambda s, d: revenue.prepare(data.rates(s, d), RATES_START).select(
            "employee", "period", "billable", "lost_hours", "lost_amount"
        ),
        over(
            "rates",
            """SELECT employee, strftime(period, '%Y-%m-%d 00:00:00') AS period,
              target * init_rate AS billable, target - billed AS lost_hours,
              (target - billed) * init_rate AS lost_amount
            FROM rates WHERE period >= DATE '1998-01-01'""",
        ),
    ),
    "f13_shortfall": Check(
        lambda s, d: data.rates(s, d)
        .withColumn("shortfall", work.shortfall())
        .withColumn("shortfall_amt", work.shortfall_amount())
        .select("employee", "indiv_eligibility", "shortfall", "shortfall_amt"),
        over(
            "rates",
            """SELECT employee, CAST(indiv_eligibility AS BIGINT) AS indiv_eligibility,
              CASE WHEN indiv_eligibility = 1 THEN 0 ELSE target - billed END AS shortfall,
              CASE WHEN indiv_eligibility = 1 THEN 0 ELSE (target - billed) * init_rate END
                AS shortfall_amt FROM rates""",
        ),
    ),
    "f14_amount_text": _on_orders(
        """format('${:,.2f}', o_totalprice) AS dollars, format('{:,.2f}', o_totalprice) AS amount,
          format('₱{:,.0f}', o_totalprice) AS pesos""",
        dollars=lambda: amounts.currency_text("o_totalprice"),
        amount=lambda: amounts.number_text("o_totalprice"),
        pesos=lambda: amounts.currency_text("o_totalprice", "₱", 0),
    ),
    "f15_short_number": Check(
        lambda s, d: data.table(s, d, "customer").select(
            "c_custkey",
            amounts.short_number("c_acctbal").alias("balance"),
            amounts.short_number(F.col("c_acctbal") * 1000).alias("thousands"),
            amounts.short_number(F.col("c_custkey") * 12_345_678.0).alias("large"),
        ),
        "SELECT c_custkey, "
        + SHORT_NUMBER_SQL.format(x="c_acctbal")
        + " AS balance, "
        + SHORT_NUMBER_SQL.format(x="(c_acctbal * 1000)")
        + " AS thousands, "
        + SHORT_NUMBER_SQL.format(x="(c_custkey * 12345678.0::DOUBLE)")
        + " AS large FROM customer",
    ),
    "f16_convert_currency": Check(
        lambda s, d: data.invoice(s, d).select(
            "inv_date", "tx_type", amounts.convert("inv_amount", 58).alias("converted")
        ),
        over(
            "invoice",
            """SELECT strftime(inv_date, '%Y-%m-%d') AS inv_date, tx_type,
              CAST(inv_amount AS DOUBLE) * 58 AS converted FROM invoice""",
        ),
    ),
    "f17_replace_null": Check(
        lambda s, d: data.invoice(s, d)
        .select("inv_date", "payment_amount", dates.iso_day("date_paid").alias("date_paid"))
        .fillna({"payment_amount": 0.0, "date_paid": "nan"}),
        over(
            "invoice",
            """SELECT strftime(inv_date, '%Y-%m-%d') AS inv_date,
              CAST(coalesce(payment_amount, 0) AS DOUBLE) AS payment_amount,
              coalesce(strftime(date_paid, '%Y-%m-%d'), 'nan') AS date_paid FROM invoice""",
        ),
    ),
    "f18_decode_code": Check(
        lambda s, d: data.table(s, d, "lineitem").select(
            "l_orderkey",
            "l_linenumber",
            worker_type_name("l_linenumber", TYPE_NAMES).alias("type_name"),
        ),
        """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
          CASE WHEN l_linenumber = 1 THEN 'Interns' WHEN l_linenumber = 3 THEN 'Other groups'
            ELSE 'Home' END AS type_name FROM lineitem""",
    ),
    "f19_running_total_sentence": Check(
        lambda s, d: sponsorship.running_total_text(data.sponsor(s, d)),
        over(
            "sponsor",
            """SELECT 'Running Total: $ ' || format('{:,.2f}', CAST(sum(cost) AS DOUBLE))
              || ' as of ' || strftime(max(date), '%b %-d, %Y') AS message FROM sponsor""",
        ),
    ),
    "f19_lost_sentence": Check(
        lambda s, d: utilisation.overall_text(
            utilisation.lost(data.rates(s, d), "20000101", "20001231", False)
        ),
        over(
            "rates",
            """SELECT 'Monthly lost opportunity is $ '
              || format('{:,.2f}', coalesce(sum((target - billed) * init_rate), 0)) AS message
            FROM rates WHERE period BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
              AND target - billed > 0 AND indiv_eligibility IS DISTINCT FROM 1""",
        ),
    ),
    "f19_forecast_sentence": Check(
        lambda s, d: cost.forecast_text(data.usage(s, d)),
        over(
            "usage",
            """SELECT 'Remaining days : ' || left_days AS remaining,
              'Current total : ' || format('${:,.2f}', total) AS current,
              'By end of the month : ' || format('${:,.2f}', total + left_days * daily) AS month_end
            FROM (SELECT max(day(last_day(d)) - day(d)) AS left_days, sum(total) AS total,
                sum(total / days) AS daily
              FROM (SELECT subscription, CAST(sum(cost) AS DOUBLE) AS total,
                  count(DISTINCT day) AS days, max(max(usage_date)) OVER () AS d
                FROM usage WHERE report_month = (SELECT max(report_month) FROM usage)
                GROUP BY subscription))""",
        ),
    ),
}
