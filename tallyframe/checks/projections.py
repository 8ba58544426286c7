"""Projections, recodes and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import standins as data
from tallyframe.checks.base import (
    CATEGORIES,
    EXCLUDED_PROJECTS,
    HOME_PREFIX,
    MONTH,
    PROJECTS,
    Check,
)
from tallyframe.checks.views import over
from tallyframe.functions import dates, labels
from tallyframe.operators import filters
from tallyframe.operators.calendar import last_months
from tallyframe.plans import revenue, utilisation, workforce
from tallyframe.sources.tables import query

USAGE_ROW = ["usage_date", "category", "subscription", "cost"]
USAGE_SQL = (
    "strftime(usage_date, '%Y-%m-%d %H:%M:%S') AS usage_date, category, subscription,"
    " CAST(cost AS DOUBLE) AS cost"
)
RATE_ROW = ["employee", "project", "period", "target", "billed"]
RATE_SQL = (
    "employee, project, strftime(period, '%Y-%m-%d 00:00:00') AS period, target, billed"
)
ORDER_NAMES = {
    "o_orderkey": "line_id",
    "o_custkey": "owner",
    "o_orderstatus": "subscription",
    "o_totalprice": "cost",
    "o_orderdate": "usage_date",
    "o_orderpriority": "category",
}
STATUS_RULES = {"new": ("F", "Beta", "Production"), "old": ("F", "Production", "Beta")}
LISTING_SQL = """
    SELECT client, strftime(inv_date, '%Y-%m-%d') AS inv_date,
      strftime(due_date, '%Y-%m-%d') AS due_date, CAST(inv_amount AS DOUBLE) AS inv_amount,
      strftime(date_paid, '%Y-%m-%d') AS date_paid,
      CAST(payment_amount AS DOUBLE) AS payment_amount
    FROM invoice WHERE """
SHORT_SQL = """
    SELECT *, CASE WHEN indiv_eligibility = 1 THEN 0 ELSE target - billed END AS shortfall,
      CASE WHEN indiv_eligibility = 1 THEN 0 ELSE (target - billed) * init_rate END AS shortfall_amt
    FROM rates WHERE period BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"""
SHORT_COLUMNS = """project, employee, "rank", "level", target, billed, shortfall, shortfall_amt"""
STRICT, OPEN = "indiv_eligibility = 0", "indiv_eligibility IS DISTINCT FROM 1"
SHORT_DATES = ("20000101", "20001231")


def _employment(active: bool, left: bool, condition: str) -> Check:
    return Check(
        lambda s, d: data.employee(s, d)
        .filter(filters.employment("resigned", active, left))
        .select("employee", "resigned", "account"),
        over("employee", f"SELECT employee, resigned, account FROM employee WHERE {condition}"),
    )


def _usage_filter(step, condition: str) -> Check:
    return Check(
        lambda s, d: step(data.usage(s, d)).select(*USAGE_ROW),
        over("usage", f"SELECT {USAGE_SQL} FROM usage WHERE {condition}"),
    )


def _rates_filter(condition, sql: str) -> Check:
    return Check(
        lambda s, d: data.rates(s, d).filter(condition()).select(*RATE_ROW),
        over("rates", f"SELECT {RATE_SQL} FROM rates WHERE {sql}"),
    )


def _eligibility(strict: bool, condition: str) -> Check:
    return Check(
        lambda s, d: utilisation.lost(data.rates(s, d), *SHORT_DATES, strict).select(
            "project", "employee", "rank", "level", *utilisation.HOURS
        ),
        over(
            "rates",
            f"SELECT {SHORT_COLUMNS} FROM short WHERE shortfall > 0 AND {condition}",
            short=SHORT_SQL,
        ),
    )


CHECKS = {
    "p1_rename": Check(
        lambda s, d: data.table(s, d, "orders").withColumnsRenamed(ORDER_NAMES),
        """SELECT o_orderkey AS line_id, o_custkey AS owner, o_orderstatus AS subscription,
          o_totalprice AS cost, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS usage_date,
          o_orderpriority AS category FROM orders""",
    ),
    "p2_project": Check(
        lambda s, d: data.usage(s, d).select("subscription", "category", "cost"),
        over("usage", "SELECT subscription, category, CAST(cost AS DOUBLE) AS cost FROM usage"),
    ),
    "p3_column_range": Check(
        lambda s, d: filters.column_range(data.employee(s, d), "employee", "account"),
        over(
            "employee",
            'SELECT employee, grp, resigned, last_day, "rank", "level", "start", account'
            " FROM employee",
        ),
    ),
    "p4_drop_columns": Check(
        lambda s, d: data.employee(s, d).drop("include", "remarks", "activities"),
        over(
            "employee",
            """SELECT employee, grp, resigned, last_day, "rank", "level", "start", account, grp2,
              company, billed_project FROM employee""",
        ),
    ),
    "p5_value_present": _rates_filter(lambda: F.col("project").isNotNull(), "project IS NOT NULL"),
    "p5_value_absent": _rates_filter(lambda: F.col("project").isNull(), "project IS NULL"),
    "p6_exclusion_list": _rates_filter(
        lambda: filters.none_of("project", EXCLUDED_PROJECTS),
        "project IS NULL OR project NOT IN ('SMALL', 'MEDIUM')",
    ),
    "p7_inclusion_list": _rates_filter(
        lambda: filters.any_of("project", PROJECTS),
        "project IN ('STANDARD', 'ECONOMY', 'LARGE')",
    ),
    "p8_optional_list_chosen": _usage_filter(
        lambda df: df.filter(filters.chosen_or_all("category", CATEGORIES)),
        "category IN ('1-URGENT', '2-HIGH', '5-LOW')",
    ),
    "p8_optional_list_empty": _usage_filter(
        lambda df: df.filter(filters.chosen_or_all("category", ())), "TRUE"
    ),
    "p9_lower_date_bound": _usage_filter(
        lambda df: df.filter(filters.on_or_after("usage_date", "2000-01-01")),
        "usage_date >= TIMESTAMP '2000-01-01'",
    ),
    "p10_closed_date_range": Check(
        lambda s, d: data.eod(s, d).filter(
            filters.in_closed_range("date", "20240105", "20240125")
        ),
        over(
            "eod",
            """SELECT employee_name, strftime(date, '%Y-%m-%d %H:%M:%S') AS date, account, hours,
              minutes FROM eod
            WHERE date >= TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-25'""",
        ),
    ),
    "p11_single_month": _usage_filter(
        lambda df: df.filter(filters.in_month("usage_date", MONTH)), "report_month = '2001-07'"
    ),
    "p12_last_months": _usage_filter(
        lambda df: last_months(df, 3),
        "report_month IN (SELECT DISTINCT report_month FROM usage ORDER BY 1 DESC LIMIT 3)",
    ),
    "p13_recode_by_source": Check(
        lambda s, d: data.table(s, d, "orders")
        .withColumn("source", F.when(F.year("o_orderdate") >= 2000, "new").otherwise("old"))
        .select(
            "o_orderkey",
            "source",
            labels.two_way_by_source("o_orderstatus", "source", STATUS_RULES).alias("subscription"),
        ),
        """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN 'new' ELSE 'old' END AS source,
          CASE WHEN (o_orderstatus = 'F') = (year(o_orderdate) >= 2000) THEN 'Beta'
            ELSE 'Production' END AS subscription FROM orders""",
    ),
    "p14_override_value": Check(
        lambda s, d: workforce.rename_account(data.eod(s, d), "error", "support").select(
            "employee_name", "account", "hours"
        ),
        over(
            "eod",
            """SELECT employee_name, CASE WHEN account = 'error' THEN 'support' ELSE account END
              AS account, hours FROM eod""",
        ),
    ),
    "p15_differs_keeps_null": Check(
        lambda s, d: data.employee(s, d)
        .filter(filters.differs("company", "NATION_7"))
        .select("employee", "company"),
        over(
            "employee",
            "SELECT employee, company FROM employee WHERE company IS DISTINCT FROM 'NATION_7'",
        ),
    ),
    "p16_except_known_amounts": Check(
        lambda s, d: data.invoice(s, d, clients=True)
        .filter(
            filters.except_known_amounts(
                "inv_yr", 2000, "inv_amount", (459694.53, 39963.45), "client", "Customer#000000899"
            )
        )
        .select("client", "inv_date", "inv_amount"),
        over(
            "invoice",
            """SELECT client, strftime(inv_date, '%Y-%m-%d') AS inv_date,
              CAST(inv_amount AS DOUBLE) AS inv_amount FROM invoice
            WHERE inv_yr >= 2000 AND NOT coalesce((inv_amount = 459694.53 OR inv_amount = 39963.45)
              AND client = 'Customer#000000899', FALSE)""",
        ),
    ),
    "p17_positive_shortfall": Check(
        lambda s, d: utilisation.short_rows(data.rates(s, d), *SHORT_DATES).select(
            "project", "employee", "rank", "level", *utilisation.HOURS
        ),
        over("rates", f"SELECT {SHORT_COLUMNS} FROM short WHERE shortfall > 0", short=SHORT_SQL),
    ),
    "p18_eligibility_strict": _eligibility(True, STRICT),
    "p18_eligibility_open": _eligibility(False, OPEN),
    "p19_text_flag": Check(
        lambda s, d: data.table(s, d, "orders").select(
            "o_orderkey", labels.flag("o_orderstatus", "P").alias("flag")
        ),
        "SELECT o_orderkey, coalesce(o_orderstatus = 'P', FALSE) AS flag FROM orders",
    ),
    "p20_invoice_listing": Check(
        lambda s, d: revenue.listing(data.invoice(s, d, clients=True), ["d", "x"]),
        over("invoice", LISTING_SQL + "tx_type IN ('d', 'x')"),
    ),
    "p20_invoice_listing_outstanding": Check(
        lambda s, d: revenue.listing(data.invoice(s, d, clients=True), ["d", "x", "f"], True),
        over("invoice", LISTING_SQL + "payment_amount IS NULL"),
    ),
    "p21_active": _employment(True, False, "NOT resigned"),
    "p21_resigned": _employment(False, True, "resigned"),
    "p21_active_and_resigned": _employment(True, True, "TRUE"),
    "p21_neither": _employment(False, False, "FALSE"),
    "p21_staff_listing": Check(
        lambda s, d: workforce.staff_listing(
            workforce.regular(data.employee(s, d)), True, False, ["Core", "nan"]
        ).select("employee", "account", "last_day"),
        over(
            "employee",
            """SELECT employee, coalesce(account, 'nan') AS account, last_day FROM employee
            WHERE include = 1 AND NOT resigned AND (account = 'Core' OR account IS NULL)""",
        ),
    ),
    "p21_staff_listing_count": Check(
        lambda s, d: workforce.row_count(
            workforce.staff_listing(workforce.regular(data.employee(s, d)), True, True)
        ),
        over("employee", "SELECT count(*) AS row_count FROM employee WHERE include = 1"),
    ),
    "p22_roster": Check(
        lambda s, d: workforce.roster(data.employee(s, d), "NATION_10", "Solutions"),
        over(
            "employee",
            """SELECT employee, "rank", "level", remarks FROM employee
            WHERE NOT resigned AND company = 'NATION_10' AND account = 'Solutions'""",
        ),
    ),
    "p23_billed_roster": Check(
        lambda s, d: workforce.billed_roster(data.employee(s, d)),
        over(
            "employee",
            """SELECT employee, "rank", "level", remarks, billed_project FROM employee
            WHERE NOT resigned AND billed_project IS NOT NULL""",
        ),
    ),
    "p24_bench_roster": Check(
        lambda s, d: workforce.bench_roster(data.employee(s, d), "Delivery"),
        over(
            "employee",
            """SELECT employee, "rank", "level", remarks, activities FROM employee
            WHERE NOT resigned AND billed_project IS NULL AND account = 'Delivery'
              AND include = 1""",
        ),
    ),
    "p25_same_month": Check(
        lambda s, d: data.holiday(s, d).filter(dates.same_month("holiday", "2001-07-15")),
        over(
            "holiday",
            """SELECT strftime(holiday, '%Y-%m-%d') AS holiday, holiday_name FROM holiday
            WHERE year(holiday) = 2001 AND month(holiday) = 7""",
        ),
    ),
    "p26_outside_prefix": Check(
        lambda s, d: data.employee(s, d)
        .filter(filters.outside_group("grp", HOME_PREFIX))
        .select("employee", "grp"),
        over(
            "employee",
            "SELECT employee, grp FROM employee WHERE NOT coalesce(grp LIKE 'M%', FALSE)",
        ),
    ),
    "p27_bound_parameters": Check(
        lambda s, d: query(
            s,
            "SELECT usage_date, category, subscription, cost FROM {lines} "
            "WHERE subscription = :name AND cost >= :floor",
            {"lines": data.usage(s, d)},
            name="Beta",
            floor=250000.0,
        ),
        over(
            "usage",
            f"SELECT {USAGE_SQL} FROM usage WHERE subscription = 'Beta' AND cost >= 250000",
        ),
    ),
    "p28_cascading_facets": Check(
        lambda s, d: filters.facets(
            data.employee(s, d),
            ("company", ["NATION_10", "NATION_5", "NATION_12", "NATION_3"]),
            ("grp2", ["AFRICA", "ASIA"]),
        ).select("employee", "company", "grp2"),
        over(
            "employee",
            """SELECT employee, company, grp2 FROM employee
            WHERE company IN ('NATION_10', 'NATION_5', 'NATION_12', 'NATION_3')
              AND grp2 IN ('AFRICA', 'ASIA')""",
        ),
    ),
    "p28_employee_listing": Check(
        lambda s, d: workforce.employee_listing(
            data.employee(s, d), False, True, ["NATION_10", "NATION_5", "NATION_12"], ["AFRICA"]
        ),
        over(
            "employee",
            """SELECT employee, resigned, last_day, "rank", "level", grp, "start",
              coalesce(account, 'nan') AS account, grp2, company, remarks FROM employee
            WHERE resigned AND company IN ('NATION_10', 'NATION_5', 'NATION_12')
              AND grp2 = 'AFRICA'""",
        ),
    ),
    "p29_drill_down": Check(
        lambda s, d: utilisation.drill_down(
            utilisation.lost(data.rates(s, d), *SHORT_DATES, False), "7"
        ),
        over(
            "rates",
            f"""SELECT {SHORT_COLUMNS}, strftime(period, '%Y-%m-%d 00:00:00') AS period FROM short
            WHERE shortfall > 0 AND {OPEN} AND employee = '7'""",
            short=SHORT_SQL,
        ),
    ),
    "p29_times_short": Check(
        lambda s, d: utilisation.times_short(
            utilisation.short_rows(data.rates(s, d), *SHORT_DATES), "7"
        ),
        over(
            "rates",
            "SELECT count(*) AS times FROM short WHERE shortfall > 0 AND employee = '7'",
            short=SHORT_SQL,
        ),
    ),
}
