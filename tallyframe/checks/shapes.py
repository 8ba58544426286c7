"""Pivots, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import standins as data
from tallyframe.checks.aggregates import CELLS, TO_DATE
from tallyframe.checks.base import ACCOUNTS, MONTH, Check
from tallyframe.checks.joins import LINES, WIDE, lines
from tallyframe.checks.projections import OPEN, SHORT_COLUMNS, SHORT_SQL
from tallyframe.checks.views import over
from tallyframe.functions.dates import month_key
from tallyframe.operators import filters
from tallyframe.operators.calendar import newest_months, rows_of_newest
from tallyframe.operators.ranking import line_numbers, order_by_group_total, top_per_group
from tallyframe.operators.totals import total_by
from tallyframe.plans import cost, revenue, sponsorship, utilisation, workforce
from tallyframe.sources.exports import union_exports

COST = "CAST(sum(cost) AS DOUBLE) AS cost"
DAILY = f"SELECT day, {COST} FROM usage GROUP BY day"
MONTH_COLUMNS = ", ".join(
    f"max(amount) FILTER (mon = {number}) AS \"{name}\""
    for number, name in enumerate(revenue.MONTHS, start=1)
)
STATEMENT = f'SELECT line, {MONTH_COLUMNS}, {TO_DATE} AS "To Date" FROM cells GROUP BY line'
MONEY_COLUMNS = ", ".join(
    f"(CASE WHEN line LIKE 'd%' THEN '$' ELSE '₱' END) || format('{{:,.0f}}', \"{name}\")"
    f' AS "{name}"'
    for name in (*revenue.MONTHS, revenue.TO_DATE)
)
RANKED_MONTHS = "SELECT DISTINCT report_month FROM usage ORDER BY report_month DESC"


def _top_of_groups(usage):
    chosen = cost.of_groups(usage, ["MACHINERY", "FURNITURE"])
    return cost.top_categories(chosen, months=4, count=3, months_of=usage)


def _type_columns(totals, month: str, amount: str, sql_month: str, sql_year: str) -> Check:
    return Check(
        lambda s, d: revenue.type_columns(totals(data.invoice(s, d)), month, amount),
        over(
            "invoice",
            f"""SELECT {sql_month},
              (sum(t) FILTER (tx_type = 'd'))::DOUBLE / count(*) FILTER (tx_type = 'd') AS d,
              (sum(t) FILTER (tx_type = 'x'))::DOUBLE / count(*) FILTER (tx_type = 'x') AS x,
              (sum(t) FILTER (tx_type = 'f'))::DOUBLE / count(*) FILTER (tx_type = 'f') AS f
            FROM (SELECT {sql_month}, tx_type, sum({amount}) AS t FROM invoice
              WHERE {sql_month} IS NOT NULL GROUP BY {sql_year}, {sql_month}, tx_type)
            GROUP BY {sql_month}""",
        ),
    )


FACETS = {
    "company": ["NATION_10", "NATION_5", "NATION_12", "NATION_3"],
    "grp2": ["AFRICA", "ASIA"],
    "account": [],
    "rank": ["BUILDING", "MACHINERY", "HOUSEHOLD"],
}


def _facet_sql(facet: str) -> str:
    """One list: the facet's values among the rows that the other facets let through."""
    held = [f""""{n}" IN ({", ".join(f"'{v}'" for v in some)})""" for n, some in FACETS.items() if n != facet and some]
    return f"""SELECT '{facet}' AS facet, "{facet}" AS value, count(*) AS row_count FROM employee
        WHERE {" AND ".join([*held, f'"{facet}" IS NOT NULL'])} GROUP BY ALL"""


FACETS_SQL = " UNION ALL ".join(_facet_sql(f) for f in FACETS)


CHECKS = {
    "r1_invoiced_type_columns": _type_columns(
        revenue.invoiced, "inv_mon", "inv_amount", "inv_mon", "inv_yr"
    ),
    "r1_collected_type_columns": _type_columns(
        revenue.collected, "payment_mon", "payment_amount", "payment_mon", "payment_yr"
    ),
    "r2_wide_hours": Check(
        lambda s, d: workforce.wide_hours(lines(s, d), ACCOUNTS),
        over(
            "eod",
            WIDE.replace("CAST(any_value(worker_type) AS BIGINT) AS worker_type, ", "")
            .replace("minutes", "total_minutes")
            .replace("typed", "lines"),
            lines=LINES,
        ),
    ),
    "r3_statement": Check(
        lambda s, d: revenue.statement(data.invoice(s, d)),
        over("invoice", STATEMENT, cells=CELLS),
    ),
    "r3_statement_text": Check(
        lambda s, d: revenue.statement_text(
            data.invoice(s, d), {"d": "$", "x": "₱", "f": "₱"}
        ),
        over(
            "invoice",
            f"SELECT line, {MONEY_COLUMNS} FROM st",
            cells=CELLS,
            st=STATEMENT,
        ),
    ),
    "w1_moving_mean": Check(
        lambda s, d: cost.daily_moving_mean(data.usage(s, d), "1995-01-05"),
        over(
            "usage",
            """SELECT day, cost, mean_cost FROM (SELECT day, cost,
              CASE WHEN count(*) OVER w >= 7
                THEN CAST(sum(CAST(cost AS DECIMAL(28,6))) OVER w AS DOUBLE) / 7 END AS mean_cost
              FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
            WHERE day >= '1995-01-05'""",
            daily=DAILY,
        ),
    ),
    "w2_top_categories": Check(
        lambda s, d: cost.top_categories(data.usage(s, d), months=4, count=3),
        over(
            "usage",
            f"""SELECT subscription, report_month, category, cost, position,
              format('{{:,.2f}}', cost) AS cost_text
            FROM (SELECT *, row_number() OVER (PARTITION BY subscription, report_month
                  ORDER BY cost DESC, category) AS position
              FROM (SELECT subscription, report_month, category, {COST} FROM usage
                WHERE report_month IN ({RANKED_MONTHS} LIMIT 4)
                GROUP BY subscription, report_month, category))
            WHERE position <= 3""",
        ),
    ),
    "w2_top_categories_of_chosen_groups": Check(
        lambda s, d: _top_of_groups(data.usage(s, d, groups=True)),
        over(
            "usage",
            f"""SELECT subscription, report_month, category, cost, position,
              format('{{:,.2f}}', cost) AS cost_text
            FROM (SELECT *, row_number() OVER (PARTITION BY subscription, report_month
                  ORDER BY cost DESC, category) AS position
              FROM (SELECT subscription, report_month, category, {COST} FROM usage
                WHERE report_month IN ({RANKED_MONTHS} LIMIT 4)
                  AND resource_group IN ('MACHINERY', 'FURNITURE')
                GROUP BY subscription, report_month, category))
            WHERE position <= 3""",
        ),
    ),
    "w2_top_resources_per_month": Check(
        lambda s, d: top_per_group(
            sponsorship.total_per_month(data.sponsor(s, d), "service_resource"),
            ["report_month"],
            "total",
            "service_resource",
            6,
        ),
        over(
            "sponsor",
            """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_month
                  ORDER BY total DESC, service_resource) AS position
              FROM (SELECT report_month, service_resource, CAST(sum(cost) AS DOUBLE) AS total
                FROM sponsor
                GROUP BY report_month, service_resource)) WHERE position <= 6""",
        ),
    ),
    "w3_months_newest_first": Check(
        lambda s, d: newest_months(data.usage(s, d)).select(
            month_key("month").alias("report_month"), "position"
        ),
        over(
            "usage",
            f"""SELECT report_month, row_number() OVER (ORDER BY report_month DESC) AS position
            FROM ({RANKED_MONTHS})""",
        ),
    ),
    "w3_pick_one_month": Check(
        lambda s, d: rows_of_newest(data.usage(s, d), 3).select("usage_date", "category", "subscription", "cost"),
        over(
            "usage",
            f"""SELECT strftime(usage_date, '%Y-%m-%d %H:%M:%S') AS usage_date, category,
              subscription, CAST(cost AS DOUBLE) AS cost FROM usage
            WHERE report_month = ({RANKED_MONTHS} LIMIT 1 OFFSET 2)""",
        ),
    ),
    "w4_line_numbers": Check(
        lambda s, d: line_numbers(
            data.employee(s, d).select("employee", "company", "account"), ["employee"]
        ),
        over(
            "employee",
            """SELECT row_number() OVER (ORDER BY employee) AS line_no, employee, company, account
            FROM employee""",
        ),
    ),
    "w4_line_numbers_per_subset": Check(
        lambda s, d: line_numbers(
            data.employee(s, d).select("employee", "company", "account"),
            ["employee"],
            ["company", "account"],
        ),
        over(
            "employee",
            """SELECT row_number() OVER (PARTITION BY company, account ORDER BY employee) AS line_no,
              employee, company, account FROM employee""",
        ),
    ),
    "w4_numbered_bench_roster": Check(
        lambda s, d: line_numbers(
            workforce.bench_roster(data.employee(s, d), "Delivery"), ["employee"]
        ),
        over(
            "employee",
            """SELECT row_number() OVER (ORDER BY employee) AS line_no, employee, "rank", "level",
              remarks, activities FROM employee
            WHERE NOT resigned AND billed_project IS NULL AND account = 'Delivery'
              AND include = 1""",
        ),
    ),
    "w5_share_of_hours": Check(
        lambda s, d: workforce.account_share(lines(s, d)),
        over(
            "eod",
            """SELECT account, sum(total_minutes)::BIGINT / 60 AS total_hrs,
              sum(total_minutes)::DOUBLE / (SELECT sum(total_minutes) FROM lines)::DOUBLE AS share
            FROM lines GROUP BY account""",
            lines=LINES,
        ),
    ),
    "w6_largest_category_first": Check(
        lambda s, d: cost.dense_daily_largest_first(
            data.usage(s, d).filter(filters.in_month("usage_date", MONTH))
        ),
        over(
            "usage",
            """SELECT s.subscription, c.category, t.day,
              CAST(coalesce(sum(u.cost), 0) AS DOUBLE) AS cost,
              (SELECT CAST(sum(m2.cost) AS DOUBLE) FROM m m2 WHERE m2.category = c.category)
                AS group_total
            FROM (SELECT DISTINCT subscription FROM m) s, (SELECT DISTINCT category FROM m) c,
              (SELECT DISTINCT day FROM m) t
            LEFT JOIN m u ON u.subscription = s.subscription AND u.category = c.category
              AND u.day = t.day
            GROUP BY s.subscription, c.category, t.day""",
            m="SELECT * FROM usage WHERE report_month = '2001-07'",
        ),
    ),
    "w6_daily_cost_by_largest_category": Check(
        lambda s, d: order_by_group_total(
            total_by(data.usage(s, d), ["category", "day"], "cost"),
            "category",
            "cost",
            "day",
        ),
        over(
            "usage",
            """SELECT category, day, CAST(sum(cost) AS DOUBLE) AS cost,
              CAST(sum(sum(cost)) OVER (PARTITION BY category) AS DOUBLE) AS group_total
            FROM usage GROUP BY category, day""",
        ),
    ),
    "w7_latest_month_total": Check(
        lambda s, d: cost.latest_month_total(data.usage(s, d)),
        over(
            "usage",
            f"SELECT report_month, {COST} FROM usage GROUP BY 1 ORDER BY 1 DESC LIMIT 1",
        ),
    ),
    "w7_latest_total_mean": Check(
        lambda s, d: cost.latest_total_mean(data.usage(s, d)),
        over(
            "usage",
            """SELECT CAST(sum(CAST(m AS DECIMAL(28,6))) AS DOUBLE) AS mean_cost
            FROM (SELECT CAST(sum(cost) AS DOUBLE) / count(DISTINCT day) AS m FROM usage
              WHERE report_month = (SELECT max(report_month) FROM usage) GROUP BY subscription)""",
        ),
    ),
    "o1_sort": Check(
        lambda s, d: data.usage(s, d)
        .select("subscription", "category", "usage_date", "cost")
        .orderBy(F.desc("cost"), "usage_date", "category", "subscription"),
        over(
            "usage",
            """SELECT subscription, category,
              strftime(usage_date, '%Y-%m-%d %H:%M:%S') AS usage_date, CAST(cost AS DOUBLE) AS cost
            FROM usage ORDER BY cost DESC""",
        ),
    ),
    "o1_lost_hours_listing": Check(
        lambda s, d: utilisation.details(
            utilisation.lost(data.rates(s, d), "20000101", "20001231", False)
        ),
        over(
            "rates",
            f"""SELECT {SHORT_COLUMNS}, strftime(period, '%Y-%m-%d') AS month FROM short
            WHERE shortfall > 0 AND {OPEN} ORDER BY project, employee""",
            short=SHORT_SQL,
        ),
    ),
    "o2_largest_days": Check(
        lambda s, d: cost.daily_total(data.usage(s, d)).orderBy(F.desc("cost"), "day").limit(6),
        over("usage", "SELECT * FROM daily ORDER BY cost DESC, day LIMIT 6", daily=DAILY),
    ),
    "o3_choices": Check(
        lambda s, d: filters.choices(data.employee(s, d), "company"),
        over("employee", "SELECT DISTINCT company FROM employee WHERE company IS NOT NULL"),
    ),
    "o3_choices_with_missing": Check(
        lambda s, d: filters.choices(data.employee(s, d), "company", missing="nan"),
        over("employee", "SELECT DISTINCT coalesce(company, 'nan') AS company FROM employee"),
    ),
    "o3_all_choices_in_one_pass": Check(
        lambda s, d: filters.facet_choices(data.employee(s, d), FACETS),
        over("employee", FACETS_SQL),
    ),
    "u1_union_by_name": Check(
        lambda s, d: union_exports(
            data.usage(s, d).select("category", "cost"),
            data.sponsor(s, d).select("cost", "service_type"),
        ),
        over(
            "usage sponsor",
            """SELECT category, CAST(cost AS DOUBLE) AS cost, NULL::VARCHAR AS service_type FROM usage
            UNION ALL SELECT NULL, CAST(cost AS DOUBLE), service_type FROM sponsor""",
        ),
    ),
    "u2_distinct": Check(
        lambda s, d: data.usage(s, d, groups=True)
        .select("category", "resource_group")
        .distinct(),
        over(
            "usage",
            "SELECT DISTINCT category, resource_group FROM usage",
        ),
    ),
}
