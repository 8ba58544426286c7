"""Grouped totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import standins as data
from tallyframe.checks.base import (
    CATEGORIES,
    EXCLUDED_PROJECTS,
    MONTH,
    PROJECTS,
    RATES_START,
    TYPE_NAMES,
    Check,
)
from tallyframe.checks.joins import CORE_SQL, LINES, TYPED, core, lines, people
from tallyframe.checks.views import over
from tallyframe.operators.filters import in_month
from tallyframe.plans import cost, revenue, sponsorship, utilisation, workforce

COST = "CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost"
LAST_FOUR = """report_month IN
  (SELECT DISTINCT report_month FROM usage ORDER BY report_month DESC LIMIT 4)"""
MEANS = f"""
  SELECT report_month, subscription, CAST(sum(cost) AS DOUBLE) / count(DISTINCT day) AS mean_cost
  FROM usage WHERE {LAST_FOUR} GROUP BY ALL"""
BILLABLE = """
  SELECT period, CAST(sum(CAST(target * init_rate AS DECIMAL(18,4))) AS DOUBLE) AS billable
  FROM rates WHERE project IS NOT NULL AND project NOT IN ('SMALL', 'MEDIUM')
    AND period >= DATE '1998-01-01' GROUP BY period"""
# Invoice and payment side by side per month, a cell being the mean of the yearly sums.
CELLS = """
  SELECT mon, tx_type || '_' || side AS line, CAST(sum(total) AS DOUBLE) / count(*) AS amount
  FROM (
    SELECT 'invoiced' AS side, inv_mon AS mon, tx_type, sum(inv_amount) AS total
    FROM invoice GROUP BY inv_yr, inv_mon, tx_type
    UNION ALL
    SELECT 'collected', payment_mon, tx_type, sum(payment_amount)
    FROM invoice WHERE payment_mon IS NOT NULL GROUP BY payment_yr, payment_mon, tx_type)
  GROUP BY ALL"""
TO_DATE = "CAST(sum(CAST(amount AS DECIMAL(28,6))) AS DOUBLE)"


def _rates(s, d):
    kept = revenue.projects(data.rates(s, d), EXCLUDED_PROJECTS)
    return revenue.prepare(kept, RATES_START)


def _latest_period(s, d):
    return data.rates(s, d, projects=False).agg(F.max("period")).scalar()


def _latest_holiday(s, d):
    return data.holiday(s, d).agg(F.max("holiday")).scalar()


def _usage_by(keys: str, run, condition: str = "TRUE") -> Check:
    return Check(run, over("usage", f"SELECT {keys}, {COST} FROM usage WHERE {condition} GROUP BY ALL"))


def _previous_month(k: int) -> Check:
    month = f"(SELECT DISTINCT report_month FROM usage ORDER BY 1 DESC LIMIT 1 OFFSET {k - 1})"
    return _usage_by(
        "day, subscription",
        lambda s, d: cost.daily_by_subscription(data.usage(s, d), k),
        f"report_month = {month}",
    )


def _lost_per_project(strict: bool, condition: str) -> Check:
    return Check(
        lambda s, d: utilisation.per_project(
            utilisation.lost(revenue.projects(data.rates(s, d)), "20000101", "20001231", strict)
        ),
        over(
            "rates",
            f"""SELECT project, grouping(project) = 1 AS is_total,
              coalesce(sum((target - billed) * init_rate), 0) AS shortfall_amt
            FROM rates WHERE project IS NOT NULL AND target - billed > 0 AND {condition}
              AND period BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
            GROUP BY ROLLUP (project)""",
        ),
    )


def _core(inside: bool) -> Check:
    test = "IN" if inside else "NOT IN"
    return Check(
        lambda s, d: workforce.core_hours(people(s, d), "purchase", core(s, d), inside),
        over(
            "eod employee",
            f"""SELECT employee_name, sum(minutes)::BIGINT / 60 AS total_hrs FROM typed
            WHERE worker_type = 2 AND account = 'purchase' AND employee_name {test} ({CORE_SQL})
            GROUP BY employee_name""",
            typed=TYPED,
        ),
    )


# From, to before, and the bucket width in seconds that the times of the given tables lead to
# is not stated: both engines find it from the times seen.
SPANS = {
    "one_day": ("2001-07-10", "2001-07-11"),
    "short": ("2001-07-01", "2001-08-01"),
    "long": ("1992-01-01", "2010-01-01"),
}


def _auto_buckets(start: str, end: str) -> Check:
    widths = "".join(f"WHEN span <= {w * 24} THEN {w} " for w in cost.WIDTHS[:-1])
    return Check(
        lambda s, d: cost.resource_group_auto_buckets(data.usage(s, d, groups=True), start, end),
        over(
            "usage",
            f"""SELECT resource_group, strftime(make_timestamp((secs - secs % width + 345600) * 1000000), '%Y-%m-%d %H:%M:%S') AS bucket,
              category, {COST} FROM chosen, ruled WHERE resource_group IS NOT NULL GROUP BY ALL""",
            chosen=f"""SELECT *, epoch(usage_date)::BIGINT - 345600 AS secs FROM usage
              WHERE usage_date >= TIMESTAMP '{start}' AND usage_date < TIMESTAMP '{end}'""",
            spanned="SELECT max(secs) - min(secs) AS span FROM chosen",
            ruled=f"SELECT CASE {widths}ELSE {cost.WIDTHS[-1]} END AS width FROM spanned",
        ),
    )


CHECKS = {
    "a1_cost_per_day": _usage_by(
        "day",
        lambda s, d: cost.daily_total(data.usage(s, d), "1996-01-01"),
        "usage_date >= TIMESTAMP '1996-01-01'",
    ),
    "a2_newest_month_per_day_and_subscription": _previous_month(1),
    "a2_previous_month_per_day_and_subscription": _previous_month(2),
    "a2_third_month_per_day_and_subscription": _previous_month(3),
    "a2_fourth_month_per_day_and_subscription": _previous_month(4),
    "a3_cost_per_month": _usage_by(
        "report_month", lambda s, d: cost.monthly_total(data.usage(s, d))
    ),
    "a4_cost_per_month_end_with_gaps": Check(
        lambda s, d: cost.month_end_totals(
            data.sponsor(s, d).filter(
                ~(in_month("date", "1997-03") | in_month("date", "1997-04"))
            )
        ),
        over(
            "sponsor",
            f"""SELECT strftime(last_day(m), '%Y-%m-%d') AS date, {COST}
            FROM (SELECT unnest(generate_series(date_trunc('month', min(date)),
                date_trunc('month', max(date)), INTERVAL 1 MONTH)) AS m FROM sponsor)
            LEFT JOIN (SELECT date_trunc('month', date) AS lm, cost FROM sponsor
              WHERE report_month NOT IN ('1997-03', '1997-04')) ON m = lm
            GROUP BY m""",
        ),
    ),
    "a5_cost_per_category": _usage_by(
        "category", lambda s, d: cost.category_total(data.usage(s, d))
    ),
    "a5_cost_below_a_cent": Check(
        lambda s, d: cost.category_total(data.usage(s, d).withColumn("cost", F.col("cost") * 0.0001)),
        over(
            "usage",
            """SELECT category, CAST(sum(CAST(CAST(cost AS DECIMAL(18, 2)) * 0.0001 AS DECIMAL(18, 6)))
              AS DOUBLE) AS cost FROM usage GROUP BY category""",
        ),
    ),
    "a6_compare_categories": _usage_by(
        "subscription, category, report_month",
        lambda s, d: cost.compare_categories(data.usage(s, d), CATEGORIES),
        "category IN ('1-URGENT', '2-HIGH', '5-LOW')",
    ),
    "a7_cost_per_resource_group": _usage_by(
        "resource_group",
        lambda s, d: cost.resource_groups(data.usage(s, d, groups=True), MONTH),
        "report_month = '2001-07' AND resource_group IS NOT NULL",
    ),
    "a8_resource_group_buckets": _usage_by(
        "resource_group, day AS bucket, category",
        lambda s, d: cost.resource_group_buckets(data.usage(s, d, groups=True), MONTH),
        "report_month = '2001-07' AND resource_group IS NOT NULL",
    ),
    "a8_resource_group_weekly_buckets": _usage_by(
        "resource_group, strftime(date_trunc('week', usage_date), '%Y-%m-%d') AS bucket, category",
        lambda s, d: cost.resource_group_buckets(data.usage(s, d, groups=True), MONTH, "week"),
        "report_month = '2001-07' AND resource_group IS NOT NULL",
    ),
    **{f"a8_auto_buckets_{name}": _auto_buckets(*span) for name, span in SPANS.items()},
    "a9_category_and_resource_group": _usage_by(
        "category, resource_group",
        lambda s, d: cost.categories_by_resource_group(data.usage(s, d, groups=True), MONTH),
        "report_month = '2001-07' AND resource_group IS NOT NULL",
    ),
    "a10_cost_per_service": Check(
        lambda s, d: sponsorship.running_cost(data.sponsor(s, d, names=True), "service_name"),
        over("sponsor", f"SELECT service_name, {COST} FROM sponsor GROUP BY ALL"),
    ),
    "a10_cost_per_resource": Check(
        lambda s, d: sponsorship.running_cost(data.sponsor(s, d), "service_resource"),
        over("sponsor", f"SELECT service_resource, {COST} FROM sponsor GROUP BY ALL"),
    ),
    "a11_large_resources": Check(
        lambda s, d: sponsorship.large_resources(data.sponsor(s, d), 32_000_000),
        over(
            "sponsor",
            f"SELECT service_resource, {COST} FROM sponsor GROUP BY ALL HAVING sum(cost) >= 32000000",
        ),
    ),
    "a12_resources_in_open_band": Check(
        lambda s, d: sponsorship.small_resources(data.sponsor(s, d), 29_000_000, 32_000_000),
        over(
            "sponsor",
            f"""SELECT service_resource, {COST} FROM sponsor GROUP BY ALL
            HAVING sum(cost) > 29000000 AND sum(cost) < 32000000""",
        ),
    ),
    "a13_large_regions": Check(
        lambda s, d: sponsorship.large_regions(data.sponsor(s, d, regions=True), 500_000_000),
        over(
            "sponsor",
            f"SELECT service_region, {COST} FROM sponsor GROUP BY ALL HAVING sum(cost) > 500000000",
        ),
    ),
    "a14_month_and_service_name": Check(
        lambda s, d: sponsorship.monthly_by(
            data.sponsor(s, d, names=True), "service_name", 6_500_000
        ),
        over(
            "sponsor",
            """SELECT report_month, service_name, CAST(sum(cost) AS DOUBLE) AS total
            FROM sponsor GROUP BY ALL HAVING sum(cost) > 6500000""",
        ),
    ),
    "a15_month_and_service_type": Check(
        lambda s, d: sponsorship.monthly_by(data.sponsor(s, d), "service_type", 6_500_000),
        over(
            "sponsor",
            """SELECT report_month, service_type, CAST(sum(cost) AS DOUBLE) AS total
            FROM sponsor GROUP BY ALL HAVING sum(cost) > 6500000""",
        ),
    ),
    "a16_mean_cost_per_day_seen": Check(
        lambda s, d: cost.mean_per_day(data.usage(s, d)), over("usage", MEANS)
    ),
    "a17_mean_cost_with_total": Check(
        lambda s, d: cost.mean_per_day_with_total(data.usage(s, d)),
        over(
            "usage",
            """SELECT report_month, coalesce(subscription, 'Total') AS subscription,
              CAST(sum(CAST(mean_cost AS DECIMAL(28,6))) AS DOUBLE) AS mean_cost
            FROM means GROUP BY GROUPING SETS ((report_month, subscription), (report_month))""",
            means=MEANS,
        ),
    ),
    "a18_posts_with_total": Check(
        lambda s, d: revenue.posts(_rates(s, d), PROJECTS),
        over(
            "rates",
            """SELECT strftime(period, '%Y-%m-%d 00:00:00') AS period,
              CASE WHEN grouping(project) = 1 THEN 'Total' ELSE project END AS project,
              CAST(sum(CAST(fte AS DECIMAL(18,4))) AS DOUBLE) AS fte
            FROM rates WHERE project IN ('STANDARD', 'ECONOMY', 'LARGE')
              AND period >= DATE '1998-01-01'
            GROUP BY GROUPING SETS ((period, project), (period))""",
        ),
    ),
    "a19_billable_hours": Check(
        lambda s, d: revenue.billable_hours(_rates(s, d), PROJECTS, {"LARGE": 160.0}),
        over(
            "rates",
            """SELECT strftime(period, '%Y-%m-%d 00:00:00') AS period, project,
              CASE WHEN project = 'LARGE' THEN 160 ELSE max(target) END AS target
            FROM rates WHERE project IN ('STANDARD', 'ECONOMY', 'LARGE')
              AND period >= DATE '1998-01-01' GROUP BY period, project""",
        ),
    ),
    "a20_projected_revenue": Check(
        lambda s, d: revenue.projected(_rates(s, d), _latest_period(s, d)),
        over(
            "rates",
            """SELECT strftime(period, '%Y-%m-%d 00:00:00') AS period,
              strftime(period, '%B %Y') AS month, billable,
              period = (SELECT max(period) FROM rates) AS is_current FROM b""",
            b=BILLABLE,
        ),
    ),
    "a21_current_month_revenue": Check(
        lambda s, d: revenue.current_month(_rates(s, d), _latest_period(s, d)),
        over(
            "rates",
            """SELECT strftime(period, '%Y-%m-%d 00:00:00') AS period,
              strftime(period, '%B %Y') AS month, billable
            FROM b WHERE period = (SELECT max(period) FROM rates)""",
            b=BILLABLE,
        ),
    ),
    "a22_invoiced": Check(
        lambda s, d: revenue.invoiced(data.invoice(s, d)),
        over(
            "invoice",
            """SELECT inv_yr, inv_mon, tx_type, CAST(sum(inv_amount) AS DOUBLE) AS inv_amount
            FROM invoice GROUP BY ALL""",
        ),
    ),
    "a23_collected": Check(
        lambda s, d: revenue.collected(data.invoice(s, d)),
        over(
            "invoice",
            """SELECT payment_yr, payment_mon, tx_type,
              CAST(sum(payment_amount) AS DOUBLE) AS payment_amount
            FROM invoice WHERE payment_yr IS NOT NULL GROUP BY ALL""",
        ),
    ),
    "a24_to_date_totals": Check(
        lambda s, d: revenue.to_date_totals(data.invoice(s, d)),
        over("invoice", f"SELECT line, {TO_DATE} AS amount FROM cells GROUP BY line", cells=CELLS),
    ),
    "a25_holidays_per_month": Check(
        lambda s, d: revenue.holidays_per_month(data.holiday(s, d), _latest_holiday(s, d)),
        over(
            "holiday",
            """SELECT strftime(holiday, '%Y-%m') AS month, count(*) AS holidays FROM holiday
            WHERE year(holiday) = (SELECT year(max(holiday)) FROM holiday) GROUP BY ALL""",
        ),
    ),
    "a26_holidays_in_month": Check(
        lambda s, d: revenue.holidays_in_month(data.holiday(s, d), "2001-07-01"),
        over(
            "holiday",
            """SELECT strftime(holiday, '%Y-%m-%d') AS holiday, holiday_name FROM holiday
            WHERE strftime(holiday, '%Y-%m') = '2001-07'""",
        ),
    ),
    "a27_lost_per_project": _lost_per_project(True, "indiv_eligibility = 0"),
    "a27_lost_per_project_open": _lost_per_project(
        False, "indiv_eligibility IS DISTINCT FROM 1"
    ),
    "a28_hours_per_account": Check(
        lambda s, d: workforce.account_hours(lines(s, d)),
        over(
            "eod",
            "SELECT account, sum(total_minutes)::BIGINT / 60 AS total_hrs FROM lines GROUP BY account",
            lines=LINES,
        ),
    ),
    "a29_hours_per_worker_type": Check(
        lambda s, d: workforce.hours_by_type(people(s, d), TYPE_NAMES),
        over(
            "eod employee",
            """SELECT CAST(worker_type AS BIGINT) AS worker_type,
              CASE worker_type WHEN 1 THEN 'Interns' WHEN 3 THEN 'Other groups' ELSE 'Home' END
                AS type_name,
              sum(minutes)::BIGINT / 60 AS total_hrs,
              sum(minutes)::DOUBLE / (SELECT sum(minutes) FROM typed)::DOUBLE AS share
            FROM typed GROUP BY worker_type""",
            typed=TYPED,
        ),
    ),
    "a29_hours_per_person": Check(
        lambda s, d: workforce.hours_per_person(people(s, d)),
        over(
            "eod employee",
            """SELECT employee_name, CAST(worker_type AS BIGINT) AS worker_type,
              sum(minutes)::BIGINT / 60 AS total_hrs FROM typed GROUP BY ALL""",
            typed=TYPED,
        ),
    ),
    "a30_heads_per_worker_type": Check(
        lambda s, d: workforce.heads_by_type(people(s, d), TYPE_NAMES),
        over(
            "eod employee",
            """SELECT CAST(worker_type AS BIGINT) AS worker_type,
              count(DISTINCT employee_name) AS heads,
              CASE worker_type WHEN 1 THEN 'Interns' WHEN 3 THEN 'Other groups' ELSE 'Home' END
                AS type_name,
              count(DISTINCT employee_name)::DOUBLE
                / (SELECT count(DISTINCT employee_name) FROM typed) AS share
            FROM typed GROUP BY worker_type""",
            typed=TYPED,
        ),
    ),
    "a31_hours_per_account_and_person": Check(
        lambda s, d: workforce.person_hours(lines(s, d)),
        over(
            "eod",
            """SELECT account, employee_name, sum(total_minutes)::BIGINT / 60 AS total_hrs
            FROM lines GROUP BY ALL""",
            lines=LINES,
        ),
    ),
    "a32_distinct_people": Check(
        lambda s, d: workforce.distinct_people(lines(s, d)),
        over("eod", "SELECT count(DISTINCT employee_name) AS people FROM lines", lines=LINES),
    ),
    "a33_core_hours": _core(True),
    "a33_core_support_hours": _core(False),
    "a33_core_title": Check(
        lambda s, d: workforce.core_title(people(s, d), "purchase", core(s, d), False, "Support"),
        over(
            "eod employee",
            f"""SELECT people, total_hrs, 'Support (' || people || ' FTEs; '
              || format('{{:,.2f}}', total_hrs) || ' hrs)' AS title
            FROM (SELECT count(DISTINCT employee_name) AS people,
                coalesce(sum(minutes), 0)::BIGINT / 60 AS total_hrs FROM typed
              WHERE worker_type = 2 AND account = 'purchase'
                AND employee_name NOT IN ({CORE_SQL}))""",
            typed=TYPED,
        ),
    ),
    "a34_active_per_company": Check(
        lambda s, d: workforce.active_by(data.employee(s, d), "company", "company"),
        over(
            "employee",
            """SELECT company, count(*) AS employees FROM employee
            WHERE NOT resigned AND company IS NOT NULL GROUP BY company""",
        ),
    ),
    "a34_active_per_department": Check(
        lambda s, d: workforce.active_by(data.employee(s, d), "grp2", "department"),
        over(
            "employee",
            """SELECT grp2 AS department, count(*) AS employees FROM employee
            WHERE NOT resigned GROUP BY grp2""",
        ),
    ),
    "a35_extent": Check(
        lambda s, d: cost.extent(data.usage(s, d)),
        over(
            "usage",
            f"""SELECT min(day) AS first_day, max(day) AS last_day, {COST}, count(*) AS row_count
            FROM usage""",
        ),
    ),
    "a36_month_end_forecast": Check(
        lambda s, d: cost.month_end_forecast(data.usage(s, d)),
        over(
            "usage",
            """SELECT remaining_days, current_total, daily_mean,
              current_total + remaining_days * daily_mean AS month_end_total
            FROM (SELECT CAST(max(day(last_day(d)) - day(d)) AS BIGINT) AS remaining_days,
                CAST(sum(cost) AS DOUBLE) AS current_total,
                CAST(sum(CAST(CAST(cost AS DOUBLE) / days AS DECIMAL(28,6))) AS DOUBLE)
                  AS daily_mean
              FROM (SELECT subscription, sum(cost) AS cost, count(DISTINCT day) AS days,
                  max(max(usage_date)) OVER () AS d
                FROM usage WHERE report_month = (SELECT max(report_month) FROM usage)
                GROUP BY subscription))""",
        ),
    ),
    "a37_dense_daily_cost": Check(
        lambda s, d: cost.dense_daily(data.usage(s, d)),
        over(
            "usage",
            f"""SELECT s.subscription, c.category, t.day, {COST}
            FROM (SELECT DISTINCT subscription FROM usage) s,
              (SELECT DISTINCT category FROM usage) c, (SELECT DISTINCT day FROM usage) t
            LEFT JOIN usage u ON u.subscription = s.subscription AND u.category = c.category
              AND u.day = t.day
            GROUP BY ALL""",
        ),
    ),
    "a38_revenue_split": Check(
        lambda s, d: revenue.revenue_split(data.invoice(s, d), {"d": 58}),
        over(
            "invoice",
            f"""SELECT tx_type, revenue, revenue
              / (SELECT sum(CAST(revenue AS DECIMAL(28,6))) FROM r)::DOUBLE AS share FROM r""",
            cells=CELLS,
            r=f"""SELECT left(line, 1) AS tx_type,
              {TO_DATE} * (CASE WHEN left(line, 1) = 'd' THEN 58 ELSE 1 END) AS revenue
            FROM cells WHERE line LIKE '%invoiced' GROUP BY line""",
        ),
    ),
}

