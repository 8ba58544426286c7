"""The stand-in views of `tallyframe.standins`, in SQL."""

from __future__ import annotations

VIEWS = {
    "usage": """
        SELECT o_orderdate AS usage_date, o_orderpriority AS category,
          CASE WHEN o_orderstatus = 'F' THEN 'Beta' ELSE 'Production' END AS subscription,
          CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS resource_group,
          CAST(o_totalprice AS DECIMAL(18,2)) AS cost,
          strftime(o_orderdate, '%Y-%m') AS report_month,
          strftime(o_orderdate, '%Y-%m-%d') AS day
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "sponsor": """
        SELECT l_shipdate AS date, p_type AS service_name,
          l_returnflag || l_linestatus AS service_type, r_name AS service_region,
          CAST(l_suppkey AS VARCHAR) AS service_resource,
          CAST(l_extendedprice AS DECIMAL(18,2)) AS cost,
          strftime(l_shipdate, '%Y-%m') AS report_month
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
        LEFT JOIN supplier ON l_suppkey = s_suppkey
        LEFT JOIN nation ON s_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "rates": """
        SELECT CAST(l_suppkey AS VARCHAR) AS employee,
          CASE WHEN p_type <> 'PROMO' THEN p_type END AS project,
          round(l_tax * 100) AS init_rate, round(l_discount * 10, 1) AS fte,
          round(l_tax * 100) AS rate, CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
          l_returnflag AS "rank", l_linestatus AS "level", l_quantity AS target,
          CASE WHEN l_quantity <> l_linenumber - 3 THEN l_quantity - (l_linenumber - 3) END AS billed,
          CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS indiv_eligibility
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    "invoice": """
        SELECT *, CAST(year(inv_date) AS BIGINT) AS inv_yr, CAST(month(inv_date) AS BIGINT) AS inv_mon,
          CAST(year(date_paid) AS BIGINT) AS payment_yr,
          CAST(month(date_paid) AS BIGINT) AS payment_mon
        FROM (SELECT c_name AS client, CAST(o_orderdate AS DATE) AS inv_date,
          CAST(o_orderdate AS DATE) + 30 AS due_date,
          CAST(o_totalprice AS DECIMAL(18,2)) AS inv_amount,
          CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) + 45 END AS date_paid,
          CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice AS DECIMAL(18,2)) END
            AS payment_amount,
          CASE o_orderstatus WHEN 'O' THEN 'd' WHEN 'F' THEN 'f' ELSE 'x' END AS tx_type
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey)""",
    "holiday": """
        SELECT CAST(o_orderdate AS DATE) AS holiday, o_orderpriority AS holiday_name FROM orders""",
    "employee": """
        SELECT CAST(c_custkey + c_custkey // 4 AS VARCHAR) AS employee, c_mktsegment AS grp,
          c_acctbal < 0 AS resigned, CASE WHEN c_acctbal < 0 THEN '2024-01-31' END AS last_day,
          c_mktsegment AS "rank", CAST(n_regionkey AS VARCHAR) AS "level",
          '2020-01-01' AS "start",
          CASE WHEN c_nationkey < 8 THEN 'Core' WHEN c_nationkey < 16 THEN 'Solutions'
            WHEN c_nationkey < 24 THEN 'Delivery' END AS account,
          r_name AS grp2, CASE WHEN c_nationkey <> 0 THEN n_name END AS company,
          CAST(CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END AS BIGINT) AS include,
          c_name AS remarks,
          CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'p' || c_nationkey END
            AS billed_project,
          n_name || ' ' || c_mktsegment AS activities
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN region ON n_regionkey = r_regionkey""",
    "eod": """
        SELECT CAST(user_id AS VARCHAR) AS employee_name, ts AS date, event_type AS account,
          CAST(floor(value / 60) AS BIGINT) AS hours,
          CAST(minute(ts) AS BIGINT) AS minutes,
          CAST(floor(value / 60) * 60 + minute(ts) AS BIGINT) AS total_minutes
        FROM events""",
}


def over(names: str, body: str, **steps: str) -> str:
    """SQL over the named views; `steps` are further named subqueries."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    parts += [f"{name} AS ({text})" for name, text in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
