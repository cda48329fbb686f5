"""The domain's tables as SQL over the driver's tables; the text serves Spark and DuckDB alike.

Money is whole cents. ``e0`` literals stay doubles in both engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.sources.rules import RULE_ROWS, version_rows

_RULES = ", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]}e0, {r[4]}e0, {r[5]})" for r in RULE_ROWS)



def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value).lower()


_VERSIONS = ", ".join(f"({', '.join(map(_sql, r))})" for r in version_rows())

VIEWS: dict[str, str] = {
    "v_transactions": """
        SELECT o_orderkey AS seq, concat('TXN', cast(o_orderkey AS varchar(20))) AS txn_id,
               concat('ACC', cast(o_custkey AS varchar(20))) AS account_id,
               cast(round(o_totalprice * 100) AS bigint) AS amount_cents, o_orderdate AS ts,
               CASE o_orderkey % 4 WHEN 0 THEN 'DEPOSIT' WHEN 1 THEN 'WITHDRAWAL' WHEN 2 THEN 'TRANSFER' ELSE 'PURCHASE' END AS type,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'channel:MOBILE' ELSE 'channel:WEB' END AS tag
        FROM orders""",
    "v_customers": """
        SELECT concat('ACC', cast(c_custkey AS varchar(20))) AS customer_id, c_name AS name,
               CASE WHEN c_acctbal >= 7000 THEN 'PREMIUM' WHEN c_acctbal >= 3000 THEN 'GOLD' ELSE 'SILVER' END AS tier,
               cast(round(c_acctbal * 100) AS bigint) AS lifetime_value_cents, n_name AS city
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_purchases": """
        SELECT concat('ORD', cast(l_orderkey AS varchar(20)), '-', cast(l_linenumber AS varchar(20))) AS order_id,
               concat('ACC', cast(o_custkey AS varchar(20))) AS customer_id, p_type AS category,
               cast(round(l_extendedprice * 100) AS bigint) AS amount_cents, n_name AS store_city
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "v_profiles": """
        SELECT c_custkey AS customer_key,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'WEALTH' WHEN 'BUILDING' THEN 'PREMIER' WHEN 'FURNITURE' THEN 'SME' ELSE 'RETAIL' END AS segment,
               300 + (c_custkey * 37) % 601 AS credit_score, (c_custkey * 11) % 361 AS tenure_months,
               cast(50000 + (c_custkey * 7919) % 5000000 AS double) AS annual_income,
               (c_acctbal + 994.28e0) * 50e0 AS current_balance,
               cast(50000 + (c_custkey * 7919) % 5000000 AS double) * (5 + (c_custkey * 13) % 70) / 100e0 AS outstanding_debt
        FROM customer""",
    "v_payments": """
        SELECT event_id AS seq, ts,
               CASE WHEN user_id % 25 = 0 THEN concat('FRAUD-TRY-', cast(user_id AS varchar(20))) ELSE concat('MUM-SAV-', cast(user_id AS varchar(20))) END AS account_id,
               cast(round(value * 100) AS bigint) * 1000 AS amount_cents,
               CASE event_id % 4 WHEN 0 THEN 'CREDIT' WHEN 1 THEN 'DEBIT' WHEN 2 THEN 'TRANSFER' ELSE 'FRAUD_CHECK' END AS type
        FROM events""",
    "v_debit_requests": """
        SELECT event_id AS seq, ts, concat('ACC', cast(user_id AS varchar(20))) AS account_id,
               concat('PAY-', cast(user_id AS varchar(20)), '-', cast(event_id % 40 AS varchar(20))) AS request_id,
               cast(round(value * 100) AS bigint) AS amount_cents, cast(100000 AS bigint) AS opening_cents
        FROM events""",
    "v_breaker_calls": """
        SELECT event_id AS seq, ts, concat('svc-', cast(user_id % 10 AS varchar(20))) AS service,
               event_type IN ('error', 'click') AS failed
        FROM events""",
    "v_queue_events": """
        SELECT event_id AS seq, ts, concat('queue-', cast(user_id % 10 AS varchar(20))) AS queue,
               cast(CASE WHEN event_id % 7 < 3 OR event_type = 'view' THEN 1 ELSE -1 END AS bigint) AS change
        FROM events""",
    "v_latency": """
        SELECT event_id AS seq, ts, event_type AS endpoint, CASE WHEN event_id % 2 = 0 THEN 'before' ELSE 'after' END AS variant,
               cast(floor(value) AS bigint) AS latency_ms, cast(50 AS bigint) AS expected_interval_ms
        FROM events""",
    "v_activities": """
        SELECT event_id AS seq, event_type AS request_type, CASE WHEN event_id % 3 = 0 THEN 'COMPUTE' ELSE 'WAIT' END AS kind, value AS ms
        FROM events""",
    "v_rules": f"SELECT * FROM (VALUES {_RULES}) AS r(rule_id, product, min_credit, min_income, max_dti, min_tenure)",
    "v_rule_versions": f"""
        SELECT rule_id, product, min_credit, cast(min_income AS double) AS min_income, cast(max_dti AS double) AS max_dti, min_tenure,
               cast(valid_from AS timestamp) AS valid_from, retired
        FROM (VALUES {_VERSIONS}) AS r(rule_id, product, min_credit, min_income, max_dti, min_tenure, valid_from, retired)""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _named(names: tuple[str, ...], sql: str) -> list[str]:
    return [name for name in names if re.search(rf"\b{name}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table, straight from the files that its SQL names; nothing is registered in the session."""
    names = _named(TABLES, VIEWS[name])
    return view_of(spark, name, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def view_of(spark: SparkSession, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A domain table over given tables, static or streaming."""
    sql = VIEWS[name]
    found = re.sub(rf"\b({'|'.join(frames) or 'none'})\b", r"{\1}", sql) if frames else sql
    return spark.sql(found, **frames)


def oracle(sql: str) -> str:
    """``sql`` behind the definitions of the domain tables that it names."""
    sql = sql.strip()
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in _named(tuple(VIEWS), sql))
    if not views:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{views}, {sql.removeprefix(start)}"
    return f"WITH {views} {sql}"
