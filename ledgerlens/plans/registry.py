"""Queries over the driver's tables, by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import rules, scoring
from ledgerlens.operators import (
    capacity,
    decisions,
    eligibility,
    latency,
    ledger,
    quality,
    resilience,
    sketches,
    statements,
    transactions,
)
from ledgerlens.plans.views import oracle, view
from ledgerlens.session import shared_folder
from ledgerlens.sources.rules import rules_file, standard_rules
from ledgerlens.streaming import queries as streams

FLAGSHIP = "recommendations"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def big(*names: str) -> list:
    return [F.col(name).cast("bigint").alias(name) for name in names]


# Filters, rules and projections


@query("SELECT txn_id, account_id AS customer_id, amount_cents FROM v_transactions WHERE amount_cents > 5000000 AND amount_cents > 7000000")
def fraud_candidates(spark, sf_dir):
    return transactions.fraud_candidates(view(spark, sf_dir, "v_transactions"))


@query("SELECT count(*) AS n FROM v_transactions WHERE type = 'WITHDRAWAL' AND amount_cents > 5000000")
def high_value_withdrawals(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions")
    return transactions.count_matching(df, rules.is_type("WITHDRAWAL"), rules.above("amount_cents", 50_000_00))


def _fraud_rules() -> dict:
    high, mobile = rules.above("amount_cents", 50_000_00), rules.has_tag("tags", "channel:MOBILE")
    withdrawal = rules.is_type("WITHDRAWAL")
    return {
        "high": high,
        "mobile": mobile,
        "withdrawal": withdrawal,
        "high_and_mobile": rules.all_of(high, mobile),
        "high_or_withdrawal": rules.any_of(high, withdrawal),
    }


_RULES_SQL = """
SELECT txn_id, amount_cents > 5000000 AS high, tag = 'channel:MOBILE' AS mobile, type = 'WITHDRAWAL' AS withdrawal,
       amount_cents > 5000000 AND tag = 'channel:MOBILE' AS high_and_mobile,
       amount_cents > 5000000 OR type = 'WITHDRAWAL' AS high_or_withdrawal
FROM v_transactions"""


def _tagged(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "v_transactions").withColumn("tags", F.array("tag"))


@query(_RULES_SQL)
def fraud_rule_flags(spark, sf_dir):
    found = _fraud_rules()
    return rules.flag_rules(_tagged(spark, sf_dir), found).select("txn_id", *found)


@query(f"""WITH f AS ({_RULES_SQL}) SELECT count_if(high)::bigint AS high, count_if(mobile)::bigint AS mobile,
count_if(withdrawal)::bigint AS withdrawal, count_if(high_and_mobile)::bigint AS high_and_mobile,
count_if(high_or_withdrawal)::bigint AS high_or_withdrawal FROM f""")
def fraud_rule_counts(spark, sf_dir):
    return rules.count_rules(_tagged(spark, sf_dir), _fraud_rules())


@query("SELECT txn_id, cast((amount_cents * 2 + 50) // 100 AS bigint) AS fee_cents FROM v_transactions")
def fees_normalised(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions")
    return df.select("txn_id", transactions.fee_cents(F.col("amount_cents")).alias("fee_cents"))


@query("""SELECT seq, amount_cents < 5000000 AS approved,
CASE WHEN amount_cents < 5000000 THEN concat('TXN-', cast(seq AS varchar), '-APPROVED') END AS response FROM v_payments""")
def authorizations(spark, sf_dir):
    return transactions.authorize(view(spark, sf_dir, "v_payments")).select("seq", "approved", "response")


@query("""SELECT customer_id, CASE WHEN lifetime_value_cents < 0 THEN 'lifetime value negative' END AS violations
FROM v_customers WHERE lifetime_value_cents < 0""")
def quality_violations(spark, sf_dir):
    checks = quality.required("customer_id", "name", "lifetime_value_cents")
    checks |= {"lifetime value negative": F.col("lifetime_value_cents") >= 0}
    _, bad = quality.split_valid(view(spark, sf_dir, "v_customers"), checks)
    return bad.select("customer_id", F.array_join("violations", ", ").alias("violations"))


# Aggregations, top-N, batches

_STATS = """count(*) AS n, cast(coalesce(sum(amount_cents), 0) AS bigint) AS sum_cents,
cast(CASE WHEN count(*) = 0 THEN 0 ELSE (2 * sum(amount_cents) + count(*)) // (2 * count(*)) END AS bigint) AS avg_cents,
greatest(coalesce(max(amount_cents), 0), 0) AS max_cents"""


@query(f"SELECT account_id, {_STATS} FROM v_transactions GROUP BY account_id")
def account_stats(spark, sf_dir):
    return transactions.account_stats(view(spark, sf_dir, "v_transactions"), ["account_id"])


@query(f"SELECT {_STATS} FROM v_transactions")
def account_stats_global(spark, sf_dir):
    return transactions.account_stats(view(spark, sf_dir, "v_transactions"))


@query("""WITH t AS (SELECT account_id, CASE WHEN type = 'DEPOSIT' THEN amount_cents ELSE -amount_cents END AS a FROM v_transactions),
s AS (SELECT account_id, count(*) AS n, cast(sum(a) AS bigint) AS total, max(a) AS top FROM t GROUP BY 1)
SELECT account_id, n, total AS sum_cents, CASE WHEN total < 0 THEN -((n - 2 * total) // (2 * n)) ELSE (2 * total + n) // (2 * n) END AS avg_cents,
greatest(top, 0) AS max_cents FROM s""")
def account_stats_signed(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions")
    signed = df.withColumn("amount_cents", F.when(rules.is_type("DEPOSIT"), F.col("amount_cents")).otherwise(-F.col("amount_cents")))
    return transactions.account_stats(signed, ["account_id"])


@query("""SELECT cast(coalesce(sum(amount_cents // 100), 0) AS bigint) AS total FROM v_transactions
WHERE type = 'DEPOSIT' AND amount_cents // 100 > 50000""")
def deposit_sum_truncated(spark, sf_dir):
    return transactions.deposit_sum_truncated(view(spark, sf_dir, "v_transactions"))


@query("SELECT cast(coalesce(sum(amount_cents), 0) AS bigint) AS total_cents FROM v_purchases")
def purchase_total(spark, sf_dir):
    return transactions.total(view(spark, sf_dir, "v_purchases"))


@query("SELECT txn_id, account_id, amount_cents FROM v_transactions ORDER BY amount_cents DESC, txn_id LIMIT 5")
def top5_transactions(spark, sf_dir):
    return transactions.top_n(view(spark, sf_dir, "v_transactions").select("txn_id", "account_id", "amount_cents"), 5)


@query("""SELECT * FROM (SELECT txn_id, account_id, amount_cents,
row_number() OVER (PARTITION BY account_id ORDER BY amount_cents DESC, txn_id) AS rank FROM v_transactions) WHERE rank <= 3""")
def top3_per_account(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions").select("txn_id", "account_id", "amount_cents")
    return transactions.top_n(df, 3, keys=["account_id"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT seq, txn_id, amount_cents FROM v_transactions WHERE amount_cents > 9900000 ORDER BY seq LIMIT 1")
def first_above_threshold(spark, sf_dir):
    return transactions.first_above(view(spark, sf_dir, "v_transactions").select("seq", "txn_id", "amount_cents"), 99_000_00)


@query("SELECT seq, upper(substring(txn_id, 1, 3)) AS prefix, account_id FROM v_transactions ORDER BY seq LIMIT 8")
def preview_rows(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions")
    return transactions.first_rows(df.select("seq", F.upper(F.substring("txn_id", 1, 3)).alias("prefix"), "account_id"), 8)


@query("""SELECT part, count(*) AS n, min(seq) AS first_seq FROM (SELECT seq, CASE WHEN row_number() OVER (ORDER BY seq) <= 2
THEN 'first' ELSE 'rest' END AS part FROM v_transactions) GROUP BY part""")
def first_two_and_rest(spark, sf_dir):
    parted = transactions.first_and_rest(view(spark, sf_dir, "v_transactions").select("seq"), 2)
    return parted.groupBy("part").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query("""SELECT producer, count(*) AS n FROM (SELECT 'events' AS producer FROM events UNION ALL SELECT 'lineitem' FROM lineitem
UNION ALL SELECT 'orders' FROM orders) GROUP BY producer UNION ALL
SELECT 'all', (SELECT count(*) FROM events) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM orders)""")
def producer_union_count(spark, sf_dir):
    names = ("events", "lineitem", "orders")
    return transactions.union_count({n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


@query("SELECT DISTINCT account_id FROM v_transactions")
def distinct_accounts(spark, sf_dir):
    return transactions.distinct_accounts(view(spark, sf_dir, "v_transactions"))


@query("""SELECT batch, count(*) AS n, cast(sum(amount_cents) AS bigint) AS total_cents FROM (SELECT amount_cents,
(row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM v_transactions) GROUP BY batch""")
def batch_totals(spark, sf_dir):
    batched = transactions.assign_batches(view(spark, sf_dir, "v_transactions"), 250)
    return batched.groupBy("batch").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("total_cents"))


@query("""SELECT half, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM
(SELECT seq, cast(ntile(2) OVER (ORDER BY seq) AS bigint) AS half FROM v_transactions) GROUP BY half""")
def half_split(spark, sf_dir):
    halves = transactions.assign_halves(view(spark, sf_dir, "v_transactions").select("seq"))
    return halves.groupBy("half").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("SELECT cast(sum(length(format('₹{:,.2f}', amount_cents / 100.0))) AS bigint) AS checksum FROM v_transactions")
def format_checksum(spark, sf_dir):
    return transactions.format_checksum(view(spark, sf_dir, "v_transactions"))


# Ledger, breakers, queues


@query("""SELECT seq, cast(1000000 + sum(CASE WHEN type = 'DEPOSIT' THEN amount_cents ELSE -amount_cents END)
OVER (PARTITION BY account_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS bigint) AS balance_cents FROM v_transactions""")
def running_balance(spark, sf_dir):
    df = view(spark, sf_dir, "v_transactions")
    return ledger.running_balance(df, 10_000_00, rules.is_type("DEPOSIT"), ["ts", "seq"]).select("seq", "balance_cents")


_RETRIES = """SELECT concat('ACC', cast(l_orderkey AS varchar(20))) AS account_id,
concat(cast(l_orderkey AS varchar(20)), '-', cast(l_linenumber AS varchar(20))) AS request_id,
cast(round(l_extendedprice * 100) AS bigint) AS amount_cents, l_shipdate AS ts, l_partkey AS part, l_suppkey AS supp FROM lineitem"""


@query(f"""WITH r AS ({_RETRIES}),
n AS (SELECT *, row_number() OVER (PARTITION BY account_id, request_id ORDER BY ts, part, supp, amount_cents) AS nth FROM r),
b AS (SELECT *, cast(100000000 - sum(CASE WHEN nth = 1 THEN amount_cents ELSE 0 END) OVER
  (PARTITION BY account_id ORDER BY ts, part, supp, amount_cents, request_id ROWS UNBOUNDED PRECEDING) AS bigint) AS balance_cents FROM n)
SELECT request_id, ts, nth > 1 AS duplicate, balance_cents, concat(CASE WHEN nth > 1 THEN 'Duplicate request ignored. Previous result: ' ELSE '' END,
  'Debited, Balance: ', cast(first_value(balance_cents) OVER (PARTITION BY account_id, request_id
  ORDER BY ts, part, supp, amount_cents, request_id) AS varchar)) AS result FROM b""")
def idempotent_debits(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    requests = spark.sql(_RETRIES.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    done = ledger.idempotent_debits(requests, 1_000_000_00, ["ts", "part", "supp", "amount_cents", "request_id"])
    return done.select("request_id", "ts", "duplicate", "balance_cents", "result")


_LEDGER_SQL = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts, seq) AS rn FROM v_debit_requests),
f AS (SELECT account_id, cast(0 AS bigint) AS rn, min(opening_cents) AS bal, cast([] AS varchar[]) AS done, '' AS status, cast(-1 AS bigint) AS seq FROM o GROUP BY 1
  UNION ALL SELECT o.account_id, o.rn,
    CASE WHEN list_contains(done, request_id) OR bal < amount_cents THEN bal ELSE bal - amount_cents END,
    CASE WHEN list_contains(done, request_id) OR bal < amount_cents THEN done ELSE list_append(done, request_id) END,
    CASE WHEN list_contains(done, request_id) THEN 'DUPLICATE' WHEN bal < amount_cents THEN 'INSUFFICIENT' ELSE 'APPLIED' END, o.seq
  FROM f JOIN o ON o.account_id = f.account_id AND o.rn = f.rn + 1)
SELECT seq, status, bal AS balance_cents FROM f WHERE rn > 0"""

_OPEN = "st = 'OPEN' AND NOT (o.ts > last + INTERVAL '2 hours')"
_BREAKER_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, seq) AS rn FROM v_breaker_calls),
f AS (SELECT service, cast(0 AS bigint) AS rn, 'CLOSED' AS st, 0 AS n, cast(NULL AS timestamp) AS last, '' AS b4, '' AS dec, cast(-1 AS bigint) AS seq FROM o GROUP BY 1
  UNION ALL SELECT o.service, o.rn,
    CASE WHEN {_OPEN} THEN 'OPEN' WHEN o.failed THEN CASE WHEN n + 1 >= 3 THEN 'OPEN' ELSE st END ELSE 'CLOSED' END,
    CASE WHEN {_OPEN} THEN n WHEN o.failed THEN n + 1 ELSE 0 END,
    CASE WHEN {_OPEN} THEN last WHEN o.failed THEN o.ts ELSE last END,
    st, CASE WHEN {_OPEN} THEN 'REJECTED' ELSE 'CALLED' END, o.seq
  FROM f JOIN o ON o.service = f.service AND o.rn = f.rn + 1)
SELECT seq, b4 AS state_before, dec AS decision, st AS state_after, cast(n AS bigint) AS failures FROM f WHERE rn > 0"""


@query(_LEDGER_SQL)
def debit_ledger(spark, sf_dir):
    return ledger.debit_ledger(view(spark, sf_dir, "v_debit_requests"))


@query(_BREAKER_SQL)
def breaker_trace(spark, sf_dir):
    return resilience.breaker_trace(view(spark, sf_dir, "v_breaker_calls"), 3, timedelta(hours=2))


# at a call: the state it meets (pre), then the outcomes that count (kept) and whether they trip the breaker
_MET = "CASE WHEN st = 'OPEN' AND o.ts >= since + INTERVAL '2 hours' THEN 'HALF_OPEN' ELSE st END"
_RATE_FOLD = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts, seq) AS rn FROM v_breaker_calls),
f AS (SELECT service, cast(0 AS bigint) AS rn, 'CLOSED' AS st, cast(NULL AS timestamp) AS since, cast([] AS integer[]) AS recent, '' AS b4, '' AS dec, cast(-1 AS bigint) AS seq
  FROM o GROUP BY 1
  UNION ALL SELECT service, rn,
    CASE WHEN pre = 'OPEN' THEN 'OPEN' WHEN trips THEN 'OPEN' WHEN pre = 'HALF_OPEN' AND len(kept) = size THEN 'CLOSED' ELSE pre END,
    CASE WHEN pre <> 'OPEN' AND trips THEN ts ELSE since END,
    CASE WHEN pre = 'OPEN' THEN recent WHEN pre = 'HALF_OPEN' AND len(kept) = size AND NOT trips THEN cast([] AS integer[]) ELSE kept END,
    pre, CASE WHEN pre = 'OPEN' THEN 'REJECTED' ELSE 'CALLED' END, seq
  FROM (SELECT *, len(kept) = size AND list_sum(kept) >= 0.5e0 * size AS trips
    FROM (SELECT *, list_slice(said, greatest(1, len(said) - size + 1), len(said)) AS kept
      FROM (SELECT *, list_append(CASE WHEN pre = st THEN recent ELSE cast([] AS integer[]) END, cast(failed AS integer)) AS said, CASE WHEN pre = 'HALF_OPEN' THEN 2 ELSE 5 END AS size
        FROM (SELECT o.service, o.rn, o.seq, o.ts, o.failed, st, since, recent, {_MET} AS pre FROM f JOIN o ON o.service = f.service AND o.rn = f.rn + 1)))))"""
_RATE_BREAKER_SQL = f"""{_RATE_FOLD}
SELECT seq, b4 AS state_before, dec AS decision, st AS state_after, cast(coalesce(list_sum(recent), 0) AS bigint) AS failures FROM f WHERE rn > 0"""


@query(_RATE_BREAKER_SQL)
def breaker_trace_by_rate(spark, sf_dir):
    return resilience.breaker_trace(view(spark, sf_dir, "v_breaker_calls"), open_for=timedelta(hours=2), mode="rate")


@query("""SELECT seq, CASE WHEN count(*) OVER w >= 5 THEN round(avg(CASE WHEN failed THEN 1e0 ELSE 0e0 END) OVER w, 6) END AS failure_rate,
CASE WHEN count(*) OVER w >= 5 THEN avg(CASE WHEN failed THEN 1e0 ELSE 0e0 END) OVER w >= 0.5e0 ELSE false END AS would_trip
FROM v_breaker_calls WINDOW w AS (PARTITION BY service ORDER BY ts, seq ROWS 4 PRECEDING)""")
def failure_rate_last5(spark, sf_dir):
    found = resilience.failure_rate(view(spark, sf_dir, "v_breaker_calls"))
    return found.select("seq", F.round("failure_rate", 6).alias("failure_rate"), "would_trip")


@query("""WITH i AS (SELECT seq, service, ts, failed, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY service ORDER BY ts, seq
ROWS UNBOUNDED PRECEDING) AS island FROM v_breaker_calls)
SELECT seq, cast(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY service, island ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS bigint) AS streak FROM i""")
def failure_streaks(spark, sf_dir):
    return resilience.failure_streaks(view(spark, sf_dir, "v_breaker_calls")).select("seq", "streak")


@query("""SELECT seq, CASE WHEN failed THEN 'Service unavailable, try later' ELSE concat('OK-', cast(seq AS varchar)) END AS message
FROM v_breaker_calls""")
def fallback_messages(spark, sf_dir):
    calls = view(spark, sf_dir, "v_breaker_calls")
    result = F.when(~F.col("failed"), F.concat(F.lit("OK-"), F.col("seq").cast("string")))
    return calls.select("seq", resilience.fallback(result, "Service unavailable, try later").alias("message"))


@query("""WITH e AS (SELECT o_orderdate AS ts, 1 AS d FROM orders UNION ALL SELECT l_shipdate, -1 FROM lineitem),
c AS (SELECT ts, cast(sum(d) AS bigint) AS change FROM e GROUP BY ts),
s AS (SELECT ts, change, cast(sum(change) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS bigint) AS size FROM c)
SELECT strftime(ts, '%Y-%m-%d') AS day, change, size, size > 10 AS above FROM s""")
def backlog_over_time(spark, sf_dir):
    arrivals = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("ts"))
    completions = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").alias("ts"))
    sized = capacity.backlog(arrivals, completions, 10)
    return sized.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "change", "size", "above")


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY ts, seq) AS rn FROM v_queue_events),
f AS (SELECT queue, cast(0 AS bigint) AS rn, cast(-1 AS bigint) AS seq, cast(0 AS bigint) AS size, false AS refused, false AS starved FROM o GROUP BY 1
  UNION ALL SELECT o.queue, o.rn, o.seq, least(10, greatest(0, size + change)), change > 0 AND size = 10, change < 0 AND size = 0
  FROM f JOIN o ON o.queue = f.queue AND o.rn = f.rn + 1)
SELECT seq, size, refused, starved FROM f WHERE rn > 0""")
def bounded_queue(spark, sf_dir):
    return capacity.bounded_queue(view(spark, sf_dir, "v_queue_events"), 10)


@query("""WITH s AS (SELECT seq, cast(sum(change) OVER (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS bigint) AS net FROM v_queue_events)
SELECT seq, greatest(0, least(net, 10)) AS size, greatest(0, net - 10) AS waiting_puts, greatest(0, -net) AS waiting_takes FROM s""")
def blocking_queue(spark, sf_dir):
    return capacity.blocking_queue(view(spark, sf_dir, "v_queue_events"), 10)


# Payments, scores and statements

_RECENT = "count(*) OVER (PARTITION BY account_id ORDER BY ts RANGE BETWEEN INTERVAL '6 hours' PRECEDING AND CURRENT ROW)"
_SCORES = f"""SELECT seq, round(least(1e0, greatest(0e0,
  0.30e0 * CASE WHEN starts_with(account_id, 'FRAUD') THEN 0.875e0 ELSE 0.5e0 * least(1e0, {_RECENT} / 20e0) END
  + 0.35e0 * CASE WHEN amount_cents > 10000000 THEN 0.75e0 WHEN amount_cents % 1000000 = 0 THEN 0.4e0 ELSE 0.1e0 END
  + 0.20e0 * CASE WHEN hour(ts) BETWEEN 1 AND 4 THEN 0.55e0 ELSE 0.075e0 END + 0.15e0 * 0.15e0)), 6) AS score FROM v_payments"""
_TIER = "CASE WHEN score >= 0.85e0 THEN 'DECLINED' WHEN score >= 0.65e0 THEN 'UNDER_REVIEW' ELSE 'APPROVED' END"


@query(f"SELECT seq, {_RECENT} AS recent FROM v_payments")
def velocity(spark, sf_dir):
    return statements.velocity(view(spark, sf_dir, "v_payments")).select("seq", "recent")


@query(f"WITH s AS ({_SCORES}) SELECT seq, score, {_TIER} AS status FROM s")
def fraud_scores(spark, sf_dir):
    return statements.fraud_scores(view(spark, sf_dir, "v_payments")).select("seq", "score", "status")


@query()
def fraud_scores_hashed(spark, sf_dir):
    return statements.fraud_scores(view(spark, sf_dir, "v_payments"), noise="hash", seed=7).select("seq", "score", "status")


@query(f"""WITH s AS ({_SCORES}), t AS (SELECT {_TIER} AS status FROM s)
SELECT count_if(status = 'APPROVED')::bigint AS approved, count_if(status = 'DECLINED')::bigint AS declined,
count_if(status = 'UNDER_REVIEW')::bigint AS under_review, 0::bigint AS other FROM t""")
def fraud_status_summary(spark, sf_dir):
    return statements.status_summary(statements.fraud_scores(view(spark, sf_dir, "v_payments")))


@query("""SELECT account_id, strftime(ts, '%Y-%m') AS period, count(*) AS n,
cast(coalesce(sum(amount_cents) FILTER (type = 'CREDIT'), 0) AS bigint) AS credit_cents,
cast(coalesce(sum(amount_cents) FILTER (type <> 'CREDIT'), 0) AS bigint) AS debit_cents,
cast(coalesce(sum(amount_cents) FILTER (type = 'CREDIT'), 0) - coalesce(sum(amount_cents) FILTER (type <> 'CREDIT'), 0) AS bigint) AS net_cents
FROM v_payments GROUP BY ALL""")
def statement_totals(spark, sf_dir):
    return statements.statement_totals(view(spark, sf_dir, "v_payments"))


@query("""SELECT account_id, strftime(ts, '%Y-%m') AS period, seq, type, amount_cents,
row_number() OVER (PARTITION BY account_id, strftime(ts, '%Y-%m') ORDER BY ts, seq) AS line_no FROM v_payments""")
def statement_lines(spark, sf_dir):
    lines = statements.statement_lines(statements.fraud_scores(view(spark, sf_dir, "v_payments")))
    return lines.select("account_id", "period", "seq", "type", "amount_cents", "line_no")


def _padded(text: str, width: int) -> str:
    return f"concat(repeat(' ', greatest(0, {width} - length({text}))), {text})"


_MONEY = "format('{{:,.2f}}', {} / 100.0)"
_TOTALS_SQL = " ".join(
    f"'  {label}₹', {_padded(_MONEY.format(cents), 14)}, chr(10),"
    for label, cents in (("Total Credits:  ", "credit"), ("Total Debits:   ", "debit"), ("Net Balance:    ", "(credit - debit)"))
)


_STATEMENTS_SQL = f"""WITH s AS ({_SCORES}), t AS (SELECT p.*, score, {_TIER} AS status, strftime(ts, '%Y-%m') AS period FROM v_payments p JOIN s USING (seq)),
l AS (SELECT account_id, period, string_agg(concat('  ', rpad(cast(seq AS varchar), cast(greatest(8, length(cast(seq AS varchar))) AS integer), ' '), ' ', rpad(type, 12, ' '), ' ',
  rpad(status, cast(greatest(8, length(status)) AS integer), ' '), ' ', {_padded(_MONEY.format("amount_cents"), 12)}, '  ',
  format('{{:.3f}}', (cast(round(score * 1e6) AS bigint) + 500) // 1000 / 1000e0), chr(10)), '' ORDER BY ts, seq) AS lines,
  cast(coalesce(sum(amount_cents) FILTER (type = 'CREDIT'), 0) AS bigint) AS credit, cast(coalesce(sum(amount_cents) FILTER (type <> 'CREDIT'), 0) AS bigint) AS debit
  FROM t GROUP BY ALL)
SELECT account_id, period, concat(repeat('═', 50), chr(10), '  Monthly Statement', chr(10), '  Account: ', account_id, chr(10), '  Period: ', period, chr(10),
repeat('═', 50), chr(10), chr(10), '  TX-ID    TYPE         STATUS     AMOUNT (₹) FRAUD SCORE ', chr(10), '  ', repeat('─', 58), chr(10), lines,
'  ', repeat('─', 58), chr(10), {_TOTALS_SQL} chr(10), repeat('═', 50), chr(10)) AS text FROM l"""


@query(_STATEMENTS_SQL)
def statement_texts(spark, sf_dir):
    return statements.statement_texts(statements.fraud_scores(view(spark, sf_dir, "v_payments")))


@query(_STATEMENTS_SQL)
def statements_delivered(spark, sf_dir):
    """In two batches, the second of which has all statements of the first again, and is retried."""
    texts = statements.statement_texts(statements.fraud_scores(view(spark, sf_dir, "v_payments")))
    path = shared_folder(spark, "delivered")
    statements.deliver(texts.where(F.crc32("account_id") % 3 == 0), path, 0)
    statements.deliver(texts, path, 1)
    statements.deliver(texts, path, 1)
    return statements.delivered(spark, path)


@query(f"WITH s AS ({_SCORES.replace('0.15e0 * 0.15e0', '0.15e0 * ((seq % 100) / 100e0 * 0.3e0)')}) SELECT seq, score, {_TIER} AS status FROM s")
def fraud_scores_geo(spark, sf_dir):
    geo = F.pmod(F.col("seq"), F.lit(100)) / 100.0 * 0.3
    return statements.fraud_scores(view(spark, sf_dir, "v_payments"), geo=geo).select("seq", "score", "status")


# Recommendations

_SCORED = """SELECT *, outstanding_debt / greatest(1e0, annual_income) AS dti FROM v_profiles"""
_RISK = "least(1e0, greatest(0e0, 0.5e0 * dti + 0.3e0 * (900 - credit_score) / 600e0 + 0.2e0 * greatest(0e0, 1 - tenure_months / 120e0)))"
_PROPENSITY = """least(1e0, 0.4e0 * least(1e0, current_balance / 500000e0) + 0.3e0 * least(1e0, tenure_months / 60e0)
+ CASE segment WHEN 'WEALTH' THEN 0.3e0 WHEN 'PREMIER' THEN 0.2e0 ELSE 0e0 END + 0.1e0)"""
_ELIGIBLE = f"""SELECT customer_key, rule_id, product FROM ({_SCORED}) p JOIN v_rules ON credit_score >= min_credit AND annual_income >= min_income
AND dti <= max_dti AND tenure_months >= min_tenure"""
_FLAGS = """SELECT p.customer_key, coalesce(bool_or(product = 'PERSONAL_LOAN'), false) AS loan,
coalesce(bool_or(product IN ('CREDIT_CARD_PREMIUM', 'CREDIT_CARD_BASIC')), false) AS card,
coalesce(bool_or(product = 'MUTUAL_FUND_SIP'), false) AS fund, coalesce(bool_or(product = 'FIXED_DEPOSIT'), false) AS deposit
FROM v_profiles p LEFT JOIN e ON e.customer_key = p.customer_key GROUP BY 1"""


@query(f"SELECT customer_key, round(dti, 6) AS dti, round({_RISK}, 6) AS risk, round({_PROPENSITY}, 6) AS propensity FROM ({_SCORED})")
def risk_propensity(spark, sf_dir):
    scored = eligibility.scored(view(spark, sf_dir, "v_profiles"))
    return scored.select("customer_key", *(F.round(c, 6).alias(c) for c in ("dti", "risk", "propensity")))


@query(_ELIGIBLE)
def eligible_products(spark, sf_dir):
    return eligibility.eligible_products(view(spark, sf_dir, "v_profiles"), rules_file(spark))


@query(f"WITH e AS ({_ELIGIBLE}) {_FLAGS}")
def eligibility_flags(spark, sf_dir):
    return eligibility.eligibility_flags(view(spark, sf_dir, "v_profiles"), standard_rules(spark))


@query(f"""WITH e AS ({_ELIGIBLE}), f AS ({_FLAGS}),
s AS (SELECT *, {_RISK} AS risk, {_PROPENSITY} AS propensity FROM ({_SCORED}) JOIN f USING (customer_key))
SELECT customer_key, round(risk, 6) AS risk, round(propensity, 6) AS propensity, concat_ws('|',
CASE WHEN loan AND risk < 0.6e0 THEN concat('PERSONAL_LOAN: Pre-approved up to ₹', format('{{:,}}', cast(floor(0.3e0 * annual_income + 0.5e0) AS bigint))) END,
CASE WHEN card THEN CASE WHEN credit_score >= 720 THEN 'CREDIT_CARD_PREMIUM: Instant approval' ELSE 'CREDIT_CARD_BASIC: Instant approval' END END,
CASE WHEN fund AND propensity > 0.5e0 THEN 'MUTUAL_FUND_SIP: Starting ₹500/month' END, CASE WHEN deposit THEN 'FIXED_DEPOSIT: 7.1% p.a. for 1 year' END,
CASE WHEN segment IN ('WEALTH', 'PREMIER') THEN 'WEALTH_MANAGEMENT: Dedicated RM assigned' END) AS products FROM s""")
def recommendations(spark, sf_dir):
    found = eligibility.recommendations(view(spark, sf_dir, "v_profiles"), standard_rules(spark))
    rounded = [F.round(c, 6).alias(c) for c in ("risk", "propensity")]
    return found.select("customer_key", *rounded, F.array_join("products", "|").alias("products"))


@query("""WITH d AS (SELECT customer_key, row_number() OVER (ORDER BY customer_key) - 1 AS slot FROM v_profiles)
SELECT event_id AS seq, customer_key FROM events JOIN d ON slot = event_id % (SELECT count(*) FROM d)""")
def round_robin_requests(spark, sf_dir):
    requests = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"))
    joined = eligibility.assign_round_robin(requests, view(spark, sf_dir, "v_profiles"), "customer_key")
    return joined.select("seq", "customer_key")


# Decisions


@query("""SELECT o_orderkey AS request_id, concat_ws(' | ', CASE WHEN c_acctbal >= 0 THEN 'KYC OK' ELSE 'KYC REVIEW' END,
CASE WHEN o_totalprice > 400000 THEN 'FRAUD SUSPECTED' ELSE 'FRAUD CLEAR' END,
CASE WHEN c_acctbal * 100 >= o_totalprice THEN 'BALANCE OK' ELSE 'BALANCE LOW' END) AS decision
FROM orders JOIN customer ON c_custkey = o_custkey""")
def decision_assembly(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("request_id", F.col("o_orderkey"))
    owned = orders.join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    checks = {
        "kyc": F.when(F.col("c_acctbal") >= 0, "KYC OK").otherwise("KYC REVIEW"),
        "fraud": orders.select("request_id", F.when(F.col("o_totalprice") > 400000, "FRAUD SUSPECTED").otherwise("FRAUD CLEAR").alias("result")),
        "balance": F.when(F.col("c_acctbal") * 100 >= F.col("o_totalprice"), "BALANCE OK").otherwise("BALANCE LOW"),
    }
    return decisions.assemble_decision(owned.select("request_id", "c_acctbal", "o_totalprice"), checks, "request_id").select("request_id", "decision")


@query("""WITH t AS (SELECT account_id, count(*) AS n, cast(sum(amount_cents) AS bigint) AS spent FROM v_transactions GROUP BY 1),
o AS (SELECT concat('ACC', cast(customer_key AS varchar(20))) AS account_id, count(*) AS n FROM v_profiles JOIN v_rules
  ON credit_score >= min_credit AND annual_income >= min_income AND outstanding_debt / greatest(1e0, annual_income) <= max_dti
  AND tenure_months >= min_tenure GROUP BY 1)
SELECT customer_id AS account_id, coalesce(t.n, 0) AS n_transactions, coalesce(spent, 0) AS spent_cents, coalesce(o.n, 0) AS n_offers,
concat_ws(' + ', CASE WHEN t.n > 0 THEN 'Transactions' END, CASE WHEN o.n > 0 THEN 'Offers' END) AS context
FROM v_customers LEFT JOIN t ON t.account_id = customer_id LEFT JOIN o ON o.account_id = customer_id""")
def customer_context(spark, sf_dir):
    customers = view(spark, sf_dir, "v_customers").select(F.col("customer_id").alias("account_id"))
    offers = eligibility.eligible_products(view(spark, sf_dir, "v_profiles"), standard_rules(spark))
    offers = offers.select(F.concat(F.lit("ACC"), F.col("customer_key").cast("string")).alias("account_id"))
    return decisions.customer_context(customers, view(spark, sf_dir, "v_transactions"), offers, "account_id")


# Latency and capacity

_LEVELS = """quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99,
quantile_disc(latency_ms, 0.999) AS p99_9"""


@query(f"""SELECT endpoint, count(*) AS n, {_LEVELS}, max(latency_ms) AS max, cast(sum(latency_ms) * 1000 // count(*) AS bigint) AS mean_us
FROM v_latency GROUP BY endpoint""")
def latency_percentiles(spark, sf_dir):
    return latency.latency_percentiles(view(spark, sf_dir, "v_latency"), ["endpoint"])


@query(f"""WITH p AS (SELECT endpoint, {_LEVELS} FROM v_latency GROUP BY endpoint), r AS (
SELECT endpoint, 'p50' AS metric, p50 AS actual, 50::bigint AS target FROM p UNION ALL SELECT endpoint, 'p95', p95, 150 FROM p
UNION ALL SELECT endpoint, 'p99', p99, 200 FROM p UNION ALL SELECT endpoint, 'p99_9', p99_9, 500 FROM p)
SELECT *, CASE WHEN actual <= target THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def sla_report(spark, sf_dir):
    return latency.sla_report(view(spark, sf_dir, "v_latency"), ["endpoint"])


@query("""SELECT endpoint, count(*) AS n, round(sum(latency_ms) / cast(count(*) AS double), 6) AS mean_ms,
cast(count(*) * 1000 // greatest(1, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000) AS bigint) AS per_second FROM v_latency GROUP BY endpoint""")
def tracker_report(spark, sf_dir):
    found = latency.tracker_report(view(spark, sf_dir, "v_latency"), ["endpoint"])
    return found.withColumn("mean_ms", F.round("mean_ms", 6))


@query("""SELECT seq, CASE WHEN seq % 7 = 0 THEN 0 ELSE cast((latency_ms * 1000000 + seq % 1000000) // 1000000 AS bigint) END AS latency_ms FROM v_latency""")
def request_latencies(spark, sf_dir):
    start = F.col("seq") * 1_000_003
    end = F.when(F.col("seq") % 7 == 0, 0).otherwise(start + F.col("latency_ms") * 1_000_000 + F.col("seq") % 1_000_000)
    return view(spark, sf_dir, "v_latency").select("seq", latency.latency_of(start, end).alias("latency_ms"))


@query("SELECT endpoint, count(*) AS n, count_if(latency_ms > 200)::bigint AS breaches FROM v_latency GROUP BY endpoint")
def breach_counts(spark, sf_dir):
    return latency.breach_counts(view(spark, sf_dir, "v_latency"), ["endpoint"], 200)


@query("""WITH p AS (SELECT quantile_disc(latency_ms, 0.99) FILTER (variant = 'before') AS base_p99,
quantile_disc(latency_ms, 0.99) FILTER (variant = 'after') AS candidate_p99 FROM v_latency)
SELECT base_p99, candidate_p99, base_p99 - candidate_p99 AS saved_ms,
round(100e0 * (base_p99 - candidate_p99) / greatest(1, base_p99), 6) AS saved_percent FROM p""")
def variant_comparison(spark, sf_dir):
    return latency.compare_variants(view(spark, sf_dir, "v_latency"), "before", "after")


@query(f"""WITH x AS (SELECT endpoint, latency_ms FROM v_latency UNION ALL SELECT endpoint, unnest(generate_series(latency_ms - 50, 50, -50))
FROM v_latency WHERE latency_ms >= 100)
SELECT endpoint, count(*) AS n, {_LEVELS}, max(latency_ms) AS max, cast(sum(latency_ms) * 1000 // count(*) AS bigint) AS mean_us FROM x GROUP BY endpoint""")
def co_corrected_percentiles(spark, sf_dir):
    return latency.corrected_percentiles(view(spark, sf_dir, "v_latency"), ["endpoint"], 50)


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY seq) AS rows_so_far, quantile_disc(latency_ms, 0.99) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p99 FROM v_latency)
SELECT rows_so_far, p99, p99 > 200 AS breached FROM r WHERE rows_so_far % 100 = 0""")
def sla_breaches_every_100(spark, sf_dir):
    return latency.sla_breaches(view(spark, sf_dir, "v_latency"))


def _bucketed(value: str) -> str:
    """The largest value that agrees with ``value`` in its first eleven binary digits."""
    return f"CASE WHEN {value} < 2048 THEN {value} ELSE (({value} >> (len(bin({value})) - 11)) + 1 << (len(bin({value})) - 11)) - 1 END"


def _sketch_sql(rows: str) -> str:
    """Percentiles of ``rows (endpoint, day, v)`` by rank, each as the cell of the true one gives it."""
    levels = ", ".join(f"min(CASE WHEN k >= ceil(round(n * {q}, 6)) THEN v END) AS {name}" for name, q in latency.LEVELS.items())
    read = ", ".join(f"least({_bucketed(name)}, top) AS {name}" for name in latency.LEVELS)
    return f"""WITH s AS (SELECT event_type AS endpoint, date_trunc('day', ts) AS d, cast(floor(value * 1000) AS bigint) * 40 AS v FROM events),
r AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY endpoint, d ORDER BY v) AS k, count(*) OVER (PARTITION BY endpoint, d) AS n FROM r),
p AS (SELECT endpoint, d, any_value(n) AS n, {levels}, max(v) AS top FROM k GROUP BY 1, 2)
SELECT endpoint, strftime(d, '%Y-%m-%d') AS day, n, {read}, top AS max FROM p"""


def _daily_sketches(spark, sf_dir, interval: int | None = None):
    """Sketches of microseconds by hour, merged to days."""
    micros = (F.floor(F.col("value") * 1000).cast("bigint") * 40).alias("micros")
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("endpoint"), F.date_trunc("hour", "ts").alias("hour"), micros)
    hours = sketches.sketch(samples, ["endpoint", "hour"], "micros", interval).withColumn("day", F.date_format("hour", "yyyy-MM-dd"))
    return sketches.sketch_percentiles(sketches.merged(hours, ["endpoint", "day"]), ["endpoint", "day"])


@query(_sketch_sql("SELECT * FROM s"))
def latency_sketches(spark, sf_dir):
    return _daily_sketches(spark, sf_dir)


@query(_sketch_sql("SELECT endpoint, d, v FROM s UNION ALL SELECT endpoint, d, unnest(generate_series(v - 7000, 7000, -7000)) FROM s WHERE v >= 14000"))
def latency_sketches_corrected(spark, sf_dir):
    return _daily_sketches(spark, sf_dir, 7_000)


_PHASES = [("steady", "STEADY", 0, 864000), ("ramp", "RAMP", 864000, 1728000), ("spike", "SPIKE", 1728000, 2592000)]
_PHASES_SQL = "(VALUES ('steady', 'STEADY', 0, 864000), ('ramp', 'RAMP', 864000, 1728000), ('spike', 'SPIKE', 1728000, 2592000)) AS t(phase, profile, from_s, to_s)"
_RATE = """CASE profile WHEN 'RAMP' THEN 100 + 4900 * least(1e0, {ms} / 60000e0)
WHEN 'SPIKE' THEN CASE WHEN {ms} > 5000 AND {ms} < 15000 THEN 15000e0 ELSE 1000e0 END ELSE 1000e0 END"""


@query(f"""SELECT phase, count(*) AS n, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99,
round(count(*) / cast(to_s - from_s AS double), 6) AS achieved_rate, {_RATE.format(ms="(to_s - from_s) * 500")} AS expected_rate
FROM v_latency JOIN {_PHASES_SQL} ON floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 1000000) >= from_s
AND floor(epoch_us(ts - TIMESTAMP '2024-01-01') / 1000000) < to_s GROUP BY phase, profile, from_s, to_s""")
def phase_report(spark, sf_dir):
    phases = spark.createDataFrame(_PHASES, "phase string, profile string, from_s bigint, to_s bigint")
    return latency.phase_report(view(spark, sf_dir, "v_latency"), phases, datetime(2024, 1, 1))


@query(f"""WITH e AS (SELECT event_id AS seq, (event_id * 37) % 90000 AS ms, CASE event_id % 3 WHEN 0 THEN 'STEADY' WHEN 1 THEN 'RAMP' ELSE 'SPIKE' END AS profile FROM events),
r AS (SELECT seq, {_RATE.format(ms="ms")} AS rate FROM e) SELECT seq, round(rate, 6) AS rate, cast(floor(1000 / rate) AS bigint) AS interval_ms FROM r""")
def expected_rate(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    profile = F.when(n % 3 == 0, "STEADY").when(n % 3 == 1, "RAMP").otherwise("SPIKE")
    rate = events.select(n.alias("seq"), scoring.expected_rate(profile, (n * 37) % 90000).alias("rate"))
    return rate.select("seq", F.round("rate", 6).alias("rate"), scoring.interval_ms(F.col("rate")).alias("interval_ms"))


@query("""WITH s AS (SELECT request_type, sum(CASE WHEN kind = 'WAIT' THEN ms ELSE 0e0 END) AS w, sum(CASE WHEN kind = 'COMPUTE' THEN ms ELSE 0e0 END) AS c
FROM v_activities GROUP BY 1) SELECT request_type, round(w, 4) AS wait_ms, round(c, 4) AS compute_ms, round(w / nullif(c, 0), 6) AS wait_compute_ratio,
round(8 * (1 + w / nullif(c, 0)), 4) AS threads, round(w / nullif(w + c, 0), 6) AS blocking_coefficient FROM s""")
def capacity_report(spark, sf_dir):
    return capacity.capacity_report(view(spark, sf_dir, "v_activities"), 8)


@query("""WITH s AS (SELECT cast(floor(epoch_us(ts) / 86400000000) AS bigint) AS "window", count(*) AS n, sum(latency_ms) AS t FROM v_latency GROUP BY 1)
SELECT "window", n, round(n / 86400e0, 6) AS rate, round(t / cast(n AS double) / 1000e0, 6) AS mean_seconds,
round((n / 86400e0) * (t / cast(n AS double) / 1000e0), 6) AS in_system FROM s""")
def littles_law(spark, sf_dir):
    return capacity.littles_law(view(spark, sf_dir, "v_latency"), 86400)


# Streams, replayed over the events file


@query("""SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) AS window_us, count(*) AS n, count_if(value < 400)::bigint AS approved FROM events GROUP BY 1""")
def traffic_5s(spark, sf_dir):
    return streams.traffic_5s(spark, sf_dir)


@query(_LEDGER_SQL)
def stream_debit_ledger(spark, sf_dir):
    return streams.debit_ledger(spark, sf_dir)


@query(_BREAKER_SQL)
def stream_breaker(spark, sf_dir):
    return streams.breaker(spark, sf_dir)


# a pause that a trip begins is over once a later call or the watermark, a day behind the last event, has passed its end
@query(f"""{_RATE_FOLD},
told AS (SELECT f.seq, f.service, o.ts, b4, dec, st, coalesce(list_sum(recent), 0) AS n FROM f JOIN o ON o.seq = f.seq WHERE f.rn > 0),
pauses AS (SELECT service, ts + INTERVAL '2 hours' AS over FROM told WHERE st = 'OPEN' AND b4 <> 'OPEN'),
ended AS (SELECT p.* FROM pauses p JOIN (SELECT service, max(ts) AS last FROM told GROUP BY 1) l USING (service)
  WHERE over <= greatest(last, (SELECT max(ts) FROM told) - INTERVAL '1 day'))
SELECT seq, service, epoch_us(ts) AS at_us, b4 AS state_before, dec AS decision, st AS state_after, cast(n AS bigint) AS failures FROM told
UNION ALL SELECT -1, service, epoch_us(over), 'OPEN', 'PAUSE_OVER', 'HALF_OPEN', 0 FROM ended""")
def stream_rate_breaker(spark, sf_dir):
    return streams.rate_breaker(spark, sf_dir)


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS window_us, event_type AS endpoint, count(*) AS n,
count_if(cast(floor(value) AS bigint) > 200)::bigint AS breaches, quantile_disc(cast(floor(value) AS bigint), 0.99) AS p99,
quantile_disc(cast(floor(value) AS bigint), 0.99) > 200 AS breached FROM events GROUP BY 1, 2""")
def stream_sla(spark, sf_dir):
    return streams.sla(spark, sf_dir)


@query("SELECT DISTINCT request_id FROM v_debit_requests")
def stream_dedup(spark, sf_dir):
    return streams.dedup(spark, sf_dir)


@query(f"""WITH e AS ({_ELIGIBLE}), d AS (SELECT customer_key, row_number() OVER (ORDER BY customer_key) - 1 AS slot FROM v_profiles)
SELECT event_id AS seq, rule_id FROM events JOIN d ON slot = event_id % (SELECT count(*) FROM d) JOIN e ON e.customer_key = d.customer_key""")
def stream_rules(spark, sf_dir):
    return streams.rules(spark, sf_dir)


_AS_OF = """WITH r AS (SELECT *, lead(valid_from) OVER (PARTITION BY rule_id ORDER BY valid_from) AS valid_to FROM v_rule_versions),
d AS (SELECT *, row_number() OVER (ORDER BY customer_key) - 1 AS slot FROM v_profiles)
SELECT event_id AS seq, rule_id FROM events JOIN d ON slot = event_id % (SELECT count(*) FROM d)
JOIN r ON ts >= valid_from AND (valid_to IS NULL OR ts < valid_to) AND NOT retired AND credit_score >= min_credit AND annual_income >= min_income
AND outstanding_debt / greatest(1e0, annual_income) <= max_dti AND tenure_months >= min_tenure"""


@query(_AS_OF)
def stream_rules_as_of(spark, sf_dir):
    return streams.rules_as_of(spark, sf_dir)
