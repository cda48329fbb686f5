"""Golden values, boundary cases and plans of the banking operators."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import rules, scoring, text
from ledgerlens.operators import capacity, decisions, eligibility, latency, ledger, quality, resilience, statements, transactions
from ledgerlens.operators.ordering import positions
from ledgerlens.plans.registry import QUERIES
from ledgerlens.plans.views import view
from ledgerlens.sources import synth
from ledgerlens.sources.rules import RULE_ROWS, read_rules, standard_rules
from ledgerlens.streaming import streams

from .conftest import SF_SMALL


def one(df):
    return df.first()[0]


def amounts(spark, values):
    rows = [(i, f"T{i}", "A", v * 100, "DEPOSIT") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq long, txn_id string, account_id string, amount_cents long, type string")


def test_candidates_and_thresholds(spark):
    df = amounts(spark, [10000, 50000, 90000, 120000, 7000, 45000, 88000, 150000])
    assert one(transactions.count_matching(df, rules.above("amount_cents", 50_000_00))) == 4
    four = amounts(spark, [10000, 90000, 75000, 30000])
    assert sorted(r["txn_id"] for r in transactions.fraud_candidates(four).collect()) == ["T1", "T2"]


def test_rules_count_null_as_false(spark):
    df = spark.createDataFrame([(None,), (5,)], "amount_cents long")
    flagged = rules.flag_rules(df, {"r": rules.any_of(F.col("amount_cents") > 3, F.lit(None).cast("boolean"))}).orderBy("amount_cents")
    assert [r["r"] for r in flagged.collect()] == [False, True]


def test_rounding(spark):
    df = spark.createDataFrame([(100_000, Decimal("123.4567"))], "c long, d decimal(10,4)")
    assert one(df.select(transactions.fee_cents(F.col("c")))) == 2000
    assert one(df.select(transactions.normalised(F.col("d")))) == Decimal("123.46")


def test_account_stats_of_nothing_and_of_negatives(spark):
    assert tuple(transactions.account_stats(amounts(spark, [])).first()) == (0, 0, 0, 0)
    assert transactions.account_stats(amounts(spark, [-5, -7])).first()["max_cents"] == 0


def test_batches_halves_first_and_rest(spark):
    df = amounts(spark, range(1000)).repartition(7)
    assert sorted(tuple(r) for r in transactions.assign_batches(df, 250).groupBy("batch").count().collect()) == [(k, 250) for k in range(4)]
    for rows in (1, 200, 5000):
        assert [r["position"] for r in positions(df, "seq", rows_a_range=rows).orderBy("seq").collect()] == list(range(1000))
    eight = amounts(spark, [10000, 25000, 50000, 75000, 90000, 120000, 150000, 200000])
    halves = transactions.assign_halves(eight).where("half = 2").orderBy("seq").collect()
    assert [r["amount_cents"] // 100 for r in halves] == [90000, 120000, 150000, 200000]
    parts = {r["part"]: r["count"] for r in transactions.first_and_rest(amounts(spark, [1, 2, 3, 4]), 2).groupBy("part").count().collect()}
    assert parts == {"first": 2, "rest": 2}


def test_ledger(spark):
    rows = [(1, "r1", 150), (2, "r1", 60), (3, "r1", 60), (4, "r2", 40)]
    df = spark.createDataFrame(
        [(s, datetime(2024, 1, 1, 0, s), "A", r, a, 100) for s, r, a in rows],
        "seq long, ts timestamp, account_id string, request_id string, amount_cents long, opening_cents long",
    )
    found = [tuple(r) for r in ledger.debit_ledger(df).orderBy("seq").collect()]
    assert found == [(1, "INSUFFICIENT", 100), (2, "APPLIED", 40), (3, "DUPLICATE", 40), (4, "APPLIED", 0)]
    opening = spark.createDataFrame([("B", 5)], "account_id string, opening_cents long")
    assert {r["status"] for r in ledger.debit_ledger(df, opening).collect()} == {"UNKNOWN_ACCOUNT"}
    twice = spark.createDataFrame([("Rahul", "PAY-123", 10000_00, 1), ("Rahul", "PAY-123", 10000_00, 2)], "account_id string, request_id string, amount_cents long, ts int")
    done = ledger.idempotent_debits(twice, 100000_00, ["ts"]).orderBy("ts").collect()
    assert [r["balance_cents"] for r in done] == [90000_00] * 2 and done[1]["result"].startswith("Duplicate request ignored")
    assert ledger.misplaced_requests(df).count() == 0


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_folds_carry_state_across_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = QUERIES["debit_ledger"](spark, SF_SMALL).groupBy("status").count().collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r["count"] for r in found) == view(spark, SF_SMALL, "v_debit_requests").count()
    assert {r["status"] for r in found} <= {"APPLIED", "DUPLICATE", "INSUFFICIENT"}


def test_breaker(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, start + timedelta(seconds=t), "s", t < 3) for t in range(10)], "seq long, ts timestamp, service string, failed boolean")
    trace = resilience.breaker_trace(df, 3, timedelta(seconds=5)).orderBy("seq").collect()
    assert [r["decision"] for r in trace] == ["CALLED"] * 3 + ["REJECTED"] * 5 + ["CALLED"] * 2
    assert trace[8]["state_after"] == "CLOSED" and trace[2]["state_after"] == "OPEN"
    rate = resilience.breaker_trace(df.withColumn("failed", F.col("seq") < 5), open_for=timedelta(seconds=2), mode="rate").orderBy("seq").collect()
    assert rate[4]["state_after"] == "OPEN" and rate[5]["decision"] == "REJECTED" and rate[6]["state_before"] == "HALF_OPEN"
    assert rate[7]["state_after"] == "CLOSED"


def test_recommendation_on_the_bounds(spark):
    df = spark.createDataFrame([(1, "PREMIER", 720, 12, 600000.0, 100000.0, 240000.0)],
                               "customer_key long, segment string, credit_score int, tenure_months int, annual_income double, current_balance double, outstanding_debt double")
    row = eligibility.recommendations(df, standard_rules(spark)).first()
    assert abs(row["risk"] - 0.47) < 1e-9 and abs(row["propensity"] - 0.44) < 1e-9
    assert row["products"] == ["PERSONAL_LOAN: Pre-approved up to ₹180,000", "CREDIT_CARD_PREMIUM: Instant approval", "FIXED_DEPOSIT: 7.1% p.a. for 1 year", "WEALTH_MANAGEMENT: Dedicated RM assigned"]
    found = {r["rule_id"] for r in eligibility.eligible_products(df, standard_rules(spark)).collect()}
    assert found == {"R01", "R02", "R03", "R04", "R05", "R07"}


def test_rules_from_csv(spark, tmp_path):
    lines = ["rule_id,product,min_credit,min_income,max_dti,min_tenure"] + [", ".join(map(str, r)) for r in RULE_ROWS]
    (tmp_path / "rules.csv").write_text("\n".join(lines))
    assert sorted(map(tuple, read_rules(spark, str(tmp_path / "rules.csv")).collect())) == sorted(map(tuple, standard_rules(spark).collect()))
    (tmp_path / "bad.csv").write_text(lines[0] + "\nR01,X,abc,1,1,1\n")
    with pytest.raises(Exception, match="MALFORMED|abc"):
        read_rules(spark, str(tmp_path / "bad.csv")).collect()


def test_scores(spark):
    tiers = spark.createDataFrame([(0.85,), (0.65,), (0.6499,)], "s double").select(scoring.decision_tier(F.col("s")))
    assert [r[0] for r in tiers.collect()] == ["DECLINED", "UNDER_REVIEW", "APPROVED"]
    ramp = spark.range(1).select(scoring.expected_rate(F.lit("RAMP"), F.lit(30000)).alias("r")).select("r", scoring.interval_ms(F.col("r")))
    assert tuple(ramp.first()) == (2550.0, 0)
    assert one(spark.range(1).select(text.grouped(F.lit(2.5)))) == "3"


def test_decisions(spark):
    requests = spark.createDataFrame([(1,), (2,)], "id long")
    checks = {n: spark.createDataFrame(rows, "id long, result string") for n, rows in
              {"kyc": [(1, "KYC OK"), (2, "KYC OK")], "fraud": [(1, "FRAUD CLEAR")], "balance": [(1, "BALANCE OK")]}.items()}
    inner = decisions.assemble_decision(requests, checks, "id").collect()
    assert [r["decision"] for r in inner] == ["KYC OK | FRAUD CLEAR | BALANCE OK"]
    left = decisions.assemble_decision(requests, checks, "id", "left").orderBy("id").collect()
    assert left[1]["missing"] == ["fraud", "balance"]


def test_latency_and_capacity(spark):
    df = spark.createDataFrame([(10,)], "latency_ms long").withColumn("k", F.lit(1))
    assert sorted(r["latency_ms"] for r in latency.expand_omitted(df, ["k"], 3).collect()) == [4, 7, 10]
    acts = spark.createDataFrame([("pay", "WAIT", 120.0), ("pay", "WAIT", 80.0), ("pay", "COMPUTE", 20.0)], "request_type string, kind string, ms double")
    row = capacity.capacity_report(acts, 8).first()
    assert (row["wait_compute_ratio"], row["threads"]) == (10.0, 88.0)
    many = spark.range(1000).select(F.lit(datetime(2024, 1, 1)).alias("ts"), F.lit(50).alias("latency_ms"))
    assert capacity.littles_law(many, 1).first()["in_system"] == 50.0
    assert one(spark.range(1).select(latency.latency_of(F.lit(5), F.lit(0)))) == 0


def test_quality(spark):
    df = spark.createDataFrame([(None, -1), ("a", 1)], "id string, v long")
    good, bad = quality.split_valid(df, quality.required("id") | {"v negative": F.col("v") >= 0})
    assert good.count() == 1 and bad.first()["violations"] == ["id missing", "v negative"]


def test_synthetic_tables_do_not_depend_on_partitioning(spark):
    profiles = synth.synth_profiles(spark, 3000, 1)
    assert profiles.where("credit_score NOT BETWEEN 300 AND 900 OR tenure_months NOT BETWEEN 0 AND 360 OR age NOT BETWEEN 25 AND 64").count() == 0
    shares = {r["segment"]: r["count"] / 3000 for r in profiles.groupBy("segment").count().collect()}
    assert abs(shares["RETAIL"] - 0.5) < 0.05 and abs(shares["SME"] - 1 / 14) < 0.03
    for make in (synth.synth_transactions, synth.synth_customers, synth.synth_payments):
        whole = make(spark, 50, 3)
        held = {str(r) for r in whole.collect()}
        assert held == {str(r) for r in whole.repartition(5).collect()} and held < {str(r) for r in make(spark, 80, 3).collect()}
    assert synth.synth_purchases(spark, 20, 5).where("amount < 50 OR amount > 50049").count() == 0
    assert synth.payment_stream(spark, 10).isStreaming


def test_statements_are_written_by_month(spark, tmp_path):
    payments = view(spark, SF_SMALL, "v_payments")
    statements.write_statements(statements.fraud_scores(payments), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == payments.select("account_id", F.date_format("ts", "yyyy-MM")).distinct().count()
    assert back.first()["text"].splitlines()[1] == "  Monthly Statement"


def test_rule_cache_and_audit(spark, tmp_path):
    now, reads = [0.0], []
    cache = streams.RuleCache(lambda: reads.append(1) or standard_rules(spark), 300, lambda: now[0])
    cache.get(), cache.get()
    now[0] = 301
    cache.get()
    assert len(reads) == 2
    streams.audit_batches(str(tmp_path / "a"), lambda *_: None)(spark.range(3), 4)
    assert spark.read.parquet(str(tmp_path / "a")).where("batch_id = 4").count() == 3


def test_plans(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    df = view(spark, SF_SMALL, "v_transactions")
    assert plan(transactions.fraud_candidates(df)).count(" Filter ") == 1
    assert "TakeOrderedAndProject" in plan(transactions.top_n(df, 5))
    assert "BroadcastNestedLoopJoin" in plan(eligibility.eligible_products(view(spark, SF_SMALL, "v_profiles"), standard_rules(spark)))
    assert plan(transactions.account_stats(df, ["account_id"])).count("Exchange") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey" in plan(df.select("txn_id", "account_id"))
