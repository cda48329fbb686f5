"""Fraud scores of payments, status counts and monthly statements."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scoring, text

STATUSES = ("APPROVED", "DECLINED", "UNDER_REVIEW")


def velocity(payments: DataFrame, seconds: int = 6 * 3600) -> DataFrame:
    """``recent``: payments of the account in the time up to each, itself included."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp"))
    near = Window.partitionBy("account_id").orderBy(epoch).rangeBetween(-seconds * 1_000_000, 0)
    return payments.withColumn("recent", F.count("*").over(near))


def fraud_scores(
    payments: DataFrame, noise: str = "none", seed: int = 0, seconds: int = 6 * 3600, geo: Column | None = None
) -> DataFrame:
    """``score`` and ``status``; every random part is its middle, or with ``noise="hash"`` a hash of the payment.

    ``geo`` is the risk of the place, from 0 to 0.3, as the caller knows it.
    """

    def u(feature: str):
        return scoring.uniform(noise, feature, F.col("seq"), seed)

    score = scoring.fraud_score(
        scoring.velocity_feature(F.col("recent"), F.col("account_id"), u("velocity")),
        scoring.amount_feature(F.col("amount_cents"), u("amount")),
        scoring.time_feature(F.col("ts"), u("time")),
        0.3 * u("geo") if geo is None else geo,
        0.1 * u("shift") - 0.05,
    )
    scored = velocity(payments, seconds).withColumn("score", F.round(score, 6))
    return scored.withColumn("status", scoring.decision_tier(F.col("score")))


def status_summary(df: DataFrame) -> DataFrame:
    """One row: how many payments have each status, and how many any other."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]
    other = F.count_if(F.coalesce(~F.col("status").isin(*STATUSES), F.lit(True))).alias("other")
    return df.agg(*counts, other)


def statement_totals(payments: DataFrame) -> DataFrame:
    """Credits, debits (every other type) and net by account and month, in one aggregation."""
    credit = F.col("type") == "CREDIT"
    grouped = payments.groupBy("account_id", text.period(F.col("ts")).alias("period"))
    totals = grouped.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(credit, F.col("amount_cents"))), F.lit(0)).alias("credit_cents"),
        F.coalesce(F.sum(F.when(~credit, F.col("amount_cents"))), F.lit(0)).alias("debit_cents"),
    )
    return totals.withColumn("net_cents", F.col("credit_cents") - F.col("debit_cents"))


#: The rules of a statement, its widths and its labels.
DOUBLE, SINGLE = "═" * 50, "  " + "─" * 58
TITLE = "Monthly Statement"
COLUMNS = "  TX-ID    TYPE         STATUS     AMOUNT (₹) FRAUD SCORE "
LINE = "  %-8s %-12s %-8s %,12.2f  %.3f"
TOTALS = "  Total Credits:  ₹%,14.2f\n  Total Debits:   ₹%,14.2f\n  Net Balance:    ₹%,14.2f"


def statement_lines(scored: DataFrame) -> DataFrame:
    """The numbered lines of each account's month: ``scored`` payments with ``period``, ``line_no`` and ``text``."""
    by_month = scored.withColumn("period", text.period(F.col("ts")))
    ordered = Window.partitionBy("account_id", "period").orderBy("ts", "seq")
    thousandths = F.floor((F.round(F.col("score") * 1e6) + 500) / 1000) / 1000.0  # halves up, whatever the format does
    line = F.format_string(LINE, F.col("seq").cast("string"), "type", "status", F.col("amount_cents") / 100.0, thousandths)
    return by_month.withColumn("line_no", F.row_number().over(ordered).cast("bigint")).withColumn("text", line)


def statement_texts(scored: DataFrame) -> DataFrame:
    """``(account_id, period, text)``: header, lines in order, totals. A statement holds one account's month."""
    lines = statement_lines(scored).groupBy("account_id", "period").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines")
    )
    joined = lines.join(statement_totals(scored), ["account_id", "period"])
    said = [F.lit(DOUBLE), F.lit("  " + TITLE), F.concat(F.lit("  Account: "), "account_id"), F.concat(F.lit("  Period: "), "period")]
    head = F.array(*said, F.lit(DOUBLE), F.lit(""), F.lit(COLUMNS), F.lit(SINGLE))
    totals = F.format_string(TOTALS, *(F.col(c) / 100.0 for c in ("credit_cents", "debit_cents", "net_cents")))
    body = F.array_join(F.concat(head, "lines", F.array(F.lit(SINGLE), totals, F.lit(""), F.lit(DOUBLE), F.lit(""))), "\n")
    return joined.select("account_id", "period", body.alias("text"))


def write_statements(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Statements as Parquet, a folder a month, each account's in one file of it."""
    statement_texts(scored).repartition("period", "account_id").write.mode(mode).partitionBy("period").parquet(path)


DELIVERY = "batch_id long, run string, committed_at timestamp, n long"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """``(account_id, period, text)`` of all statements that have been delivered, each once.

    What a run has staged counts when the run is in the manifest. Of several runs that have a statement the one that
    was there first counts.
    """
    manifest = _stored(spark, f"{path}/manifest", DELIVERY).withColumnRenamed("batch_id", "_batch")
    staged = _stored(spark, f"{path}/staged", "account_id string, period string, text string, batch_id long, run string")
    valid = staged.join(manifest.select("_batch", "run", "committed_at"), "run").where(F.col("batch_id") == F.col("_batch"))
    first = F.min_by("text", F.struct("committed_at", "run")).alias("text")
    return valid.groupBy("account_id", "period").agg(first)


def deliver(texts: DataFrame, path: str, batch_id: int) -> bool:
    """Deliver ``(account_id, period, text)`` as a batch: False if that batch has been delivered before.

    A run first stages its files in a folder of its own and then adds itself to the manifest, in one small file. One
    that is killed before leaves files that nothing refers to; a retry stages anew. Two runs of one batch at a time may
    both be in the manifest, and readers take the first. Statements that earlier batches have delivered are left out.
    """
    spark = texts.sparkSession
    done = _stored(spark, f"{path}/manifest", DELIVERY)
    if not done.where(F.col("batch_id") == batch_id).isEmpty():
        return False
    run = uuid.uuid4().hex
    known = delivered(spark, path).select("account_id", "period")
    fresh = texts.select("account_id", "period", "text").join(known, ["account_id", "period"], "left_anti")
    staged = f"{path}/staged/batch_id={batch_id}/run={run}"
    fresh.repartition("period", "account_id").write.parquet(staged)
    n = spark.read.parquet(staged).count()
    _commit(spark, path, batch_id, run, n)
    return True


def _commit(spark: SparkSession, path: str, batch_id: int, run: str, n: int) -> None:
    entry = spark.createDataFrame([(batch_id, run, n)], "batch_id long, run string, n long")
    entry.select("batch_id", "run", F.current_timestamp().alias("committed_at"), "n").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
