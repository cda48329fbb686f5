"""Synthetic tables from ids and hashes: the same rows however they are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import text

#: Fixed values of the tables: names that rows draw from.
TYPES = ("DEPOSIT", "WITHDRAWAL", "TRANSFER", "PURCHASE")
CHANNELS = ("channel:MOBILE", "channel:WEB")
TIERS = ("PREMIUM", "GOLD", "SILVER")
CITIES = ("Bengaluru", "Mumbai", "Delhi", "Pune", "Hyderabad")
CATEGORIES = ("GROCERY", "ELECTRONICS", "APPAREL", "BOOKS")
PAYMENT_TYPES = ("CREDIT", "DEBIT", "TRANSFER", "FRAUD_CHECK")
ACCOUNTS = ("MUM-SAV-001", "MUM-SAV-002", "MUM-CUR-003", "MUM-SAV-004", "DEL-SAV-005", "FRAUD-TRY-001")
#: Segment, weight out of 14, and typical income.
SEGMENTS = (("RETAIL", 7, 400_000.0), ("PREMIER", 4, 1_200_000.0), ("WEALTH", 2, 5_000_000.0), ("SME", 1, 2_000_000.0))


def _hash(seed: int, salt: str) -> Column:
    return F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt))


def below(n: int, seed: int, salt: str) -> Column:
    """A whole number from 0 to before n."""
    return F.pmod(_hash(seed, salt), F.lit(n))


def uniform(seed: int, salt: str) -> Column:
    """A number in (0, 1)."""
    return (below(1 << 40, seed, salt) + 0.5) / float(1 << 40)


def normal(seed: int, salt: str) -> Column:
    """Standard normal, by Box and Muller from two hashes."""
    return F.sqrt(-2 * F.log(uniform(seed, salt + " r"))) * F.cos(2 * math.pi * uniform(seed, salt + " a"))


def pick(names: tuple[str, ...], seed: int, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (below(len(names), seed, salt) + 1).cast("int"))


def _minutes_ago(seed: int, minutes: int) -> Column:
    return F.timestamp_add("MINUTE", -below(minutes, seed, "ts").cast("int"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


def _number(low: int, count: int, seed: int, salt: str) -> Column:
    return (low + below(count, seed, salt)).cast("decimal(18,2)")


def synth_transactions(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Amounts from 100 to 99 999 over 30 days on a thousand accounts."""
    return spark.range(n).select(
        F.concat(F.lit("TXN"), F.col("id").cast("string")).alias("txn_id"),
        F.concat(F.lit("ACC"), below(1000, seed, "account").cast("string")).alias("account_id"),
        _number(100, 99_900, seed, "amount").alias("amount"),
        _minutes_ago(seed, 30 * 24 * 60).alias("ts"),
        pick(TYPES, seed, "type").alias("type"),
        F.array(pick(CHANNELS, seed, "channel")).alias("tags"),
    )


def synth_customers(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Lifetime values from 1 000 to 500 999."""
    return spark.range(n).select(
        text.customer_id(F.col("id")).alias("customer_id"),
        F.concat(F.lit("Customer "), F.col("id").cast("string")).alias("name"),
        pick(TIERS, seed, "tier").alias("tier"),
        _number(1_000, 500_000, seed, "value").alias("lifetime_value"),
        pick(CITIES, seed, "city").alias("city"),
    )


def synth_purchases(spark: SparkSession, n: int, customers: int, seed: int = 0) -> DataFrame:
    """Amounts from 50 to 50 049."""
    return spark.range(n).select(
        F.concat(F.lit("ORD"), F.col("id").cast("string")).alias("order_id"),
        text.customer_id(below(customers, seed, "customer")).alias("customer_id"),
        pick(CATEGORIES, seed, "category").alias("category"),
        _number(50, 50_000, seed, "amount").alias("amount"),
        pick(CITIES, seed, "city").alias("store_city"),
    )


def synth_profiles(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Segments by weight, credit around 680, log-normal income, exponential tenure."""
    place, names, incomes = below(sum(w for _, w, _ in SEGMENTS), seed, "segment"), F.lit(None), F.lit(None)
    upper = 0
    for name, weight, income in SEGMENTS:
        upper += weight
        names = F.coalesce(names, F.when(place < upper, name))
        incomes = F.coalesce(incomes, F.when(place < upper, income))
    credit = F.greatest(F.lit(300.0), F.least(F.lit(900.0), 680 + 90 * normal(seed, "credit"))).cast("int")
    tenure = F.least(F.lit(360), (-36 * F.log(1 - uniform(seed, "tenure"))).cast("int"))
    drawn = spark.range(n).select(
        F.col("id").alias("customer_key"),
        names.alias("segment"),
        credit.alias("credit_score"),
        tenure.alias("tenure_months"),
        (25 + below(40, seed, "age")).cast("int").alias("age"),
        (incomes * F.exp(0.4 * normal(seed, "income"))).alias("annual_income"),
        (0.05 + 0.55 * uniform(seed, "dti")).alias("_dti"),
        uniform(seed, "balance").alias("_u"),
    )
    return drawn.withColumns(
        {"current_balance": F.col("annual_income") * 0.1 * F.col("_u"), "outstanding_debt": F.col("annual_income") * F.col("_dti")}
    ).drop("_dti", "_u")


def synth_payments(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Pending payments of 100 to 500 099 on six accounts, with ids that follow from row and seed."""
    return spark.range(n).select(
        text.short_id(F.col("id"), F.lit(seed)).alias("id"),
        pick(ACCOUNTS, seed, "account").alias("account_id"),
        _number(100, 500_000, seed, "amount").alias("amount"),
        pick(PAYMENT_TYPES, seed, "type").alias("type"),
        F.lit("PENDING").alias("status"),
        _minutes_ago(seed, 30 * 24 * 60).cast("timestamp").alias("ts"),
        F.lit(0.0).alias("fraud_score"),
    )


def payment_stream(spark: SparkSession, rows_per_second: int, seed: int = 0) -> DataFrame:
    """An endless stream of payment requests with increasing ids; the rate is the admission control."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.withColumnRenamed("value", "id").select(
        "timestamp",
        F.col("id").alias("txn_id"),
        below(100_000, seed, "customer").alias("customer_id"),
        (uniform(seed, "amount") * 100_000).alias("amount"),
        F.concat(F.lit("M-"), below(5000, seed, "merchant").cast("string")).alias("merchant_id"),
    )
