"""Filters, projections, statistics, top-N and batches over transactions with whole cents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import rules, text
from ledgerlens.operators.ordering import positions


def fraud_candidates(df: DataFrame, first_cents: int = 50_000_00, then_cents: int = 70_000_00) -> DataFrame:
    """Strictly above one threshold, projected, strictly above another; Catalyst makes it one filter."""
    high = df.where(rules.above("amount_cents", first_cents))
    return high.select("txn_id", F.col("account_id").alias("customer_id"), "amount_cents").where(
        rules.above("amount_cents", then_cents)
    )


def count_matching(df: DataFrame, *conditions: Column) -> DataFrame:
    return df.where(rules.all_of(*conditions)).agg(F.count("*").alias("n"))


def fee_cents(amount_cents: Column, rate: str = "0.0200") -> Column:
    """An exact fee, rounded half up to cents."""
    amount = (amount_cents.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")
    fee = F.round(amount * F.lit(rate).cast("decimal(5,4)"), 2)
    return (fee * 100).cast("bigint")


def normalised(amount: Column) -> Column:
    """A decimal to two places, half up."""
    return F.round(amount, 2)


def authorize(df: DataFrame, id_column: str = "seq", limit_cents: int = 50_000_00) -> DataFrame:
    """Approved strictly under the limit; only then is there a response."""
    approved = rules.holds(F.col("amount_cents") < limit_cents)
    response = F.when(approved, F.concat(F.lit("TXN-"), F.col(id_column).cast("string"), F.lit("-APPROVED")))
    return df.withColumns({"approved": approved, "response": response})


def account_stats(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, exact sum, mean (0 without rows) and largest amount, at least 0, in cents.

    The mean is rounded to whole cents, halves away from 0, in whole numbers throughout.
    """
    n, total = F.count("amount_cents"), F.coalesce(F.sum("amount_cents"), F.lit(0))
    grouped = df.groupBy(*(keys or []))
    stats = grouped.agg(n.alias("n"), total.alias("sum_cents"), F.coalesce(F.max("amount_cents"), F.lit(0)).alias("_max"))
    size, held = F.abs("sum_cents"), F.greatest("n", F.lit(1))
    up = F.when(size % held >= held - size % held, 1).otherwise(0)
    mean = F.signum("sum_cents").cast("bigint") * (F.call_function("div", size, held) + up)
    return stats.select(
        *(keys or []), "n", "sum_cents", mean.cast("bigint").alias("avg_cents"), F.greatest("_max", F.lit(0)).alias("max_cents")
    )


def deposit_sum_truncated(df: DataFrame, threshold: int = 50_000) -> DataFrame:
    """Whole units of deposits, cut off before they are compared and added."""
    units = F.floor(F.col("amount_cents") / 100).cast("bigint")
    return df.where(rules.is_type("DEPOSIT")).where(units > threshold).agg(F.coalesce(F.sum(units), F.lit(0)).alias("total"))


def total(df: DataFrame, column: str = "amount_cents") -> DataFrame:
    return df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total_cents"))


def top_n(df: DataFrame, n: int, by: str = "amount_cents", tie: str = "txn_id", keys: list[str] | None = None) -> DataFrame:
    """The n largest, ties by id; for each key if keys are given."""
    order = [F.desc(by), F.asc(tie)]
    if not keys:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def first_rows(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return df.orderBy(order).limit(n)


def first_above(df: DataFrame, threshold_cents: int, order: str = "seq") -> DataFrame:
    return df.where(rules.above("amount_cents", threshold_cents)).orderBy(order).limit(1)


def first_and_rest(df: DataFrame, n: int, order: str = "seq") -> DataFrame:
    """``part``: whether a row is among the first n or of the rest; the n-th key is found by a top-n, not a sort."""
    last = df.select(order).orderBy(order).limit(n).agg(F.max(order).alias("_last"))
    return df.withColumn("part", F.when(F.col(order) <= last.scalar(), "first").otherwise("rest"))


def union_count(producers: dict[str, DataFrame]) -> DataFrame:
    """Rows of each producer and of all together."""
    tagged = reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("producer")) for name, df in producers.items()))
    counts = tagged.rollup("producer").agg(F.count("*").alias("n"))
    return counts.select(F.coalesce("producer", F.lit("all")).alias("producer"), "n")


def distinct_accounts(df: DataFrame) -> DataFrame:
    return df.select("account_id").distinct()


def assign_batches(df: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """``batch``: fixed-size batches in order; the last may be short."""
    return positions(df, order).withColumn("batch", F.floor(F.col("position") / size).cast("bigint"))


def assign_halves(df: DataFrame, order: str = "seq") -> DataFrame:
    """``half`` 1 or 2 in order; the first has the odd row."""
    placed = positions(df, order)
    middle = F.floor((df.count() + 1) / F.lit(2))
    return placed.withColumn("half", F.when(F.col("position") < middle, 1).otherwise(2).cast("bigint"))


def format_checksum(df: DataFrame, column: str = "amount_cents") -> DataFrame:
    """Total length of the formatted amounts: equal however the rows are partitioned."""
    return df.agg(F.coalesce(F.sum(F.length(text.money(F.col(column)))), F.lit(0)).alias("checksum"))
