"""Results of independent checks put together by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble_decision(requests: DataFrame, checks: dict[str, DataFrame | Column], key: str, how: str = "inner") -> DataFrame:
    """``decision``: the results of all checks in order, with ``missing`` ones listed for a left join.

    A check is a column of the requests, or a table ``(key, result)`` with a row a request.
    """
    columns = {name: check for name, check in checks.items() if isinstance(check, Column)}
    tables = {name: check for name, check in checks.items() if name not in columns}
    joined = reduce(
        lambda df, item: df.join(item[1].select(key, F.col("result").alias(item[0])), key, how),
        tables.items(),
        requests.withColumns(columns),
    )
    missing = F.array_compact(F.array(*(F.when(F.col(name).isNull(), F.lit(name)) for name in checks)))
    return joined.select(
        *requests.columns, F.concat_ws(" | ", *(F.col(name) for name in checks)).alias("decision"), missing.alias("missing")
    )


def customer_context(customers: DataFrame, transactions: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """Customers with counts and sums of two branches, each aggregated before it is joined."""
    spent = transactions.groupBy(key).agg(F.count("*").alias("n_transactions"), F.sum("amount_cents").alias("spent_cents"))
    offered = offers.groupBy(key).agg(F.count("*").alias("n_offers"))
    joined = customers.join(spent, key, "left").join(offered, key, "left")
    zero = F.lit(0).cast("bigint")
    filled = {c: F.coalesce(c, zero) for c in ("n_transactions", "spent_cents", "n_offers")}
    parts = [F.when(F.col("n_transactions") > 0, "Transactions"), F.when(F.col("n_offers") > 0, "Offers")]
    return joined.withColumns(filled).withColumn("context", F.concat_ws(" + ", *parts))
