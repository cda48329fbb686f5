"""Positions in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range that one task sorts, about, as long as that makes at most ``SPLIT ** 2`` ranges.
ROWS_A_RANGE = 100_000
SPLIT = 256


def _place(cuts: Column, key: str) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(key))), F.lit(0))


def positions(df: DataFrame, key: str, *ties: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with ``position``, from 0, in the order of a numeric ``key`` and then ``ties``.

    Approximate quantiles cut the key into ranges, in proportion to the rows and twice where there are many; a range is
    ordered by itself, and the counts of the ranges before it are added. Rows with a null key come first.
    """
    ranges = max(1, -(-df.count() // rows_a_range))
    first = min(ranges, SPLIT)
    second = min(SPLIT, -(-ranges // first))
    cut = df.withColumns({"_range": F.lit(0), "_part": F.lit(0)})
    if first > 1:
        edges = df.agg(F.percentile_approx(key, [i / first for i in range(1, first)], 20 * SPLIT)).first()[0] or []
        at = _place(F.array(*map(F.lit, sorted(set(edges)))), key) if edges else F.lit(0)
        cut = cut.withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(at))
    if second > 1:
        steps = [i / second for i in range(1, second)]
        cuts = cut.groupBy("_range").agg(F.percentile_approx(key, steps, 20 * SPLIT).alias("_cuts"))
        cut = cut.join(F.broadcast(cuts), "_range").withColumn("_part", _place(F.col("_cuts"), key)).drop("_cuts")
    counts = cut.groupBy("_range", "_part").count()
    front = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.select("_range", "_part", F.coalesce(F.sum("count").over(front), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", "_part").orderBy(key, *ties))
    return (
        cut.withColumn("_within", within)
        .join(F.broadcast(offsets), ["_range", "_part"])
        .withColumn("position", F.col("_before") + F.col("_within") - 1)
        .drop("_range", "_part", "_within", "_before")
    )
