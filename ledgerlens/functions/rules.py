"""Composable boolean rules: a rule is a name and a column; a null counts as false."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(False))


def all_of(*rules: Column) -> Column:
    return reduce(and_, map(holds, rules))


def any_of(*rules: Column) -> Column:
    return reduce(or_, map(holds, rules))


def above(column: str, threshold: float) -> Column:
    """Strictly more than a threshold."""
    return F.col(column) > threshold


def is_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def has_tag(tags: str, tag: str) -> Column:
    return F.array_contains(tags, tag)


def has_prefix(column: str, prefix: str) -> Column:
    return F.col(column).startswith(prefix)


def flag_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One boolean column for each rule."""
    return df.withColumns({name: holds(rule) for name, rule in rules.items()})


def count_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with how many rows each rule holds for."""
    return df.agg(*(F.count_if(holds(rule)).alias(name) for name, rule in rules.items()))
