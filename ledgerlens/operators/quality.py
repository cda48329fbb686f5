"""Row checks instead of constructors that throw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import holds


def validate(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``violations``: the names of the checks that a row fails; a null check fails."""
    failed = F.array_compact(F.array(*(F.when(~holds(check), F.lit(name)) for name, check in checks.items())))
    return df.withColumn("violations", failed)


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that don't, with their violations)."""
    checked = validate(df, checks)
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)


def required(*names: str) -> dict[str, Column]:
    """Checks that columns aren't null."""
    return {f"{name} missing": F.col(name).isNotNull() for name in names}
