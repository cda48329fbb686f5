"""Ids, dates and formatted numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(x: Column, decimals: int = 0) -> Column:
    """Digits in groups of three, halves away from zero."""
    return F.format_string(f"%,.{decimals}f", x.cast("double"))


def money(cents: Column) -> Column:
    return F.concat(F.lit("₹"), grouped(cents / F.lit(100.0), 2))


def customer_id(number: Column) -> Column:
    return F.format_string("CUST-%07d", number.cast("bigint"))


def short_id(*parts: Column) -> Column:
    """Eight upper-case hexadecimal digits that depend on the parts only."""
    return F.upper(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 8))


def period(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
