"""Scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fraud model: weights, and the tiers' lower bounds.
WEIGHTS = {"velocity": 0.30, "amount": 0.35, "time": 0.20, "geo": 0.15}
DECLINE_FROM, REVIEW_FROM = 0.85, 0.65


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def dti(debt: Column, income: Column) -> Column:
    """Debt to income; incomes under 1 count as 1."""
    return debt / F.greatest(F.lit(1.0), income)


def risk_score(ratio: Column, credit: Column, tenure: Column) -> Column:
    return clamp(
        0.5 * ratio + 0.3 * (900 - credit) / F.lit(600.0) + 0.2 * F.greatest(F.lit(0.0), 1 - tenure / F.lit(120.0))
    )


def propensity_score(balance: Column, tenure: Column, segment: Column) -> Column:
    """At most 1; a negative balance lowers it."""
    boost = F.when(segment == "WEALTH", 0.3).when(segment == "PREMIER", 0.2).otherwise(0.0)
    return F.least(
        F.lit(1.0),
        0.4 * F.least(F.lit(1.0), balance / F.lit(500000.0)) + 0.3 * F.least(F.lit(1.0), tenure / F.lit(60.0)) + boost + 0.1,
    )


def uniform(noise: str, feature: str, key: Column, seed: int = 0) -> Column:
    """A number in [0, 1): one half without noise, else a hash of key, feature and seed."""
    if noise == "none":
        return F.lit(0.5)
    return F.pmod(F.xxhash64(key, F.lit(feature), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def amount_feature(amount_cents: Column, u: Column) -> Column:
    """Over 100 000, round tens of thousands, or anything else."""
    return (
        F.when(amount_cents > 100_000_00, 0.6 + 0.3 * u).when(amount_cents % 10_000_00 == 0, 0.3 + 0.2 * u).otherwise(0.2 * u)
    )


def time_feature(ts: Column, u: Column) -> Column:
    """From one to before five in the morning, by the time of the event."""
    return F.when(F.hour(ts).between(1, 4), 0.4 + 0.3 * u).otherwise(0.15 * u)


def velocity_feature(recent: Column, account: Column, u: Column) -> Column:
    """Recent payments scaled to at most one half; accounts marked FRAUD lie above."""
    return F.when(account.startswith("FRAUD"), 0.75 + 0.25 * u).otherwise(0.5 * F.least(F.lit(1.0), recent / F.lit(20.0)))


def fraud_score(velocity: Column, amount: Column, time: Column, geo: Column, shift: Column) -> Column:
    w = WEIGHTS
    return clamp(w["velocity"] * velocity + w["amount"] * amount + w["time"] * time + w["geo"] * geo + shift)


def decision_tier(score: Column) -> Column:
    return F.when(score >= DECLINE_FROM, "DECLINED").when(score >= REVIEW_FROM, "UNDER_REVIEW").otherwise("APPROVED")


def expected_rate(profile: Column, elapsed_ms: Column) -> Column:
    """Requests a second that a load profile asks for after so many milliseconds."""
    ramp = 100 + 4900 * F.least(F.lit(1.0), elapsed_ms / F.lit(60000.0))
    spike = F.when((elapsed_ms > 5000) & (elapsed_ms < 15000), 15000.0).otherwise(1000.0)
    return F.when(profile == "RAMP", ramp).when(profile == "SPIKE", spike).otherwise(1000.0)


def interval_ms(rate: Column) -> Column:
    """Whole milliseconds between requests; 0 above a thousand a second."""
    return F.floor(1000 / rate).cast("bigint")
