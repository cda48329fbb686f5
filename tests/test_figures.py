"""Sketches, omission, running percentiles, exact means and hashed noise against plain computations."""

import math
import random
import struct

import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.operators import latency, sketches, statements, transactions
from ledgerlens.plans.views import view

from .conftest import SF_SMALL


def ranked(values, q):
    return sorted(values)[max(0, math.ceil(round(len(values) * q, 6)) - 1)]


def test_cells_are_narrow_and_in_order(spark):
    rng = random.Random(1)
    values = [*range(3000), *(rng.randrange(1 << rng.randrange(1, 46)) for _ in range(3000)), *(2**k + d for k in range(11, 45) for d in (-1, 0, 1))]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    cell = sketches.cell_of(F.col("v"))
    rows = df.select("v", cell.alias("c"), sketches.lowest(cell).alias("low"), sketches.lowest(cell + 1).alias("next")).collect()
    assert all(r.low <= r.v < r.next and r.next - r.low <= max(1, r.low / 1024) for r in rows)
    by_value = sorted(rows, key=lambda r: r.v)
    assert all(a.c <= b.c for a, b in zip(by_value, by_value[1:], strict=False))


@pytest.mark.parametrize("interval", [None, 1, 7_000])
def test_percentiles_of_merged_sketches(spark, interval):
    """Hours merge to days as if made at once; every rank is at most one part in 1024 off, also far over ten seconds."""
    rng = random.Random(9)
    rows = [(d, h, int(rng.lognormvariate(9, 2.5))) for d in range(2) for h in range(24) for _ in range(30)]
    rows += [(0, 3, 90_000_000), (1, 5, None), (1, 6, 0)] if interval != 1 else [(0, 3, 300_000), (1, 5, None)]
    if interval == 1:
        rows = [(d, h, v if v is None else min(v, 300_000)) for d, h, v in rows]
    df = spark.createDataFrame(rows, "day int, hour int, v long")
    hours = sketches.sketch(df, ["day", "hour"], "v", interval)
    assert hours.count() == 48
    merged = sketches.merged(hours, ["day"])
    once = sketches.sketch(df, ["day"], "v", interval)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, once.collect()))
    found = {r.day: r for r in sketches.sketch_percentiles(merged, ["day"]).collect()}
    for day in range(2):
        held = [v for d, _, v in rows if d == day and v is not None]
        if interval:
            held += [p for v in held for p in range(v - interval, interval - 1, -interval)]
        assert found[day].n == len(held) and found[day].max == max(held)
        for name, q in latency.LEVELS.items():
            true = ranked(held, q)
            assert true <= found[day][name] <= true + true / 1024


def test_omission_of_long_values(spark):
    df = spark.createDataFrame([("a", 25_000), ("a", 25_000), ("a", 1_999), ("a", 40), ("b", 9_000_017), ("a", None)], "k string, latency_ms long")
    found = {(r.k, r.latency_ms): r.freq for r in latency.expand_omitted(df, ["k"], 1000).collect()}
    expected: dict = {}
    for k, v in [("a", 25_000), ("a", 25_000), ("a", 1_999), ("a", 40), ("b", 9_000_017)]:
        for p in [v, *range(v - 1000, 999, -1000)]:
            expected[k, p] = expected.get((k, p), 0) + 1
    assert {k: v for k, v in found.items() if k[1] is not None} == expected


def test_running_percentiles_over_many_groups(spark, monkeypatch):
    monkeypatch.setattr(latency, "BLOCKS_A_GROUP", 2)
    monkeypatch.setattr(latency, "GROUPS_A_LEVEL", 3)
    rng = random.Random(4)
    values = [None if k % 17 == 0 or k < 25 else rng.choice([5, 190, 201, 30_000, rng.randrange(400)]) for k in range(430)]
    df = spark.createDataFrame(list(enumerate(values)), "seq long, latency_ms long").repartition(3)
    found = {r.rows_so_far: (r.p99, r.breached) for r in latency.sla_breaches(df, every=10).collect()}
    for n in range(10, 431, 10):
        held = [v for v in values[:n] if v is not None]
        p99 = sorted(held)[-(-99 * len(held) // 100) - 1] if held else None
        assert found.pop(n) == (p99, p99 is not None and p99 > 200)
    assert not found


def test_means_are_exact(spark):
    rows = [("a", -2), ("a", -3), ("b", 2), ("b", 3), ("c", 9007199254740993), ("d", 4611686018427387000), ("e", None), ("f", -1), ("f", -1), ("f", -2)]
    df = spark.createDataFrame(rows, "k string, amount_cents long")
    found = {r.k: r.avg_cents for r in transactions.account_stats(df, ["k"]).collect()}
    assert found == {"a": -3, "b": 3, "c": 9007199254740993, "d": 4611686018427387000, "e": 0, "f": -1}


def test_phases_are_few(spark, monkeypatch):
    monkeypatch.setattr(latency, "PHASE_LIMIT", 1)
    phases = spark.createDataFrame([("a", "RAMP", 0, 1), ("b", "RAMP", 1, 2)], "phase string, profile string, from_s int, to_s int")
    with pytest.raises(ValueError, match="phases"):
        latency.phase_report(view(spark, SF_SMALL, "v_latency"), phases, "2024-01-01")


def test_hashed_noise_by_hand(spark):
    """Every score recomputed in Python, hashes and six-hour counts included."""
    payments = view(spark, SF_SMALL, "v_payments")
    rows = payments.toPandas()
    found = statements.fraud_scores(payments, noise="hash", seed=7).select("seq", "score").toPandas().set_index("seq").score

    def u(feature, seq):
        h = xxhash.xxh64(struct.pack("<q", seq), seed=42).intdigest()
        h = xxhash.xxh64(feature.encode(), seed=h).intdigest()
        h = xxhash.xxh64(struct.pack("<i", 7), seed=h).intdigest()
        return h % (1 << 30) / (1 << 30)

    for _, own in rows.groupby("account_id"):
        for r in own.itertuples():
            recent = ((own.ts <= r.ts) & (own.ts >= r.ts - pd.Timedelta(hours=6))).sum()
            velocity = 0.75 + 0.25 * u("velocity", r.seq) if r.account_id.startswith("FRAUD") else 0.5 * min(1.0, recent / 20)
            x = u("amount", r.seq)
            amount = 0.6 + 0.3 * x if r.amount_cents > 10_000_000 else 0.3 + 0.2 * x if r.amount_cents % 1_000_000 == 0 else 0.2 * x
            hour = 0.4 + 0.3 * u("time", r.seq) if 1 <= r.ts.hour <= 4 else 0.15 * u("time", r.seq)
            score = 0.30 * velocity + 0.35 * amount + 0.20 * hour + 0.15 * 0.3 * u("geo", r.seq) + 0.1 * u("shift", r.seq) - 0.05
            assert abs(min(1.0, max(0.0, score)) - found[r.seq]) < 2e-6


def test_omitted_values_never_become_rows(spark, monkeypatch):
    """They are added up in the task that has the value; keys that go over tasks, null keys and long values by hand."""
    monkeypatch.setattr(sketches, "LISTED", 200, raising=False)
    monkeypatch.setattr(sketches, "AT_ONCE", 5_000, raising=False)
    rng = random.Random(3)
    rows = [(k, rng.randrange(1 << rng.randrange(4, 22))) for k in ("a", None, "c") for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    hours = sketches.sketch(df.withColumn("h", F.col("v") % 3), ["k", "h"], "v", 70)
    merged = sketches.merged(hours, ["k"])
    for made in (hours, merged):
        assert "Generate" not in made._jdf.queryExecution().toString()
    found = {r.k: (r.n, r.largest, {c.cell: c.freq for c in r["cells"]}) for r in merged.collect()}
    for key in ("a", None, "c"):
        held = [p for k, v in rows if k == key for p in [v, *range(v - 70, 69, -70)]]
        cells: dict = {}
        for p in held:
            e = max(0, p.bit_length() - 11)
            cells[e * 1024 + (p >> e)] = cells.get(e * 1024 + (p >> e), 0) + 1
        assert found[key] == (len(held), max(held), cells)
