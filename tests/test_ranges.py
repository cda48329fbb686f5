"""Folds over ranges of a key's rows give what one pass over all its rows gives, and spread a hot key."""

import random
from copy import deepcopy
from datetime import datetime, timedelta

import pytest

from ledgerlens.operators import capacity, ledger, ranges, resilience
from ledgerlens.plans.registry import ORACLES
from ledgerlens.plans.views import view

from .conftest import SF_TEST
from .duck import connection, same_rows

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def duck():
    return connection(SF_TEST)


def test_what_a_range_does_to_any_breaker():
    """From random states over random calls, the summary leads to a breaker that goes on as the plain one does."""
    rng = random.Random(7)

    def calls(n, steps, share, t):
        out = []
        for _ in range(n):
            t += timedelta(seconds=rng.choice(steps))
            out.append((t, rng.random() < share))
        return out, t

    for _ in range(4000):
        pause = timedelta(seconds=rng.choice([0, 1, 3, 10, 60]))
        made = (
            resilience.Breaker(rng.randint(1, 5), pause)
            if rng.random() < 0.5
            else resilience.RateBreaker(rng.randint(1, 7), rng.choice([0.3, 0.5, 1.0]), pause, rng.randint(1, 4))
        )
        before, first = deepcopy(made), deepcopy(made)
        earlier, t = calls(rng.randint(0, 30), [0, 0, 1, 2, 5], rng.choice([0.1, 0.5, 0.8, 1.0]), DAY)
        held, t = calls(rng.randint(1, 60), [0, 0, 1, 2, 5], rng.choice([0.1, 0.5, 0.8, 1.0]), t)
        later, _ = calls(40, [0, 1, 2, 5, 30], 0.6, t)
        for call in earlier:
            before.call(*call)
        after = resilience.CallRange(first, *map(list, zip(*held, strict=True)))(deepcopy(before))
        for call in held:
            before.call(*call)
        assert [after.call(*c) for c in later] == [before.call(*c) for c in later]


@pytest.mark.parametrize("mode", ["count", "rate"])
def test_breaker_over_many_ranges(spark, duck, mode):
    calls = view(spark, SF_TEST, "v_breaker_calls")
    if mode == "count":
        found = resilience.breaker_trace(calls, 3, timedelta(hours=2), rows_a_range=150)
    else:
        found = resilience.breaker_trace(calls, open_for=timedelta(hours=2), mode="rate", rows_a_range=150)
    same_rows(found.toPandas(), duck.sql(ORACLES["breaker_trace" if mode == "count" else "breaker_trace_by_rate"]).df())


@pytest.mark.parametrize("mode", ["count", "rate"])
def test_one_service_over_many_tasks(spark, mode):
    rng = random.Random(5)
    t, rows = DAY, []
    for seq in range(4000):
        t += timedelta(seconds=rng.choice([0, 1, 1, 4, 20]))
        rows.append((seq, t, "hot" if seq % 50 else None, rng.random() < (0.3 if seq // 500 % 2 else 0.9)))
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, service string, failed boolean").repartition(4)
    folder = ranges.shared_folder(spark, "test")
    held = ranges.in_ranges(df, "service", ["ts", "seq"], folder, 200)
    counts = [r["count"] for r in held.groupBy("_part").count().collect()]
    assert len(counts) > 15 and max(counts) < 600
    found = resilience.breaker_trace(df, 3, timedelta(seconds=30), mode=mode, rows_a_range=200)
    states, expected = {}, []
    for seq, ts, service, failed in rows:
        made = resilience.Breaker(3, timedelta(seconds=30)) if mode == "count" else resilience.RateBreaker(5, 0.5, timedelta(seconds=30), 2)
        expected.append((seq, *states.setdefault(service, made).call(ts, failed)))
    assert sorted(map(tuple, found.collect())) == expected


def test_queues_over_many_ranges(spark, duck):
    events = view(spark, SF_TEST, "v_queue_events")
    for name, operator in (("bounded_queue", capacity.bounded_queue), ("blocking_queue", capacity.blocking_queue)):
        found = operator(events, 10, rows_a_range=130).toPandas()
        same_rows(found, duck.sql(ORACLES[name]).df())
        assert found["size"].between(0, 10).all()
    assert capacity.bounded_queue(events.where("false"), 10).count() == 0


def test_clamps_compose():
    rng = random.Random(1)
    for _ in range(500):
        parts = [capacity.Clamp(lo := rng.randint(-5, 5), lo + rng.randint(0, 6), rng.randint(-4, 4)) for _ in range(rng.randint(1, 6))]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.then(part)
        for x in range(-12, 13):
            y = x
            for part in parts:
                y = part(y)
            assert whole(x) == y


def plain_ledger(rows):
    states, out = {}, []
    for account, request, amount, _, seq, opened in sorted(rows, key=lambda r: (r[3], r[4])):
        state = states.setdefault(account, {"balance": opened, "done": set()})
        status, state["balance"] = ledger.apply_debit(state["balance"], request in state["done"], amount)
        if status == ledger.APPLIED:
            state["done"].add(request)
        out.append((seq, status, state["balance"]))
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 12, -1])
def test_one_account_over_many_ranges(spark, scale):
    """A hot account whose balance runs out soon, or late, or may rise; nulls everywhere."""
    rng, rows = random.Random(scale), []
    for seq in range(2500):
        account = rng.choice(["hot"] * 8 + ["b", None, "c"])
        amount = abs(scale) * rng.choice([rng.randint(1, 400), rng.randint(1, 30), 5])
        if scale < 0 and account == "b" and rng.random() < 0.1:
            amount = -amount
        request = rng.choice([None] + [f"r{rng.randint(0, 900)}"] * 30)
        opened = None if account == "c" else 20_000
        rows.append((account, request, None if seq % 50 == 0 else amount, DAY + timedelta(seconds=rng.randint(0, 500)), seq, opened))
    df = spark.createDataFrame(rows, "account_id string, request_id string, amount_cents long, ts timestamp_ntz, seq long, opening_cents long")
    found = ledger.debit_ledger(df.repartition(5), rows_a_range=60)
    assert sorted(map(tuple, found.collect())) == plain_ledger(rows)


@pytest.mark.parametrize("rows_a_range", [20, 70])
def test_ledger_over_many_ranges_equals_sql(spark, duck, rows_a_range):
    """Most accounts go over ranges, or about half of them do."""
    found = ledger.debit_ledger(view(spark, SF_TEST, "v_debit_requests"), rows_a_range=rows_a_range)
    same_rows(found.toPandas(), duck.sql(ORACLES["debit_ledger"]).df())
