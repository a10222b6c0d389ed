"""Long keys: parts run at once, and the number of passes doesn't grow with them."""

import random
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

from tallyspark.operators import inventory, segments
from tallyspark.streaming import limiter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROW = "id string, product_id string, kind string, quantity decimal(14,3), moved_on date"


def counted(monkeypatch):
    """How many times the parts are replayed: one written table of results each."""
    passes, write = [], segments.stored
    monkeypatch.setattr(segments, "stored", lambda df, name: (passes.append(name) if name == "replayed" else None, write(df, name))[1])
    return passes


def test_passes_of_a_hot_key_do_not_grow_with_its_parts(spark, monkeypatch):
    rng, rows, at = random.Random(5), [], 0
    for _ in range(3000):
        at += rng.choice([1, 2, 5, 20, 50])
        rows.append(("a", "ip", START + timedelta(seconds=at), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "email string, ip string, ts timestamp, success boolean")
    want = [("a|ip", *x) for x in limiter.replay([(r[2].timestamp(), r[3]) for r in rows], [], 0.0)[0]]
    passes = counted(monkeypatch)
    got = limiter.blocked_attempts(df, 50)
    assert len(passes) <= 3 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_keys_meet_within_parts_and_equal_rows_are_kept(spark):
    rows = [(k, "ip", START + timedelta(seconds=t), s) for k in "abcdefg" for t, s in ((1, False), (1, False), (2, False), (3, False), (3, False), (4, False), (70, True), (70, True), (71, False))]
    df = spark.createDataFrame(rows, "email string, ip string, ts timestamp, success boolean")
    want = [(f"{k}|ip", *x) for k in "abcdefg" for x in limiter.replay([(r[2].timestamp(), r[3]) for r in rows if r[0] == k], [], 0.0)[0]]
    for part in (1, 4, 1000):
        assert sorted(tuple(r) for r in limiter.blocked_attempts(df, part).collect()) == sorted(want)


def test_a_product_without_refusals_is_done_in_one_pass(spark, monkeypatch):
    rng, day = random.Random(9), date(2025, 1, 1)
    moves = [(f"m{i:05}", "p", rng.choice(["SALIDA", "AJUSTE"]), Decimal(rng.randrange(1, 900)) / 8, day + timedelta(i // 40)) for i in range(2000)]
    opening = spark.createDataFrame([("o", "p", "ENTRADA", Decimal(1_000_000), day)], ROW)
    passes = counted(monkeypatch)
    got = inventory.checked_movements(spark.createDataFrame(moves, ROW), opening, 20).collect()
    assert len(passes) == 1 and len(got) == 2000 and all(r.accepted for r in got)


def test_a_product_that_runs_out_equals_a_replay(spark, monkeypatch):
    rng, day = random.Random(11), date(2025, 1, 1)
    moves = [(f"m{i:05}", "p", "SALIDA" if rng.random() < 0.6 else "AJUSTE", Decimal(rng.randrange(1, 12)), day + timedelta(i // 40)) for i in range(3000)]
    have, want = Decimal(7), []
    for i, _, kind, quantity, _ in moves:
        ok = kind == "AJUSTE" or quantity <= have
        have += (quantity if kind == "AJUSTE" else -quantity) if ok else 0
        want.append((i, ok))
    opening = spark.createDataFrame([("o", "p", "ENTRADA", Decimal(7), day)], ROW)
    passes = counted(monkeypatch)
    got = inventory.checked_movements(spark.createDataFrame(moves, ROW), opening, 100).collect()
    assert sorted((r.id, r.accepted) for r in got) == want and not all(ok for _, ok in want)
    assert len(passes) <= 5
