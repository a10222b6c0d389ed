import random
from datetime import date, timedelta
from decimal import Decimal

import pytest

from tallyspark.operators import inventory
from tallyspark.plans.registry import QUERIES
from tallyspark.sources.views import Tables

ROW = "id string, product_id string, kind string, quantity decimal(14,3), moved_on date"
DAY = date(2025, 1, 1)


def brute(movements, opening):
    have, out = dict(opening), []
    for i, product, kind, quantity, _ in sorted(movements, key=lambda m: (m[4], m[0])):
        s = have.get(product, Decimal(0))
        ok = quantity > 0 and (kind == "AJUSTE" or (kind == "SALIDA" and quantity <= s))
        out.append((i, ok))
        if ok:
            have[product] = s + (quantity if kind == "AJUSTE" else -quantity)
    return sorted(out)  # ids of the tables repeat, but not within a product and day


def test_a_refused_issue_takes_nothing(spark):
    ledger = spark.createDataFrame([("l", "p", "ENTRADA", Decimal(5), DAY)], ROW)
    moves = spark.createDataFrame([("a", "p", "SALIDA", Decimal(10), DAY), ("b", "p", "SALIDA", Decimal(3), DAY + timedelta(1))], ROW)
    assert {r.id: r.accepted for r in inventory.checked_movements(moves, ledger).collect()} == {"a": False, "b": True}
    assert inventory.checked_movements(moves.limit(0), ledger).count() == 0


@pytest.mark.parametrize("part", [7, 1000])
def test_equals_a_replay(spark, part):
    rng = random.Random(3)
    moves = [(f"m{i:03}", f"p{rng.randrange(4)}", rng.choice(["SALIDA", "SALIDA", "AJUSTE", "ENTRADA"]), Decimal(rng.randrange(0, 9)), DAY + timedelta(rng.randrange(30))) for i in range(200)]
    ledger = spark.createDataFrame([("l", "p1", "ENTRADA", Decimal(20), DAY)], ROW)
    got = inventory.checked_movements(spark.createDataFrame(moves, ROW), ledger, part).collect()
    assert sorted((r.id, r.accepted) for r in got) == brute(moves, {"p1": Decimal(20)})


def test_the_query_leaves_no_row_out(spark, sf_dir):
    rows = [(r.id, r.product_id, r.kind, r.quantity, r.moved_on) for r in Tables(spark, sf_dir).ledger.collect()]
    cut, opening = date(1996, 1, 1), {}
    for _, p, kind, q, on in rows:
        if on < cut:
            opening[p] = opening.get(p, Decimal(0)) + (-q if kind == "SALIDA" else q)
    want = brute([r for r in rows if r[4] >= cut], opening)
    assert sorted((r.id, r.accepted) for r in QUERIES["I06_checked_movements"](spark, sf_dir).collect()) == want
