"""What the joins of all pairs send, and the test of names without functions over elements."""

import random
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions.text import comparable, first_and_last_words, long_words, mentions_joined, mentions_words
from tallyspark.operators import matching

from test_matching import BANK, DAY, RECEIPT


def test_names_joined_as_by_words(spark):
    names = [None, "", "a b", "ACME", "Acmé S.A.", "Customer#000000123", "uno dos tres cuatro", "tres tres", "ab tres", "(x.*y) tres", "000 0001"]
    texts = [None, "", "PAGO ACME", "PAGO CUSTOMER 000000123", "CUSTOMER 00000012", "tres cuatro dos uno", "cuatro uno dos", "entres", "0001000", "x.*y tres"]
    df = spark.createDataFrame([(n, t) for n in names for t in texts], "name string, text string").select(long_words(F.col("name")).alias("w"), comparable(F.col("text")).alias("t"))
    df = df.select("*", *first_and_last_words(F.col("w")))
    rows = df.select("w", "t", mentions_words(F.col("w"), F.col("t")).alias("want"), mentions_joined(F.col("first"), F.col("last"), F.col("t")).alias("got")).collect()
    assert all(r.got is r.want for r in rows) and {r.want for r in rows} == {True, False}


def test_pairs_against_all(spark):
    """Every pair within cents or days, with its criteria, and no other; nulls meet nothing."""
    rng = random.Random(3)
    day = lambda: DAY + timedelta(days=rng.randrange(40))
    amount = lambda: Decimal(rng.randrange(1, 3000)) / 100
    receipts = [("c", f"r{i}", day(), amount(), rng.choice(["Acme", "Acme Norte", "", None])) for i in range(60)]
    bank = [("c", f"b{i}", day(), -amount(), rng.choice(["PAGO ACME", "NORTE ACME", ""]), False) for i in range(60)]
    odd = [("c", "null1", None, Decimal(99), "x"), (None, "null2", DAY, Decimal(1), "x")]
    for days, tolerance in ((3, "0.01"), (0, "0.00"), (5, "1.50")):
        pairs = matching.candidates(spark.createDataFrame(receipts + odd, RECEIPT), spark.createDataFrame(bank, BANK), tolerance, days)
        assert pairs.schema["gap"].dataType.simpleString() == "decimal(13,2)" and pairs.schema["days"].dataType.simpleString() == "int"
        got = sorted((p.receipt_id, p.bank_id, p.expense_date, p.gap, p.days, p.mentioned, p.tier) for p in pairs.collect())
        want = []
        for _, r, d, a, n in receipts:
            for _, b, t, m, text, _ in bank:
                gap, apart, words = abs(a + m), abs((d - t).days), (n or "").upper().split()
                if gap <= Decimal(tolerance) or apart <= days:
                    want.append((r, b, d, gap, apart, bool(words) and all(w in text for w in words), 1 if gap <= Decimal(tolerance) else 2))
        assert got == sorted(want)


def test_joins_send_numbers_and_texts_only(spark):
    """What is shuffled for the pairs holds no list of words and no amount beside its cents, and no function over elements meets a pair."""
    r = spark.createDataFrame([("c", "r", DAY, Decimal(1), "Acme")], RECEIPT)
    b = spark.createDataFrame([("c", "b", DAY, Decimal(-1), "ACME", False)], BANK)
    plan = matching.candidates(r, b)._jdf.queryExecution().optimizedPlan()
    assert "forall" not in plan.toString()
    joins, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        joins += [x.schema().simpleString() for x in below] if node.nodeName() == "Join" else []
        nodes += below
    assert len(joins) == 4 and not any("array" in x or "decimal" in x for x in joins)
