from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import dates, money, stats, text


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    given = ["1,234.56", "1.234,56", "-8,500.00", "1,234", "89.000", "0.0001", "$ 12", "12,5", "", None, "abc", "1,23,4", "+7.5", "1.250"]
    want = ["1234.56", "1234.56", "-8500", "1234", "89000", "0.0001", "12", "12.5", None, None, None, None, "7.5", "1250"]
    assert values(spark, money.parse_amount, given) == [None if w is None else Decimal(w) for w in want]


def test_receipt_numbers(spark):
    assert values(spark, money.receipt_number, ["$1,234.50", "1.234,50", "12,5", "1,234", "7"]) == [Decimal(x) for x in ("1234.50", "1234.50", "12.50", "1234", "7")]


def test_money_text(spark):
    assert values(spark, money.money_text, [Decimal("1234.5"), None, Decimal(-1)], "decimal(12,2)") == ["$1,234.50", "no disponible", "$-1.00"]


def test_keys(spark):
    assert values(spark, text.category_key, ["Supermercado", " SUPERMERCADO ", "Materiáles", None, " \t"]) == ["SUPERMERCADO", "SUPERMERCADO", "MATERIALES", "SIN_CLASIFICAR", "SIN_CLASIFICAR"]
    assert values(spark, text.description_key, ["  Café   con Léche.*", "AZÚCAR #"]) == ["cafe con leche", "azucar"]
    assert values(spark, text.formula_guard, ["=1+1", " @x", "ok", None]) == ["'=1+1", "' @x", "ok", None]


def test_tax_ids(spark):
    assert values(spark, text.tax_id, ["RFC: abc-010101-xy1.", "none", "WXYZ010101AB1"]) == ["ABC010101XY1", None, "WXYZ010101AB1"]


def test_legal_suffix(spark):
    assert values(spark, text.without_legal_suffix, ["Acme, S.A. de C.V.", "Beta SA DE CV", "Casa", "Gama S. de R.L. de C.V."]) == ["Acme", "Beta", "Casa", "Gama"]


def test_plain_text_and_types(spark):
    assert values(spark, text.is_plain_text, [b"hola\n", b"a\x00b", b"\xff\xfe", b"", b"\x01\x02\x03abc"], "binary") == [True, False, False, False, False]
    assert values(spark, text.magic_type, [b"%PDF-1", b"\xff\xd8\xff\xe0", b"\xef\xbb\xbf<?xml", b"hello", None], "binary") == ["pdf", "image", "xml", "unknown", "unknown"]


def test_capped_text(spark):
    [a, b] = values(spark, text.capped_text, ["x" * 20_000, "a" * 12_000 + "b" * 9_000 + "c" * 8_000])
    assert a == "x" * 20_000
    assert b == "a" * 12_000 + "\n[...]\n" + "c" * 8_000


def test_calendar(spark):
    assert values(spark, dates.days_in_month, [date(2028, 2, 3), date(2026, 2, 1), date(2026, 12, 31)], "date") == [29, 28, 31]
    assert values(spark, lambda d: dates.shift_years(d, -3), [date(2024, 2, 29)], "date") == [date(2021, 2, 28)]
    assert dates.add_months(date(2026, 12, 5), 1) == date(2027, 1, 1) and dates.add_months(date(2026, 1, 9), -1) == date(2025, 12, 1)
    months = [r.month for r in dates.months_until(spark, date(2026, 3, 17), 12).collect()]
    assert months[0] == date(2025, 4, 1) and months[-1] == date(2026, 3, 1) and len(months) == 12
    with pytest.raises(ValueError):
        dates.months_until(spark, date(2026, 3, 17), 37)


def test_verdicts(spark):
    rows = [(25, 25), (24, 25), (23, 25), (20, 25), (0, 0), (970, 1000), (1500, 1500)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h int, n int")
    got = [r.v for r in df.select("i", stats.verdict(F.col("h"), F.col("n")).alias("v")).orderBy("i").collect()]
    assert got == ["INCONCLUYENTE"] * 3 + ["NO_CUMPLE", "SIN_EVIDENCIA", "INCONCLUYENTE", "CUMPLE"]


def test_reviews_needed(spark):
    rows = [(0, 0), (90, 100), (96, 100), (99, 100), (100, 100)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h int, n int")
    got = [r.x for r in df.select("i", stats.reviews_needed(F.col("h"), F.col("n")).alias("x")).orderBy("i").collect()]
    assert [x.reason for x in got] == ["sin_muestra", "acierto_por_debajo", "acierto_en_la_linea", "suficiente", "suficiente"]
    assert got[3].n > 100 and got[4].n == 100


def test_sample(spark):
    import hashlib
    import zlib

    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)] + ["not hex", "", None, "abc"]
    want = [int(d, 16) % 10000 < 500 for d in digests[:300]] + [zlib.crc32(b"not hex") % 10000 < 500, False, False, int("abc", 16) % 10000 < 500]
    assert values(spark, stats.in_sample, digests) == want
