"""Separators of statements by all of their first records, quotes respected."""

from datetime import date
from decimal import Decimal

import pytest

from tallyspark.sources import bank_csv

SAMPLES = [
    ("fecha,importe\n1,2\n", ","), ("fecha;importe;concepto\n1;2,5;a, b\n", ";"), ("fecha\timporte\n1\t2\n", "\t"), ("fecha|importe\n", "|"),
    ('"a;b;c;d",x,y\n"e;f",1,2\n', ","), ("a,b,c;d\n1;2\n3;4\n", ";"), ("fecha^importe^concepto\n1^2^a\n", "^"), ("fecha\n1\n", ","), ("", ","), ("fecha operacion\n", ","),
    ('fecha;importe;concepto\n1;2;"uno;\ndos"\n3;4;b\n', ";"), ("fecha:importe\n1:2\n3:4:5\n", ","),
]


@pytest.mark.parametrize(("sample", "want"), SAMPLES)
def test_separator(sample, want):
    assert bank_csv.detect_separator(sample) == want


@pytest.mark.parametrize("text", [
    'fecha,importe,"concepto; largo; con; marcas",concepto\n01/02/2026,"1,50",x,a\n', "﻿fecha^importe^concepto\n01/02/2026^1,50^a\n", 'fecha;importe;concepto\n01/02/2026;1,50;a\n' + '02/02/2026;2,00;"b;\n' + "c" * 5000 + '"\n',
])
def test_statements_of_odd_form(spark, tmp_path, text):
    (tmp_path / "s.csv").write_text(text, encoding="utf-8")
    first = bank_csv.read_statement(spark, str(tmp_path / "s.csv")).collect()[0]
    assert tuple(first) == (date(2026, 2, 1), Decimal("1.50"), "a", None)
