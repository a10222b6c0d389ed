import hashlib
import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import gate, receipt_text
from tallyspark.plans.registry import QUERIES
from tallyspark.sources import bank_csv, scratch


def test_listing_of_the_tables(spark, sf_dir):
    got = {os.path.basename(r.path): (r.file_size, r.content_hash) for r in QUERIES["S08_listing"](spark, sf_dir).collect()}
    want = {}
    for name in os.listdir(sf_dir):
        raw = open(f"{sf_dir}/{name}", "rb").read()
        want[name] = (len(raw), hashlib.sha256(raw).hexdigest())
    assert got == want


def test_line_breaks_and_quotes_in_a_statement(spark, tmp_path):
    (tmp_path / "s.csv").write_text('fecha,importe,concepto,referencia\n01/02/2026,"1.234,50","PAGO ""X""\nsegunda, linea",\n\n02/02/2026,-5,y,r2\n')
    got = [tuple(r) for r in bank_csv.read_statement(spark, str(tmp_path / "s.csv")).collect()]
    assert got == [(date(2026, 2, 1), Decimal("1234.50"), 'PAGO "X"\nsegunda, linea', None), (date(2026, 2, 2), Decimal("-5.00"), "y", "r2")]


def test_readers(spark):
    rows = [("image", None, True, "ocr"), ("image", None, None, "model"), ("pdf", " \n" * 50, True, "pages"), ("pdf", "x" * 40, True, "rules"), ("pdf", "x" * 40, False, "model"), ("pdf", None, True, "pages"), ("xml", "", True, "rules"), ("zip", "x", True, "unsupported"), (None, "x", True, "unsupported")]
    df = spark.createDataFrame(rows, "kind string, text string, useful boolean, want string")
    assert df.where(gate.reader(F.col("kind"), F.col("text"), F.col("useful")) != F.col("want")).isEmpty()


def test_scores_and_partial_dates(spark):
    rows = [(1, "RFC: ABC010101XY1\nSUBTOTAL 86.21\nIVA 13.79\nTOTAL 100.00"), (2, "TOTAL 5"), (3, ""), (4, None)]
    got = {r.id: (r.score, r.good) for r in receipt_text.reading_scores(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: (74, True), 2: (23, False), 3: (0, False), 4: (0, False)}
    answers = spark.createDataFrame([('{"expense_date": "2024"}',), ('{"expense_date": "2024-3"}',), ('{"expense_date": "2024-3-5"}',)], "a string")
    assert [r[0]["expense_date"] for r in answers.select(receipt_text.repaired_json(F.col("a"))).collect()] == [None, None, date(2024, 3, 5)]


class _Session:
    """What shared_folder asks of a session."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-of-the-test", "getConf": staticmethod(dict)})


def test_no_local_folder_beyond_one_process():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="share"):
            scratch.shared_folder(_Session(master))
    assert scratch.shared_folder(_Session("local[*]")) == scratch.shared_folder(_Session("local[*]"))
