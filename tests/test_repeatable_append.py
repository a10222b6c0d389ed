"""A statement that is appended twice, or whose writer was killed, is there once."""

import shutil
from datetime import date
from decimal import Decimal

from tallyspark.sources import bank_csv

ROWS = [(date(2025, 1, 2), Decimal("1.00"), "a", "r"), (date(2025, 1, 2), Decimal("1.00"), "a", "r"), (date(2025, 1, 3), Decimal("-2.50"), "", None)]
SCHEMA = "transaction_date date, amount decimal(12,2), description string, reference string"


def test_the_same_statement_twice(spark, tmp_path):
    path = f"file://{tmp_path}/movements"
    assert bank_csv.movements(spark, path).count() == 0
    first = bank_csv.append_statement(spark.createDataFrame(ROWS, SCHEMA), "7", path)
    assert bank_csv.append_statement(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(3), "7", path) == first
    assert bank_csv.append_statement(spark.createDataFrame(ROWS, SCHEMA), "8", path) != first
    assert bank_csv.append_statement(spark.createDataFrame(ROWS[1:], SCHEMA), "7", path) != first
    assert bank_csv.movements(spark, path).count() == 8


def test_a_killed_writer(spark, tmp_path):
    path = f"file://{tmp_path}/movements"
    name = bank_csv.append_statement(spark.createDataFrame(ROWS, SCHEMA), "7", path)
    (tmp_path / "movements" / f"batch={name}" / "_SUCCESS").unlink()  # as if it had ended before its commit
    part = next((tmp_path / "movements" / f"batch={name}").glob("part-*.parquet"))
    shutil.copy(part, part.with_name("part-99999-left.parquet"))
    assert bank_csv.movements(spark, path).count() == 0
    bank_csv.append_statement(spark.createDataFrame(ROWS, SCHEMA), "7", path)
    assert bank_csv.movements(spark, path).count() == 3
