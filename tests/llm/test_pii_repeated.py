"""A surname that stands alone later is replaced as where it was introduced, in every script."""

import pytest

from tallyspark.llm import pii


@pytest.mark.parametrize(("text", "name"), [("Иван Петров пришел. Потом Петров ушел.", "Петров"), ("Madame Élodie Étienne. Étienne left.", "Étienne"), ("Mrs Smith came. Smith left.", "Smith"), ("Κυρία Ελένη Ζαχαρίου. Ζαχαρίου.", "Ζαχαρίου")])
def test_alone(spark, text, name):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pii.with_surrogates(rows, "a key", count="n_replaced").first()
    assert name not in out.text and out.n_replaced >= 2
