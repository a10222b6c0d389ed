from datetime import date

from tallyspark.operators import scans
from tallyspark.plans.registry import QUERIES
from tallyspark.sources.views import Tables


def test_every_event_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in QUERIES["T04_event_history"](spark, sf_dir).select("path", "action").collect()]
    want = [tuple(r) for r in Tables(spark, sf_dir).scan_detail.where("status = 'PROCESADO'").select("path", "action").collect()]
    assert len(want) > 60 and sorted(rows) == sorted(want)


def test_order_within_a_file(spark):
    d = lambda n: date(2025, 1, n)
    events = spark.createDataFrame([(1, "a", "X", d(2)), (2, "a", "B", d(1)), (3, "a", "A", d(2)), (4, "b", "Z", d(3))], "seq long, path string, action string, happened_on date")
    got = sorted((r.path, r.n, r.action) for r in scans.event_history(events).collect())
    assert got == [("a", 1, "B"), ("a", 2, "A"), ("a", 3, "X"), ("b", 1, "Z")]
