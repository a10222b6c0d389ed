import random
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal

import pytest

from tallyspark.operators import findings, receipt_text, scans
from tallyspark.sources import bank_csv
from tallyspark.streaming import incremental, limiter


def statement(tmp_path, content, encoding="utf-8", **options):
    f = tmp_path / "s.csv"
    f.write_bytes(content.encode(encoding))
    return str(f), options


def read(spark, tmp_path, content, encoding="utf-8", **options):
    path, options = statement(tmp_path, content, encoding, **options)
    return [tuple(r) for r in bank_csv.read_statement(spark, path, encoding=encoding, **options).collect()]


def test_semicolons_and_synonyms(spark, tmp_path):
    rows = read(spark, tmp_path, "Fecha;Descripcion;Importe;Referencia\n05/01/2026;PAGO;-8,500.00;R001\n")
    assert rows == [(date(2026, 1, 5), Decimal("-8500.00"), "PAGO", "R001")]


def test_day_comes_first(spark, tmp_path):
    assert read(spark, tmp_path, "fecha,importe,concepto\n01/02/2026,1.00,x\n")[0][0] == date(2026, 2, 1)
    assert read(spark, tmp_path, "fecha,importe,concepto\n2026-02-01,1.00,x\n")[0][0] == date(2026, 2, 1)


def test_latin_1(spark, tmp_path):
    assert read(spark, tmp_path, "fecha\timporte\tconcepto\n01/02/2026\t1.234,50\tCAFÉ\n", "latin-1") == [(date(2026, 2, 1), Decimal("1234.50"), "CAFÉ", None)]


@pytest.mark.parametrize("content", ["fecha,importe,concepto\n01/02/2026,abc,x\n", "fecha,importe,concepto\n01/02/2026,1.00,x\nnever,1.00,x\n", "a,b,c\n1,2,3\n"])
def test_one_bad_row_fails_the_file(spark, tmp_path, content):
    with pytest.raises(bank_csv.UnreadableStatement):
        read(spark, tmp_path, content)


def test_headers_only_and_named_columns(spark, tmp_path):
    assert read(spark, tmp_path, "fecha,importe,concepto\n") == []
    assert read(spark, tmp_path, "when,fecha,importe,concepto\n02/01/2026,x,5,y\n", named={"transaction_date": "when"})[0][0] == date(2026, 1, 2)
    with pytest.raises(bank_csv.UnreadableStatement):
        read(spark, tmp_path, "fecha,importe,concepto\n01/02/2026,1,x\n", named={"amount": "nope"})


def test_listing_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.pdf").write_bytes(b"%PDF one")
    (folder / "sub" / "b.pdf").write_bytes(b"%PDF two")
    (folder / ".hidden").write_bytes(b"x")
    found = scans.listing(spark, str(folder))
    assert sorted(r.path.rsplit("/", 1)[-1] for r in found.collect()) == ["a.pdf", "b.pdf"]
    ledger = str(tmp_path / "ledger")
    spark.createDataFrame([], "path string, content_hash string, status string, receipt_id string").write.parquet(ledger)
    for _ in range(2):
        incremental.scan_stream(spark, str(folder), ledger, str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(ledger).collect()
    assert sorted((r.path.rsplit("/", 1)[-1], r.status) for r in rows) == [("a.pdf", "PROCESADO"), ("b.pdf", "PROCESADO")]


def attempts(spark, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at, rows = 0, []
    for _ in range(300):
        at += rng.choice([1, 2, 3, 5, 20, 90, 400])
        rows.append((f" U{rng.randrange(3)}@x ", "1.1.1.1", start + timedelta(seconds=at), rng.random() < 0.1))
    return rows, spark.createDataFrame(rows, "email string, ip string, ts timestamp, success boolean")


def test_limiter_batch_and_stream_agree(spark, tmp_path):
    rows, df = attempts(spark)
    want = []
    for email in sorted({r[0] for r in rows}):
        own = [(r[2].timestamp(), r[3]) for r in rows if r[0] == email]
        want += [(f"{email.strip().lower()}|1.1.1.1", *x) for x in limiter.replay(own, [], 0.0)[0]]
    got = sorted(tuple(r) for r in limiter.blocked_attempts(df).collect())
    assert got == sorted(want)
    assert any(r[4] for r in got) and any(r[3] for r in got)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limiter.blocked_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == sorted(want)


def test_receipt_text(spark):
    paper = "SUPERMERCADO EL SOL SA\nRFC: ABC-010101-XY1\nFecha: 05/03/26\nCafe 10.00\nSUBTOTAL 86.21\nIVA (16%): 13.79\nTOTAL\n$ 100.00\nUsted ahorra en Total: $119.97\nVence 01/01/2030"
    rows = [(1, paper), (2, "Tienda Del Norte\nTotal: 50\nImporte 12.30\n10/08/2026 13:45"), (3, None), (4, ""), (5, "fecha 2026-01-02\nTOTAL 5.00\nTOTAL 7")]
    got = {r.id: r for r in receipt_text.parsed_receipts(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert (got[1].provider_name, got[1].provider_tax_id, got[1].total_amount, got[1].tax_amount, got[1].subtotal, got[1].expense_date) == ("SUPERMERCADO EL SOL SA", "ABC010101XY1", Decimal("100.00"), Decimal("13.79"), Decimal("86.21"), date(2026, 3, 5))
    assert (got[2].provider_name, got[2].total_amount, got[2].expense_date) == ("Tienda Del Norte", Decimal("50.00"), date(2026, 8, 10))
    assert got[3].provider_name == got[4].provider_name == "Unknown Provider" and got[3].total_amount == 0
    assert (got[5].total_amount, got[5].expense_date) == (Decimal("5.00"), date(2026, 1, 2))


def test_boxes(spark):
    rows = [("p", 50.0, 60.0, 1.0, 11.0, "b"), ("p", 0.0, 10.0, 0.0, 10.0, "a"), ("p", 0.0, 10.0, 20.0, 30.0, "c"), ("p", 0.0, 10.0, 40.0, 50.0, " "), ("q", 0.0, 1.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "page_id string, x0 double, x1 double, y0 double, y1 double, text string")
    assert sorted(tuple(r) for r in receipt_text.lines_from_boxes(df).collect()) == [("p", 0, "a b"), ("p", 1, "c")]


def test_findings(spark):
    months = [(date(2025, i + 1, 1), Decimal(a)) for i, a in enumerate([100] * 9 + [1000, 120])]
    trend = spark.createDataFrame(months, "month date, amount decimal(18,2)")
    got = [(r.kind, r.amount) for r in findings.findings(trend).collect()]
    assert got == [("level", 100.0), ("outlier", 1000.0), ("month_in_range", 120.0), ("dispersion", 1.5)]
    short = spark.createDataFrame(months[:3], "month date, amount decimal(18,2)")
    assert [(r.kind, r.amount) for r in findings.findings(short).collect()] == [("insufficient_data", 2.0)]
