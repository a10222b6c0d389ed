"""Outcomes of a run, rival runs, a run that dies before it is committed."""

import os
import time

from tallyspark.operators import scan_run
from tallyspark.sources import run_ledger

FILE, LEDGER = "path string, content_hash string, file_type string, failed boolean", "path string, content_hash string, status string, receipt_id string"
NOTHING = "receipt_id string, version int, sha256 string"


def test_outcomes(spark):
    found = spark.createDataFrame([(p, h, "unknown" if p == "odd" else "pdf", p == "bad") for p, h in {"a": "1", "bad": "2", "copy": "5", "kept": "5", "lost": "6", "moved": "8", "new": "9", "odd": "0", "orphan": "7", "seen": "4"}.items()], FILE)
    ledger = spark.createDataFrame([("a", "1", "PENDIENTE", "r1"), ("kept", "5", "PROCESADO", "r2"), ("lost", "6", "ERROR", "gone"), ("moved", "3", "PROCESADO", "r3"), ("orphan", "7", "PROCESADO", None), ("seen", "4", "ERROR", "r3")], LEDGER)
    receipts = spark.createDataFrame([("r1", "PENDIENTE", False), ("r2", "APROBADO", False), ("r3", "AUTO_APROBADO", True)], "id string, extraction_status string, reviewed boolean")
    documents = spark.createDataFrame([("r2", 1, "x"), ("r2", 2, "5"), ("r3", 1, "4"), ("r3", 2, "y")], NOTHING)
    rows = {r.path: (r.action, r.status, r.retire) for r in scan_run.run_details(found, ledger, receipts, documents, "co").collect()}
    assert rows == {
        "a": ("ACTUALIZADO", "PROCESADO", "BANDEJA"), "bad": ("ERROR", "ERROR", None), "copy": ("OMITIDO", "DUPLICADO", None), "kept": ("SIN_CAMBIOS", "PROCESADO", "RETIRADO"), "lost": ("CREADO", "PROCESADO", "BANDEJA"),
        "moved": ("OMITIDO", "PROCESADO", "SIN_RESPALDO"), "new": ("CREADO", "PROCESADO", "BANDEJA"), "odd": ("OMITIDO", "NO_SOPORTADO", None), "orphan": ("CREADO", "PROCESADO", "BANDEJA"), "seen": ("OMITIDO", "PROCESADO", "SIN_RESPALDO"),
    }
    stock = scan_run.run_details(found, ledger, receipts, documents, None, cap=4, pending_only=True)
    assert {r.path: (r.action, r.retire) for r in stock.collect()} == {"a": ("OMITIDO", None), "bad": ("ERROR", None), "copy": ("OMITIDO", None)}
    assert scan_run.run_totals(found, stock, 4).first().asDict() == {"seen": 10, "waiting": 6, "created": 0, "updated": 0, "unchanged": 0, "duplicates": 0, "unsupported": 0, "failed": 1, "in_tray": 0, "retired": 0}


def test_rivals_and_a_dead_run(spark, tmp_path):
    folder = f"file://{tmp_path}/ledger"
    details = lambda *rows: spark.createDataFrame([(p, h, "CREADO", "PROCESADO", r, None) for p, h, r in rows], run_ledger.ROW)
    now = lambda **k: sorted(tuple(r) for r in run_ledger.ledger(spark, folder, **k).collect())
    assert now() == []
    first = run_ledger.take(spark, folder, 60)
    assert first.number == 1 and run_ledger.take(spark, folder, 60) is None and run_ledger.renew(spark, first)
    for _ in range(2):
        run_ledger.commit(details(("a", "1", "r1"), ("b", "2", "r2")), first)
    run_ledger.release(spark, first)
    dead = run_ledger.take(spark, folder, 60)
    run_ledger.commit(details(("a", "9", "r9")), dead)
    os.remove(f"{tmp_path}/ledger/run-000000002/_SUCCESS")  # as if it had died before
    assert now() == [("a", "1", "PROCESADO", "r1"), ("b", "2", "PROCESADO", "r2")]
    os.utime(f"{tmp_path}/ledger/leases/lease-000000002", (time.time() - 100,) * 2)
    third = run_ledger.take(spark, folder, 60)
    assert third.number == 3 and not run_ledger.renew(spark, dead)
    run_ledger.commit(details(("a", "3", "r3")), third)
    run_ledger.commit(details(("a", "9", "r9"), ("c", "4", "r4")), dead)  # late: its rows are older than the third run's
    want = [("a", "3", "PROCESADO", "r3"), ("b", "2", "PROCESADO", "r2"), ("c", "4", "PROCESADO", "r4")]
    assert now() == want
    run_ledger.release(spark, third)
    fourth = run_ledger.take(spark, folder, 60)
    for _ in range(2):
        run_ledger.compact(spark, fourth)
    assert now() == want and os.path.exists(f"{tmp_path}/ledger/base-000000003")
    run_ledger.commit(details(("b", "5", "r5")), fourth)
    assert now()[1] == ("b", "5", "PROCESADO", "r5")
