"""Queries of matching, exports and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports, gate, integrity, matching
from ..sources.views import Tables
from .registry import AS_OF, END, START, query
from .shared_sql import AGREE, AGREE_X, EXPORT, FAILURES, PASSED

NAME = "trim(regexp_replace(strip_accents(upper(coalesce({}, ''))), '[^A-Z0-9]+', ' ', 'g'))"
MENTIONED = f"(len(list_filter(string_split({NAME.format('provider_name')}, ' '), lambda w: length(w) >= 3)) > 0 AND len(list_filter(string_split({NAME.format('provider_name')}, ' '), lambda w: length(w) >= 3 AND NOT contains({NAME.format('description')}, w))) = 0)"
PAIRS = f"""(SELECT r.company_id, r.id AS receipt_id, b.id AS bank_id, r.expense_date, abs(abs(total_amount) - abs(amount)) AS gap, cast(abs(date_diff('day', transaction_date, expense_date)) AS int) AS days, {MENTIONED} AS mentioned,
  CASE WHEN abs(abs(total_amount) - abs(amount)) <= 0.01 THEN 1 ELSE 2 END AS tier FROM receipt AS r JOIN bank AS b ON b.company_id = r.company_id AND (abs(abs(total_amount) - abs(amount)) <= 0.01 OR abs(date_diff('day', transaction_date, expense_date)) <= 3)
  WHERE NOT is_reconciled AND expense_date BETWEEN date '1998-03-01' AND date '1998-04-01' AND transaction_date BETWEEN date '1998-03-01' AND date '1998-04-01')"""
#: The same without date bounds.
ALL_PAIRS = PAIRS.replace(" AND expense_date BETWEEN date '1998-03-01' AND date '1998-04-01' AND transaction_date BETWEEN date '1998-03-01' AND date '1998-04-01'", "")
BEST = f"(SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY tier, gap, days, NOT mentioned, bank_id) AS n FROM {PAIRS} AS p)"
ALL_BEST = BEST.replace(PAIRS, ALL_PAIRS)


def _eligible(t: Tables, link: bool = False):
    return matching.eligible(t.receipt, t.bank, t.reconciliation if link else None, START, END)


def _pairs(t: Tables):
    """Of one month."""
    return matching.candidates(*_eligible(t))


def _all_pairs(t: Tables):
    return matching.candidates(*matching.eligible(t.receipt, t.bank))


@query("J03_M05_eligible_receipts", "SELECT id FROM receipt AS r WHERE expense_date BETWEEN date '1998-03-01' AND date '1998-04-01' AND NOT EXISTS (SELECT 1 FROM reconciliation AS m WHERE m.receipt_id = r.id)")
def m05(t: Tables):
    return _eligible(t, True)[0].select("id")


@query("J04_candidates", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days, mentioned, tier FROM {PAIRS} AS p")
def j04(t: Tables):
    return _pairs(t).select("receipt_id", "bank_id", F.col("gap").cast("decimal(13,2)").alias("gap"), "days", "mentioned", "tier")


@query("J04_candidates_all", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days, mentioned, tier FROM {ALL_PAIRS} AS p")
def j04_all(t: Tables):
    return _all_pairs(t).select("receipt_id", "bank_id", F.col("gap").cast("decimal(13,2)").alias("gap"), "days", "mentioned", "tier")


@query("M01_pair_distances", "SELECT m.id, cast(abs(abs(total_amount) - abs(amount)) AS decimal(13,2)) AS gap, cast(abs(date_diff('day', transaction_date, expense_date)) AS int) AS days FROM reconciliation AS m JOIN receipt AS r ON r.id = m.receipt_id JOIN bank AS b ON b.id = m.bank_id")
def m01(t: Tables):
    r, b = t.receipt.select(F.col("id").alias("receipt_id"), "total_amount", "expense_date"), t.bank.select(F.col("id").alias("bank_id"), "amount", "transaction_date")
    rows = t.reconciliation.join(r, "receipt_id").join(b, "bank_id")
    return rows.select("id", matching.amount_gap(F.col("total_amount"), F.col("amount")).cast("decimal(13,2)").alias("gap"), F.abs(F.datediff("expense_date", "transaction_date")).alias("days"))


@query("M03_best_candidates", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days, mentioned, CASE WHEN days <= 3 THEN 'PERFECT' ELSE 'MANUAL' END AS match_status FROM {BEST} AS x WHERE n = 1 AND tier = 1")
def m03(t: Tables):
    return matching.best_tables(*_eligible(t)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


@query("M03_best_candidates_all", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days, mentioned, CASE WHEN days <= 3 THEN 'PERFECT' ELSE 'MANUAL' END AS match_status FROM {ALL_BEST} AS x WHERE n = 1 AND tier = 1")
def m03_all(t: Tables):
    return matching.best_tables(*matching.eligible(t.receipt, t.bank)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


@query("M04_nearest_by_date", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days FROM {BEST} AS x WHERE n = 1 AND tier = 2")
def m04(t: Tables):
    return matching.nearest_tables(*_eligible(t)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


@query("M04_nearest_by_date_all", f"SELECT receipt_id, bank_id, cast(gap AS decimal(13,2)) AS gap, days FROM {ALL_BEST} AS x WHERE n = 1 AND tier = 2")
def m04_all(t: Tables):
    return matching.nearest_tables(*matching.eligible(t.receipt, t.bank)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


#: The serial rule, receipt after receipt of a company: each takes the first of its wishes that none before it took.
SERIAL = """SELECT p.receipt_id, p.bank_id, CASE WHEN tier = 2 THEN 'DISCREPANCY' WHEN days <= 3 THEN 'PERFECT' ELSE 'MANUAL' END AS match_status, cast(gap AS decimal(13,2)) AS gap, days, mentioned, CRITERION AS criterion
FROM (WITH RECURSIVE pair AS MATERIALIZED (SELECT * FROM PAIRS AS q),
    wish AS MATERIALIZED (SELECT company_id, receipt_id, row_number() OVER (PARTITION BY company_id ORDER BY expense_date, receipt_id) AS k, wishes FROM (SELECT company_id, receipt_id, expense_date, list(bank_id ORDER BY tier, gap, days, NOT mentioned, bank_id) AS wishes FROM pair GROUP BY ALL) AS g),
    turn AS (SELECT company_id, cast(0 AS bigint) AS k, cast([] AS varchar[]) AS taken, cast(NULL AS varchar) AS receipt_id, cast(NULL AS varchar) AS bank_id FROM (SELECT DISTINCT company_id FROM wish) AS c
      UNION ALL SELECT company_id, k, CASE WHEN bank_id IS NULL THEN taken ELSE list_append(taken, bank_id) END, receipt_id, bank_id
      FROM (SELECT w.company_id, w.k, t.taken, w.receipt_id, list_filter(w.wishes, lambda b: NOT list_contains(t.taken, b))[1] AS bank_id FROM turn AS t JOIN wish AS w ON w.company_id = t.company_id AND w.k = t.k + 1) AS n)
  SELECT pair.* FROM turn JOIN pair ON pair.receipt_id = turn.receipt_id AND pair.bank_id = turn.bank_id) AS p"""
CRITERION = "CASE WHEN gap = 0 THEN 'monto exacto' ELSE 'monto con $' || cast(cast(gap AS decimal(13,2)) AS varchar) || ' de diferencia' END || ', ' || CASE days WHEN 0 THEN 'misma fecha' WHEN 1 THEN 'con 1 dia de diferencia de fecha' ELSE 'con ' || cast(days AS varchar) || ' dias de diferencia de fecha' END || CASE WHEN mentioned THEN ' y el nombre del proveedor aparece en la descripcion' ELSE '' END"


@query("M02_match", SERIAL.replace("CRITERION", CRITERION).replace("PAIRS", ALL_PAIRS))
def m02(t: Tables):
    return matching.match_tables(*matching.eligible(t.receipt, t.bank)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


@query("M02_match_month", SERIAL.replace("CRITERION", CRITERION).replace("PAIRS", PAIRS))
def m02_month(t: Tables):
    return matching.match_tables(*_eligible(t)).withColumn("gap", F.col("gap").cast("decimal(13,2)"))


@query("M06_provider_mentioned", f"SELECT b.id, {MENTIONED} AS mentioned FROM bank AS b JOIN receipt AS r ON r.k = b.k")
def m06(t: Tables):
    return t.bank.select("id", "k", "description").join(t.receipt.select("k", "provider_name"), "k").select("id", matching.mentions(F.col("provider_name"), F.col("description")).alias("mentioned"))


@query("M07_criterion", f"SELECT receipt_id, bank_id, CASE WHEN gap = 0 THEN 'monto exacto' ELSE 'monto con $' || cast(cast(gap AS decimal(13,2)) AS varchar) || ' de diferencia' END || ', ' || CASE days WHEN 0 THEN 'misma fecha' WHEN 1 THEN 'con 1 dia de diferencia de fecha' ELSE 'con ' || cast(days AS varchar) || ' dias de diferencia de fecha' END || CASE WHEN mentioned THEN ' y el nombre del proveedor aparece en la descripcion' ELSE '' END AS criterion FROM {PAIRS} AS p")
def m07(t: Tables):
    return _pairs(t).select("receipt_id", "bank_id", matching.criterion_text(F.col("gap").cast("decimal(13,2)"), F.col("days"), F.col("mentioned")).alias("criterion"))


@query("M07_criterion_all", f"SELECT receipt_id, bank_id, CASE WHEN gap = 0 THEN 'monto exacto' ELSE 'monto con $' || cast(cast(gap AS decimal(13,2)) AS varchar) || ' de diferencia' END || ', ' || CASE days WHEN 0 THEN 'misma fecha' WHEN 1 THEN 'con 1 dia de diferencia de fecha' ELSE 'con ' || cast(days AS varchar) || ' dias de diferencia de fecha' END || CASE WHEN mentioned THEN ' y el nombre del proveedor aparece en la descripcion' ELSE '' END AS criterion FROM {ALL_PAIRS} AS p")
def m07_all(t: Tables):
    return _all_pairs(t).select("receipt_id", "bank_id", matching.criterion_text(F.col("gap").cast("decimal(13,2)"), F.col("days"), F.col("mentioned")).alias("criterion"))


@query("M08_applied_flags", "SELECT b.id, is_reconciled OR m.id IS NOT NULL AS is_reconciled FROM bank AS b LEFT JOIN reconciliation AS m ON m.bank_id = b.id")
def m08(t: Tables):
    return matching.applied(t.bank, t.reconciliation).select("id", "is_reconciled")


@query("M09_manual_overrides", "SELECT id, match_status FROM reconciliation WHERE CAST(receipt_id AS bigint) % 10 <> 0 UNION ALL SELECT 'x' || b.id, 'MANUAL' FROM bank AS b WHERE k % 9 = 1 AND (k % 2 = 1 OR k % 10 = 0)")
def m09(t: Tables):
    removed = t.reconciliation.where("cast(receipt_id as bigint) % 10 = 0")
    added = t.bank.where("k % 9 = 1").select(F.concat(F.lit("x"), "id").alias("id"), F.col("k").cast("string").alias("receipt_id"), F.col("id").alias("bank_id"), F.col("transaction_date").alias("matched_on"))
    return matching.with_overrides(t.reconciliation, added, removed)[0].select("id", "match_status")


@query("A38_run_counts", "SELECT count(*) FILTER (WHERE match_status = 'PERFECT') AS perfect, count(*) FILTER (WHERE match_status = 'MANUAL') AS manual, count(*) FILTER (WHERE match_status = 'DISCREPANCY') AS discrepancy, (SELECT count(*) FROM receipt) - count(*) AS receipts_alone, (SELECT count(*) FROM bank) - count(*) AS movements_alone FROM reconciliation")
def a38(t: Tables):
    return matching.run_counts(t.receipt, t.bank, t.reconciliation)


def _export(t: Tables):
    return exports.export_rows(t.receipt, t.reconciliation, t.bank)


@query("M10_J02_export_rows", f"SELECT * FROM {EXPORT} AS e")
def m10(t: Tables):
    return _export(t)


def _layout_sql(sources: dict[str, str]) -> str:
    columns = [f"""coalesce(cast("{sources[c]}" AS varchar), '') AS "{c}\"""" if sources.get(c, "") in exports.STANDARD else f"""'{sources.get(c, "")}' AS "{c}\"""" for c in exports.ACCOUNTING]
    return f"SELECT id, {', '.join(columns)} FROM {EXPORT} AS e"


@query("M11_accounting_layout", _layout_sql(exports.ACCOUNTING_FROM))
def m11(t: Tables):
    return exports.accounting_layout(_export(t))


@query("M11_accounting_mapped", _layout_sql({**exports.ACCOUNTING_FROM, "Cuenta": "5000", "Moneda": "MXN", "Concepto": "Descripcion Banco"}))
def m11_mapped(t: Tables):
    return exports.accounting_layout(_export(t), {"Cuenta": "5000", "Moneda": "MXN", "Concepto": "Descripcion Banco"})


@query("P12_selected_columns", f"""SELECT id, "Proveedor" AS provider, "Total" AS total FROM {EXPORT} AS e""")
def p12(t: Tables):
    return exports.selected(_export(t), {"Proveedor": "provider", "Nope": "nope", "Total": "total"})


@query("V01_checks", f"SELECT id, array_to_string({PASSED}, '; ') AS passed, array_to_string({FAILURES}, '; ') AS failures FROM draft")
def v01(t: Tables):
    rows = gate.gate(t.draft, AS_OF)
    return rows.select("id", F.array_join("passed", "; ").alias("passed"), F.array_join("failures", "; ").alias("failures"))


STATUS = "CASE WHEN list_has_any(f, ['provider_missing', 'total_not_positive', 'date_missing']) THEN 'PENDIENTE' WHEN len(f) > 0 THEN 'REQUIERE_REVISION' {} ELSE 'REQUIERE_REVISION' END"


@query("V02_decisions", f"SELECT id, {STATUS.format('WHEN confidence >= 0.9 THEN ' + chr(39) + 'AUTO_APROBADO' + chr(39))} AS extraction_status, CASE WHEN len(f) > 0 THEN array_to_string(list_transform(f, lambda x: 'check:' || x), '; ') WHEN confidence >= 0.9 THEN 'confidence_high' WHEN confidence >= 0.6 THEN 'confidence_medium' ELSE 'confidence_low' END AS reasons FROM (SELECT *, {FAILURES} AS f FROM draft) AS d")
def v02(t: Tables):
    return gate.gate(t.draft, AS_OF).select("id", "extraction_status", "reasons")


@query("V03_manual_entries", f"SELECT id, {STATUS.format('WHEN true THEN ' + chr(39) + 'APROBADO' + chr(39))} AS extraction_status FROM (SELECT *, {FAILURES} AS f FROM draft) AS d")
def v03(t: Tables):
    return gate.gate(t.draft, AS_OF, manual=True).select("id", "extraction_status")


@query("V05_rule_confidence", """SELECT id, cast(CASE WHEN confidence_source = 'ocr' THEN CASE WHEN i AND s AND d THEN 0.93 WHEN i AND s THEN 0.88 WHEN s AND d THEN 0.86 WHEN i AND d THEN 0.80 WHEN s THEN 0.76 WHEN i THEN 0.72 WHEN d THEN 0.68 ELSE 0.60 END
    ELSE CASE WHEN i AND s AND d THEN 0.97 WHEN i AND s THEN 0.94 WHEN s AND d THEN 0.92 WHEN i AND d THEN 0.90 WHEN s THEN 0.90 WHEN i THEN 0.90 WHEN d THEN 0.88 ELSE 0.86 END END AS decimal(4,3)) AS confidence
    FROM (SELECT *, coalesce(provider_tax_id, '') <> '' AS i, subtotal IS NOT NULL AS s, expense_date IS NOT NULL AS d FROM draft) AS x""")
def v05(t: Tables):
    return t.draft.select("id", gate.rule_confidence().alias("confidence"))


@query("V10_arithmetic_sign", f"SELECT id, CASE WHEN total_amount IS NULL OR total_amount <= 0 THEN 0 WHEN {AGREE} OR {AGREE_X} THEN 1 WHEN subtotal IS NOT NULL AND tax_amount IS NOT NULL THEN -1 ELSE 0 END AS sign FROM draft")
def v10(t: Tables):
    return t.draft.select("id", gate.arithmetic_sign().alias("sign"))


@query("V10_best_reading", f"""SELECT id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(total_amount, 0) > 0 DESC, coalesce(provider_name, '') <> 'Unknown Provider' DESC, sg DESC, p DESC, coalesce(provider_tax_id, '') <> '' DESC, subtotal IS NOT NULL DESC, attempt) AS n FROM (
    SELECT *, CASE WHEN total_amount IS NULL OR total_amount <= 0 THEN 0 WHEN {AGREE} OR {AGREE_X} THEN 1 WHEN subtotal IS NOT NULL AND tax_amount IS NOT NULL THEN -1 ELSE 0 END AS sg, coalesce(provider_name, '') LIKE 'Customer#%' AND false AS p
    FROM (SELECT *, 1 AS attempt FROM draft UNION ALL SELECT id, k, provider_name, provider_tax_id, total_amount, tax_amount, subtotal, excise_amount, expense_date, confidence, confidence_source, 2 FROM receipt) AS u) AS v) AS w WHERE n = 1""")
def v10_best(t: Tables):
    columns = ["id", "k", "provider_name", "provider_tax_id", "total_amount", "tax_amount", "subtotal", "excise_amount", "expense_date", "confidence", "confidence_source"]
    both = t.draft.select(*columns, F.lit(1).alias("attempt")).unionByName(t.receipt.select(*columns, F.lit(2).alias("attempt")))
    return gate.best_reading(both.withColumn("n_items", F.lit(0))).select("id", "attempt")


@query("V18_clamped", "SELECT id, CASE WHEN abs(total_amount * 500000) > 9999999999.99 THEN NULL ELSE cast(total_amount * 500000 AS decimal(12,2)) END AS amount FROM receipt")
def v18(t: Tables):
    from ..functions.money import clamped

    return t.receipt.select("id", clamped((F.col("total_amount") * 500000).cast("decimal(20,2)")).alias("amount"))


@query("V19_persisted", f"SELECT id, {STATUS.format('WHEN confidence >= 0.9 THEN ' + chr(39) + 'AUTO_APROBADO' + chr(39))} AS extraction_status FROM (SELECT *, {FAILURES} AS f FROM (SELECT *, row_number() OVER (PARTITION BY company_id, source_hash ORDER BY id) AS n FROM receipt WHERE k % 3 <> 0) AS r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM receipt AS e WHERE e.k % 3 = 0 AND e.company_id = r.company_id AND e.source_hash = r.source_hash)) AS d")
def v19(t: Tables):
    return gate.persisted(t.receipt.where("k % 3 <> 0"), t.receipt.where("k % 3 = 0"), AS_OF).select("id", "extraction_status")


@query("C11_duplicate_hashes", "SELECT company_id, source_hash, count(*) AS n FROM receipt GROUP BY 1, 2 HAVING count(*) > 1")
def c11(t: Tables):
    return integrity.duplicates(t.receipt, ["company_id", "source_hash"])


@query("P11_changed_rows", "SELECT r.id AS key, CASE WHEN d.id IS NULL THEN 'deleted' ELSE 'changed' END AS what FROM receipt AS r LEFT JOIN (SELECT * FROM draft WHERE k % 101 <> 0) AS d ON d.id = r.id WHERE d.id IS NULL OR r.total_amount IS DISTINCT FROM d.total_amount OR r.expense_date IS DISTINCT FROM d.expense_date")
def p11(t: Tables):
    columns = ["id", "total_amount", "expense_date"]
    return integrity.changed_rows(t.receipt.select(*columns), t.draft.where("k % 101 <> 0").select(*columns), "id")
