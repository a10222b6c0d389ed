"""Queries of predicates, dashboards, queues, accuracy, the close report and findings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates, stats
from ..operators import accuracy, close, dashboard, findings, queues
from ..sources.views import Tables, prefix
from .registry import AS_OF, END, ORACLE_SQL, START, query

MARCH = "expense_date >= date '1998-03-01' AND expense_date < date '1998-04-01'"
KEY = "CASE WHEN coalesce(trim(category), '') = '' THEN 'SIN_CLASIFICAR' ELSE strip_accents(upper(trim(category))) END"
TREND = """SELECT m.month, cast(coalesce(s.a, 0) AS decimal(18,2)) AS amount, coalesce(s.n, 0) AS receipts
  FROM (SELECT cast(unnest(generate_series(timestamp '1997-04-01', timestamp '1998-03-01', interval 1 month)) AS date) AS month) AS m
  LEFT JOIN (SELECT cast(date_trunc('month', expense_date) AS date) AS month, sum(total_amount) AS a, count(*) AS n FROM receipt WHERE expense_date >= date '1997-04-01' AND expense_date < date '1998-04-01' GROUP BY 1) AS s ON s.month = m.month"""


@query("S01_tenant_scan", "SELECT id, total_amount, expense_date FROM receipt WHERE company_id = '7'")
def s01(t: Tables):
    return dashboard.of_company(t.receipt, "7").select("id", "total_amount", "expense_date")


@query("P01_half_open_window", f"SELECT id, expense_date FROM receipt WHERE {MARCH}")
def p01(t: Tables):
    return t.receipt.where(dashboard.in_window(F.col("expense_date"), START, END)).select("id", "expense_date")


@query("P02_closed_window", "SELECT id, expense_date FROM receipt WHERE expense_date BETWEEN date '1998-03-01' AND date '1998-03-17'")
def p02(t: Tables):
    return t.receipt.where(F.col("expense_date").between(F.lit(START), F.lit(AS_OF))).select("id", "expense_date")


@query("P03_firm_dates", f"SELECT id FROM receipt WHERE {MARCH} AND NOT date_provisional")
def p03(t: Tables):
    return t.receipt.where(dashboard.in_window(F.col("expense_date"), START, END) & ~F.col("date_provisional")).select("id")


@query("P04_no_category", "SELECT id, extraction_status FROM receipt WHERE category IS NULL OR trim(category) = ''")
def p04(t: Tables):
    return queues.receipt_list(t.receipt, without_category=True).select("id", "extraction_status")


@query("P05_open_receipts", "SELECT id, extraction_status FROM receipt WHERE company_id = '3' AND extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE') ORDER BY expense_date DESC, id LIMIT 40 OFFSET 20")
def p05(t: Tables):
    return queues.page(queues.receipt_list(t.receipt, company="3", only_open=True, status="APROBADO"), [F.desc("expense_date"), F.col("id")], 40, 20).select("id", "extraction_status")


@query("P06_settled_set", "SELECT id FROM receipt WHERE extraction_status IN ('AUTO_APROBADO', 'APROBADO')")
def p06(t: Tables):
    return t.receipt.where(F.col("extraction_status").isin(*queues.SETTLED)).select("id")


@query("P07_stale_scans", "SELECT path FROM scan_file WHERE last_error LIKE '%sobreescribe%'")
def p07(t: Tables):
    return t.scan_file.where(F.col("last_error").contains("sobreescribe")).select("path")


@query("P08_tax_id_pattern", "SELECT id, regexp_full_match(upper(trim(provider_tax_id)), '[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}') AS valid FROM receipt WHERE provider_tax_id IS NOT NULL")
def p08(t: Tables):
    from ..functions.text import valid_tax_id

    return t.receipt.where("provider_tax_id is not null").select("id", valid_tax_id(F.col("provider_tax_id")).alias("valid"))


@query("P09_name_equality", "SELECT a.c_custkey AS id FROM customer AS a JOIN supplier AS b ON lower(replace(a.c_name, 'Customer', 'X')) = lower(replace(b.s_name, 'Supplier', 'x'))")
def p09(t: Tables):
    a = t.customer.select("c_custkey", F.lower(F.replace("c_name", F.lit("Customer"), F.lit("X"))).alias("e"))
    b = t.supplier.select(F.lower(F.replace("s_name", F.lit("Supplier"), F.lit("x"))).alias("e"))
    return a.join(b, "e").select(F.col("c_custkey").alias("id"))


@query("P10_paid_in_other_month", "SELECT r.id FROM reconciliation AS m JOIN receipt AS r ON r.id = m.receipt_id JOIN bank AS b ON b.id = m.bank_id WHERE year(r.expense_date) = year(b.transaction_date) AND month(r.expense_date) <> month(b.transaction_date)")
def p10(t: Tables):
    r, b = t.receipt.select(F.col("id").alias("receipt_id"), "expense_date"), t.bank.select(F.col("id").alias("bank_id"), "transaction_date")
    rows = t.reconciliation.join(r, "receipt_id").join(b, "bank_id")
    return rows.where((F.year("expense_date") == F.year("transaction_date")) & (F.month("expense_date") != F.month("transaction_date"))).select(F.col("receipt_id").alias("id"))


@query("P13_audit_window", "SELECT id, user_id, action FROM audit WHERE action = 'PURCHASE' AND module = 'module1' AND logged_on BETWEEN date '2024-01-05' AND date '2024-01-20'")
def p13(t: Tables):
    return queues.audit_log(t.audit, action="PURCHASE", module="module1", since=date(2024, 1, 5), until=date(2024, 1, 20)).select("id", "user_id", "action")


@query("P14_active_unverified", "SELECT id FROM product WHERE active AND NOT verified")
def p14(t: Tables):
    return t.product.where("active and not verified").select("id")


@query("A01_period_total", f"SELECT cast(coalesce(sum(total_amount), 0) AS decimal(18,2)) AS amount, count(*) AS receipts FROM receipt WHERE {MARCH} AND NOT date_provisional")
def a01(t: Tables):
    return dashboard.period_total(t.receipt, START, END)


def _compare_sql(now: str, before: str) -> str:
    return f"""SELECT *, cast(amount - amount_before AS decimal(18,2)) AS delta, round(CASE WHEN amount_before <> 0 THEN (cast(amount AS double) - cast(amount_before AS double)) / cast(amount_before AS double) * 100 END, 6) AS change_pct
      FROM (SELECT cast(coalesce(sum(total_amount) FILTER (WHERE {now}), 0) AS decimal(18,2)) AS amount, count(*) FILTER (WHERE {now}) AS receipts,
      cast(coalesce(sum(total_amount) FILTER (WHERE {before}), 0) AS decimal(18,2)) AS amount_before, count(*) FILTER (WHERE {before}) AS receipts_before FROM receipt WHERE NOT date_provisional) AS s"""


@query("A02_month_on_month", _compare_sql(MARCH, "expense_date >= date '1998-02-01' AND expense_date < date '1998-03-01'"))
def a02(t: Tables):
    return dashboard.month_on_month(t.receipt, AS_OF)


@query("A03_month_to_date", _compare_sql("expense_date BETWEEN date '1998-03-01' AND date '1998-03-17'", "expense_date BETWEEN date '1998-02-01' AND date '1998-02-17'"))
def a03(t: Tables):
    return dashboard.month_to_date(t.receipt, AS_OF)


@query("A03_month_to_date_legacy", _compare_sql("expense_date >= date '1998-03-01' AND expense_date < date '1998-03-31'", "expense_date >= date '1998-02-01' AND expense_date < date '1998-02-28'"))
def a03_legacy(t: Tables):
    return dashboard.month_to_date(t.receipt, date(1998, 3, 31), legacy_cut=True)


@query("A04_spend_by_category", f"""SELECT category, CASE category WHEN 'RENTA' THEN 'Renta' WHEN 'ALIMENTACION' THEN 'Alimentacion' WHEN 'COMBUSTIBLE' THEN 'Combustible' WHEN 'SIN_CLASIFICAR' THEN 'Sin clasificar' ELSE upper(substr(category, 1, 1)) || lower(replace(substr(category, 2), '_', ' ')) END AS label,
    category <> 'RENTA' AS varies, cast(CASE category WHEN 'RENTA' THEN 0 WHEN 'ALIMENTACION' THEN 7 WHEN 'COMBUSTIBLE' THEN 9 WHEN 'SIN_CLASIFICAR' THEN 17 ELSE 10000 END AS int) AS position, amount, receipts, round(cast(amount AS double) / cast(sum(amount) OVER () AS double), 6) AS share
    FROM (SELECT {KEY} AS category, cast(sum(total_amount) AS decimal(18,2)) AS amount, count(*) AS receipts FROM receipt WHERE {MARCH} AND NOT date_provisional GROUP BY 1) AS s""")  # fmt: skip
def a04(t: Tables):
    return dashboard.spend_by_category(t.receipt, START, END)


@query("A05_monthly_trend", TREND)
def a05(t: Tables):
    return dashboard.monthly_trend(t.receipt, AS_OF)


@query("A06_top_providers", f"SELECT provider_name, cast(sum(total_amount) AS decimal(18,2)) AS amount, count(*) AS receipts FROM receipt WHERE {MARCH} GROUP BY 1 ORDER BY amount DESC, provider_name LIMIT 8")
def a06(t: Tables):
    return dashboard.top_providers(t.receipt, START, END)


@query("A07_by_status", "SELECT extraction_status AS value, count(*) AS n FROM receipt GROUP BY 1")
def a07(t: Tables):
    return dashboard.counts_by(t.receipt, "extraction_status")


@query("A08_by_match_status", "SELECT match_status, count(*) AS n FROM reconciliation AS m JOIN receipt AS r ON r.id = m.receipt_id WHERE company_id = '5' GROUP BY 1")
def a08(t: Tables):
    return dashboard.match_status_counts(t.receipt, t.reconciliation, "5")


@query("A09_bank_coverage", """SELECT *, movements - reconciled AS open, CASE WHEN movements > 0 THEN round(reconciled * 100.0 / movements, 6) ELSE 0 END AS reconciled_pct FROM (SELECT count(*) AS movements, count(*) FILTER (WHERE is_reconciled) AS reconciled, cast(coalesce(sum(amount), 0) AS decimal(18,2)) AS amount,
    cast(coalesce(sum(amount) FILTER (WHERE is_reconciled), 0) AS decimal(18,2)) AS reconciled_amount FROM bank WHERE transaction_date >= date '1998-03-01' AND transaction_date < date '1998-04-01') AS s""")
def a09(t: Tables):
    return dashboard.bank_coverage(t.bank, START, END)


@query("A10_months_by_category", f"""SELECT m.month, c.category, cast(coalesce(s.a, 0) AS decimal(18,2)) AS amount FROM (SELECT cast(unnest(generate_series(timestamp '1997-10-01', timestamp '1998-03-01', interval 1 month)) AS date) AS month) AS m
    CROSS JOIN (SELECT DISTINCT {KEY} AS category FROM receipt WHERE expense_date >= date '1997-10-01' AND expense_date < date '1998-04-01' AND NOT date_provisional) AS c
    LEFT JOIN (SELECT cast(date_trunc('month', expense_date) AS date) AS month, {KEY} AS category, sum(total_amount) AS a FROM receipt WHERE expense_date >= date '1997-10-01' AND expense_date < date '1998-04-01' AND NOT date_provisional GROUP BY 1, 2) AS s ON s.month = m.month AND s.category = c.category""")
def a10(t: Tables):
    return dashboard.months_by_category(t.receipt, AS_OF)


@query("A11_uncategorised", "SELECT cast(coalesce(sum(total_amount), 0) AS decimal(18,2)) AS amount, count(*) AS receipts FROM receipt WHERE category IS NULL OR trim(category) = ''")
def a11(t: Tables):
    return dashboard.uncategorised(t.receipt)


@query("A12_open_queues", "SELECT extraction_status AS value, count(*) AS n FROM receipt WHERE extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE') GROUP BY 1")
def a12(t: Tables):
    return dashboard.counts_by(queues.receipt_list(t.receipt, only_open=True), "extraction_status")


@query("A13_history_totals", f"SELECT cast(sum(amount) AS decimal(18,2)) AS amount, cast(sum(receipts) AS bigint) AS receipts FROM ({TREND}) AS x")
def a13(t: Tables):
    return dashboard.history_totals(t.receipt, AS_OF)


@query("W02_months", "SELECT cast(unnest(generate_series(timestamp '1997-04-01', timestamp '1998-03-01', interval 1 month)) AS date) AS month")
def w02(t: Tables):
    return dates.months_until(t.spark, AS_OF, 12)


@query("W03_month_changes", f"""SELECT month, amount, cast(amount - lag(amount) OVER (ORDER BY month) AS decimal(18,2)) AS delta, round(CASE WHEN lag(amount) OVER (ORDER BY month) <> 0 THEN (cast(amount AS double) - cast(lag(amount) OVER (ORDER BY month) AS double)) / cast(lag(amount) OVER (ORDER BY month) AS double) * 100 END, 6) AS change_pct FROM ({TREND}) AS x""")
def w03(t: Tables):
    return dashboard.month_changes(t.receipt, AS_OF)


@query("A14_review_queue", """SELECT count(*) FILTER (WHERE extraction_status = 'REQUIERE_REVISION') AS needs_review, count(*) FILTER (WHERE extraction_status = 'PENDIENTE') AS pending, count(*) AS total_open,
    (SELECT round(avg(date_diff('day', created_on, date '1998-03-17')), 1) FROM (SELECT created_on FROM receipt WHERE extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE') ORDER BY created_on, id LIMIT 50) AS f) AS mean_age_days FROM receipt WHERE extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE')""")
def a14(t: Tables):
    return queues.review_queue(t.receipt, AS_OF)


@query("A15_spot_check_queue", """SELECT count(*) FILTER (WHERE spot_check_status = 'PENDIENTE') AS pending, count(*) FILTER (WHERE spot_check_status <> 'PENDIENTE') AS reviewed, count(*) FILTER (WHERE spot_check_status = 'CORRECTO') AS correct, count(*) FILTER (WHERE spot_check_status = 'INCORRECTO') AS incorrect,
    cast(date_diff('day', min(created_on) FILTER (WHERE spot_check_status = 'PENDIENTE'), date '1998-03-17') AS int) AS oldest_age_days FROM receipt WHERE spot_check_status IS NOT NULL""")
def a15(t: Tables):
    return queues.spot_check_queue(t.receipt, AS_OF)


SOURCES = """(SELECT source, sum(reviewed) AS reviewed, sum(hits) AS hits, sum(misses) AS misses, sum(pending) AS pending FROM (
    SELECT coalesce(confidence_source, 'desconocido') AS source, cast(spot_check_status IN ('CORRECTO', 'INCORRECTO') AS bigint) AS reviewed, cast(spot_check_status = 'CORRECTO' AS bigint) AS hits, cast(spot_check_status = 'INCORRECTO' AS bigint) AS misses, cast(spot_check_status = 'PENDIENTE' AS bigint) AS pending
    FROM receipt WHERE spot_check_status IS NOT NULL UNION ALL SELECT unnest(['llm', 'pdf_text', 'rules']), 0, 0, 0, 0) AS u GROUP BY 1)"""
BOUNDS = f"""(SELECT *, hits / reviewed AS p, 1 + 1.96 * 1.96 / reviewed AS b, 1.96 / (1 + 1.96 * 1.96 / reviewed) * sqrt((hits / reviewed) * (1 - hits / reviewed) / reviewed + 1.96 * 1.96 / (4.0 * reviewed * reviewed)) AS mg,
    (hits / reviewed + 1.96 * 1.96 / (2.0 * reviewed)) / (1 + 1.96 * 1.96 / reviewed) AS c FROM (SELECT source, cast(reviewed AS double) AS reviewed, cast(hits AS double) AS hits, misses, pending FROM {SOURCES} AS s) AS q)"""
VERDICT = "CASE WHEN reviewed <= 0 THEN 'SIN_EVIDENCIA' WHEN c - mg >= 0.96 THEN 'CUMPLE' WHEN least(1.0, c + mg) < 0.96 THEN 'NO_CUMPLE' ELSE 'INCONCLUYENTE' END"


@query("A16_accuracy_by_source", f"SELECT source, cast(reviewed AS bigint) AS reviewed, cast(hits AS bigint) AS hits, cast(misses AS bigint) AS misses, cast(pending AS bigint) AS pending FROM {SOURCES} AS s")
def a16(t: Tables):
    return accuracy.by_source(t.receipt)


@query("A17_failed_fields", "SELECT coalesce(confidence_source, 'desconocido') AS source, trim(f) AS field, count(*) AS n FROM (SELECT confidence_source, unnest(string_split(spot_check_wrong_fields, ',')) AS f FROM receipt WHERE spot_check_status = 'INCORRECTO') AS x WHERE trim(f) <> '' GROUP BY 1, 2")
def a17(t: Tables):
    return accuracy.failed_fields(t.receipt)


@query("A17_most_failed_field", """SELECT source, field, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, field) AS r FROM (SELECT coalesce(confidence_source, 'desconocido') AS source, trim(f) AS field, count(*) AS n
    FROM (SELECT confidence_source, unnest(string_split(spot_check_wrong_fields, ',')) AS f FROM receipt WHERE spot_check_status = 'INCORRECTO') AS x WHERE trim(f) <> '' GROUP BY 1, 2) AS y) AS z WHERE r = 1""")
def a17_most(t: Tables):
    return accuracy.most_failed_field(t.receipt)


@query("A18_wilson", f"SELECT source, round(CASE WHEN reviewed > 0 THEN CASE WHEN c - mg <= 1e-9 THEN 0.0 ELSE c - mg END END, 6) AS low, round(CASE WHEN reviewed > 0 THEN CASE WHEN c + mg >= 1 - 1e-9 THEN 1.0 ELSE c + mg END END, 6) AS high FROM {BOUNDS} AS x")
def a18(t: Tables):
    return accuracy.report(t.receipt).select("source", "low", "high")


@query("A19_verdicts", f"SELECT source, {VERDICT} AS verdict FROM {BOUNDS} AS x")
def a19(t: Tables):
    return accuracy.report(t.receipt).select("source", "verdict")


@query("A20_reviews_needed", f"""SELECT source, cast(n AS int) AS needed, CASE WHEN reviewed <= 0 THEN 'sin_muestra' WHEN p < 0.96 THEN 'acierto_por_debajo' WHEN p = 0.96 THEN 'acierto_en_la_linea' WHEN n IS NOT NULL THEN 'suficiente' ELSE 'fuera_de_alcance' END AS needed_reason FROM (
    SELECT *, CASE WHEN p > 0.96 THEN (SELECT min(k) FROM (SELECT cast(unnest(generate_series(cast(x.reviewed AS bigint), 200000, 10)) AS double) AS k) AS g
      WHERE ((round_even(x.p * k, 0) / k + 1.96 * 1.96 / (2 * k)) - 1.96 * sqrt((round_even(x.p * k, 0) / k) * (1 - round_even(x.p * k, 0) / k) / k + 1.96 * 1.96 / (4 * k * k))) / (1 + 1.96 * 1.96 / k) >= 0.96) END AS n FROM {BOUNDS} AS x) AS y""")
def a20(t: Tables):
    return accuracy.report(t.receipt).select("source", "needed", "needed_reason")


@query("A21_overall_verdict", f"SELECT CASE WHEN bool_or(v = 'NO_CUMPLE') THEN 'NO_CUMPLE' WHEN bool_or(v = 'INCONCLUYENTE') THEN 'INCONCLUYENTE' WHEN count(*) > 0 THEN 'CUMPLE' ELSE 'SIN_EVIDENCIA' END AS verdict, cast(coalesce(sum(reviewed), 0) AS bigint) AS reviewed, cast(coalesce(sum(hits), 0) AS bigint) AS hits FROM (SELECT *, {VERDICT} AS v FROM {BOUNDS} AS x WHERE reviewed > 0) AS y")
def a21(t: Tables):
    return accuracy.overall(t.receipt)


@query("A22_explanations", f"""SELECT source, verdict, CASE WHEN verdict = 'SIN_EVIDENCIA' THEN source || ': sin revisiones, no hay evidencia' ELSE source || ': ' || cast(cast(hits AS bigint) AS varchar) || ' de ' || cast(cast(reviewed AS bigint) AS varchar) || ' (' || printf('%.1f', hits * 100.0 / reviewed) || '%)' ||
    CASE verdict WHEN 'CUMPLE' THEN ' cumple el objetivo de ' WHEN 'NO_CUMPLE' THEN ' no cumple el objetivo de ' ELSE ' no alcanza para afirmar ni negar el objetivo de ' END || '96.0%' END AS text FROM (SELECT *, {VERDICT} AS verdict FROM {BOUNDS} AS x) AS y""")
def a22(t: Tables):
    return accuracy.explanations(t.receipt)


@query("A42_field_accuracy", """SELECT field, count(*) FILTER (WHERE o = 'h') AS hits, count(*) FILTER (WHERE o = 'm') AS misses, count(*) FILTER (WHERE o = 'n') AS not_on_paper, count(*) FILTER (WHERE o = 'u') AS unsupported, round(count(*) FILTER (WHERE o = 'h') / CASE WHEN count(*) FILTER (WHERE o IN ('h', 'm')) > 0 THEN cast(count(*) FILTER (WHERE o IN ('h', 'm')) AS double) END, 6) AS accuracy FROM (
    SELECT 'provider_name' AS field, CASE WHEN r.provider_name IS NULL THEN CASE WHEN d.provider_name IS NULL THEN 'n' ELSE 'u' END WHEN coalesce(r.provider_name = d.provider_name, false) THEN 'h' ELSE 'm' END AS o FROM receipt AS r LEFT JOIN draft AS d ON d.id = r.id
    UNION ALL SELECT 'total_amount', CASE WHEN r.total_amount IS NULL THEN CASE WHEN d.total_amount IS NULL THEN 'n' ELSE 'u' END WHEN coalesce(abs(r.total_amount - d.total_amount) <= 0.01, false) THEN 'h' ELSE 'm' END FROM receipt AS r LEFT JOIN draft AS d ON d.id = r.id
    UNION ALL SELECT 'subtotal', CASE WHEN r.subtotal IS NULL THEN CASE WHEN d.subtotal IS NULL THEN 'n' ELSE 'u' END WHEN coalesce(abs(r.subtotal - d.subtotal) <= 0.01, false) THEN 'h' ELSE 'm' END FROM receipt AS r LEFT JOIN draft AS d ON d.id = r.id) AS x GROUP BY 1""")
def a42(t: Tables):
    return accuracy.field_accuracy(t.receipt.withColumn("name", F.col("id")), t.draft.withColumn("name", F.col("id")), {"provider_name": None, "total_amount": 0.01, "subtotal": 0.01})


@query("V06_sample", """SELECT doc_id, list_reduce(list_transform(range(1, 65), lambda i: cast(strpos('0123456789abcdef', substr(sha256(text), cast(i AS int), 1)) - 1 AS bigint)), lambda a, d: (a * 16 + d) % 10000) < 500 AS sampled FROM documents WHERE text IS NOT NULL""")
def v06(t: Tables):
    return t.documents.where("text is not null").select("doc_id", stats.in_sample(F.sha2(F.col("text").cast("binary"), 256)).alias("sampled"))


@query("A23_close_reconciliation", f"""SELECT count(DISTINCT r.id) AS receipts, count(*) FILTER (WHERE match_status = 'PERFECT') AS perfect, count(*) FILTER (WHERE match_status = 'MANUAL') AS manual, count(*) FILTER (WHERE match_status = 'DISCREPANCY') AS discrepancy,
    cast(coalesce(sum(total_amount) FILTER (WHERE match_status = 'DISCREPANCY'), 0) AS decimal(18,2)) AS discrepancy_amount,
    count(*) FILTER (WHERE year(expense_date) = year(transaction_date) AND month(expense_date) <> month(transaction_date) AND NOT date_provisional) AS paid_in_other_period,
    cast(coalesce(sum(total_amount) FILTER (WHERE year(expense_date) = year(transaction_date) AND month(expense_date) <> month(transaction_date) AND NOT date_provisional), 0) AS decimal(18,2)) AS paid_in_other_period_amount,
    greatest(count(DISTINCT r.id) - count(*) FILTER (WHERE match_status IN ('PERFECT', 'MANUAL')), 0) AS unreconciled
    FROM receipt AS r LEFT JOIN reconciliation AS m ON m.receipt_id = r.id LEFT JOIN bank AS b ON b.id = m.bank_id WHERE {MARCH}""")
def a23(t: Tables):
    return close.reconciliation_section(t.receipt, t.reconciliation, t.bank, START, END)


@query("A24_close_reading", f"SELECT count(*) FILTER (WHERE extraction_status = 'AUTO_APROBADO') AS by_system, count(*) FILTER (WHERE extraction_status = 'APROBADO') AS verified, count(*) FILTER (WHERE extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE')) AS open FROM receipt WHERE {MARCH}")
def a24(t: Tables):
    return close.reading_section(t.receipt, START, END)


WINTER = "expense_date >= date '1995-03-01' AND expense_date < date '1995-06-01'"


@query("A25_close_verification", f"SELECT count(*) AS sample, count(*) FILTER (WHERE spot_check_status <> 'PENDIENTE') AS reviewed, count(*) FILTER (WHERE spot_check_status = 'PENDIENTE') AS pending, coalesce(string_agg(DISTINCT spot_checked_by, ', ' ORDER BY spot_checked_by), '') AS reviewers, max(created_on) FILTER (WHERE spot_check_status <> 'PENDIENTE') AS last_review FROM receipt WHERE {WINTER} AND spot_check_status IS NOT NULL")
def a25(t: Tables):
    return close.verification_section(t.receipt, date(1995, 3, 1), date(1995, 6, 1))


@query("A26_close_pending", f"""SELECT *, cast(0 AS decimal(18,2)) AS unreconciled_amount, uncategorised + undated + unreconciled + discrepancies > 0 AS has_pending,
    concat_ws(', ', CASE WHEN uncategorised > 0 THEN cast(uncategorised AS varchar) || ' sin categoria' END, CASE WHEN undated > 0 THEN cast(undated AS varchar) || ' sin fecha' END, CASE WHEN unreconciled > 0 THEN cast(unreconciled AS varchar) || ' sin conciliar' END, CASE WHEN discrepancies > 0 THEN cast(discrepancies AS varchar) || ' con discrepancia' END) AS reasons FROM (
    SELECT count(*) FILTER (WHERE category IS NULL OR trim(category) = '') AS uncategorised, cast(coalesce(sum(total_amount) FILTER (WHERE category IS NULL OR trim(category) = ''), 0) AS decimal(18,2)) AS uncategorised_amount,
    count(*) FILTER (WHERE date_provisional) AS undated, cast(coalesce(sum(total_amount) FILTER (WHERE date_provisional), 0) AS decimal(18,2)) AS undated_amount,
    count(*) FILTER (WHERE coalesce(match_status, '') NOT IN ('PERFECT', 'MANUAL')) AS unreconciled, count(*) FILTER (WHERE match_status = 'DISCREPANCY') AS discrepancies, cast(coalesce(sum(total_amount) FILTER (WHERE match_status = 'DISCREPANCY'), 0) AS decimal(18,2)) AS discrepancies_amount
    FROM receipt AS r LEFT JOIN reconciliation AS m ON m.receipt_id = r.id WHERE {MARCH}) AS x""")
def a26(t: Tables):
    return close.pending_section(t.receipt, t.reconciliation, START, END)


@query("A28_period_states", f"""SELECT coalesce(o.company_id, c.company_id) AS company_id, coalesce(o.open, 0) AS open, CASE WHEN c.pending IS NOT NULL THEN CASE WHEN c.pending > 0 THEN 'CERRADO_CON_PENDIENTES' ELSE 'CERRADO' END WHEN coalesce(o.open, 0) > 0 THEN 'NO_CIERRA' ELSE 'CIERRE_DISPONIBLE' END AS state
    FROM (SELECT company_id, count(*) FILTER (WHERE category IS NULL OR trim(category) = '' OR date_provisional OR m.id IS NULL) AS open FROM receipt AS r LEFT JOIN reconciliation AS m ON m.receipt_id = r.id AND m.match_status IN ('PERFECT', 'MANUAL') WHERE {MARCH} GROUP BY 1) AS o
    FULL JOIN (SELECT company_id, pending FROM close WHERE period = '1998-03') AS c ON c.company_id = o.company_id""")
def a28(t: Tables):
    return close.states(t.receipt, t.reconciliation, t.close, START, END, date(1998, 4, 2))


def _section_sql(name: str, company: str) -> str:
    """A section's SQL for one company's month."""
    return ORACLE_SQL[name].removeprefix(prefix()).replace(MARCH, company).replace(WINTER, company)


#: The report's sections, their SQL and their columns.
SECTIONS = {
    "reconciliation": (_section_sql("A23_close_reconciliation", f"{MARCH} AND r.company_id = '7'"), "receipts perfect manual discrepancy discrepancy_amount paid_in_other_period paid_in_other_period_amount unreconciled"),
    "reading": (_section_sql("A24_close_reading", f"{MARCH} AND company_id = '7'"), "by_system verified open"),
    "verification": (_section_sql("A25_close_verification", f"{MARCH} AND company_id = '7'"), "sample reviewed pending reviewers last_review"),
    "pending": (_section_sql("A26_close_pending", f"{MARCH} AND company_id = '7'"), "uncategorised uncategorised_amount undated undated_amount unreconciled discrepancies discrepancies_amount unreconciled_amount has_pending reasons"),
}


@query("A29_close_report", f"SELECT '7' AS company_id, {', '.join(f'{s}.{c} AS {s}_{c}' for s, (_, names) in SECTIONS.items() for c in names.split())} FROM {', '.join(f'({sql}) AS {s}' for s, (sql, _) in SECTIONS.items())} WHERE EXISTS (SELECT 1 FROM receipt WHERE company_id = '7')")
def a29(t: Tables):
    report = close.report(t.receipt, t.reconciliation, t.bank, t.receipt, "7", START, END)
    return report.select("company_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s, (_, names) in SECTIONS.items() for c in names.split()])


@query("A30_statistics", f"SELECT count(*) AS months, round(median(x), 2) AS median, round(min(x), 2) AS low, round(max(x), 2) AS high, round(avg(x), 2) AS mean, CASE WHEN count(*) >= 3 AND avg(x) > 0 THEN round(stddev_samp(x) / avg(x), 2) END AS dispersion FROM (SELECT cast(amount AS double) AS x FROM ({TREND}) AS t WHERE amount >= 0) AS y")
def a30(t: Tables):
    return findings.statistics(dashboard.monthly_trend(t.receipt, AS_OF))


MONEY_SQL, OFF_SQL = "'$' || format('{:,.0f}', amount)", "format('{:,.0f}', abs(deviation) * 100) || '%' || CASE WHEN deviation > 0 THEN ' por encima' ELSE ' por debajo' END || ' de lo habitual'"


@query("A31_findings", f"""SELECT position, kind, month, amount, deviation, CASE kind WHEN 'insufficient_data' THEN 'Hacen falta 4 meses cerrados y hay ' || cast(cast(amount AS int) AS varchar) WHEN 'level' THEN 'alrededor de ' || {MONEY_SQL} || ' al mes'
    WHEN 'dispersion' THEN 'varia ' || format('{{:,.0f}}', amount * 100) || '% entre meses' ELSE {MONEY_SQL} || ', ' || {OFF_SQL} END AS text FROM (
  WITH t AS (SELECT month, cast(amount AS double) AS x, month = max(month) OVER () AS now FROM ({TREND}) AS q),
    s AS (SELECT count(*) AS n, round(median(x), 2) AS md, CASE WHEN count(*) >= 3 AND avg(x) > 0 THEN round(stddev_samp(x) / avg(x), 2) END AS cv FROM t WHERE NOT now AND x >= 0),
    d AS (SELECT month, x, now, n, CASE WHEN md <> 0 THEN (x - md) / md ELSE 0 END AS dev FROM t, s WHERE n >= 4),
    o AS (SELECT *, row_number() OVER (ORDER BY abs(dev) DESC, month) AS r FROM d WHERE NOT now AND abs(dev) > 0.5)
  SELECT cast(0 AS int) AS position, 'insufficient_data' AS kind, cast(NULL AS date) AS month, round(cast(n AS double), 2) AS amount, cast(NULL AS double) AS deviation FROM s WHERE n < 4
  UNION ALL SELECT 1, 'level', NULL, md, NULL FROM s WHERE n >= 4
  UNION ALL SELECT cast(1 + r AS int), 'outlier', month, round(x, 2), round(dev, 6) FROM o WHERE r <= 2
  UNION ALL SELECT 4, CASE WHEN abs(dev) > 0.5 THEN 'month_out_of_range' ELSE 'month_in_range' END, month, round(x, 2), round(dev, 6) FROM d WHERE now
  UNION ALL SELECT 5, 'unusual_base', month, round(x, 2), round(dev, 6) FROM d WHERE NOT now AND month = (SELECT max(month) FROM d WHERE NOT now) AND abs(dev) > 0.25 AND dev < 0
  UNION ALL SELECT 6, 'dispersion', NULL, cv, NULL FROM s WHERE n >= 4 AND cv >= 0.35) AS f""")
def a31(t: Tables):
    return findings.texts(findings.findings(dashboard.monthly_trend(t.receipt, AS_OF), change_to_date=12.0))


@query("W04_outliers", f"""SELECT month, round(cast(amount AS double), 2) AS amount FROM (SELECT *, row_number() OVER (ORDER BY abs(d) DESC, month) AS r FROM (SELECT month, amount, (cast(amount AS double) - md) / md AS d FROM ({TREND}) AS t, (SELECT round(median(cast(amount AS double)), 2) AS md FROM ({TREND}) AS u WHERE month < date '1998-03-01') AS v WHERE month < date '1998-03-01') AS w WHERE abs(d) > 0.5) AS z WHERE r <= 2""")
def w04(t: Tables):
    return findings.findings(dashboard.monthly_trend(t.receipt, AS_OF)).where("kind = 'outlier'").select("month", "amount")


@query("J07_audit_emails", "SELECT a.id, a.action, c.c_name AS email FROM audit AS a LEFT JOIN customer AS c ON c.c_custkey = a.user_id")
def j07(t: Tables):
    return queues.audit_log(t.audit, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))).select("id", "action", "email")


@query("J10_reconciliation_gaps", "SELECT m.id, match_status, total_amount, amount, cast(abs(abs(total_amount) - abs(amount)) AS decimal(18,2)) AS amount_gap, cast(abs(date_diff('day', transaction_date, expense_date)) AS int) AS days_gap FROM reconciliation AS m LEFT JOIN receipt AS r ON r.id = m.receipt_id LEFT JOIN bank AS b ON b.id = m.bank_id")
def j10(t: Tables):
    return queues.reconciliation_list(t.reconciliation, t.receipt, t.bank)


@query("J13_category_lookup", f"SELECT id, {KEY} AS category FROM receipt")
def j13(t: Tables):
    from ..functions.text import category_key

    return t.receipt.select("id", category_key(F.col("category")).alias("category"))


@query("J14_account_usage", "SELECT a.id, a.key, a.name, coalesce(n, 0) AS receipts FROM account AS a LEFT JOIN (SELECT account_id, count(*) AS n FROM receipt WHERE account_id IS NOT NULL GROUP BY 1) AS u ON u.account_id = a.id")
def j14(t: Tables):
    return queues.account_usage(t.account, t.receipt)


@query("J09_authorization_queue", "SELECT r.id, created_on, total_amount, a.key AS account_key FROM (SELECT * FROM receipt WHERE authorization_status = 'PENDIENTE' ORDER BY created_on DESC, id LIMIT 100) AS r LEFT JOIN account AS a ON a.id = r.account_id")
def j09(t: Tables):
    return queues.authorization_queue(t.receipt, t.account)


@query("A36_authorization_counts", "SELECT s.value, coalesce(n, 0) AS n FROM (SELECT unnest(['PENDIENTE', 'APROBADA', 'RECHAZADA']) AS value) AS s LEFT JOIN (SELECT authorization_status AS value, count(*) AS n FROM receipt GROUP BY 1) AS c ON c.value = s.value")
def a36(t: Tables):
    return dashboard.counts_by(t.receipt, "authorization_status", ("PENDIENTE", "APROBADA", "RECHAZADA"))


@query("A39_page_with_total", "SELECT id, action, (SELECT count(*) FROM audit WHERE module = 'module2') AS total_rows FROM audit WHERE module = 'module2' ORDER BY logged_on DESC, id LIMIT 30 OFFSET 10")
def a39(t: Tables):
    return queues.page_with_total(queues.audit_log(t.audit, module="module2"), [F.desc("logged_on"), F.col("id")], 30, 10).select("id", "action", "total_rows")


@query("A43_other_active_users", "SELECT count(*) AS others FROM customer WHERE c_custkey <> 5 AND c_acctbal > 0")
def a43(t: Tables):
    return queues.other_active_users(t.customer.select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_acctbal") > 0).alias("active")), "5")


@query("T01_newest_receipts", "SELECT id FROM receipt ORDER BY expense_date DESC, id LIMIT 25 OFFSET 5")
def t01(t: Tables):
    return queues.page(t.receipt, [F.desc("expense_date"), F.col("id")], 25, 5).select("id")


@query("T02_fifo_queue", "SELECT id FROM receipt WHERE spot_check_status = 'PENDIENTE' ORDER BY created_on, id LIMIT 30")
def t02(t: Tables):
    return queues.page(t.receipt.where("spot_check_status = 'PENDIENTE'"), [F.col("created_on"), F.col("id")], 30).select("id")


@query("T08_ring_buffer", "SELECT id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY logged_on DESC, id) AS n FROM audit) AS x WHERE n <= 3")
def t08(t: Tables):
    return queues.newest_per(t.audit, ["user_id"], [F.desc("logged_on"), F.col("id")], 3).select("id", "user_id")


@query("S12_current_documents", "SELECT receipt_id, id, version, versions FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY version DESC, id DESC) AS n, count(*) OVER (PARTITION BY receipt_id) AS versions FROM document_version) AS x WHERE n = 1")
def s12(t: Tables):
    return queues.current_documents(t.document_version).select("receipt_id", "id", "version", "versions")


@query("U01_distinct_reviewers", "SELECT DISTINCT spot_checked_by AS reviewer FROM receipt WHERE spot_checked_by IS NOT NULL")
def u01(t: Tables):
    return t.receipt.where("spot_checked_by is not null").select(F.col("spot_checked_by").alias("reviewer")).distinct()
