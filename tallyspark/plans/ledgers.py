"""Queries of the scan ledger, integrity rules, transitions and the limiter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, queues, scan_run, scans, transitions
from ..sources.views import Tables
from ..streaming import limiter
from .registry import AS_OF, query
from .shared_sql import FAILURES


@query("A33_scan_stats", """SELECT count(*) AS files, cast(sum(attempts) AS bigint) AS attempts, count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE status = 'PROCESADO') AS processed, count(*) FILTER (WHERE status = 'DUPLICADO') AS duplicates, count(*) FILTER (WHERE status IN ('PENDIENTE', 'ERROR')) AS open,
    count(*) FILTER (WHERE last_error LIKE '%sobreescribe%') AS stale, count(receipt_id) AS linked, count(*) FILTER (WHERE receipt_id IS NULL) AS unlinked, max(scanned_on) FILTER (WHERE status = 'PROCESADO') AS newest FROM scan_file""")
def a33(t: Tables):
    return queues.scan_stats(t.scan_file)


@query("J08_files_with_receipts", "SELECT path, status, f.receipt_id, provider_name, expense_date, total_amount FROM scan_file AS f LEFT JOIN receipt AS r ON r.id = f.receipt_id")
def j08(t: Tables):
    return queues.scan_files_with_receipts(t.scan_file, t.receipt)


@query("T07_scan_listing", "SELECT path, status FROM scan_file ORDER BY path LIMIT 40 OFFSET 15")
def t07(t: Tables):
    return queues.page(t.scan_file, [F.col("path")], 40, 15).select("path", "status")


@query("J11_duplicate_files", "SELECT path, sibling FROM (SELECT l.path, (SELECT min(f.path) FROM scan_file AS f WHERE f.content_hash = l.content_hash AND f.path <> l.path AND f.status = 'PROCESADO' AND f.receipt_id IS NOT NULL) AS sibling FROM scan_listing AS l) AS x WHERE sibling IS NOT NULL")
def j11(t: Tables):
    return scans.duplicates_of(t.scan_listing, t.scan_file)


@query("K01_scan_actions", """SELECT coalesce(l.path, f.path) AS path, CASE WHEN l.path IS NULL THEN 'MISSING' WHEN f.path IS NULL THEN CASE WHEN (SELECT min(g.path) FROM scan_file AS g WHERE g.content_hash = l.content_hash AND g.path <> l.path AND g.status = 'PROCESADO' AND g.receipt_id IS NOT NULL) IS NOT NULL THEN 'DUPLICATE' ELSE 'NEW' END
    WHEN f.status IN ('PENDIENTE', 'ERROR') THEN 'REPROCESS' WHEN l.content_hash = f.content_hash THEN 'UNCHANGED' ELSE 'CHANGED' END AS action FROM scan_listing AS l FULL JOIN scan_file AS f ON f.path = l.path""")
def k01(t: Tables):
    return scans.scan_actions(t.scan_listing, t.scan_file).select("path", "action")


RUN = """(SELECT path, content_hash, action, status, CASE WHEN action = 'CREADO' THEN substr(sha256('co|' || path || '|' || content_hash), 1, 32) WHEN status IN ('ERROR', 'DUPLICADO', 'NO_SOPORTADO') THEN NULL ELSE old_receipt END AS receipt_id, old_receipt, extraction_status
  FROM (SELECT *, CASE WHEN quiet AND same THEN 'SIN_CAMBIOS' WHEN quiet OR unsupported THEN 'OMITIDO' WHEN failed THEN 'ERROR' WHEN fresh AND twin THEN 'OMITIDO' WHEN rid IS NULL THEN 'CREADO' WHEN reviewed THEN 'OMITIDO' ELSE 'ACTUALIZADO' END AS action,
      CASE WHEN quiet THEN old_status WHEN unsupported THEN 'NO_SOPORTADO' WHEN failed THEN 'ERROR' WHEN fresh AND twin THEN 'DUPLICADO' ELSE 'PROCESADO' END AS status
    FROM (SELECT l.path, l.content_hash, f.receipt_id AS old_receipt, f.status AS old_status, l.k % 11 = 5 AS unsupported, l.k % 13 = 6 AS failed, f.path IS NULL AS fresh, f.content_hash = l.content_hash AS same, r.id AS rid, r.k % 4 = 0 AS reviewed, r.extraction_status,
        f.path IS NOT NULL AND f.status NOT IN ('PENDIENTE', 'ERROR') AND f.receipt_id IS NOT NULL AS quiet,
        EXISTS (SELECT 1 FROM scan_file AS g WHERE g.content_hash = l.content_hash AND g.path <> l.path AND g.status = 'PROCESADO' AND g.receipt_id IS NOT NULL) AS twin
      FROM scan_listing AS l LEFT JOIN scan_file AS f ON f.path = l.path LEFT JOIN receipt AS r ON r.id = f.receipt_id) AS x) AS y)"""
RETIRED = f"""(SELECT y.path, y.content_hash, action, status, y.receipt_id, CASE WHEN y.receipt_id IS NULL THEN NULL WHEN action = 'CREADO' OR coalesce(extraction_status NOT IN ('AUTO_APROBADO', 'APROBADO'), true) THEN 'BANDEJA' WHEN d.sha256 = y.content_hash THEN 'RETIRADO' ELSE 'SIN_RESPALDO' END AS retire
  FROM {RUN} AS y LEFT JOIN (SELECT receipt_id, arg_max(content_hash, k) AS sha256 FROM scan_file GROUP BY 1) AS d ON d.receipt_id = y.old_receipt)"""


def _run(t: Tables):
    found = t.scan_listing.select("path", "content_hash", F.when(F.col("k") % 11 == 5, "unknown").otherwise("pdf").alias("file_type"), (F.col("k") % 13 == 6).alias("failed"))
    receipts = t.receipt.select("id", "extraction_status", (F.col("k") % 4 == 0).alias("reviewed"))
    documents = t.scan_file.select("receipt_id", F.col("k").alias("version"), F.col("content_hash").alias("sha256"))
    return found, scan_run.run_details(found, t.scan_file, receipts, documents, "co", cap=None)


@query("K02_scan_run", f"SELECT * FROM {RETIRED} AS z")
def k02(t: Tables):
    return _run(t)[1]


@query("K02_run_totals", f"""SELECT (SELECT count(*) FROM scan_listing) AS seen, cast(0 AS bigint) AS waiting, count(*) FILTER (WHERE action = 'CREADO') AS created, count(*) FILTER (WHERE action = 'ACTUALIZADO') AS updated, count(*) FILTER (WHERE action = 'SIN_CAMBIOS') AS unchanged, count(*) FILTER (WHERE action = 'OMITIDO' AND status = 'DUPLICADO') AS duplicates,
    count(*) FILTER (WHERE action = 'OMITIDO' AND status = 'NO_SOPORTADO') AS unsupported, count(*) FILTER (WHERE action = 'ERROR') AS failed, count(*) FILTER (WHERE retire = 'BANDEJA') AS in_tray, count(*) FILTER (WHERE retire = 'RETIRADO') AS retired FROM {RETIRED} AS z""")
def k02_totals(t: Tables):
    found, details = _run(t)
    return scan_run.run_totals(found, details, None)


@query("K03_retirable", """SELECT l.path, min(d.receipt_id) AS receipt_id FROM scan_listing AS l JOIN (SELECT receipt_id, arg_max(sha256, version) AS content_hash FROM (SELECT k % 60 + 32 AS receipt_id, content_hash AS sha256, k AS version FROM scan_file) AS v GROUP BY 1) AS d ON d.content_hash = l.content_hash
    JOIN receipt AS r ON r.k = d.receipt_id AND r.extraction_status IN ('AUTO_APROBADO', 'APROBADO') GROUP BY 1""")
def k03(t: Tables):
    documents = t.scan_file.select((F.col("k") % 60 + 32).alias("receipt_id"), F.col("content_hash").alias("sha256"), F.col("k").alias("version"))
    receipts = t.receipt.select(F.col("k").alias("id"), "extraction_status")
    return scans.retirable(t.scan_listing, documents, receipts)


@query("K05_event_log", "SELECT path, action, 'scanner' AS actor, date '1998-03-17' AS logged_on FROM scan_detail")
def k05(t: Tables):
    return scans.event_log(t.scan_detail, "scanner", AS_OF)


FIRST = "(SELECT r.* FROM receipt AS r JOIN (SELECT DISTINCT receipt_id FROM scan_detail WHERE receipt_id IS NOT NULL) AS d ON d.receipt_id = r.id)"


@query("A34_run_summary", f"""SELECT *, to_review + failed + unsupported + without_receipt AS needs_action FROM (SELECT count(*) AS seen, count(*) FILTER (WHERE action = 'CREADO') AS created, count(*) FILTER (WHERE action = 'ACTUALIZADO') AS updated, count(*) FILTER (WHERE action = 'SIN_CAMBIOS') AS unchanged, count(*) FILTER (WHERE action = 'ERROR') AS failed,
    count(*) FILTER (WHERE status = 'DUPLICADO') AS duplicates, count(*) FILTER (WHERE status = 'NO_SOPORTADO') AS unsupported, count(*) FILTER (WHERE receipt_id IS NULL) AS without_receipt FROM scan_detail) AS a,
    (SELECT cast(sum(total_amount) AS decimal(18,2)) AS read_amount, cast(CASE WHEN count(*) > 0 THEN coalesce(sum(total_amount) FILTER (WHERE extraction_status = 'AUTO_APROBADO'), 0) END AS decimal(18,2)) AS trusted_amount, cast(CASE WHEN count(*) > 0 THEN coalesce(sum(total_amount) FILTER (WHERE extraction_status IN ('PENDIENTE', 'REQUIERE_REVISION')), 0) END AS decimal(18,2)) AS review_amount,
    count(*) FILTER (WHERE total_amount > 0) AS with_total, count(*) FILTER (WHERE NOT coalesce(total_amount > 0, false)) AS without_total, count(*) FILTER (WHERE coalesce(provider_tax_id, '') <> '') AS with_tax_id, count(*) FILTER (WHERE extraction_status IN ('PENDIENTE', 'REQUIERE_REVISION')) AS to_review FROM {FIRST} AS f) AS b""")
def a34(t: Tables):
    return scans.run_summary(t.scan_detail, t.receipt)


@query("A35_readings_per_engine", f"SELECT confidence_source, count(*) AS n FROM {FIRST} AS f WHERE confidence_source IS NOT NULL GROUP BY 1")
def a35(t: Tables):
    return scans.readings_per_engine(t.scan_detail, t.receipt)


@query("A37_U02_reset_counts", "SELECT 'receipts' AS entity, count(*) AS rows, count(*) FILTER (WHERE extraction_status = 'APROBADO') AS human_rows FROM receipt UNION ALL SELECT 'movements', count(*), 0 FROM bank UNION ALL SELECT 'reconciliations', count(*), count(reviewed_by) FROM reconciliation UNION ALL SELECT 'files', count(*), 0 FROM scan_file")
def a37(t: Tables):
    return scans.reset_counts({"receipts": t.receipt, "movements": t.bank, "reconciliations": t.reconciliation, "files": t.scan_file}, {"receipts": "extraction_status = 'APROBADO'", "reconciliations": "reviewed_by is not null"})


def _violations_sql(table: str, key: str, rules: dict[str, str]) -> str:
    import re

    plain = lambda c: re.sub(r"(\w+) rlike r'([^']*)'", lambda m: f"regexp_full_match({m[1]}, '{m[2].lstrip('^').removesuffix(chr(92) + 'z')}')", c)
    return " UNION ALL ".join(f"SELECT cast({key} AS varchar) AS key, '{name}' AS rule FROM {table} WHERE NOT ({plain(c)})" for name, c in rules.items())


def _rules(name: str, table: str, key: str, rules: dict[str, str], view: str | None = None):
    sql = _violations_sql(view or table, key, rules)

    @query(name, sql)
    def check(t: Tables):
        rows = getattr(t, table)
        return integrity.violations(rows, key, rules)




@query("C01_receipt_rules", _violations_sql("(SELECT *, 'APROBADO' AS extraction_status FROM draft)", "id", integrity.RECEIPT_RULES))
def c01(t: Tables):
    return integrity.violations(t.draft.withColumn("extraction_status", F.lit("APROBADO")), "id", integrity.RECEIPT_RULES)


@query("C02_spot_check_rules", _violations_sql("(SELECT * REPLACE (CASE WHEN k % 3 = 1 THEN 'APROBADO' ELSE extraction_status END AS extraction_status) FROM receipt)", "id", integrity.SPOT_CHECK_RULES))
def c02(t: Tables):
    return integrity.violations(t.receipt.withColumn("extraction_status", F.when(F.col("k") % 3 == 1, "APROBADO").otherwise(F.col("extraction_status"))), "id", integrity.SPOT_CHECK_RULES)


_rules("C03_reconciliation_rules", "reconciliation", "id", integrity.RECONCILIATION_RULES)
_rules("C04_scan_rules", "scan_file", "path", integrity.SCAN_RULES)
_rules("C05_document_rules", "document_version", "id", integrity.DOCUMENT_RULES)
_rules("C06_close_rules", "close", "company_id", integrity.CLOSE_RULES)
_rules("C07_product_rules", "product", "id", integrity.PRODUCT_RULES)
_rules("C08_purchase_rules", "purchase", "id", integrity.PURCHASE_RULES)
_rules("C08_line_rules", "purchase_line", "id", integrity.LINE_RULES)
_rules("C09_ledger_rules", "ledger", "id", integrity.LEDGER_RULES)
_rules("C10_account_rules", "account", "id", integrity.ACCOUNT_RULES)


@query("C04_duplicate_paths", "SELECT path, count(*) AS n FROM (SELECT path FROM scan_listing UNION ALL SELECT path FROM scan_file) AS x GROUP BY 1 HAVING count(*) > 1")
def c04(t: Tables):
    return integrity.duplicates(t.scan_listing.select("path").unionByName(t.scan_file.select("path")), ["path"])


@query("C05_document_forks", "SELECT replaces, count(*) AS n FROM (SELECT replaces FROM document_version UNION ALL SELECT replaces FROM document_version WHERE version = 3) AS x WHERE replaces IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def c05(t: Tables):
    return integrity.duplicates(t.document_version.select("replaces").unionByName(t.document_version.where("version = 3").select("replaces")), ["replaces"])


@query("C06_duplicate_closes", "SELECT period, digest, count(*) AS n FROM close WHERE digest IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def c06(t: Tables):
    return integrity.duplicates(t.close, ["period", "digest"])


@query("C07_duplicate_codes", "SELECT company_id, code, count(*) AS n FROM product WHERE code IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def c07(t: Tables):
    return integrity.duplicates(t.product, ["company_id", "code"])


@query("C10_authorization_rules", _violations_sql("(SELECT *, CASE WHEN k % 8 = 3 THEN ' ' ELSE 'late' END AS rejection_reason FROM receipt)", "id", integrity.AUTHORIZATION_RULES))
def c10(t: Tables):
    return integrity.violations(t.receipt.withColumn("rejection_reason", F.when(F.col("k") % 8 == 3, " ").otherwise("late")), "id", integrity.AUTHORIZATION_RULES)


@query("C12_backfilled_status", """SELECT id, CASE WHEN coalesce(total_amount, 0) <= 0 OR coalesce(provider_name, '') IN ('', 'Unknown Provider') THEN 'PENDIENTE' WHEN trim(coalesce(category, '')) = '' THEN 'REQUIERE_REVISION' ELSE 'APROBADO' END AS status,
    nullif(concat_ws('; ', CASE WHEN coalesce(total_amount, 0) <= 0 THEN 'total_not_positive' END, CASE WHEN coalesce(provider_name, '') IN ('', 'Unknown Provider') THEN 'provider_missing' END, CASE WHEN trim(coalesce(category, '')) = '' THEN 'category_missing' END), '') AS reasons FROM receipt""")
def c12(t: Tables):
    return integrity.backfilled_status(t.receipt)


def _seq(rows, **columns):
    return rows.select(F.col("k").alias("seq"), "id", *[F.expr(c).alias(n) for n, c in columns.items()])


@query("V20_reviewed", f"""SELECT id, CASE WHEN NOT ok THEN extraction_status WHEN action = 'approve' THEN 'APROBADO' WHEN action = 'reject' THEN 'RECHAZADO' ELSE 'REQUIERE_REVISION' END AS extraction_status, CASE WHEN ok OR action IS NULL THEN provider_name ELSE was END AS provider_name,
    CASE WHEN ok OR action IS NULL THEN date_provisional ELSE was_provisional END AS date_provisional, CASE WHEN ok AND (moved OR extraction_status <> CASE action WHEN 'approve' THEN 'APROBADO' WHEN 'reject' THEN 'RECHAZADO' ELSE 'REQUIERE_REVISION' END) THEN 'user1' END AS reviewed_by
  FROM (SELECT *, action IS NOT NULL AND extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE') AND NOT (action = 'approve' AND len({FAILURES}) > 0) AS ok
    FROM (SELECT id, extraction_status, total_amount, tax_amount, subtotal, excise_amount, provider_tax_id, action, provider_name AS was, date_provisional AS was_provisional, CASE WHEN action IS NOT NULL AND k % 31 = 0 THEN 'Known' ELSE provider_name END AS provider_name,
        CASE WHEN action IS NOT NULL AND k % 17 = 0 THEN date '1998-03-01' ELSE expense_date END AS expense_date, date_provisional AND NOT (action IS NOT NULL AND k % 17 = 0) AS date_provisional, action IS NOT NULL AND (k % 31 = 0 OR (k % 17 = 0 AND expense_date <> date '1998-03-01')) AS moved
      FROM (SELECT *, CASE WHEN k % 3 = 1 THEN CASE k % 9 WHEN 1 THEN 'approve' WHEN 4 THEN 'reject' ELSE 'request_info' END END AS action FROM receipt) AS a) AS f) AS g""")
def v20(t: Tables):
    actions = _seq(t.receipt.where("k % 3 = 1"), action="case k % 9 when 1 then 'approve' when 4 then 'reject' else 'request_info' end", actor="'user1'", total_amount="cast(null as decimal(12,2))", provider_name="case when k % 31 = 0 then 'Known' end", expense_date="case when k % 17 = 0 then date '1998-03-01' end")
    return transitions.review(t.receipt, actions, AS_OF)[0].select("id", "extraction_status", "provider_name", "date_provisional", "reviewed_by")


@query("V21_edited", "SELECT id, cast(CASE WHEN k % 4 = 2 THEN total_amount + 1 ELSE total_amount END AS decimal(12,2)) AS total_amount, CASE WHEN k % 4 = 2 AND extraction_status IN ('REQUIERE_REVISION', 'PENDIENTE') THEN NULL ELSE confidence END AS confidence FROM receipt")
def v21(t: Tables):
    changes = _seq(t.receipt.where("k % 4 = 2"), total_amount="cast(total_amount + 1 as decimal(12,2))", provider_name="cast(null as string)", expense_date="cast(null as date)")
    return transitions.edit(t.receipt, changes, AS_OF).select("id", F.col("total_amount").cast("decimal(12,2)").alias("total_amount"), "confidence")


@query("V22_spot_checked", "SELECT id, CASE WHEN k % 8 = 4 AND spot_check_status IS NOT NULL AND extraction_status = 'AUTO_APROBADO' AND (k % 3 <> 1 OR k % 5 <> 0) THEN CASE WHEN k % 3 = 1 THEN 'INCORRECTO' ELSE 'CORRECTO' END ELSE spot_check_status END AS spot_check_status FROM receipt")
def v22(t: Tables):
    verdicts = _seq(t.receipt.where("k % 8 = 4"), verdict="case when k % 3 = 1 then 'INCORRECTO' else 'CORRECTO' end", fields="case when k % 5 <> 0 then 'total_amount' end", actor="'user2'")
    return transitions.spot_check(t.receipt, verdicts)[0].select("id", "spot_check_status")


@query("V23_U03_categorised", "SELECT id, CASE WHEN k % 50 = 1 THEN 'OTROS' WHEN k % 50 = 2 THEN NULL ELSE category END AS category FROM receipt")
def v23(t: Tables):
    changes = _seq(t.receipt.where("k % 50 in (1, 2)"), category="case when k % 50 = 1 then 'OTROS' else ' ' end")
    return transitions.categorise(t.receipt, changes.unionByName(changes.withColumns({"seq": F.col("seq") + 1_000_000_000, "category": F.lit("LATER")})))[0].select("id", "category")


@query("Z01_authorized", "SELECT id, CASE WHEN authorization_status = 'PENDIENTE' AND k % 6 = 1 THEN 'APROBADA' WHEN authorization_status = 'PENDIENTE' AND k % 6 = 2 AND k % 5 <> 0 THEN 'RECHAZADA' ELSE authorization_status END AS authorization_status FROM receipt")
def z01(t: Tables):
    actions = _seq(t.receipt.where("k % 6 in (1, 2)"), action="case k % 6 when 1 then 'approve' else 'reject' end", actor="'user3'", reason="case when k % 5 <> 0 then 'too high' else ' ' end")
    return transitions.authorize(t.receipt, actions)[0].select("id", "authorization_status")


@query("Z02_seeded_accounts", "SELECT cast(n_nationkey AS varchar) AS company_id, upper(replace(n_name, ' ', '_')) AS key FROM nation WHERE n_nationkey % 4 <> 0")
def z02(t: Tables):
    every = t.nation.select(F.col("n_nationkey").cast("string").alias("company_id"), F.upper(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("key"), "n_nationkey")
    return transitions.seeded(every.where("n_nationkey % 4 = 0"), every.select("company_id", "key"))


@query("Z03_assigned_accounts", "SELECT r.id, CASE WHEN r.k % 10 = 3 THEN 'acc2' ELSE r.account_id END AS account_id, CASE WHEN r.k % 10 = 3 THEN (SELECT key FROM account WHERE id = 'acc2') ELSE r.category END AS category FROM receipt AS r")
def z03(t: Tables):
    assignments = _seq(t.receipt.where("k % 5 = 3"), account_id="case when k % 10 = 3 then 'acc2' else 'none' end")
    return transitions.assign_accounts(t.receipt, assignments, t.account).select("id", "account_id", "category")


@query("Z04_product_guards", "SELECT c.id, CASE WHEN c.code IS NOT NULL AND EXISTS (SELECT 1 FROM product AS p WHERE p.company_id = c.company_id AND p.code = c.code AND p.id <> c.id) THEN 'code taken' WHEN c.origin = 'OCR' AND c.code IS NULL AND c.verified THEN 'unverifiable' END AS reason FROM product AS c")
def z04(t: Tables):
    return transitions.product_guards(t.product, t.product.select("id", "company_id", "code", "origin", "verified"))


def _attempts(t: Tables):
    return t.events.select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("email"), F.lit("ip").alias("ip"), F.timestamp_micros(1_704_067_200_000_000 + F.col("event_id") * 4_000_000).alias("ts"), (F.col("event_type") == "purchase").alias("success"))


@query("R01_login_limiter", """SELECT key, ts, success, blocked, blocks FROM (WITH RECURSIVE a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, success) AS k
      FROM (SELECT 'u' || cast(user_id % 40 AS varchar) || '|ip' AS key, cast(1704067200 + event_id * 4 AS double) AS ts, event_type = 'purchase' AS success FROM events) AS e),
    turn AS (SELECT DISTINCT key, cast(0 AS bigint) AS k, cast([] AS double[]) AS failures, cast(0 AS double) AS until, cast(0 AS double) AS ts, false AS success, false AS blocked, false AS blocks FROM a
      UNION ALL SELECT key, k, CASE WHEN blocked THEN failures WHEN success OR blocks THEN cast([] AS double[]) ELSE recent END, CASE WHEN blocked THEN until WHEN success THEN 0 WHEN blocks THEN ts + 60 ELSE until END, ts, success, blocked, blocks
      FROM (SELECT *, NOT blocked AND NOT success AND len(recent) >= 5 AS blocks
        FROM (SELECT a.key, a.k, a.ts, a.success, t.failures, t.until, a.ts < t.until AS blocked, list_append(list_filter(t.failures, lambda x: x > a.ts - 60), a.ts) AS recent FROM turn AS t JOIN a ON a.key = t.key AND a.k = t.k + 1) AS r) AS n)
  SELECT * FROM turn WHERE k > 0) AS x""")
def r01(t: Tables):
    return limiter.blocked_attempts(_attempts(t))


@query("R02_failure_bursts", """SELECT key, ts, n FROM (SELECT 'u' || cast(user_id % 40 AS varchar) || '|ip' AS key, cast(1704067200 + event_id * 4 AS double) AS ts, count(*) OVER (PARTITION BY user_id % 40 ORDER BY event_id * 4 RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type <> 'purchase') AS x WHERE n >= 5""")
def r02(t: Tables):
    return limiter.bursts(_attempts(t))


@query("T04_event_history", "SELECT d.path, row_number() OVER (PARTITION BY d.path ORDER BY scanned_on, action, seq) AS n, scanned_on AS happened_on, action FROM scan_detail AS d JOIN scan_file AS f ON f.k = d.seq AND f.path = d.path WHERE d.status = 'PROCESADO'")
def t04(t: Tables):
    times = t.scan_file.select(F.col("k").alias("seq"), "path", F.col("scanned_on").alias("happened_on"))
    return scans.event_history(t.scan_detail.where("status = 'PROCESADO'").join(times, ["seq", "path"])).select("path", "n", "happened_on", "action")


@query("J16_reconciled_receipts", "SELECT id FROM receipt AS r WHERE EXISTS (SELECT 1 FROM reconciliation AS m WHERE m.receipt_id = r.id AND m.match_status = 'MANUAL')")
def j16(t: Tables):
    return t.receipt.join(t.reconciliation.where("match_status = 'MANUAL'").select(F.col("receipt_id").alias("id")), "id", "left_semi").select("id")
