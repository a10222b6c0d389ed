"""Queries of scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..sources.views import Tables
from .registry import AS_OF, query

AMOUNT = "CASE k % 6 WHEN 0 THEN '$' || cast(total_amount AS string) WHEN 1 THEN '-1,234.56' WHEN 2 THEN '1.234,5' WHEN 3 THEN '12,345' WHEN 4 THEN 'MXN ' || cast(k AS string) ELSE 'n/a' END"


@query("F01_S06_amounts", "SELECT id, cast(CASE k % 6 WHEN 0 THEN total_amount WHEN 1 THEN -1234.56 WHEN 2 THEN 1234.5 WHEN 3 THEN 12345 WHEN 4 THEN k END AS decimal(18,4)) AS amount FROM receipt")
def f01(t: Tables):
    return t.receipt.select("id", money.parse_amount(F.expr(AMOUNT)).alias("amount"))


@query("F02_receipt_numbers", "SELECT id, cast(CASE k % 4 WHEN 0 THEN total_amount WHEN 1 THEN 1234.56 WHEN 2 THEN 1234.56 ELSE 12.5 END AS decimal(12,2)) AS amount FROM receipt")
def f02(t: Tables):
    raw = F.expr("CASE k % 4 WHEN 0 THEN cast(total_amount AS string) WHEN 1 THEN '1,234.56' WHEN 2 THEN '1.234,56' ELSE '12,5' END")
    return t.receipt.select("id", money.receipt_number(raw).alias("amount"))


@query("F03_comparable", "SELECT doc_id, trim(regexp_replace(upper(replace(strip_accents(coalesce(text, '')), 'ß', 'ss')), '[^A-Z0-9]+', ' ', 'g')) AS s FROM documents")
def f03(t: Tables):
    return t.documents.select("doc_id", text.comparable(F.col("text")).alias("s"))


@query("F04_category_keys", "SELECT id, CASE WHEN coalesce(trim(category), '') = '' THEN 'SIN_CLASIFICAR' ELSE strip_accents(upper(trim(category))) END AS key FROM receipt")
def f04(t: Tables):
    return t.receipt.select("id", text.category_key(F.col("category")).alias("key"))


@query("F05_category_labels", "SELECT DISTINCT category AS key, CASE category WHEN 'RENTA' THEN 'Renta' ELSE upper(substr(category, 1, 1)) || lower(replace(substr(category, 2), '_', ' ')) END AS label, category <> 'RENTA' AS varies FROM receipt WHERE trim(category) <> ''")
def f05(t: Tables):
    key = F.col("key")
    return t.receipt.where("trim(category) <> ''").select(F.col("category").alias("key")).distinct().select("key", text.category_label(key).alias("label"), text.category_varies(key).alias("varies"))


@query("F06_month_names", "SELECT id, ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(expense_date)] AS name, ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(expense_date)] AS short FROM receipt")
def f06(t: Tables):
    d = F.col("expense_date")
    return t.receipt.select("id", dates.month_names(d).alias("name"), dates.month_names(d, short=True).alias("short"))


@query("F07_days_in_month", "SELECT id, cast(day(last_day(expense_date)) AS int) AS days FROM receipt")
def f07(t: Tables):
    return t.receipt.select("id", dates.days_in_month(F.col("expense_date")).alias("days"))


@query("F08_age_days", "SELECT event_id, round((epoch_us(timestamp '2024-02-01') - epoch_us(ts)) / 86400000000.0, 6) AS age FROM events")
def f08(t: Tables):
    return t.events.select("event_id", F.round(dates.age_days(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")), 6).alias("age"))


@query("F09_pct_change", "SELECT r.id, round(CASE WHEN b.amount <> 0 THEN (cast(total_amount AS double) - cast(b.amount AS double)) / cast(b.amount AS double) * 100 END, 6) AS pct FROM receipt AS r JOIN bank AS b ON b.k = r.k")
def f09(t: Tables):
    rows = t.receipt.select("id", "k", "total_amount").join(t.bank.select("k", "amount"), "k")
    return rows.select("id", F.round(money.pct_change(F.col("total_amount"), F.col("amount")), 6).alias("pct"))


@query("F10_money_text", "SELECT id, CASE WHEN subtotal IS NULL THEN 'no disponible' ELSE '$' || format('{:,.2f}', cast(subtotal AS double)) END AS s FROM receipt")
def f10(t: Tables):
    return t.receipt.select("id", money.money_text(F.col("subtotal")).alias("s"))


@query("F11_latin1", "SELECT doc_id, regexp_replace(replace(replace(translate(text, '–—‘’“”•', '--''''\"\"*'), '…', '...'), '€', 'EUR'), '[^\\x{00}-\\x{FF}]', '?', 'g') AS s FROM documents")
def f11(t: Tables):
    return t.documents.select("doc_id", text.latin1(F.col("text")).alias("s"))


@query("F12_digests", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def f12(t: Tables):
    return t.documents.where("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("F13_formula_guard", "SELECT conv_id, turn, CASE WHEN regexp_matches(s, '^\\s*[=+\\-@\\t\\r]') THEN '''' || s ELSE s END AS s FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '=' || role WHEN 1 THEN ' -' || role ELSE role END AS s FROM conversations) AS x")
def f13(t: Tables):
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("="), "role")).when(F.col("turn") % 3 == 1, F.concat(F.lit(" -"), "role")).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", text.formula_guard(raw).alias("s"))


@query("F14_tax_ids", "SELECT id, CASE WHEN provider_tax_id IS NOT NULL AND provider_tax_id <> 'BAD-ID' THEN provider_tax_id END AS found FROM receipt")
def f14(t: Tables):
    raw = F.concat(F.lit("rfc: "), F.regexp_replace("provider_tax_id", r"^(ABC)(\d{6})", "$1-$2 "), F.lit(" ."))
    return t.receipt.select("id", text.tax_id(raw).alias("found"))


@query("F15_legal_suffix", "SELECT id, provider_name AS name FROM receipt")
def f15(t: Tables):
    raw = F.concat("provider_name", F.expr("CASE k % 4 WHEN 0 THEN ', S.A. de C.V.' WHEN 1 THEN ' SA DE CV' WHEN 2 THEN ' S. de R.L. de C.V.' ELSE '' END"))
    return t.receipt.select("id", text.without_legal_suffix(raw).alias("name"))


@query("F16_F17_details_json", "SELECT id, '{\"action\":\"' || action || '\",\"amount\":\"' || cast(cast(user_id / 4 AS decimal(12,2)) AS varchar) || '\"}' AS details FROM audit")
def f17(t: Tables):
    return t.audit.select("id", F.to_json(F.struct("action", (F.col("user_id") / 4).cast("decimal(12,2)").cast("string").alias("amount"))).alias("details"))


@query("F18_date_format", "SELECT id, strftime(expense_date, '%d/%m/%Y') AS s FROM receipt")
def f18(t: Tables):
    return t.receipt.select("id", F.date_format("expense_date", "dd/MM/yyyy").alias("s"))


@query("F19_periods", "SELECT company_id, period, CASE WHEN regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2])') THEN cast(period || '-01' AS date) END AS first, CASE WHEN regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2])') THEN last_day(cast(period || '-01' AS date)) END AS last FROM (SELECT company_id, CASE WHEN company_id = '3' THEN '1998-13' ELSE period END AS period FROM close) AS c")
def f19(t: Tables):
    rows = t.close.select("company_id", F.when(F.col("company_id") == "3", "1998-13").otherwise(F.col("period")).alias("period"))
    first = dates.period_start(F.col("period"))
    return rows.select("company_id", "period", first.alias("first"), F.last_day(first).alias("last"))


@query("F20_file_names", "SELECT id, trim(regexp_replace(lower(strip_accents(provider_name || '_' || strftime(expense_date, '%Y-%m'))), '[^a-z0-9._-]+', '_', 'g'), '_') || '.pdf' AS name FROM receipt")
def f20(t: Tables):
    return t.receipt.select("id", text.file_name(F.col("provider_name"), F.date_format("expense_date", "yyyy-MM"), extension="pdf").alias("name"))


@query("V04_shifted_years", "SELECT id, cast(expense_date - interval 3 year AS date) AS d FROM receipt")
def v04(t: Tables):
    return t.receipt.select("id", dates.shift_years(F.col("expense_date"), -3).alias("d"))


@query("A27_cut_day", "SELECT DISTINCT expense_date, least(day(date '1998-03-17'), day(last_day(cast(date_trunc('month', expense_date) - interval 1 day AS date)))) AS day FROM receipt")
def a27(t: Tables):
    return t.receipt.select("expense_date").distinct().select("expense_date", F.least(F.dayofmonth(F.lit(AS_OF)), dates.days_in_month(F.add_months(F.trunc("expense_date", "month"), -1))).cast("long").alias("day"))
