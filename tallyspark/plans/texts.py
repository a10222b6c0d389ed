"""Queries of file types, receipt texts and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import gate, receipt_text
from ..sources.views import Tables
from .registry import query

RAW = "CASE page_id % 6 WHEN 0 THEN '%PDF-1.7' || html WHEN 1 THEN '<?xml version=\"1.0\"?>' || html WHEN 2 THEN ' <?xml' || html WHEN 3 THEN 'GIF89a' || html WHEN 4 THEN 'BM' || html ELSE html END"


@query("S09_file_types", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xml' WHEN 2 THEN 'xml' WHEN 3 THEN 'image' WHEN 4 THEN 'image' ELSE 'unknown' END AS kind FROM pages")
def s09(t: Tables):
    return t.pages.select("page_id", text.magic_type(F.expr(RAW).cast("binary")).alias("kind"))


@query("S10_plain_text", "SELECT page_id, page_id % 4 <> 1 AND coalesce(html, '') <> '' AS plain FROM pages")
def s10(t: Tables):
    content = F.concat(F.when(F.col("page_id") % 4 == 1, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary")), F.coalesce("html", F.lit("")).cast("binary"))
    return t.pages.select("page_id", text.is_plain_text(content).alias("plain"))


@query("V08_capped_text", "SELECT doc_id, CASE WHEN length(text) > 20000 THEN substr(text, 1, 12000) || chr(10) || '[...]' || chr(10) || substr(text, length(text) - 7999) ELSE text END AS s FROM documents")
def v08(t: Tables):
    return t.documents.select("doc_id", text.capped_text(F.col("text")).alias("s"))


#: Names as a scanner gives them, and whether they are implausible.
NAMES = (
    ("Supermercado del Norte", False), ("CALLE 5", True), ("", True), ("TICKET DE VENTA", True), ("ab cd", True), ("Unknown Provider", True), ("TIENDA 55", True), ("CANT. TOTAL", True), ("Y ARTICULO TOT", True), ("gt Edson Nte hunera 1235", True),
    ("PRUNE MIEN FIC 104 Py LEN As", True), ("7 Eleven", False), ("La Comer", False), ("Total Fitness", False), ("Ticketmaster", False), ("OXXO SA DE CV", False), ("OXXO S.A. DE C.V.", False), ("AAA AI", True), ("UN POLE Tag mA ee ki m", True),
    ("Taqueria La Esquina", False), ("PAPELERIA Y SUMINISTROS CENTRAL SA DE CV", False), ("ai_disabled", True), ("3M", True), ("Domicilio Conocido", True), ("IVA IMPORTE", True), ("El Puerto", False), ("A ~ NERCASTAR", True),
)


def _name(k: str) -> str:
    return f"CASE {k} % {len(NAMES)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(NAMES)) + " END"


@query("V09_implausible_names", f"SELECT k, k % {len(NAMES)} IN ({', '.join(str(i) for i, (_, bad) in enumerate(NAMES) if bad)}) AS implausible FROM receipt")
def v09(t: Tables):
    return t.receipt.select("k", text.implausible_name(F.expr(_name("k"))).alias("implausible"))


#: V13's points of the text {0}.
QUALITY = "cast(CASE WHEN coalesce({0}, '') = '' THEN 0 ELSE least(CASE WHEN len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}} .,;:-]')) / greatest(length({0}), 1) > 0.75 THEN 2 WHEN len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}} .,;:-]')) / greatest(length({0}), 1) > 0.6 THEN 1 ELSE 0 END + cast(length({0}) > 200 AS int) + cast(length({0}) > 600 AS int) + least(" + " + ".join(f"cast(contains(lower({{0}}), '{w}') AS int)" for w in ("total", "subtotal", "iva", "importe", "rfc", "fecha", "caja", "cajero")) + ", 2), 5) END AS int)"


@query("V13_text_quality", f"SELECT doc_id, {QUALITY.format('text')} AS points FROM documents")
def v13(t: Tables):
    return t.documents.select("doc_id", text.text_quality(F.col("text")).alias("points"))


PAPER = "'COMERCIAL ' || provider_name || chr(10) || 'RFC: ABC010101XY1' || chr(10) || 'FECHA: ' || {day} || chr(10) || 'SUBTOTAL: $' || cast(total_amount - tax_amount AS string) || chr(10) || 'IVA (16%): $' || cast(tax_amount AS string) || chr(10) || CASE k % 3 WHEN 0 THEN 'TOTAL: $' || cast(total_amount AS string) WHEN 1 THEN 'TOTAL' || chr(10) || cast(total_amount AS string) ELSE 'Total a pagar MXN ' || cast(total_amount AS string) END || chr(10) || 'Usted ahorra en total: $1.00' || chr(10) || 'Vence 01/01/2099'"


@query("V07_parsed_receipts", "SELECT id, 'COMERCIAL ' || provider_name AS provider_name, 'ABC010101XY1' AS provider_tax_id, cast(total_amount - tax_amount AS decimal(12,2)) AS subtotal, tax_amount, total_amount, expense_date FROM receipt")
def v07(t: Tables):
    paper = F.expr(PAPER.replace("{day}", "date_format(expense_date, 'dd/MM/yyyy')"))
    # rows of one small file are dealt to all cores first
    rows = t.receipt.repartition("id").select("id", paper.alias("text"))
    return receipt_text.parsed_receipts(rows).select("id", "provider_name", "provider_tax_id", "subtotal", "tax_amount", "total_amount", "expense_date")


TRACE = f"""SELECT id, cast(n AS int) AS n, field, cast(line AS int) AS line, rule, raw, field <> 'due' AS chosen FROM (
  SELECT id, 0 AS n, 'provider' AS field, 0 AS line, 'look' AS rule, 'COMERCIAL ' || provider_name AS raw FROM receipt UNION ALL SELECT id, 1, 'tax_id', 1, 'labelled', 'ABC010101XY1' FROM receipt
  UNION ALL SELECT id, 2, 'date', 2, 'labelled', strftime(expense_date, '%d/%m/%Y') FROM receipt UNION ALL SELECT id, 3, 'subtotal', 3, 'beside', cast(total_amount - tax_amount AS varchar) FROM receipt
  UNION ALL SELECT id, 4, 'tax', 4, 'beside', cast(tax_amount AS varchar) FROM receipt UNION ALL SELECT id, 5, 'total', 5, CASE k % 3 WHEN 0 THEN 'beside' WHEN 1 THEN 'below' ELSE 'later' END, cast(total_amount AS varchar) FROM receipt
  UNION ALL SELECT id, 6, 'due', 5, 'beside', cast(total_amount AS varchar) FROM receipt WHERE k % 3 = 0) AS candidates"""


@query("V24_reading_trace", TRACE)
def v24(t: Tables):
    paper = F.expr(PAPER.replace("{day}", "date_format(expense_date, 'dd/MM/yyyy')"))
    rows = receipt_text.parsed_receipts(t.receipt.repartition("id").select("id", paper.alias("text")), trace="why")
    # the outer form: from the plain one the optimizer infers a filter, for which it would make the whole reading again
    return rows.select("id", F.posexplode_outer("why").alias("n", "w")).where("n is not null").select("id", "n", "w.field", "w.line", "w.rule", "w.raw", "w.chosen")


@query("V13_reading_scores", f"SELECT id, cast(CASE k % 2 WHEN 0 THEN 70 ELSE 30 END + {QUALITY.format('paper')} AS int) AS score, k % 2 = 0 AS good FROM (SELECT *, CASE k % 2 WHEN 0 THEN {PAPER.replace('{day}', "strftime(expense_date, '%d/%m/%Y')")} ELSE 'RFC ABC010101XY1 TOTAL 5.00' END AS paper FROM receipt) AS r")
def v13_scores(t: Tables):
    paper = F.expr(f"CASE k % 2 WHEN 0 THEN {PAPER.replace('{day}', "date_format(expense_date, 'dd/MM/yyyy')")} ELSE 'RFC ABC010101XY1 TOTAL 5.00' END")
    rows = t.receipt.repartition("id").select("id", paper.alias("text"))
    return receipt_text.reading_scores(rows).select("id", "score", "good")


@query("V11_readers", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ocr' ELSE 'model' END WHEN 1 THEN CASE WHEN length(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) < 40 THEN 'pages' WHEN doc_id % 2 = 0 THEN 'rules' ELSE 'model' END WHEN 4 THEN 'unsupported' ELSE CASE WHEN doc_id % 2 = 0 THEN 'rules' ELSE 'model' END END AS reader FROM documents""")
def v11(t: Tables):
    kind = F.expr("CASE doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' WHEN 3 THEN 'xml' ELSE 'zip' END")
    return t.documents.select("doc_id", gate.reader(kind, F.col("text"), F.col("doc_id") % 2 == 0).alias("reader"))


#: A model's answer: whole and fenced, with nulls, cut in a string, cut in a number, with a nested total.
ANSWER = """CASE k % 5 WHEN 0 THEN '```json\n{"provider_name": "' || provider_name || '", "total_amount": "' || cast(total_amount AS string) || '", "currency": "MXN"}\n```'
  WHEN 1 THEN 'Here: {"provider_name": "' || provider_name || '", "total_amount": null, "invoice_number": "F-' || cast(k AS string) || '"}'
  WHEN 2 THEN '{"provider_name": "' || provider_name || '", "total_amount": ' || cast(total_amount AS string) || ', "cut'
  WHEN 3 THEN '{"invoice_number": "F-' || cast(k AS string) || '", "provider_name": "The \\\\"' || provider_name || '\\\\" {", "total_amount": ' || cast(total_amount AS string)
  ELSE '{"items": [{"total": 99, "currency": "USD"}], "provider_name": "' || provider_name || '", "total": ' || cast(total_amount AS string) || ', "ieps_amount": 1.50, "invoice_date": "' || cast(expense_date AS string) || '"' END"""


@query("V12_repaired_json", """SELECT id, CASE WHEN k % 5 = 3 THEN 'The "' || provider_name || '" {' ELSE provider_name END AS provider_name, CASE WHEN k % 5 IN (1, 3) THEN NULL ELSE total_amount END AS total_amount,
  CASE WHEN k % 5 = 0 THEN 'MXN' END AS currency, CASE WHEN k % 5 IN (1, 3) THEN 'F-' || cast(k AS varchar) END AS invoice_number, cast(CASE WHEN k % 5 = 4 THEN 1.5 END AS decimal(12,2)) AS excise_amount, CASE WHEN k % 5 = 4 THEN expense_date END AS expense_date FROM receipt""")
def v12(t: Tables):
    found = t.receipt.repartition("id").select("id", receipt_text.repaired_json(F.expr(ANSWER)).alias("found"))
    return found.select("id", *(F.col(f"found.{n}").alias(n) for n in ("provider_name", "total_amount", "currency", "invoice_number", "excise_amount", "expense_date")))


@query("V14_lines_from_boxes", """SELECT page_id, cast(place - 1 AS int) AS line, string_agg(text, ' ' ORDER BY x0, k) AS text FROM (WITH RECURSIVE w AS (SELECT cast(conv_id AS varchar) || '-' || cast(turn AS varchar) AS page_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
    p AS (SELECT page_id, text, i % 7 * 10.0::double AS x0, i // 7 * 12.0::double + i % 3 AS y0, i // 7 * 12.0::double + 10 + i % 2 AS y1 FROM w WHERE regexp_matches(text, '\\S')),
    b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, y1, text) AS k FROM p),
    turn AS (SELECT DISTINCT page_id, cast(0 AS bigint) AS k, cast([] AS struct(a double, b double)[]) AS lines, cast(0 AS bigint) AS place, cast(NULL AS varchar) AS text, cast(0 AS double) AS x0 FROM b
      UNION ALL SELECT page_id, k, CASE WHEN hit = 0 THEN list_append(lines, {'a': y0, 'b': y1}) ELSE list_concat(list_concat(lines[:hit - 1], [{'a': least(lines[hit].a, y0), 'b': greatest(lines[hit].b, y1)}]), lines[hit + 1:]) END, CASE WHEN hit = 0 THEN len(lines) + 1 ELSE hit END, text, x0
      FROM (SELECT b.*, t.lines, cast(coalesce(list_position(list_transform(t.lines, lambda r: least(r.b, b.y1) - greatest(r.a, b.y0) > 0.5 * least(r.b - r.a, b.y1 - b.y0)), true), 0) AS bigint) AS hit FROM turn AS t JOIN b ON b.page_id = t.page_id AND b.k = t.k + 1) AS n)
  SELECT * FROM turn WHERE k > 0) AS z GROUP BY page_id, place""")
def v14(t: Tables):
    words = t.conversations.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("page_id"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    line = F.floor(F.col("i") / 7)
    boxes = words.select("page_id", (F.col("i") % 7 * 10.0).alias("x0"), (F.col("i") % 7 * 10.0 + 9).alias("x1"), (line * 12.0 + F.col("i") % 3).alias("y0"), (line * 12.0 + 10 + F.col("i") % 2).alias("y1"), "text")
    return receipt_text.lines_from_boxes(boxes)
