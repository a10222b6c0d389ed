"""The domain's tables as views over the star schema that the driver supplies.

Each view is one SQL text that Spark and DuckDB both run, so that queries and their checks start from the
same rows. With tables of your own you pass DataFrames with these columns to the operators instead.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS: dict[str, str] = {
    "receipt": """
        SELECT k, cast(k AS string) AS id, company_id, provider_name, provider_tax_id,
          cast(cents / 100 AS decimal(12,2)) AS total_amount, cast(tax / 100 AS decimal(12,2)) AS tax_amount,
          CASE WHEN k % 13 = 0 THEN NULL WHEN k % 19 = 0 THEN cast((cents - tax - 100) / 100 AS decimal(12,2))
               WHEN k % 10 = 3 THEN cast((cents - tax - 500) / 100 AS decimal(12,2)) ELSE cast((cents - tax) / 100 AS decimal(12,2)) END AS subtotal,
          CASE WHEN k % 10 = 3 THEN cast(5 AS decimal(12,2)) END AS excise_amount,
          expense_date, k % 17 = 0 AS date_provisional,
          CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Alimentación' WHEN 3 THEN 'ALIMENTACION' WHEN 4 THEN 'combustible' WHEN 5 THEN 'RENTA' ELSE o_orderpriority END AS category,
          cast((50 + k % 51) / 100 AS decimal(4,3)) AS confidence,
          CASE k % 5 WHEN 0 THEN 'llm' WHEN 1 THEN 'pdf_text' WHEN 2 THEN 'rules' WHEN 3 THEN 'ocr' END AS confidence_source,
          CASE WHEN o_orderstatus = 'O' THEN 'REQUIERE_REVISION' WHEN o_orderstatus = 'P' THEN 'PENDIENTE' WHEN k % 3 = 0 THEN 'APROBADO' ELSE 'AUTO_APROBADO' END AS extraction_status,
          CASE WHEN o_orderstatus = 'F' AND k % 3 <> 0 AND k % 4 = 0 THEN CASE WHEN k % 11 < 8 THEN 'CORRECTO' WHEN k % 11 < 10 THEN 'INCORRECTO' ELSE 'PENDIENTE' END END AS spot_check_status,
          CASE WHEN o_orderstatus = 'F' AND k % 3 <> 0 AND k % 4 = 0 AND k % 11 IN (8, 9) THEN CASE k % 5 WHEN 0 THEN 'total_amount, expense_date' WHEN 1 THEN 'total_amount' WHEN 2 THEN 'provider_name,, ' ELSE 'tax_amount,total_amount' END END AS spot_check_wrong_fields,
          CASE WHEN o_orderstatus = 'F' AND k % 3 <> 0 AND k % 4 = 0 AND k % 11 < 10 THEN 'user' || cast(k % 5 AS string) END AS spot_checked_by,
          CASE k % 4 WHEN 0 THEN 'APROBADA' WHEN 3 THEN 'RECHAZADA' ELSE 'PENDIENTE' END AS authorization_status,
          CASE WHEN k % 6 < 4 THEN 'acc' || cast(k % 6 AS string) END AS account_id,
          md5(cast(CASE WHEN k % 40 = 1 THEN k - 1 ELSE k END AS string)) AS source_hash,
          expense_date + cast(k % 4 AS int) AS created_on
        FROM (SELECT o_orderkey AS k, o_orderstatus, o_orderpriority, cast(c_nationkey AS string) AS company_id, cast(o_orderdate AS date) AS expense_date,
                CASE WHEN o_orderkey % 31 = 0 THEN 'Unknown Provider' ELSE c_name END AS provider_name,
                CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 21 = 1 THEN 'BAD-ID' ELSE 'ABC0101' || lpad(cast(o_orderkey % 100 AS string), 2, '0') || 'XY1' END AS provider_tax_id,
                cast(round(o_totalprice * 100) AS bigint) AS cents,
                cast((cast(round(o_totalprice * 100) AS bigint) * 16 - (cast(round(o_totalprice * 100) AS bigint) * 16) % 116) / 116 AS bigint) AS tax
              FROM {orders} AS o JOIN {customer} AS c ON o.o_custkey = c.c_custkey) AS t""",
    "draft": """
        SELECT id, k, CASE WHEN k % 23 = 0 THEN NULL ELSE provider_name END AS provider_name, provider_tax_id,
          CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN cast(0 AS decimal(12,2)) WHEN k % 43 = 0 THEN cast(60000000 AS decimal(12,2)) ELSE total_amount END AS total_amount,
          CASE WHEN k % 47 = 0 THEN cast(-1 AS decimal(12,2)) ELSE tax_amount END AS tax_amount, subtotal, excise_amount,
          CASE WHEN k % 29 = 0 THEN NULL ELSE expense_date END AS expense_date, confidence, confidence_source
        FROM {receipt} AS r""",
    "bank": """
        SELECT 'b' || id AS id, k, company_id, expense_date + cast(k % 6 AS int) AS transaction_date,
          cast(-(total_amount + CASE WHEN k % 7 = 0 THEN 50 ELSE 0 END) AS decimal(12,2)) AS amount,
          CASE k % 3 WHEN 0 THEN 'PAGO ' || provider_name ELSE 'TRANSFERENCIA SPEI' END AS description,
          CASE WHEN k % 2 = 0 THEN 'R' || id END AS reference, k % 9 = 0 AS is_reconciled
        FROM {receipt} AS r WHERE k % 11 <> 0""",
    "reconciliation": """
        SELECT 'm' || r.id AS id, r.id AS receipt_id, b.id AS bank_id,
          CASE WHEN abs(b.amount) <> r.total_amount THEN 'DISCREPANCY' WHEN r.k % 6 <= 3 THEN 'PERFECT' ELSE 'MANUAL' END AS match_status,
          b.transaction_date AS matched_on, CASE WHEN r.k % 5 = 0 THEN 'user' || cast(r.k % 3 AS string) END AS reviewed_by,
          CASE WHEN r.k % 5 = 0 AND r.k % 35 <> 0 THEN b.transaction_date END AS reviewed_on
        FROM {receipt} AS r JOIN {bank} AS b ON b.k = r.k WHERE r.k % 2 = 0""",
    "account": """
        SELECT 'acc' || cast(n_nationkey AS string) AS id, upper(replace(n_name, ' ', '_')) AS key, n_name AS name, n_nationkey % 2 = 0 AS variable FROM {nation} AS n WHERE n_nationkey < 6""",
    "product": """
        SELECT cast(p_partkey AS string) AS id, cast(p_partkey % 5 AS string) AS company_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'C' || cast(CASE WHEN p_partkey % 50 = 1 THEN p_partkey + 9 ELSE p_partkey END AS string) END AS code,
          p_name AS name, cast(p_retailprice AS decimal(12,2)) AS reference_price, p_partkey % 10 <> 0 AS active,
          CASE WHEN p_partkey % 2 = 0 THEN 'OCR' ELSE 'MANUAL' END AS origin, p_partkey % 4 <> 0 AS verified, date '1996-01-01' + cast(p_partkey % 700 AS int) AS created_on
        FROM {part} AS p""",
    "purchase": """
        SELECT id, company_id, id AS receipt_id, CASE k % 4 WHEN 0 THEN 'PROCESADO' WHEN 1 THEN 'EN_REVISION' WHEN 2 THEN 'PROCESAR' ELSE 'RECHAZADO' END AS state,
          expense_date AS purchased_on, provider_name, total_amount AS total, CASE WHEN k % 4 = 0 AND k % 44 <> 0 THEN 'user1' END AS confirmed_by,
          CASE WHEN k % 4 = 0 THEN created_on END AS confirmed_on
        FROM {receipt} AS r""",
    "purchase_line": """
        SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS id, cast(l_orderkey AS string) AS purchase_id,
          CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE cast(l_partkey AS string) END AS product_id, p_name AS description,
          cast(l_quantity AS decimal(14,3)) AS quantity, cast(l_extendedprice AS decimal(12,2)) AS total, l_linenumber AS line_order
        FROM {lineitem} AS l JOIN {part} AS p ON l.l_partkey = p.p_partkey""",
    "ledger": """
        SELECT cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS id, cast(l_partkey % 5 AS string) AS company_id, cast(l_partkey AS string) AS product_id,
          CASE l_returnflag WHEN 'N' THEN 'ENTRADA' WHEN 'A' THEN 'AJUSTE' ELSE 'SALIDA' END AS kind, cast(l_quantity AS decimal(14,3)) AS quantity,
          cast(l_shipdate AS date) AS moved_on, 'user' || cast(l_suppkey % 7 AS string) AS actor
        FROM {lineitem} AS l""",
    "audit": """
        SELECT event_id AS id, user_id, upper(event_type) AS action, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'module' || cast(event_id % 4 AS string) END AS module, cast(ts AS date) AS logged_on, props AS details
        FROM {events} AS e""",
    "scan_file": """
        SELECT 'dir' || cast(doc_id % 7 AS string) || '/file' || cast(doc_id AS string) AS path, doc_id AS k, md5(text) AS content_hash, octet_length(encode(text)) AS file_size, lang AS read_by,
          CASE doc_id % 10 WHEN 0 THEN 'PENDIENTE' WHEN 1 THEN 'DUPLICADO' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'NO_SOPORTADO' ELSE 'PROCESADO' END AS status,
          cast(1 + doc_id % 3 AS int) AS attempts, CASE WHEN doc_id % 10 > 3 THEN cast(doc_id - doc_id % 8 AS string) END AS receipt_id,
          CASE WHEN doc_id % 10 = 2 THEN CASE WHEN doc_id % 20 = 2 THEN 'no se sobreescribe' ELSE 'ilegible' END END AS last_error, date '1998-01-01' + cast(doc_id % 200 AS int) AS scanned_on
        FROM {documents} AS d""",
    "scan_listing": """
        SELECT path, k, CASE WHEN k % 12 = 0 THEN md5(content_hash) ELSE content_hash END AS content_hash, file_size FROM {scan_file} AS f WHERE k % 9 <> 0
        UNION ALL SELECT 'new/' || path AS path, k, CASE WHEN k % 2 = 0 THEN content_hash ELSE md5(path) END AS content_hash, file_size FROM {scan_file} AS f WHERE k % 15 = 0""",
    "scan_detail": """
        SELECT cast(k AS bigint) AS seq, path, status, receipt_id, CASE k % 10 WHEN 2 THEN 'ERROR' WHEN 4 THEN 'CREADO' WHEN 5 THEN 'ACTUALIZADO' WHEN 6 THEN 'SIN_CAMBIOS' WHEN 7 THEN 'CREADO' ELSE 'OMITIDO' END AS action FROM {scan_file} AS f""",
    "document_version": """
        SELECT cast(o_orderkey % 500 AS string) AS receipt_id, cast(o_orderkey AS string) AS id, cast(1 + (o_orderkey - o_orderkey % 500) / 500 AS int) AS version, o_totalprice AS size,
          CASE WHEN o_orderkey >= 500 THEN cast(o_orderkey - 500 AS string) END AS replaces, CASE WHEN o_orderkey >= 500 AND o_orderkey % 90 <> 1 THEN 'user2' END AS actor
        FROM {orders} AS o""",
    "close": """
        SELECT cast(n_nationkey AS string) AS company_id, '1998-0' || cast(1 + n_nationkey % 9 AS string) AS period, CASE WHEN n_nationkey % 4 = 0 THEN 'bad' ELSE md5(n_name) || md5(n_name) END AS digest, n_nationkey % 3 AS pending FROM {nation} AS n""",
}


def prefix(names: tuple[str, ...] = tuple(VIEWS)) -> str:
    """The views as a WITH clause for DuckDB."""
    plain = {n: n for n in (*BASE, *VIEWS)}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names) + "\n"


class Tables:
    """The views (and base tables) of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name].replace("encode(text)", "encode(text, 'utf-8')")
                used = {n: getattr(self, n) for n in (*BASE, *VIEWS) if "{" + n + "}" in text}
                self._made[name] = self.spark.sql(text, **used)
            elif name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]
