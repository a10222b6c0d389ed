"""Queries of files: statements, listings, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import exports, integrity, scans
from ..sources import bank_csv
from ..sources.scratch import shared_folder
from ..sources.views import Tables
from .registry import query
from .shared_sql import EXPORT


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _statement(t: Tables, where: str = "true") -> str:
    """The view of movements as a bank's file: semicolons, Latin-1, days first, decimal commas, line breaks in quotes."""
    amount = F.replace(F.format_number("amount", 2), F.lit(","), F.lit(""))
    rows = t.bank.where(where).select(
        F.date_format("transaction_date", "dd/MM/yyyy").alias("Fecha Operacion"), F.translate(amount, ".", ",").alias("Importe"),
        F.expr("CASE WHEN k % 5 = 0 THEN description || chr(10) || 'segunda; linea' ELSE description || ' ñ' END").alias("Concepto"), F.col("reference").alias("Referencia"),
    )
    path = _folder(t, "statement")
    rows.write.csv(path, header=True, sep=";", encoding="ISO-8859-1", quoteAll=True)
    return path


DESCRIPTION = "CASE WHEN k % 5 = 0 THEN description || chr(10) || 'segunda; linea' ELSE description || ' ñ' END"


@query("S02_S03_S04_S05_statement", f"SELECT transaction_date, amount, {DESCRIPTION} AS description, reference FROM bank")
def s02(t: Tables):
    return bank_csv.read_statement(t.spark, _statement(t), encoding="latin-1")


@query("S07_appended_statements", f"SELECT company_id, transaction_date, amount, {DESCRIPTION} AS description, reference, false AS is_reconciled FROM bank")
def s07(t: Tables):
    path = _folder(t, "movements")
    for (company,) in t.bank.select("company_id").distinct().collect():  # a statement of each company
        bank_csv.append_statement(bank_csv.read_statement(t.spark, _statement(t, f"company_id = '{company}'"), encoding="latin-1"), company, path)
    return bank_csv.movements(t.spark, path)


@query("S08_listing")
def s08(t: Tables):
    return scans.listing(t.spark, t.sf_dir)


@query("S13_written_export", f"SELECT * FROM {EXPORT} AS e")
def s13(t: Tables):
    rows, path = exports.export_rows(t.receipt, t.reconciliation, t.bank), _folder(t, "export")
    exports.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).csv(path, header=True, multiLine=True, escape='"')


@query("I08_changed_rows", "SELECT cast(id AS varchar) AS key, CASE WHEN logged_on >= (SELECT max(logged_on) FROM audit) THEN 'deleted' ELSE 'changed' END AS what FROM audit WHERE logged_on >= (SELECT max(logged_on) FROM audit) OR action = 'PURCHASE'")
def i08(t: Tables):
    last = t.audit.agg(F.max("logged_on").alias("last"))
    after = t.audit.join(last).where("logged_on < last").drop("last").withColumn("user_id", F.expr("CASE WHEN action = 'PURCHASE' THEN -user_id - 1 ELSE user_id END").cast(t.audit.schema["user_id"].dataType))
    return integrity.changed_rows(t.audit, after, "id")
