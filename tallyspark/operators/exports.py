"""Export layouts (M10, M11, P12, S13): DataFrames ready for a CSV or Parquet sink."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import amount_gap
from ..functions.text import formula_guard

MATCHED = ("PERFECT", "MANUAL")
TWO = "decimal(18,2)"

# Columns of the standard and the accounting layout, and where the latter's come from by default.
STANDARD = ("Fecha", "Proveedor", "RFC Proveedor", "Concepto", "Subtotal", "IVA", "IEPS", "Total", "Fecha Banco", "Descripcion Banco", "Referencia Banco", "Estatus Conciliacion", "Diferencia Monto", "Diferencia Dias")
ACCOUNTING = ("Fecha", "Concepto", "RFC", "Nombre", "Importe", "IVA", "IEPS", "Total", "Cuenta", "Referencia", "TipoComprobante", "Serie", "Folio", "Moneda", "TipoCambio", "MetodoPago", "UsoCFDI")
ACCOUNTING_FROM = {"Fecha": "Fecha", "Concepto": "Concepto", "RFC": "RFC Proveedor", "Nombre": "Proveedor", "Importe": "Subtotal", "IVA": "IVA", "IEPS": "IEPS", "Total": "Total", "Referencia": "Referencia Banco"}


def export_rows(receipts: DataFrame, reconciliations: DataFrame, bank: DataFrame, start: date | None = None, end: date | None = None, statuses: tuple[str, ...] = MATCHED) -> DataFrame:
    """One row for each reconciliation, within closed bounds of the receipt's date, in the standard layout.

    Subtotal falls back to total - tax where it is missing and there is no excise. `Diferencia Monto` keeps
    the movement's sign; `Brecha` ignores signs as the engine does.
    """
    r = receipts.withColumnRenamed("id", "receipt_id")
    b = bank.select(F.col("id").alias("bank_id"), "transaction_date", "amount", "description", "reference")
    rows = reconciliations.where(F.col("match_status").isin(*statuses)).select("id", "receipt_id", "bank_id", "match_status").join(r, "receipt_id").join(b, "bank_id")
    if start is not None:
        rows = rows.where(F.col("expense_date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("expense_date") <= F.lit(end))
    plain = F.coalesce("excise_amount", F.lit(0)) == 0
    subtotal = F.when(F.col("subtotal").isNull() & plain, F.col("total_amount") - F.col("tax_amount")).otherwise(F.col("subtotal"))
    return rows.select(
        "id", F.date_format("expense_date", "dd/MM/yyyy").alias("Fecha"), formula_guard(F.col("provider_name")).alias("Proveedor"), F.col("provider_tax_id").alias("RFC Proveedor"), F.col("category").alias("Concepto"),
        subtotal.cast(TWO).alias("Subtotal"), F.col("tax_amount").alias("IVA"), F.col("excise_amount").alias("IEPS"), F.col("total_amount").alias("Total"), F.date_format("transaction_date", "dd/MM/yyyy").alias("Fecha Banco"),
        formula_guard(F.col("description")).alias("Descripcion Banco"), F.col("reference").alias("Referencia Banco"), F.col("match_status").alias("Estatus Conciliacion"),
        F.abs(F.col("total_amount") - F.col("amount")).cast(TWO).alias("Diferencia Monto"), F.abs(F.datediff("expense_date", "transaction_date")).alias("Diferencia Dias"), amount_gap(F.col("total_amount"), F.col("amount")).cast(TWO).alias("Brecha"),
    )


def accounting_layout(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """The accounting package's columns from the standard layout.

    Without a mapping, columns without a source are empty. With one, a value that names no standard column
    is a constant; columns it doesn't mention keep their default source.
    """
    sources = {c: ACCOUNTING_FROM.get(c, "") for c in ACCOUNTING} | (mapping or {})

    def column(name: str):
        source = sources[name]
        if source in STANDARD:
            return F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias(name)
        return F.lit(source if mapping and source else "").alias(name)

    return rows.select("id", *[column(c) for c in ACCOUNTING])


def selected(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The wanted columns under their new names, in order; unknown ones are passed over."""
    return rows.select("id", *[F.col(f"`{c}`").alias(new) for c, new in columns.items() if c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, quotes doubled inside quotes, blanks as they are; text that a spreadsheet would run is already guarded."""
    rows.write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
