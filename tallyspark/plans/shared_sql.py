"""SQL that queries of several modules share: the rows of the export, and the checks of the gate."""

from __future__ import annotations

GUARD = "CASE WHEN regexp_matches({0}, '^\\s*[=+\\-@\\t\\r]') THEN '''' || {0} ELSE {0} END"
EXPORT = f"""(SELECT m.id, strftime(expense_date, '%d/%m/%Y') AS "Fecha", {GUARD.format('provider_name')} AS "Proveedor", provider_tax_id AS "RFC Proveedor", category AS "Concepto", cast(CASE WHEN subtotal IS NULL AND coalesce(excise_amount, 0) = 0 THEN total_amount - tax_amount ELSE subtotal END AS decimal(18,2)) AS "Subtotal",
  tax_amount AS "IVA", excise_amount AS "IEPS", total_amount AS "Total", strftime(transaction_date, '%d/%m/%Y') AS "Fecha Banco", {GUARD.format('description')} AS "Descripcion Banco", reference AS "Referencia Banco", match_status AS "Estatus Conciliacion", cast(abs(total_amount - amount) AS decimal(18,2)) AS "Diferencia Monto",
  cast(abs(date_diff('day', transaction_date, expense_date)) AS int) AS "Diferencia Dias", cast(abs(abs(total_amount) - abs(amount)) AS decimal(18,2)) AS "Brecha" FROM reconciliation AS m JOIN receipt AS r ON r.id = m.receipt_id JOIN bank AS b ON b.id = m.bank_id WHERE match_status IN ('PERFECT', 'MANUAL'))"""

NO_NAME = "(trim(coalesce(provider_name, '')) IN ('', 'Unknown Provider'))"
AGREE = "(coalesce(abs(subtotal + tax_amount - total_amount) <= 0.01, false))"
AGREE_X = "(coalesce(abs(subtotal + tax_amount + excise_amount - total_amount) <= 0.01, false))"
VALID_ID = "regexp_full_match(upper(trim(provider_tax_id)), '[A-ZÑ&]{3,4}[0-9]{6}[A-Z0-9]{3}')"
FAILURES = f"""list_filter([CASE WHEN {NO_NAME} THEN 'provider_missing' END, CASE WHEN total_amount IS NULL OR total_amount <= 0 THEN 'total_not_positive' WHEN total_amount > 50000000 THEN 'total_out_of_range(' || cast(total_amount AS varchar) || ')' END,
  CASE WHEN tax_amount < 0 THEN 'tax_negative' WHEN tax_amount > total_amount THEN 'tax_exceeds_total' END,
  CASE WHEN subtotal IS NOT NULL AND tax_amount IS NOT NULL AND total_amount IS NOT NULL AND NOT {AGREE} AND NOT {AGREE_X} THEN 'subtotal_plus_tax_mismatch(leido=' || cast(total_amount AS varchar) || ',esperado=' || cast(cast(subtotal + tax_amount AS decimal(12,2)) AS varchar) || CASE WHEN excise_amount IS NOT NULL THEN ',ieps=' || cast(excise_amount AS varchar) ELSE '' END || ')' END,
  CASE WHEN provider_tax_id <> '' AND NOT {VALID_ID} THEN 'malformed_rfc' END,
  CASE WHEN expense_date IS NULL THEN 'date_missing' WHEN expense_date > date '1998-03-19' THEN 'date_in_future(' || cast(expense_date AS varchar) || ')' WHEN expense_date < date '1995-03-17' THEN 'date_too_old(' || cast(expense_date AS varchar) || ')' END], lambda x: x IS NOT NULL)"""
PASSED = f"""list_filter([CASE WHEN NOT {NO_NAME} THEN 'provider_present' END, CASE WHEN total_amount > 0 AND total_amount <= 50000000 THEN 'total_positive' END, CASE WHEN NOT coalesce(tax_amount < 0, false) AND NOT coalesce(tax_amount > total_amount, false) THEN 'tax_within_range' END,
  CASE WHEN {AGREE} THEN 'arithmetic_consistent' WHEN {AGREE_X} THEN 'arithmetic_consistent_with_ieps' END, CASE WHEN provider_tax_id <> '' AND {VALID_ID} THEN 'rfc_valid' END, CASE WHEN expense_date BETWEEN date '1995-03-17' AND date '1998-03-19' THEN 'date_plausible' END], lambda x: x IS NOT NULL)"""
