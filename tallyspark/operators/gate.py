"""Checks of a reading and what follows from them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import shift_years
from ..functions.stats import in_sample
from ..functions.text import UNKNOWN_PROVIDER, implausible_name, valid_tax_id

AUTO_APPROVE, REVIEW = 0.90, 0.60
TOLERANCE, LARGEST_TOTAL, FUTURE_DAYS, PAST_YEARS = "0.01", 50_000_000, 2, 3
BLOCKING = ("provider_missing", "total_not_positive", "date_missing")

# Confidence by which of tax id, subtotal and date were read, for text layers and for OCR.
TEXT_CONFIDENCE = {(0, 0, 0): 0.86, (0, 0, 1): 0.88, (1, 0, 0): 0.90, (0, 1, 0): 0.90, (1, 0, 1): 0.90, (0, 1, 1): 0.92, (1, 1, 0): 0.94, (1, 1, 1): 0.97}
OCR_CONFIDENCE = {(0, 0, 0): 0.60, (0, 0, 1): 0.68, (1, 0, 0): 0.72, (0, 1, 0): 0.76, (1, 0, 1): 0.80, (0, 1, 1): 0.86, (1, 1, 0): 0.88, (1, 1, 1): 0.93}


def _arithmetic() -> tuple[Column, Column, Column]:
    """Whether subtotal, tax and total were all read; they agree; they agree with the excise."""
    subtotal, tax, whole, excise = (F.col(c) for c in ("subtotal", "tax_amount", "total_amount", "excise_amount"))
    tolerance = F.lit(TOLERANCE).cast("decimal(12,2)")
    told = subtotal.isNotNull() & tax.isNotNull() & whole.isNotNull()
    return told, told & (F.abs(subtotal + tax - whole) <= tolerance), told & F.coalesce(F.abs(subtotal + tax + excise - whole) <= tolerance, F.lit(False))


def checks(as_of: date) -> tuple[Column, Column]:
    """Arrays of what passed and what failed, in the order of the checks."""
    name = F.trim(F.coalesce("provider_name", F.lit("")))
    whole, tax, day, given = F.col("total_amount"), F.col("tax_amount"), F.col("expense_date"), F.col("provider_tax_id")
    no_name = (name == "") | (name == UNKNOWN_PROVIDER)
    no_total, too_large = whole.isNull() | (whole <= 0), whole > LARGEST_TOTAL
    told, agrees, with_excise = _arithmetic()
    expected = (F.col("subtotal") + tax).cast("decimal(12,2)").cast("string")
    mismatch = F.concat(F.lit("subtotal_plus_tax_mismatch(leido="), whole.cast("string"), F.lit(",esperado="), expected, F.when(F.col("excise_amount").isNotNull(), F.concat(F.lit(",ieps="), F.col("excise_amount").cast("string"))).otherwise(""), F.lit(")"))
    has_id = F.coalesce(given, F.lit("")) != ""
    future, old = day > F.lit(as_of + timedelta(days=FUTURE_DAYS)), day < shift_years(F.lit(as_of), -PAST_YEARS)
    passed = F.array(
        F.when(~no_name, "provider_present"), F.when(~no_total & ~too_large, "total_positive"), F.when(~F.coalesce(tax < 0, F.lit(False)) & ~F.coalesce(tax > whole, F.lit(False)), "tax_within_range"),
        F.when(agrees, "arithmetic_consistent").when(with_excise, "arithmetic_consistent_with_ieps"), F.when(has_id & valid_tax_id(given), "rfc_valid"), F.when(day.isNotNull() & ~future & ~old, "date_plausible"),
    )
    failures = F.array(
        F.when(no_name, "provider_missing"), F.when(no_total, "total_not_positive").when(too_large, F.concat(F.lit("total_out_of_range("), whole.cast("string"), F.lit(")"))),
        F.when(tax < 0, "tax_negative").when(tax > whole, "tax_exceeds_total"), F.when(told & ~agrees & ~with_excise, mismatch), F.when(has_id & ~valid_tax_id(given), "malformed_rfc"),
        F.when(day.isNull(), "date_missing").when(future, F.concat(F.lit("date_in_future("), day.cast("string"), F.lit(")"))).when(old, F.concat(F.lit("date_too_old("), day.cast("string"), F.lit(")"))),
    )
    return F.array_compact(passed), F.array_compact(failures)


def gate(drafts: DataFrame, as_of: date, manual: bool = False) -> DataFrame:
    """Drafts with passed, failures, extraction_status, confidence and reasons.

    A blocking failure leaves a draft pending, any other sends it to review; without failures confidence
    decides. Manual entries without failures are approved and have no confidence.
    """
    passed, failures = checks(as_of)
    rows = drafts.withColumns({"passed": passed, "failures": failures})
    c = F.coalesce("confidence", F.lit(0)).cast("double")
    failed = F.size("failures") > 0
    status = (
        F.when(F.arrays_overlap("failures", F.array(*[F.lit(b) for b in BLOCKING])), "PENDIENTE").when(failed, "REQUIERE_REVISION")
        .when(F.lit(manual), "APROBADO").when(c >= AUTO_APPROVE, "AUTO_APROBADO").otherwise("REQUIERE_REVISION")
    )
    band = F.when(c >= AUTO_APPROVE, "confidence_high").when(c >= REVIEW, "confidence_medium").otherwise("confidence_low")
    reasons = F.when(failed, F.array_join(F.transform("failures", lambda f: F.concat(F.lit("check:"), f)), "; ")).when(F.lit(manual), "manual_entry").otherwise(band)
    out = rows.withColumns({"extraction_status": status, "reasons": reasons})
    return out.withColumn("confidence", F.lit(None).cast("decimal(4,3)")) if manual else out


def rule_confidence() -> Column:
    """Confidence of a rule-based reading by the fields it has."""
    flags = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("provider_tax_id", "subtotal", "expense_date")]

    def by(table: dict) -> Column:
        out = F.lit(None).cast("double")
        for values, confidence in table.items():
            hit = [f if v else ~f for f, v in zip(flags, values, strict=True)]
            out = F.when(hit[0] & hit[1] & hit[2], confidence).otherwise(out)
        return out

    return F.when(F.col("confidence_source") == "ocr", by(OCR_CONFIDENCE)).otherwise(by(TEXT_CONFIDENCE)).cast("decimal(4,3)")


def arithmetic_sign() -> Column:
    """1 if the amounts agree, -1 if they contradict each other, 0 where they say nothing."""
    told, agrees, with_excise = _arithmetic()
    return F.when(F.col("total_amount").isNull() | (F.col("total_amount") <= 0), 0).when(agrees | with_excise, 1).when(told, -1).otherwise(0)


def completeness() -> Column:
    """What a reading has, most important first; structs compare like the tuples they are."""
    has = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) != "").cast("int")
    name = F.coalesce("provider_name", F.lit(""))
    return F.struct(
        (F.coalesce("total_amount", F.lit(0)) > 0).cast("int").alias("total"), F.coalesce("n_items", F.lit(0)).cast("boolean").cast("int").alias("items"), (name != UNKNOWN_PROVIDER).cast("int").alias("provider"),
        arithmetic_sign().alias("arithmetic"), (~implausible_name(name)).cast("int").alias("plausible"), has("provider_tax_id").alias("tax_id"), F.col("subtotal").isNotNull().cast("int").alias("subtotal"),
    )


#: Characters from which a PDF's own text is worth reading.
LEAST_PDF_TEXT = 40


def reader(file_type: Column, text: Column, useful: Column) -> Column:
    """Whose reading of a file counts: rules or ocr where theirs is useful, else the model; pages (as pictures) for a PDF
    without enough text of its own; unsupported for other files. text: the file's own; useful: what the first reading is."""
    first = lambda name: F.when(F.coalesce(useful, F.lit(False)), name).otherwise("model")
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    pdf = F.when(F.length(bare) < LEAST_PDF_TEXT, "pages").otherwise(first("rules"))
    return F.when(file_type == "image", first("ocr")).when(file_type.isin("text", "xml"), first("rules")).when(file_type == "pdf", pdf).otherwise("unsupported")


def best_reading(readings: DataFrame, key: str = "id", attempt: str = "attempt") -> DataFrame:
    """Of several readings of a document the most complete; of equal ones the earliest."""
    rest = [c for c in readings.columns if c != key]
    best = readings.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(completeness().alias("c"), (-F.col(attempt)).alias("a"))).alias("__r"))
    return best.select(key, "__r.*")


def persisted(drafts: DataFrame, existing: DataFrame, as_of: date, rate: float = 0.05) -> DataFrame:
    """Gated drafts that are new by company and content hash (of repeats the first by id), with a
    provisional date where there was none and the sample's mark on automatic approvals."""
    first = Window.partitionBy("company_id", "source_hash").orderBy("id")
    known = existing.where("source_hash is not null").select("company_id", "source_hash").distinct()
    kept = drafts.withColumn("__n", F.when(F.col("source_hash").isNull(), 1).otherwise(F.row_number().over(first))).where("__n = 1").drop("__n")
    rows = gate(kept.join(known, ["company_id", "source_hash"], "left_anti"), as_of)
    sampled = (F.col("extraction_status") == "AUTO_APROBADO") & in_sample(F.col("source_hash"), rate)
    return rows.withColumns({"date_provisional": F.col("expense_date").isNull(), "expense_date": F.coalesce("expense_date", F.lit(as_of)), "spot_check_status": F.when(sampled, "PENDIENTE")})
