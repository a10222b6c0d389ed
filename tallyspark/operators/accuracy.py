"""Accuracy of automatic readings by spot checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import SLO, Z, reviews_needed, verdict, wilson
from ..functions.text import list_items

#: Sources that are reported even without rows.
REQUIRED_SOURCES = ("llm", "pdf_text", "rules")


def by_source(receipts: DataFrame) -> DataFrame:
    """Sample counts by reading source (null: desconocido), the required sources always there."""
    s = F.col("spot_check_status")
    counts = receipts.where(s.isNotNull()).groupBy(F.coalesce("confidence_source", F.lit("desconocido")).alias("source")).agg(
        F.count_if(s.isin("CORRECTO", "INCORRECTO")).alias("reviewed"), F.count_if(s == "CORRECTO").alias("hits"), F.count_if(s == "INCORRECTO").alias("misses"), F.count_if(s == "PENDIENTE").alias("pending"))
    wanted = receipts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in REQUIRED_SOURCES])).alias("source"))
    missing = wanted.join(counts, "source", "left_anti").select("source", *[F.lit(0).cast("long").alias(c) for c in ("reviewed", "hits", "misses", "pending")])
    return counts.unionByName(missing)


def report(receipts: DataFrame, slo: float = SLO, z: float = Z) -> DataFrame:
    """Counts, share, Wilson bounds, verdict and reviews that are missing, by source."""
    hits, n = F.col("hits"), F.col("reviewed")
    low, high = wilson(hits, n, z)
    rows = by_source(receipts).withColumns({"share": F.round(hits / F.when(n > 0, n.cast("double")), 6), "low": F.round(low, 6), "high": F.round(high, 6), "verdict": verdict(hits, n, slo, z)})
    need = reviews_needed(hits, n, slo, z)
    return rows.withColumns({"needed": need["n"], "needed_reason": need["reason"]})


def overall(receipts: DataFrame, slo: float = SLO, z: float = Z) -> DataFrame:
    """The worst verdict of the sources that have reviews."""
    v = F.col("verdict")
    rows = by_source(receipts).where("reviewed > 0").withColumn("verdict", verdict(F.col("hits"), F.col("reviewed"), slo, z))
    out = F.when(F.bool_or(v == "NO_CUMPLE"), "NO_CUMPLE").when(F.bool_or(v == "INCONCLUYENTE"), "INCONCLUYENTE").when(F.count(F.lit(1)) > 0, "CUMPLE").otherwise("SIN_EVIDENCIA")
    return rows.agg(out.alias("verdict"), F.coalesce(F.sum("reviewed"), F.lit(0)).alias("reviewed"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def failed_fields(receipts: DataFrame) -> DataFrame:
    """How often each field was wrong, by source."""
    rows = receipts.where("spot_check_status = 'INCORRECTO'").select(F.coalesce("confidence_source", F.lit("desconocido")).alias("source"), F.explode(list_items(F.col("spot_check_wrong_fields"))).alias("field"))
    return rows.groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"))


def most_failed_field(receipts: DataFrame) -> DataFrame:
    """Each source's most failed field, ties by name."""
    return failed_fields(receipts).groupBy("source").agg(F.min_by(F.struct("field", "n"), F.struct((-F.col("n")).alias("m"), "field")).alias("__f")).select("source", "__f.field", "__f.n")


def explained(source: Column, reviewed: Column, hits: Column, outcome: Column, slo: float = SLO) -> Column:
    """The verdict in a sentence."""
    share = F.concat(F.format_number(hits * 100.0 / reviewed, 1), F.lit("%"))
    line = F.lit(f"{slo * 100:.1f}%")
    head = F.concat(source, F.lit(": "), hits.cast("string"), F.lit(" de "), reviewed.cast("string"), F.lit(" ("), share, F.lit(")"))
    return (
        F.when(outcome == "SIN_EVIDENCIA", F.concat(source, F.lit(": sin revisiones, no hay evidencia")))
        .when(outcome == "CUMPLE", F.concat(head, F.lit(" cumple el objetivo de "), line)).when(outcome == "NO_CUMPLE", F.concat(head, F.lit(" no cumple el objetivo de "), line))
        .otherwise(F.concat(head, F.lit(" no alcanza para afirmar ni negar el objetivo de "), line))
    )


def explanations(receipts: DataFrame, slo: float = SLO, z: float = Z) -> DataFrame:
    rows = by_source(receipts).withColumn("verdict", verdict(F.col("hits"), F.col("reviewed"), slo, z))
    return rows.select("source", "verdict", explained(F.col("source"), F.col("reviewed"), F.col("hits"), F.col("verdict"), slo).alias("text"))


def field_accuracy(truth: DataFrame, readings: DataFrame, fields: dict[str, float | None]) -> DataFrame:
    """Hits, misses and readings of what the paper doesn't say, by field. truth and readings share `name`;
    fields give a tolerance for amounts, None for equality. A truth of null is not on the paper and doesn't count in the share."""
    both = truth.select("name", F.struct(*fields).alias("t")).join(readings.select("name", F.struct(*fields).alias("r")), "name", "left")

    def outcome(field: str, tolerance: float | None) -> Column:
        t, r = F.col(f"t.{field}"), F.col(f"r.{field}")
        same = t == r if tolerance is None else F.abs(t - r) <= tolerance
        return F.when(t.isNull(), F.when(r.isNull(), "not_on_paper").otherwise("unsupported")).when(F.coalesce(same, F.lit(False)), "hit").otherwise("miss")

    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), outcome(f, t).alias("outcome")) for f, t in fields.items()])).alias("x")
    rows = both.select(each).select("x.*").groupBy("field").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("hit", "hits"), ("miss", "misses"), ("not_on_paper", "not_on_paper"), ("unsupported", "unsupported"))])
    n = F.col("hits") + F.col("misses")
    return rows.withColumn("accuracy", F.round(F.col("hits") / F.when(n > 0, n.cast("double")), 6))
