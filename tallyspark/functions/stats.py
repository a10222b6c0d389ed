"""Statistics of quality control: deterministic samples, Wilson intervals, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLO, Z, EDGE = 0.96, 1.96, 1e-9
LARGEST_SAMPLE = 200_001


def in_sample(digest: Column, rate: float = 0.05) -> Column:
    """Whether a document is in the deterministic sample: its hex digest (else crc32) modulo 10000 is below the rate. Null and empty: no."""
    if rate <= 0:
        return F.lit(False)
    if rate >= 1:
        return F.lit(True)
    # a long hex number modulo 10000, six digits at a time
    def step(rest: Column, i: Column) -> Column:
        part = F.substring(digest, i, F.lit(6))
        return (rest * F.pow(F.lit(16), F.length(part)).cast("long") + F.conv(part, 16, 10).cast("long")) % 10000

    hexed = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digest), F.lit(1)), F.lit(6)), F.lit(0).cast("long"), step)
    drawn = F.when(digest.rlike(r"^[0-9a-fA-F]+\z"), hexed).otherwise(F.crc32(digest.cast("binary")) % 10000)
    return F.when(F.coalesce(digest, F.lit("")) == "", False).otherwise(drawn < int(rate * 10000))


def _snapped(x: Column) -> Column:
    return F.when(x >= 1 - EDGE, 1.0).when(x <= EDGE, 0.0).otherwise(x)


def wilson(hits: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of hits in total; nulls without rows or with hits outside 0..total."""
    n = total.cast("double")
    valid = (total > 0) & (hits >= 0) & (hits <= total)
    p = hits.cast("double") / F.when(valid, n)
    below = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / below
    margin = z / below * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(valid, _snapped(F.greatest(F.lit(0.0), middle - margin))), F.when(valid, _snapped(F.least(F.lit(1.0), middle + margin)))


def verdict(hits: Column, total: Column, slo: float = SLO, z: float = Z) -> Column:
    """A19."""
    low, high = wilson(hits, total, z)
    return F.when(F.coalesce(total, F.lit(0)) <= 0, "SIN_EVIDENCIA").when(low >= slo, "CUMPLE").when(high < slo, "NO_CUMPLE").otherwise("INCONCLUYENTE")


def reviews_needed(hits: Column, total: Column, slo: float = SLO, z: float = Z) -> Column:
    """Struct (n, reason): the smallest sample size total, total + 10 .. at which the observed share would pass."""
    p = hits.cast("double") / F.when(total > 0, total.cast("double"))
    sizes = F.sequence(total.cast("int"), F.greatest(total.cast("int"), F.lit(LARGEST_SAMPLE - 1)), F.lit(10))
    passing = F.filter(sizes, lambda n: wilson(F.bround(p * n).cast("int"), n, z)[0] >= slo)
    n = F.when(p > slo, F.try_element_at(passing, F.lit(1)))
    reason = F.when(F.coalesce(total, F.lit(0)) <= 0, "sin_muestra").when(p < slo, "acierto_por_debajo").when(p == slo, "acierto_en_la_linea").when(n.isNotNull(), "suficiente").otherwise("fuera_de_alcance")
    return F.struct(n.alias("n"), reason.alias("reason"))
