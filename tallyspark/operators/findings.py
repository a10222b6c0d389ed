"""Findings over the monthly series (A30, A31, W04). The series is short: one row a month, at most 36."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTLIER, UNUSUAL_BASE, LEAST_MONTHS, IRREGULAR, NAMED = 0.50, 0.25, 4, 0.35, 2


def statistics(trend: DataFrame) -> DataFrame:
    """Over months (month, amount): median, min, max, mean and coefficient of variation (three months at least) of amounts from 0."""
    rows = trend.where("amount >= 0").select(F.col("amount").cast("double").alias("x"))
    n, mean = F.count(F.lit(1)), F.avg("x")
    cv = F.when((n >= 3) & (mean > 0), F.round(F.stddev_samp("x") / mean, 2))
    return rows.agg(n.alias("months"), F.round(F.median("x"), 2).alias("median"), F.round(F.min("x"), 2).alias("low"), F.round(F.max("x"), 2).alias("high"), F.round(mean, 2).alias("mean"), cv.alias("dispersion"))


def _deviation(x: Column) -> Column:
    return F.when(F.col("median") != 0, (x.cast("double") - F.col("median")) / F.col("median")).otherwise(0.0)


def findings(trend: DataFrame, in_progress: bool = True, change_to_date: float | None = None) -> DataFrame:
    """Rows (position, kind, month, amount, deviation) in their order of display.

    trend: month and amount, the month in progress last. Under four closed months there is only
    insufficient_data. Else: level; up to two outliers, the farthest first, ties in time order; the month in
    progress against the median; unusual_base if last month was off and change_to_date leads back; dispersion.
    """
    last = trend.agg(F.max("month").alias("last"))
    closed = trend.join(last).where("month < last").drop("last") if in_progress else trend
    s = statistics(closed)
    enough, none = F.col("months") >= LEAST_MONTHS, F.lit(None)

    def row(rows: DataFrame, position: int | Column, kind: str | Column, month: Column, amount: Column, deviation: Column) -> DataFrame:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return rows.select(as_column(position).cast("int").alias("position"), as_column(kind).alias("kind"), month.cast("date").alias("month"), F.round(amount.cast("double"), 2).alias("amount"), F.round(deviation.cast("double"), 6).alias("deviation"))

    measured = closed.join(s).where(enough).withColumn("deviation", _deviation(F.col("amount")))
    ranked = measured.where(F.abs("deviation") > OUTLIER).withColumn("n", F.row_number().over(Window.orderBy(F.desc(F.abs("deviation")), "month")))
    parts = [
        row(s.where(~enough), 0, "insufficient_data", none, F.col("months"), none), row(s.where(enough), 1, "level", none, F.col("median"), none),
        row(ranked.where(F.col("n") <= NAMED), 1 + F.col("n"), "outlier", F.col("month"), F.col("amount"), F.col("deviation")),
        row(s.where(enough & (F.col("dispersion") >= IRREGULAR)), 6, "dispersion", none, F.col("dispersion"), none),
    ]
    if in_progress:
        now = trend.join(last).where("month = last").join(s).where(enough).withColumn("deviation", _deviation(F.col("amount")))
        parts.append(row(now, 4, F.when(F.abs("deviation") > OUTLIER, "month_out_of_range").otherwise("month_in_range"), F.col("month"), F.col("amount"), F.col("deviation")))
        if change_to_date is not None:
            before = measured.join(closed.agg(F.max("month").alias("m"))).where("month = m")
            back = ((F.col("deviation") < 0) & F.lit(change_to_date > 0)) | ((F.col("deviation") >= 0) & F.lit(change_to_date < 0))
            parts.append(row(before.where((F.abs("deviation") > UNUSUAL_BASE) & back), 5, "unusual_base", F.col("month"), F.col("amount"), F.col("deviation")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("position")


def texts(rows: DataFrame) -> DataFrame:
    """The findings in words."""
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 0))
    pct = F.concat(F.format_number(F.abs("deviation") * 100, 0), F.lit("%"), F.when(F.col("deviation") > 0, " por encima").otherwise(" por debajo"))
    kind = F.col("kind")
    text = (
        F.when(kind == "insufficient_data", F.concat(F.lit(f"Hacen falta {LEAST_MONTHS} meses cerrados y hay "), F.col("amount").cast("int").cast("string")))
        .when(kind == "level", F.concat(F.lit("alrededor de "), money("amount"), F.lit(" al mes"))).when(kind == "dispersion", F.concat(F.lit("varia "), F.format_number(F.col("amount") * 100, 0), F.lit("% entre meses")))
        .otherwise(F.concat(money("amount"), F.lit(", "), pct, F.lit(" de lo habitual")))
    )
    return rows.withColumn("text", text)
