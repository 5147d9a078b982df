"""Measures of distortion, share and rate, all as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: PSNR of equal inputs, and the constants of structural similarity for a peak of 255.
SAME, C1, C2 = 1e9, (0.01 * 255) ** 2, (0.03 * 255) ** 2


def mae(a: Column, b: Column) -> Column:
    return F.avg(F.abs(a - b))


def max_abs_error(a: Column, b: Column) -> Column:
    return F.max(F.abs(a - b))


def psnr(a: Column, b: Column, peak: float = 255.0, same: float = SAME) -> Column:
    mse = F.avg((a - b) * (a - b))
    return F.when(mse == 0, same).otherwise(10 * F.log10(F.lit(peak * peak) / F.when(mse > 0, mse)))


def ssim(rows: DataFrame, block: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """One row: the mean over blocks of their structural similarity."""
    per = rows.groupBy(*block).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.covar_samp(a, b).alias("cov"))
    ma, mb = F.col("ma"), F.col("mb")
    one = (2 * ma * mb + C1) * (2 * F.col("cov") + C2) / ((ma * ma + mb * mb + C1) * (F.col("va") + F.col("vb") + C2))
    return per.agg(F.avg(one).alias("ssim"))


def percentile(rows: DataFrame, value: str, p: float, by: list[str]) -> DataFrame:
    """(by, value): the sorted element floor(p * (n - 1)) of each group, not interpolated.

    Counts by distinct value come first, so a value held by most rows is one row, and the running count picks the element.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy(value))
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counts.select(*by, value, upto.alias("upto"), F.floor(F.lit(p) * (total - 1)).alias("at"))
    return ranked.where(F.col("upto") > F.col("at")).groupBy(*by).agg(F.min(value).alias(value))


def air_fraction(v: Column) -> Column:
    return F.avg(F.when(v == 0, 1.0).otherwise(0.0))


def gate(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a value is within bounds."""
    ok = F.lit(True)
    ok = ok & (value >= low) if low is not None else ok
    return ok & (value <= high) if high is not None else ok
