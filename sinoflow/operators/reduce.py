"""Reductions, statistics and fits over bins and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(rows: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by or []).agg(
        F.sum(v).alias("sum"), F.sum(F.when(v > 0, v).otherwise(0.0)).alias("sum_positive"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(v * v).alias("norm_squared"), F.sqrt(F.sum(v * v)).alias("norm"), F.min(F.when(v > 0, v)).alias("min_positive"),
    )


def centre_of_gravity(voxels: DataFrame, by: list[str], size: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    mean = lambda c, s: (F.sum(F.col(c) * F.col("value")) * s / F.sum("value")).alias(f"c{c}")
    return voxels.groupBy(*by).agg(*(mean(c, s) for c, s in zip("zyx", size, strict=True)))


def index_at_maximum(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Indices of the largest voxel; of equal ones the first in (z, y, x)."""
    best = F.max_by(F.struct("z", "y", "x"), F.struct("value", -F.col("z"), -F.col("y"), -F.col("x")))
    return voxels.groupBy(*by).agg(best.alias("i"), F.max("value").alias("value")).select(*by, "i.z", "i.y", "i.x", "value")


def roi_values(voxels: DataFrame, weight: Column, by: list[str], volume: float = 1.0, per_plane: bool = False) -> DataFrame:
    """Volume, integral, mean, standard deviation, extremes of a weighted region; per plane with z, and in all."""
    w, v = F.col("w"), F.col("value")
    rows = voxels.withColumn("w", weight).filter("w > 0")
    sums = [(F.sum(w) * volume).alias("volume"), (F.sum(w * v) * volume).alias("integral"), (F.sum(w * v * v) * volume).alias("square"), F.min(v).alias("min"), F.max(v).alias("max")]
    out = rows.groupBy(*by, *["z"] * per_plane).agg(*sums)
    mean = F.col("integral") / F.col("volume")
    var = F.col("square") / F.col("volume") - mean * mean
    var = F.when(var < 1e-4 * mean * mean, 0.0).otherwise(var)
    return out.withColumn("mean", mean).withColumn("std", F.sqrt(var))


def weighted_line(rows: DataFrame, by: list[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Weighted least-squares line: slope, intercept, their variances and covariance, chi square."""
    s = rows.select(*by, x.alias("__x"), y.alias("__y"), w.alias("__w")).groupBy(*by).agg(
        *(F.sum(F.expr(e)).alias(n) for n, e in {"s": "__w", "sx": "__w*__x", "sy": "__w*__y", "sxx": "__w*__x*__x", "sxy": "__w*__x*__y", "syy": "__w*__y*__y"}.items())
    )
    s = s.withColumn("stt", F.expr("sxx - sx*sx/s")).withColumn("sty", F.expr("sxy - sx*sy/s")).filter("s > 0 and stt > 0")
    s = s.withColumn("slope", F.expr("sty/stt")).withColumn("intercept", F.expr("(sy - sx*sty/stt)/s"))
    return s.select(
        *by, "slope", "intercept", F.expr("1/stt").alias("var_slope"), F.expr("(1 + sx*sx/(s*stt))/s").alias("var_intercept"), F.expr("-sx/(s*stt)").alias("covariance"),
        F.expr("greatest(0.0, syy - slope*slope*stt - sy*sy/s)").alias("chi_square"),
    )


def trapezoid(samples: DataFrame, by: list[str], t: str, v: str) -> DataFrame:
    """Integral over an irregular grid, per group."""
    over = Window.partitionBy(*by).orderBy(t)
    part = (F.lead(t).over(over) - F.col(t)) * (F.lead(v).over(over) + F.col(v)) / 2
    return samples.withColumn("part", part).groupBy(*by).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("integral"))


def compare(a: DataFrame, b: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Greatest absolute difference, relative to the greatest amplitude of ``a``; a missing row counts as 0."""
    both = a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), keys, "full")
    va, vb = F.coalesce("va", F.lit(0.0)), F.coalesce("vb", F.lit(0.0))
    return both.groupBy(*by).agg(F.max(F.abs(va - vb)).alias("difference"), (F.max(F.abs(va - vb)) / F.max(F.abs(va))).alias("relative"))
