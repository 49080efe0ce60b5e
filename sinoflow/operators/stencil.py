"""Neighbourhood operators on voxel grids: filters and the gradients and values of priors.

A voxel sends its value to its neighbours (one explode of a small list of offsets) and each receives by one
aggregation on the voxel's key, so there is one shuffle and no self-join for linear filters.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def _offsets(offsets) -> Column:
    return F.explode(F.array(*(F.struct(*(F.lit(int(d)).alias(f"d{a}") for a, d in zip(AXES, o, strict=True)), F.lit(float(w)).alias("w")) for o, w in offsets)))


def sent(voxels: DataFrame, by: list[str], offsets) -> DataFrame:
    """Rows (target voxel, source value v, weight w) for offsets [((dz, dy, dx), weight)]."""
    rows = voxels.select(*by, *AXES, "value", _offsets(offsets).alias("o"))
    return rows.select(*by, *((F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES), F.col("value").alias("v"), F.col("o.w").alias("w"))


def never_broadcast(rows: DataFrame) -> DataFrame:
    """For joins of voxels: Spark takes exploded rows, and files of constant images, for as small as they were before."""
    return rows.hint("merge")


def convolve(voxels: DataFrame, by: list[str], kernel: dict[tuple[int, int, int], float]) -> DataFrame:
    """out[i] = sum of kernel[d] * value[i - d] within the grid; outside it counts as 0."""
    summed = sent(voxels, by, list(kernel.items())).groupBy(*by, *AXES).agg(F.sum(F.col("w") * F.col("v")).alias("value"))
    return summed.join(voxels.select(*by, *AXES), [*by, *AXES], "left_semi")


def gaussian_kernel(fwhm: float, spacing: float = 1.0, normalise: bool = True) -> list[float]:
    sigma = fwhm / math.sqrt(8 * math.log(2)) / spacing
    half = math.ceil(sigma * math.sqrt(-2 * math.log(1e-6)))
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    total = sum(k) if normalise else sigma * math.sqrt(2 * math.pi)
    return [v / total for v in k]


def separable(voxels: DataFrame, by: list[str], kernels: dict[str, list[float]]) -> DataFrame:
    """One 1-D convolution an axis; each kernel is centred."""
    for axis, k in kernels.items():
        half = len(k) // 2
        voxels = convolve(voxels, by, {tuple((i - half) * (a == axis) for a in AXES): v for i, v in enumerate(k)})
    return voxels


def rank_filter(voxels: DataFrame, by: list[str], radius: int, kind: str) -> DataFrame:
    """Median, minimum or maximum over the neighbours within ``radius`` that lie in the grid."""
    box = [(o, 1.0) for o in itertools.product(range(-radius, radius + 1), repeat=3)]
    how = {"median": F.median, "min": F.min, "max": F.max}[kind]
    out = sent(voxels, by, box).groupBy(*by, *AXES).agg(how("v").alias("value"))
    return out.join(voxels.select(*by, *AXES), [*by, *AXES], "left_semi")


def neighbour_weights(spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)):
    """The 26 neighbours, weighted by the x spacing over their distance."""
    return [(o, spacing[2] / math.sqrt(sum((d * s) ** 2 for d, s in zip(o, spacing, strict=True)))) for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]


def _potential(kind: str, x: Column, y: Column, p: dict) -> tuple[Column, Column]:
    """Value of a pair and its derivative in x."""
    d = x - y
    if kind == "quadratic":
        return d * d / 4, d
    if kind == "relative_difference":
        g, e = p.get("gamma", 2.0), p.get("epsilon", 0.0)
        den = x + y + g * F.abs(d) + e
        slope = d * (g * F.abs(d) + x + 3 * y + 2 * e) / (den * den)
        return F.when(den == 0, 0.0).otherwise(d * d / den / 2), F.when(den == 0, 0.0).otherwise(slope)
    if kind == "logcosh":
        s = p.get("scalar", 1.0)
        a = F.abs(s * d)
        return F.when(a >= 30, a - math.log(2)).otherwise(F.log(F.cosh(a))) / (s * s), F.tanh(s * d) / s
    raise ValueError(kind)


def prior(voxels: DataFrame, by: list[str], kind: str, spacing=(1.0, 1.0, 1.0), **parameters) -> DataFrame:
    """Per voxel: its share of the prior's value, and the gradient."""
    pairs = sent(voxels, by, neighbour_weights(spacing)).join(never_broadcast(voxels), [*by, *AXES])
    value, slope = _potential(kind, F.col("value"), F.col("v"), parameters)
    return pairs.groupBy(*by, *AXES).agg(F.sum(F.col("w") * value).alias("prior"), F.sum(F.col("w") * slope).alias("gradient"))


def gamma_planes(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Per plane: values to [0, 1], raised to the power that moves the mean of those above 0.1 to a quarter, and back."""
    plane = [*by, "z"]
    w = Window.partitionBy(*plane)
    rows = voxels.withColumn("low", F.min("value").over(w)).withColumn("high", F.max("value").over(w))
    rows = rows.withColumn("s", F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")))
    rows = rows.withColumn("p", math.log(0.25) / F.log(F.avg(F.when(F.abs("s") > 0.1, F.col("s"))).over(w)))
    return rows.select(*by, *AXES, F.coalesce(F.pow("s", "p") * (F.col("high") - F.col("low")) + F.col("low"), F.col("value")).alias("value"))


def truncate_cylinder(voxels: DataFrame, centre: tuple[float, float], radius: float, strictly: bool = True) -> DataFrame:
    r2 = F.pow(F.col("y") - centre[0], F.lit(2)) + F.pow(F.col("x") - centre[1], F.lit(2))
    return voxels.withColumn("value", F.when(r2 < radius * radius if strictly else r2 <= radius * radius, F.col("value")).otherwise(0.0))


def floor_at_smallest(voxels: DataFrame, by: list[str], small: float = 1e-6) -> DataFrame:
    """Values below ``small`` times the smallest positive one are set to that."""
    least = F.min(F.when(F.col("value") > 0, F.col("value"))).over(Window.partitionBy(*by)) * small
    return voxels.withColumn("value", F.greatest("value", least))


def wiener_planes(voxels: DataFrame, by: list[str]) -> DataFrame:
    """Per plane, adaptive smoothing towards the mean of 3 x 3 pixels; the noise level is the plane's mean local variance.

    Pixels without all eight neighbours keep their value; they count in the mean's size with variance zero.
    """
    box = [((0, dy, dx), 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    key = [*by, *AXES]
    local = sent(voxels, by, box).groupBy(*key).agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("square"))
    rows = voxels.join(local, key).withColumn("var", F.when(F.col("k") == 9, F.col("square") - F.col("mean") * F.col("mean")).otherwise(0.0))
    rows = rows.withColumn("noise", F.avg("var").over(Window.partitionBy(*by, "z")))
    excess = F.greatest(F.col("var") - F.col("noise"), F.lit(0.0))
    smooth = F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.greatest("var", "noise")) * excess, F.lit(0.0)) + F.col("mean")
    return rows.select(*key, F.when(F.col("k") == 9, smooth).otherwise(F.col("value")).alias("value"))


def median_root_prior(voxels: DataFrame, by: list[str], radius: int, beta: float, most: float = 1000.0) -> DataFrame:
    """Gradient beta * (value / its median - 1), the quotient kept within ``most``; this prior's value is always 0."""
    filtered = rank_filter(voxels, by, radius, "median").withColumnRenamed("value", "filtered")
    ratio = F.coalesce(F.try_divide(F.col("value"), F.col("filtered")), F.when(F.col("value") == 0, 0.0).otherwise(F.signum("value") * most))
    ratio = F.least(F.greatest(ratio, F.lit(-most)), F.lit(most))
    return voxels.join(filtered, [*by, *AXES]).select(*by, *AXES, (beta * (ratio - 1)).alias("gradient"))
