"""Measures of images and curves: widths, maxima, contrast, displacement, frame means, noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoflow.operators.listmode import uniform
from sinoflow.operators.reduce import index_at_maximum

AXES = ("z", "y", "x")


def variation(regions: DataFrame) -> DataFrame:
    """Regions (mean, std) with their coefficient of variation."""
    return regions.withColumn("cv", F.try_divide("std", "mean"))


def contrast(regions: DataFrame, by: list[str], hot: str, cold: str, background: str, true_ratio: float) -> DataFrame:
    """Hot and cold contrast recovery and uniformity from the means of named regions (by, region, mean, std)."""
    of = lambda name, c: F.max(F.when(F.col("region") == name, F.col(c)))
    rows = regions.groupBy(*by).agg(of(hot, "mean").alias("h"), of(cold, "mean").alias("c"), of(background, "mean").alias("b"), of(background, "std").alias("s"))
    return rows.select(
        *by, ((F.try_divide("h", "b") - 1) / (true_ratio - 1)).alias("hot_recovery"), (1 - F.try_divide("c", "b")).alias("cold_recovery"), F.try_divide("s", "b").alias("uniformity")
    )


def find_maxima(voxels: DataFrame, by: list[str], n: int, reach: int = 1) -> DataFrame:
    """The n largest voxels of each image, none within ``reach`` of one before it along all axes: by, rank, z, y, x, value."""
    rest, found = voxels, None
    for rank in range(n):
        best = index_at_maximum(rest, by)
        row = best.select(*by, F.lit(rank + 1).alias("rank"), *AXES, "value")
        found = row if found is None else found.unionByName(row)
        near = F.lit(True)
        for a in AXES:
            near &= F.abs(F.col(a) - F.col(f"_{a}")) <= reach
        at = best.select(*by, *(F.col(a).alias(f"_{a}") for a in AXES))
        rest = rest.join(at, by).filter(~near).select(*voxels.columns)
    return found


def width_at(voxels: DataFrame, by: list[str], axis: str = "x", level: float = 0.5, spacing: float = 1.0) -> DataFrame:
    """Width of the profile through each image's maximum at a share of its peak.

    The peak is that of the parabola through the maximum and its two neighbours, the crossings lie on straight lines
    between samples; null where the profile does not fall to the level on both sides.
    """
    others = [a for a in AXES if a != axis]
    best = index_at_maximum(voxels, by).select(*by, *others, F.col(axis).alias("top"), F.col("value").alias("high"))
    line = voxels.join(best, [*by, *others]).groupBy(*by).agg(F.max("top").alias("top"), F.max("high").alias("high"), F.map_from_entries(F.collect_list(F.struct(F.col(axis), F.col("value")))).alias("v"), F.min(axis).alias("low"), F.max(axis).alias("end"))
    v, top, high = F.col("v"), F.col("top"), F.col("high")
    before, after = v[top - 1], v[top + 1]
    bend = before - 2 * high + after
    peak = F.when(bend < 0, high - (after - before) * (after - before) / (8 * bend)).otherwise(high)
    rows = line.withColumn("cut", F.coalesce(peak, high) * level)
    cut = F.col("cut")

    def crossing(steps: Column, sign: int) -> Column:
        """The first place outwards whose value is below the cut."""
        out = F.get(F.filter(steps, lambda k: v[top + sign * k] < cut), F.lit(0))
        a, b = v[top + sign * (out - 1)], v[top + sign * out]
        return out - 1 + (a - cut) / (a - b)

    steps = lambda n: F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    left, right = crossing(steps(top - F.col("low")), -1), crossing(steps(F.col("end") - top), 1)
    return rows.select(*by, ((left + right) * spacing).alias("width"))


def displaced(voxels: DataFrame, field: DataFrame, keys: list[str]) -> DataFrame:
    """Image pulled through a displacement field (keys, z, y, x, dz, dy, dx): the value at x + d(x), trilinear, 0 outside.

    Every voxel asks for the eight around its place; one equi-join and one sum.
    """
    corner = F.explode(F.array(*(F.struct(*(F.lit((k >> i) & 1).alias(a) for i, a in enumerate(AXES))) for k in range(8)))).alias("k")
    rows = field.select(*keys, *(F.col(a).alias(f"to_{a}") for a in AXES), *((F.col(a) + F.col(f"d{a}")).alias(f"at_{a}") for a in AXES), corner)
    weight, place = F.lit(1.0), {}
    for a in AXES:
        low = F.floor(f"at_{a}")
        part = F.col(f"at_{a}") - low
        place[a] = (low + F.col(f"k.{a}")).cast("int")
        weight = weight * F.when(F.col(f"k.{a}") == 1, part).otherwise(1 - part)
    rows = rows.select(*keys, *(f"to_{a}" for a in AXES), *(place[a].alias(a) for a in AXES), weight.alias("w"))
    met = rows.filter("w > 0").join(voxels.select(*keys, *AXES, "value"), [*keys, *AXES], "left")
    out = met.groupBy(*keys, *(f"to_{a}" for a in AXES)).agg(F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))).alias("value"))
    return out.withColumnsRenamed({f"to_{a}": a for a in AXES})


def shifted(voxels: DataFrame, by: dict[str, int]) -> DataFrame:
    """Image moved by whole voxels along axes."""
    return voxels.withColumns({a: (F.col(a) + n).cast("int") for a, n in by.items()})


def padded(voxels: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Planes of zeros from ``first`` to ``last`` where an image has none."""
    frame = voxels.select(*keys, "y", "x").distinct().select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("z"))
    return frame.join(voxels, [*keys, *AXES], "left").select(*keys, *AXES, F.coalesce("value", F.lit(0.0)).alias("value"))


def line_through(voxels: DataFrame, axis: str, at: dict[str, int]) -> DataFrame:
    """The voxels along an axis at given places on the others."""
    if set(at) != set(AXES) - {axis}:
        raise ValueError("give a place on each other axis")
    for a, k in at.items():
        voxels = voxels.filter(F.col(a) == k)
    return voxels


def frame_means(curve: DataFrame, frames: list[tuple[float, float]], by: list[str]) -> DataFrame:
    """Mean over frames of a curve (by, t, value) that is straight between samples and counts as 0 beyond them."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy("t")  # a curve has few samples
    rows = curve.select(*by, "t", "value", F.lead("t").over(w).alias("t2"), F.lead("value").over(w).alias("v2")).filter("t2 > t")
    frame = F.explode(F.array(*(F.struct(F.lit(i).alias("frame"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(frames, 1)))).alias("f")
    rows = rows.select("*", frame).select(*by, "t", "value", "t2", "v2", "f.*")
    rows = rows.filter((F.col("t2") > F.col("a")) & (F.col("t") < F.col("b")))
    at = lambda x: F.col("value") + (F.col("v2") - F.col("value")) * (x - F.col("t")) / (F.col("t2") - F.col("t"))
    low, high = F.greatest("t", "a"), F.least("t2", "b")
    return rows.groupBy(*by, "frame").agg((F.sum((high - low) * (at(low) + at(high)) / 2) / F.max(F.col("b") - F.col("a"))).alias("value"))


def poisson_noise(rows: DataFrame, keys: list[str], scale: float = 1.0, preserve_mean: bool = False, seed: int = 43) -> DataFrame:
    """Every value drawn from a Poisson distribution with it times ``scale`` as mean; the keys fix the draw.

    Means up to 60 by inverting the distribution, larger ones from a normal of equal mean and variance, rounded, 0 at least.
    """
    mean = F.col("value") * float(scale)
    u, w = uniform(keys, seed), uniform(keys, seed + 1)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))
    step = lambda a, i: F.when(a["sum"] > u, a).otherwise(F.struct((a["p"] * mean / i).alias("p"), (a["sum"] + a["p"] * mean / i).alias("sum"), (a["k"] + 1).alias("k")))
    small = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step)["k"].cast("double")
    large = F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * w)))
    drawn = F.when(mean <= 0, 0.0).when(mean <= 60, small).otherwise(large)
    return rows.withColumn("value", drawn / float(scale) if preserve_mean else drawn)
