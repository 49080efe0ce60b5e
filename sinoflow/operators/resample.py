"""Geometric resampling by weighted key joins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlap_weights(n_in: int, n_out: int, zoom: float, offset: float = 0.0) -> list[tuple[int, int, float]]:
    """(in, out, share of the input cell) for cells of width 1 about their indices, input coordinate = out / zoom + offset."""
    out = []
    for j in range(n_out):
        a, b = (j - 0.5) / zoom + offset, (j + 0.5) / zoom + offset
        for i in range(max(0, math.floor(a + 0.5)), min(n_in - 1, math.ceil(b + 0.5)) + 1):
            part = min(b, i + 0.5) - max(a, i - 0.5)
            if part > 1e-12:
                out.append((i, j, part))
    return out


def overlap_interpolate(rows: DataFrame, keys: list[str], axis: str, weights: list[tuple[int, int, float]], value: str = "value") -> DataFrame:
    """Count-preserving resampling of one axis; the weights are a table of the grid's size."""
    table = rows.sparkSession.createDataFrame(weights, f"{axis} int, __to int, __w double")
    joined = rows.join(F.broadcast(table), axis)
    return joined.groupBy(*keys, F.col("__to").alias(axis)).agg(F.sum(F.col(value) * F.col("__w")).alias(value))


def zoom_image(voxels: DataFrame, by: list[str], n: tuple[int, int, int], zooms: tuple[float, float, float], keep: str = "sum") -> DataFrame:
    """Overlap interpolation along z, y and x. keep: sum, values or projections decides the scale."""
    for axis, size, zoom in zip("zyx", n, zooms, strict=True):
        others = [a for a in "zyx" if a != axis]
        voxels = overlap_interpolate(voxels, [*by, *others], axis, overlap_weights(size, max(1, round(size * zoom)), zoom))
    scale = {"sum": 1.0, "values": zooms[0] * zooms[1] * zooms[2], "projections": zooms[0] * zooms[1]}[keep]
    return voxels.select(*by, "z", "y", "x", (F.col("value") * scale).alias("value"))


def invert_axis(voxels: DataFrame, axis: str, n: int) -> DataFrame:
    return voxels.withColumn(axis, F.lit(n - 1) - F.col(axis))


def warp(voxels: DataFrame, by: list[str], shift: tuple[float, float, float], n: tuple[int, int, int]) -> DataFrame:
    """Image moved by a displacement with linear interpolation; what comes from outside is 0.

    Each voxel sends its value to the two targets an axis that it contributes to, so no neighbour is joined.
    """
    rows = voxels
    for axis, d, size in zip("zyx", shift, n, strict=True):
        low = math.floor(d)
        f = d - low
        parts = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in ((low, 1 - f), (low + 1, f)) if w))
        rows = rows.withColumn("__p", F.explode(parts)).withColumn(axis, (F.col(axis) + F.col("__p.k")).cast("int")).withColumn("value", F.col("value") * F.col("__p.w")).drop("__p")
        rows = rows.filter(F.col(axis).between(0, size - 1))
    return rows.groupBy(*by, "z", "y", "x").agg(F.sum("value").alias("value"))
