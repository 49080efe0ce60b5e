"""System matrix of lines through a grid of pixels, traced as column expressions: one row a bin becomes one row a pixel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines this near to a pixel border run along it and are split between both sides (in pixels).
NEAR = 1e-6


def ray_matrix(spark: SparkSession, n_views: int, n_tang: int, n: int, spacing: float = 1.0, rays: int = 1) -> DataFrame:
    """view, t, y, x, a: the length of line (view, t) within pixel (y, x) of an n x n grid of unit pixels about the axis.

    Views share half a turn, lines of a view lie ``spacing`` apart about the axis, with ``rays`` evenly in a bin's
    width. A line cuts the grid's borders at sorted places; each piece between two of them lies in one pixel. Lines
    along a border go half to either side. No bin needs another, so nothing is shuffled but to add the rays of a bin.
    """
    half, eps = n / 2, 1e-9
    bins = spark.range(n_views * n_tang).select(F.floor(F.col("id") / n_tang).cast("int").alias("view"), F.pmod("id", F.lit(n_tang)).cast("int").alias("t"))
    shift = F.explode(F.array(*(F.lit(((k + 0.5) / rays - 0.5) * spacing) for k in range(rays)))).alias("shift")
    rows = bins.select("view", "t", shift).select("view", "t", ((F.col("t") - (n_tang - 1) / 2) * spacing + F.col("shift")).alias("s"), (F.col("view") * (math.pi / n_views)).alias("phi"))
    rows = rows.withColumns({"c": F.cos("phi"), "d": F.sin("phi")})
    c, d, s = F.col("c"), F.col("d"), F.col("s")
    straight = (F.abs(c) < eps) | (F.abs(d) < eps)
    on_border = straight & (F.abs(s + half - F.round(s + half)) < NEAR)
    sides = F.when(on_border, F.array(F.lit(-NEAR), F.lit(NEAR))).otherwise(F.array(F.lit(0.0)))
    rows = rows.withColumn("weight", F.when(on_border, 0.5).otherwise(1.0) / rays).withColumn("side", F.explode(sides)).withColumn("s", s + F.col("side"))
    border = F.sequence(F.lit(0), F.lit(n))
    # points of the line are (s c - u d, s d + u c)
    cuts_x = F.when(F.abs(d) < eps, F.array().cast("array<double>")).otherwise(F.transform(border, lambda k: (s * c - (k - half)) / d))
    cuts_y = F.when(F.abs(c) < eps, F.array().cast("array<double>")).otherwise(F.transform(border, lambda k: ((k - half) - s * d) / c))
    rows = rows.withColumn("u", F.array_sort(F.concat(cuts_x, cuts_y)))
    pieces = F.zip_with(F.slice("u", F.lit(1), F.size("u") - 1), F.slice("u", F.lit(2), F.size("u") - 1), lambda a, b: F.struct(((a + b) / 2).alias("middle"), (b - a).alias("long")))
    rows = rows.select("view", "t", "weight", "s", "c", "d", F.explode(pieces).alias("p"))
    x, y = F.floor(s * c - F.col("p.middle") * d + half), F.floor(s * d + F.col("p.middle") * c + half)
    rows = rows.select("view", "t", y.cast("int").alias("y"), x.cast("int").alias("x"), (F.col("p.long") * F.col("weight")).alias("a"))
    rows = rows.filter((F.col("a") > eps) & F.col("x").between(0, n - 1) & F.col("y").between(0, n - 1))
    return rows.groupBy("view", "t", "y", "x").agg(F.sum("a").alias("a")) if rays > 1 else rows
