"""Corrections, shapes and kinetic models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.operators.reduce import weighted_line
from sinoflow.sources.tables import saved


def efficiencies(bins: DataFrame, detectors: DataFrame) -> DataFrame:
    """Bins (d1, d2, ...) with the product of their detectors' efficiencies; ``detectors`` (det, eff) is a scanner's size."""
    e = lambda n: F.broadcast(detectors.select(F.col("det").alias(f"d{n}"), F.col("eff").alias(f"e{n}")))
    return bins.join(e(1), "d1").join(e(2), "d2").withColumn("eff", F.col("e1") * F.col("e2")).drop("e1", "e2")


def normalise(bins: DataFrame, undo: bool = False) -> DataFrame:
    eff = F.col("eff")
    return bins.withColumn("value", F.col("value") * eff if undo else F.col("value") / F.greatest(F.lit(1e-20), eff))


def attenuate(bins: DataFrame, integrals: DataFrame, keys: list[str], undo: bool = False) -> DataFrame:
    """Multiply by exp of the line integral of attenuation, or divide."""
    f = F.exp(F.col("li") if not undo else -F.col("li"))
    return bins.join(integrals.select(*keys, F.col("value").alias("li")), keys).withColumn("value", F.col("value") * f).drop("li")


def randoms(singles: DataFrame, window_s: float) -> DataFrame:
    """Randoms of detector pairs d1 < d2 from their singles rates: 2 tau r1 r2. The pairs are a scanner's size."""
    s = lambda n: singles.select(F.col("det").alias(f"d{n}"), F.col("rate").alias(f"r{n}"))
    return s(1).join(s(2), F.col("d1") < F.col("d2")).select("d1", "d2", (2 * window_s * F.col("r1") * F.col("r2")).alias("value"))


def tail_mask(acf: DataFrame, by: list[str], threshold: float, margin: int = 0) -> DataFrame:
    """1 from either edge of a line up to the first factor at or over ``threshold``, less ``margin``; lines without such are all 1."""
    over = F.when(F.col("value") >= threshold, F.col("tang"))
    ends = acf.groupBy(*by).agg(F.min(over).alias("first"), F.max(over).alias("last"))
    t = F.col("tang")
    return acf.join(ends, by).select(*by, "tang", F.when(F.col("first").isNull() | (t < F.col("first") - margin) | (t > F.col("last") + margin), 1).otherwise(0).alias("mask"))


def triple_window(rows: DataFrame, lower: str, upper: str, main_kev: float, side_kev: float) -> DataFrame:
    """Scatter in the main window as the trapezoid under the counts of two side windows."""
    return rows.withColumn("scatter", (F.col(lower) / side_kev + F.col(upper) / side_kev) * main_kev / 2)


def inside(kind: str, z, y, x, centre: tuple[float, float, float], size: tuple[float, float, float]):
    """Whether a point lies in an ellipsoid, elliptic cylinder or box of half sizes (z, y, x)."""
    d = [(c - m) / s for c, m, s in zip((z, y, x), centre, size, strict=True)]
    if kind == "ellipsoid":
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= 1
    if kind == "cylinder":
        return (F.abs(d[0]) <= 1) & (d[1] * d[1] + d[2] * d[2] <= 1)
    return (F.abs(d[0]) <= 1) & (F.abs(d[1]) <= 1) & (F.abs(d[2]) <= 1)


def rasterise(spark, n: tuple[int, int, int], kind: str, centre, size, samples: int = 1) -> DataFrame:
    """Share of each voxel inside a shape, from ``samples`` points an axis."""
    nz, ny, nx = n
    i = F.col("id")
    grid = spark.range(nz * ny * nx).select(F.floor(i / (ny * nx)).cast("int").alias("z"), F.floor(F.pmod(i, F.lit(ny * nx)) / nx).cast("int").alias("y"), F.pmod(i, F.lit(nx)).cast("int").alias("x"))
    subs = F.explode(F.array(*(F.lit((k + 0.5) / samples - 0.5) for k in range(samples))))
    pts = grid.withColumn("sz", subs).withColumn("sy", subs).withColumn("sx", subs)
    hit = inside(kind, F.col("z") + F.col("sz"), F.col("y") + F.col("sy"), F.col("x") + F.col("sx"), centre, size)
    return pts.groupBy("z", "y", "x").agg(F.avg(hit.cast("double")).alias("value"))


def patlak(frames: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """Per voxel: slope and intercept of tissue over plasma against normalised plasma integral.

    frames: by, frame, value. model: frame, plasma, integral (a row a frame).
    """
    rows = frames.join(F.broadcast(model), "frame")
    line = weighted_line(rows, by, F.col("integral") / F.col("plasma"), F.col("value") / F.col("plasma"), F.lit(1.0))
    return line.select(*by, F.col("slope").alias("ki"), F.col("intercept").alias("vb"))


def divide_and_truncate(bins: DataFrame, viewgram: list[str], rim: tuple[int, int], small: float = 1e-6, most: float = 10_000.0) -> DataFrame:
    """``num`` over ``den``: 0 where both are small against the viewgram's largest numerator, at most ``most``, 0 outside the rim."""
    least = F.max("num").over(Window.partitionBy(*viewgram)) * small
    quotient = F.when((F.abs("num") <= least) & (F.abs("den") <= least), 0.0).otherwise(F.least(F.coalesce(F.try_divide("num", "den"), F.lit(most)), F.lit(most)))
    return bins.withColumn("value", F.when(F.col("tang").between(*rim), quotient).otherwise(0.0))


def triple_energy_window(windows: DataFrame, keys: list[str], widths: tuple[float, float, float]) -> DataFrame:
    """Scatter of the main window from those below and above it (columns low, main, high): a trapezoid between their rates."""
    low, main, high = widths
    scatter = (F.col("low") / low + F.col("high") / high) * (main / 2)
    return windows.select(*keys, scatter.alias("scatter"), F.greatest(F.col("main") - scatter, F.lit(0.0)).alias("value"))


def precorrect(bins: DataFrame, undo: bool = False) -> DataFrame:
    """(value - randoms) * norm * acf - scatter, for columns of these names; ``undo`` reverts it."""
    factor = F.col("norm") * F.col("acf")
    done = (F.col("value") + F.col("scatter")) / factor + F.col("randoms") if undo else (F.col("value") - F.col("randoms")) * factor - F.col("scatter")
    return bins.withColumn("value", done)


def block_sums(pairs: DataFrame, crystals: int) -> DataFrame:
    """Detector-pair data summed over pairs of blocks of ``crystals`` detectors."""
    block = lambda c: F.floor(F.col(c) / crystals).cast("int")
    return pairs.groupBy(block("d1").alias("b1"), block("d2").alias("b2")).agg(F.sum("value").alias("value"))


def ml_efficiencies(pairs: DataFrame, detectors: DataFrame, n_updates: int) -> DataFrame:
    """Maximum-likelihood detector efficiencies (det, eff) from pairs (d1, d2, value, model), damped simultaneous updates.

    eff <- eff * sqrt(fan sum of the data / fan sum of the model times both efficiencies); from 1 at every detector.
    """
    ends = F.explode(F.array(F.struct(F.col("d1").alias("det"), F.col("d2").alias("other")), F.struct(F.col("d2").alias("det"), F.col("d1").alias("other"))))
    both = pairs.filter("d1 <> d2").select(ends.alias("e"), "value", "model").select("e.det", "e.other", "value", "model")
    both = saved(both.groupBy("det", "other").agg(F.sum("value").alias("value"), F.sum("model").alias("model")), "fans")
    eff = detectors.select("det", F.lit(1.0).alias("eff"))
    for _ in range(n_updates):
        other = eff.select(F.col("det").alias("other"), F.col("eff").alias("far"))  # a scanner's size
        fans = both.join(F.broadcast(other), "other").groupBy("det").agg(F.sum("value").alias("fan"), F.sum(F.col("model") * F.col("far")).alias("expected"))
        factor = F.coalesce(F.sqrt(F.try_divide(F.col("fan"), F.col("expected") * F.col("eff"))), F.lit(0.0))
        eff = saved(eff.join(fans, "det", "left").select("det", (F.col("eff") * factor).alias("eff")), "eff")
    return eff


def dynamic_from_parameters(parameters: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Dynamic image of a linear kinetic model: per frame ki * integral + vb * plasma; ``model`` has a row a frame."""
    rows = parameters.crossJoin(F.broadcast(model))  # frames are few
    return rows.select(*keys, "frame", (F.col("ki") * F.col("integral") + F.col("vb") * F.col("plasma")).alias("value"))
