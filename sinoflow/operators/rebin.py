"""Re-binning of projection data: new keys and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def axial_map(axial_sizes: dict[int, int], segments: int) -> list[tuple[int, int, int, int, int]]:
    """(segment, axial, new segment, new axial, slices that share it) for every slice of a scanner.

    Slices of a segment lie a sampling apart about the scanner's middle; those of equal coordinate meet.
    """
    place = {(s, a): ((s + segments // 2) // segments, 2 * a - (n - 1)) for s, n in axial_sizes.items() for a in range(n)}
    slices = sorted(set(place.values()))
    first = {}
    for i, (s, _) in enumerate(slices):
        first.setdefault(s, i)
    share = {k: sum(v == k for v in place.values()) for k in slices}
    return [(s, a, k[0], slices.index(k) - first[k[0]], share[k]) for (s, a), k in sorted(place.items())]


def ssrb(bins: DataFrame, axial_sizes: dict[int, int], segments: int, mash_views: int = 1, max_tang: int | None = None, normalise: bool = True) -> DataFrame:
    """Single-slice rebinning: ``segments`` neighbouring segments and ``mash_views`` views are added.

    Slices meet at the same axial coordinate, by ``axial_sizes``, the axial positions of each segment; with
    ``normalise`` a sum is divided by the slices times views that make up the new bin, with counts or not.
    """
    rows = bins if max_tang is None else bins.filter(F.abs("tang") <= max_tang)
    spark = bins.sparkSession
    made = spark.createDataFrame(axial_map(axial_sizes, segments), "segment int, axial int, new_segment int, new_axial int, share int")
    rows = rows.join(F.broadcast(made), ["segment", "axial"])  # a row a slice of the scanner
    view = F.floor(F.col("view") / mash_views).cast("int")
    key = [F.col("new_segment").alias("segment"), view.alias("view"), F.col("new_axial").alias("axial"), "tang"]
    summed = rows.groupBy(*key).agg(F.sum("value").alias("total"), F.max("share").alias("share"))
    total = F.col("total") / (F.col("share") * mash_views) if normalise else F.col("total")
    return summed.select("segment", "view", "axial", "tang", total.alias("value"))


def inverse_ssrb(direct: DataFrame, direct_size: int, axial_sizes: dict[int, int]) -> DataFrame:
    """Bins of all segments from direct slices (view, axial, tang, value), linear between the two nearest axial coordinates; none beyond the ends."""
    parts = []
    for s, n in axial_sizes.items():
        for a in range(n):
            at = a - (n - 1) / 2 + (direct_size - 1) / 2
            low = int(at // 1)
            parts += [(s, a, low + k, w) for k, w in ((0, 1 - (at - low)), (1, at - low)) if w > 0 and 0 <= low + k < direct_size]
    made = direct.sparkSession.createDataFrame(parts, "segment int, new_axial int, axial int, w double")
    rows = direct.join(F.broadcast(made), "axial")  # two rows a slice of the scanner
    return rows.groupBy("segment", "view", F.col("new_axial").alias("axial"), "tang").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def zero_end_planes(bins: DataFrame, axial_sizes: dict[int, int], segment: int = 0) -> DataFrame:
    """The first and the last slice of a segment set to 0."""
    ends = (F.col("segment") == segment) & F.col("axial").isin(0, axial_sizes[segment] - 1)
    return bins.withColumn("value", F.when(ends, F.lit(0).cast("double")).otherwise(F.col("value")))


def project_axis(bins: DataFrame, keep: list[str]) -> DataFrame:
    """Sum over all other axes."""
    return bins.groupBy(*keep).agg(F.sum("value").alias("value"))


def scale_factors(num: DataFrame, den: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Per sinogram: sum(num * weight) / sum(den * weight), 1 where the latter is 0."""
    both = num.select(*keys, F.col("value").alias("n"), "weight").join(den.select(*keys, F.col("value").alias("d")), keys)
    s = both.groupBy(*by).agg(F.sum(F.col("n") * F.col("weight")).alias("n"), F.sum(F.col("d") * F.col("weight")).alias("d"))
    return s.select(*by, F.when(F.col("d") == 0, 1.0).otherwise(F.try_divide("n", "d")).alias("factor"))


def apply_factors(bins: DataFrame, factors: DataFrame, by: list[str]) -> DataFrame:
    """Factors are one row a sinogram: a small dimension whatever the counts."""
    return bins.join(factors, by).withColumn("value", F.col("value") * F.col("factor")).drop("factor")


def extend_segment(bins: DataFrame, n_views: int, by: int) -> DataFrame:
    """Views continued by ``by`` on either side: half a turn further the tangential axis is mirrored."""
    low = bins.filter(F.col("view") < by).select("segment", (F.col("view") + n_views).alias("view"), "axial", (-F.col("tang")).alias("tang"), "value")
    high = bins.filter(F.col("view") >= n_views - by).select("segment", (F.col("view") - n_views).alias("view"), "axial", (-F.col("tang")).alias("tang"), "value")
    return bins.select("segment", "view", "axial", "tang", "value").unionByName(low).unionByName(high)


def tof_mash(bins: DataFrame, factor: int) -> DataFrame:
    """Timing positions added in groups about 0; halves round away from 0."""
    return bins.groupBy("segment", "view", "axial", "tang", F.round(F.col("tof") / factor).cast("int").alias("tof")).agg(F.sum("value").alias("value"))
