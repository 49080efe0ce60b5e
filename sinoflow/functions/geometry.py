"""Geometry of a cylindrical scanner as column expressions: ring pairs, bins, lines and timing positions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoflow.functions.scalar import MM_PER_PS, detectors_of_view, view_of_detectors


@dataclass(frozen=True)
class Scanner:
    """Rings of detectors on a cylinder; lengths in mm, timing positions in ps. ``span`` (odd) ring differences make a segment."""

    rings: int
    detectors: int
    radius: float
    ring_spacing: float
    span: int = 1
    tof_positions: int = 1
    tof_bin_ps: float = 0.0
    tof_mash: int = 1

    @property
    def sampling(self) -> float:
        """Axial distance of the slices of a segment."""
        return self.ring_spacing if self.span == 1 else self.ring_spacing / 2


def round_away(x: Column) -> Column:
    """Nearest whole number, halves away from 0."""
    return F.round(x).cast("int")


def segment_of(ring1: Column, ring2: Column, scanner: Scanner) -> Column:
    return F.floor((ring2 - ring1 + scanner.span // 2) / scanner.span).cast("int")


def _least_difference(segment: Column, scanner: Scanner) -> Column:
    return F.greatest(F.lit(0), F.abs(segment) * scanner.span - scanner.span // 2)


def axial_of(ring1: Column, ring2: Column, scanner: Scanner) -> Column:
    """Axial position within the segment: slices of equal middle share one."""
    place = ring1 + ring2 - _least_difference(segment_of(ring1, ring2, scanner), scanner)
    return F.floor(place / 2).cast("int") if scanner.span == 1 else place


def m_of(segment: Column, axial: Column, scanner: Scanner) -> Column:
    """Axial coordinate of a bin's middle, 0 at the middle of the scanner."""
    twice = axial * 2 if scanner.span == 1 else axial
    return (twice + _least_difference(segment, scanner) - (scanner.rings - 1)) * (scanner.ring_spacing / 2)


def s_of(tang: Column, scanner: Scanner) -> Column:
    """Distance of the line from the axis."""
    return F.lit(scanner.radius) * F.sin(tang * (math.pi / scanner.detectors))


def phi_of(view: Column, scanner: Scanner) -> Column:
    return view * (2 * math.pi / scanner.detectors)


def tan_theta_of(segment: Column, tang: Column, scanner: Scanner) -> Column:
    """Slope of the line: the segment's mean ring difference over the chord."""
    s = s_of(tang, scanner)
    return segment * (scanner.span * scanner.ring_spacing) / (2 * F.sqrt(scanner.radius**2 - s * s))


def t_of(segment: Column, axial: Column, tang: Column, scanner: Scanner) -> Column:
    slope = tan_theta_of(segment, tang, scanner)
    return m_of(segment, axial, scanner) / F.sqrt(1 + slope * slope)


def k_of(tof: Column, scanner: Scanner) -> Column:
    """Offset along the line, in mm, of a mashed timing position."""
    return tof * (scanner.tof_bin_ps * scanner.tof_mash * MM_PER_PS / 2)


def mm_to_ps(mm: Column) -> Column:
    return mm / (MM_PER_PS / 2)


def ring_pairs(spark: SparkSession, scanner: Scanner, most_difference: int | None = None) -> DataFrame:
    """ring1, ring2, segment, axial of all ring pairs, or of those up to a difference."""
    r1, r2 = F.floor(F.col("id") / scanner.rings).cast("int").alias("ring1"), F.pmod("id", F.lit(scanner.rings)).cast("int").alias("ring2")
    rows = spark.range(scanner.rings**2).select(r1, r2)
    if most_difference is not None:
        rows = rows.filter(F.abs(F.col("ring1") - F.col("ring2")) <= most_difference)
    a, b = F.col("ring1"), F.col("ring2")
    return rows.withColumn("segment", segment_of(a, b, scanner)).withColumn("axial", axial_of(a, b, scanner))


def bin_of_pair(pairs: DataFrame, scanner: Scanner) -> DataFrame:
    """``pairs`` (d1, ring1, d2, ring2, tof unmashed) with segment, view, axial, tang and the mashed timing position.

    If the detectors of a pair change places, so do the rings, and the timing position changes sign; of an even number
    of positions the middle lies between two, which moves it by one.
    """
    view, tang, swapped = view_of_detectors(F.col("d1"), F.col("d2"), scanner.detectors)
    first, second = F.when(swapped, F.col("ring2")).otherwise(F.col("ring1")), F.when(swapped, F.col("ring1")).otherwise(F.col("ring2"))
    mashed = round_away(F.col("tof") / scanner.tof_mash) if scanner.tof_positions > 1 else F.lit(0)
    even = 1 if scanner.tof_positions > 1 and (scanner.tof_positions // scanner.tof_mash) % 2 == 0 else 0
    mashed = F.when(swapped, -mashed - even).otherwise(mashed)
    rows = pairs.withColumns({"view": view, "tang": tang, "_r1": first, "_r2": second, "_tof": mashed})
    rows = rows.withColumn("segment", segment_of(F.col("_r1"), F.col("_r2"), scanner)).withColumn("axial", axial_of(F.col("_r1"), F.col("_r2"), scanner))
    return rows.withColumn("tof", F.col("_tof")).drop("_r1", "_r2", "_tof")


def pairs_of_bin(bins: DataFrame, scanner: Scanner, view_mash: int = 1) -> DataFrame:
    """A row for each detector and ring pair that falls into a bin: the bin's columns with d1, d2, ring1, ring2."""
    views = F.explode(F.sequence(F.col("view") * view_mash, F.col("view") * view_mash + view_mash - 1)).alias("_view")
    rows = bins.select("*", views)
    d1, d2 = detectors_of_view(F.col("_view"), F.col("tang"), scanner.detectors)
    rows = rows.withColumns({"d1": d1, "d2": d2}).drop("_view")
    return rows.join(F.broadcast(ring_pairs(bins.sparkSession, scanner)), ["segment", "axial"])  # rings squared, whatever the data


def line_ends(d1: Column, d2: Column, scanner: Scanner) -> list[Column]:
    """x1, y1, x2, y2 of the two detectors of a pair."""
    turn = 2 * math.pi / scanner.detectors
    return [scanner.radius * f(d * turn) for d in (d1, d2) for f in (F.cos, F.sin)]


def nearest_pair(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column, scanner: Scanner) -> list[Column]:
    """d1, ring1, d2, ring2 of the detectors next to two points on the cylinder; z is 0 at the first ring."""
    turn = scanner.detectors / (2 * math.pi)
    det = lambda x, y: F.pmod(round_away(F.atan2(y, x) * turn), F.lit(scanner.detectors))
    ring = lambda z: round_away(z / scanner.ring_spacing)
    return [det(x1, y1), ring(z1), det(x2, y2), ring(z2)]
