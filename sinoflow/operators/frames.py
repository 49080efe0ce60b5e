"""Frames and gates of dynamic data, arc correction, fan sums of projection data, replicated events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.functions import geometry
from sinoflow.functions.scalar import decay_factor
from sinoflow.operators import listmode, recon, resample
from sinoflow.sources.tables import saved


def calibrated(images: DataFrame, frames: list[tuple[float, float]], half_life_s: float, calibration: float = 1.0) -> DataFrame:
    """Values of each frame (1, 2, ...) corrected for decay to time 0, times the calibration factor; a frame without times raises."""
    cases = F.create_map(*(c for i, (a, b) in enumerate(frames, 1) for c in (F.lit(i), decay_factor(F.lit(a), F.lit(b), half_life_s))))
    factor = F.coalesce(cases[F.col("frame")], F.raise_error(F.lit("frame without times")).cast("double"))
    return images.withColumn("value", F.col("value") * factor * calibration)


def restricted(bins: DataFrame, most_segment: int, most_tof: int | None = None) -> DataFrame:
    """Bins of segments, and timing positions, up to a number on both sides of 0."""
    rows = bins.filter(F.abs("segment") <= most_segment)
    return rows if most_tof is None else rows.filter(F.abs("tof") <= most_tof)


def arc_weights(scanner: geometry.Scanner, tangs: range, sampling: float) -> list[tuple[int, int, float]]:
    """(tang, new tang, share of the new bin's width) from bins of equal angle to bins of equal width."""
    edge = lambda t: scanner.radius * math.sin((t - 0.5) * math.pi / scanner.detectors)
    far = lambda t: scanner.radius * math.sin(t * math.pi / scanner.detectors)
    most = math.ceil(max(far(tangs[-1] + 2), -far(tangs[0] - 2)) / sampling)
    out = []
    for j in range(-most, most + 1):
        for t in tangs:
            part = min(edge(t + 1), (j + 0.5) * sampling) - max(edge(t), (j - 0.5) * sampling)
            if part > 0:
                out.append((t, j, part / sampling))
    return out


def arc_corrected(bins: DataFrame, keys: list[str], scanner: geometry.Scanner, tangs: range, sampling: float | None = None) -> DataFrame:
    """Projection data resampled along ``tang`` to equal distances; without ``sampling`` the middle bin's width."""
    width = sampling or scanner.radius * math.sin(math.pi / scanner.detectors)
    return resample.overlap_interpolate(bins, keys, "tang", arc_weights(scanner, tangs, width))


def detector_pair_data(bins: DataFrame, scanner: geometry.Scanner) -> DataFrame:
    """d1, ring1, d2, ring2, value: the bins' values at each of their detector pairs (a pair once, no axial compression)."""
    if scanner.span != 1:
        raise ValueError("detector-pair data need a span of 1")
    return geometry.pairs_of_bin(bins, scanner).select("d1", "ring1", "d2", "ring2", "value")


def fan_sums(bins: DataFrame, scanner: geometry.Scanner) -> DataFrame:
    """Sum of all bins that a detector has part in."""
    ends = F.explode(F.array(F.struct(F.col("ring1").alias("ring"), F.col("d1").alias("det")), F.struct(F.col("ring2").alias("ring"), F.col("d2").alias("det"))))
    rows = detector_pair_data(bins, scanner).select(ends.alias("e"), "value")
    return rows.groupBy("e.ring", "e.det").agg(F.sum("value").alias("value"))


def attenuation_factors(matrix: DataFrame, mu: DataFrame, by: list[str], cm: float = 0.1) -> DataFrame:
    """exp of the line integrals of an attenuation image in 1/cm; ``cm`` is the matrix's unit of length, mm as it stands."""
    return recon.forward(matrix, mu, by).withColumn("value", F.exp(F.col("value") * cm))


def summary(events: DataFrame, by: list[str]) -> DataFrame:
    """Numbers of records, prompts and delayeds, times of the first and the last."""
    prompt = F.col("is_prompt").cast("long")
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.sum(prompt).alias("prompts"), F.sum(1 - prompt).alias("delayeds"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms")
    )


def gated_counts(events: DataFrame, triggers: DataFrame, gates: int, stream: list[str]) -> DataFrame:
    """Events by the phase of the cycle that they lie in: gate 1 to ``gates`` of equal share; outside whole cycles none.

    ``triggers`` (stream, start_ms, end_ms) are cycles that do not overlap. Cycles and events meet in pieces of a common length,
    so that the join is on equal keys whatever a stream's length.
    """
    piece = triggers.agg(F.greatest(F.lit(1.0), F.avg(F.col("end_ms") - F.col("start_ms"))).alias("piece"))
    slot = lambda c: F.floor(F.col(c) / F.col("piece"))
    cycles = triggers.filter("end_ms > start_ms").crossJoin(F.broadcast(piece))  # one row
    cycles = cycles.select(*stream, "start_ms", "end_ms", F.explode(F.sequence(slot("start_ms"), F.floor((F.col("end_ms") - 1) / F.col("piece")))).alias("_slot"))
    rows = events.crossJoin(F.broadcast(piece)).withColumn("_slot", slot("time_ms"))
    met = rows.join(cycles, [*stream, "_slot"]).filter("time_ms >= start_ms AND time_ms < end_ms")
    phase = (F.col("time_ms") - F.col("start_ms")) * gates / (F.col("end_ms") - F.col("start_ms"))
    return met.groupBy(*stream, (F.floor(phase) + 1).cast("int").alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def bootstrap(events: DataFrame, by: list[str], key: str = "rec_no", seed: int = 42) -> DataFrame:
    """by, key, times: how often each event is drawn when as many are drawn with replacement as there are (per ``by``).

    Events are numbered over key ranges, written once; the draws come from a hash of the key, so that tasks that run again
    draw the same. Events never drawn have 0.
    """
    rows = saved(events.select(*by, key).repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "events")
    sizes = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_size"))  # a row for each key range
    all_of = Window.partitionBy(*by)
    sizes = sizes.withColumn("_total", F.sum("_size").over(all_of)).withColumn("_before", F.sum("_size").over(all_of.orderBy("_part")) - F.col("_size"))
    placed = rows.join(sizes, [*by, "_part"])
    number = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_part").orderBy(key)) - 1
    drawn = placed.select(*by, F.floor(listmode.uniform([key], seed) * F.col("_total")).alias("_number")).groupBy(*by, "_number").agg(F.count(F.lit(1)).alias("times"))
    found = placed.select(*by, key, number.alias("_number")).join(drawn, [*by, "_number"], "left")
    return found.select(*by, key, F.coalesce("times", F.lit(0)).alias("times"))
