"""List-mode events: frames, gates, signed histograms and count rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.functions.scalar import view_of_detectors


def frame_of(time_s: Column, frames: list[tuple[float, float]]) -> Column:
    """Number from 1 of the frame [start, end) that holds a time; null in gaps. Frames are ordered and disjoint."""
    if any(a >= b for a, b in frames) or any(x[1] > y[0] for x, y in zip(frames, frames[1:], strict=False)):
        raise ValueError("frames must be ordered and disjoint")
    found = F.lit(None).cast("int")
    for i, (a, b) in enumerate(frames, 1):
        found = F.when((time_s >= a) & (time_s < b), i).otherwise(found)
    return found


def carry_time(records: DataFrame, stream: list[str] | None = None) -> DataFrame:
    """Give events the time of the last time record before them (0 before the first), per stream."""
    by = Window.partitionBy(*stream or [F.lit(0)]).orderBy("rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("time_ms", F.coalesce(F.last(F.when(F.col("kind") == "time", F.col("time_ms")), ignorenulls=True).over(by), F.lit(0)))


def bin_events(events: DataFrame, n_detectors: int, frames: list[tuple[float, float]], delayed: int = -1, prompts: bool = True, max_tang: int | None = None) -> DataFrame:
    """Signed histogram of events: frame, ring, view, tang, value. Prompts add 1, delayeds ``delayed`` (-1, 0 or 1).

    One map-side combined aggregation; the frame and the bin are expressions, so nothing is joined.
    """
    view, tang, _ = view_of_detectors(F.col("d1"), F.col("d2"), n_detectors)
    weight = F.when(F.col("is_prompt"), F.lit(1 if prompts else 0)).otherwise(F.lit(delayed))
    rows = events.select(frame_of(F.col("time_ms") / 1000.0, frames).alias("frame"), "ring", view.alias("view"), tang.alias("tang"), weight.alias("w"))
    rows = rows.filter(F.col("frame").isNotNull() & (F.col("w") != 0))
    if max_tang is not None:
        rows = rows.filter(F.abs("tang") <= max_tang)
    return rows.groupBy("frame", "ring", "view", "tang").agg(F.sum("w").alias("value"))


def until_net_counts(events: DataFrame, counts: int, stream: list[str]) -> DataFrame:
    """Events of each stream up to the one at which prompts minus delayeds first reach ``counts``."""
    by = Window.partitionBy(*stream).orderBy("rec_no")
    net = F.sum(F.when(F.col("is_prompt"), 1).otherwise(-1)).over(by)
    before = F.max("net").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("net", net).withColumn("before", before).filter(F.coalesce(F.col("before") < counts, F.lit(True))).drop("net", "before")


def count_rates(events: DataFrame, step_s: float) -> DataFrame:
    slot = F.floor(F.col("time_ms") / (1000.0 * step_s))
    return events.groupBy(slot.alias("slot")).agg(F.count_if("is_prompt").alias("prompts"), F.count_if(~F.col("is_prompt")).alias("delayeds"))


def fan_sums(events: DataFrame) -> DataFrame:
    """Prompts per detector, both ends counted."""
    ends = events.filter("is_prompt").select("ring", F.explode(F.array("d1", "d2")).alias("det"))
    return ends.groupBy("ring", "det").agg(F.count(F.lit(1)).alias("n"))


def singles_rebin(slices: DataFrame, step: float) -> DataFrame:
    """Counts of time slices (unit, start_s, end_s, n) re-sliced in steps from 0 in proportion to overlap, however long the scan.

    Shares of a step are added in order of time, so that the last digit does not depend on how rows are dealt out.
    """
    whole = F.sequence(F.floor(F.col("start_s") / step), F.ceil(F.col("end_s") / step) - 1)  # only slices that overlap
    rows = slices.filter("end_s > start_s").select("unit", "start_s", "end_s", "n", F.explode(whole).alias("k")).withColumn("a", F.col("k") * float(step))
    overlap = F.least("end_s", F.col("a") + step) - F.greatest("start_s", "a")
    rows = rows.withColumn("part", F.col("n") * overlap / (F.col("end_s") - F.col("start_s")))
    by = Window.partitionBy("unit", "a").orderBy("start_s", "end_s", "n")
    rows = rows.select("unit", "a", F.sum("part").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.row_number().over(by).alias("i"))
    return rows.groupBy("unit", F.col("a").alias("slice_s")).agg(F.max_by("sum", "i").alias("n"))


def rate_in(slices: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Mean rate of each unit over [start_s, end_s]; a slice counts as far as it lies within."""
    part = (F.least("end_s", F.lit(end_s)) - F.greatest("start_s", F.lit(start_s))) / (F.col("end_s") - F.col("start_s"))
    rows = slices.filter((F.col("end_s") > start_s) & (F.col("start_s") < end_s))
    return rows.groupBy("unit").agg((F.sum(F.col("n") * part) / (end_s - start_s)).alias("rate"))


def keep_at_random(events: DataFrame, share: float, key: str = "rec_no", seed: int = 42) -> DataFrame:
    """Each event stays with probability ``share``. Its key decides, so that a task that runs again keeps the same."""
    return events.filter(uniform([key], seed) < share)


def uniform(keys: list[str], seed: int) -> Column:
    """A number in [0, 1) that a row's keys fix."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11).cast("double") / float(1 << 53)
