"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoflow.llm import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the least node it is connected to) for every node of ``edges`` (a, b; longs).

    Every round is written to the shared folder, so a lost executor never repeats earlier rounds. Ends when a round
    changes nothing; the rounds grow with the logarithm of the largest component.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = common.materialize(edges, "components")
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, edges = edges, common.materialize(small.filter("a <> b").distinct(), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        common.discard(old)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
