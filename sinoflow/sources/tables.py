"""The engine's logical tables, and their generation from the driver's star schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN = ["segment", "view", "axial", "tang"]
VOXEL = ["image_id", "z", "y", "x"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or tempfile.gettempdir()
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str = "recon") -> DataFrame:
    """Written to the shared folder and read again: an iteration never repeats those before it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection bins from ``lineitem``: key, value (quantity) and weight (discount), many rows a bin."""
    i = lambda c: c.cast("int")
    return load(spark, sf_dir, "lineitem").select(
        i(F.pmod("l_suppkey", F.lit(5)) - 2).alias("segment"), i(F.pmod("l_partkey", F.lit(16))).alias("view"), i(F.pmod("l_orderkey", F.lit(8))).alias("axial"),
        i(F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(16)) - 8).alias("tang"), F.col("l_quantity").alias("value"), F.col("l_discount").alias("weight"),
    )


def projdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a bin: summed value."""
    return bins(spark, sf_dir).groupBy(*BIN).agg(F.sum("value").alias("value"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels from ``embeddings``: each vector is a plane of 8 x 8, eight vectors an image; values made positive."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.select(
        F.floor(F.col("vec_id") / 8).alias("image_id"), F.pmod("vec_id", F.lit(8)).cast("int").alias("z"), F.floor(F.col("i") / 8).cast("int").alias("y"),
        F.pmod("i", F.lit(8)).cast("int").alias("x"), F.abs(F.col("v").cast("double")).alias("value"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List-mode records from ``events``: record number, time in ms since the first, kind, and detectors on a ring of 64."""
    e = load(spark, sf_dir, "events")
    return _records(e.crossJoin(F.broadcast(e.agg(F.min("ts").alias("t0")))))  # one row


def as_records(events: DataFrame, first) -> DataFrame:
    """The same from a stream of events, its first time given."""
    return _records(events.withColumn("t0", F.lit(first)))


def _records(e: DataFrame) -> DataFrame:
    ms = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 1000)
    d1, d2 = F.pmod("user_id", F.lit(64)).cast("int"), F.pmod(F.col("user_id") * 7 + F.col("event_id"), F.lit(64)).cast("int")
    return e.select(
        F.col("event_id").alias("rec_no"), ms.alias("time_ms"), (F.col("event_type") != "error").alias("is_prompt"), F.col("event_type").alias("kind"),
        d1.alias("d1"), d2.alias("d2"), F.pmod("event_id", F.lit(8)).cast("int").alias("ring"),
    )
