"""Structured Streaming over list-mode records: signed histograms and count rates kept up to date while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoflow.operators import listmode
from sinoflow.sources.tables import shared_folder


def run_available(stream: DataFrame, label: str, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there and return what it gave.

    Complete mode: the last batch's table. Append mode: all batches. Each batch goes to a folder of its own number,
    so a batch that is repeated after a failure overwrites itself.
    """
    spark = stream.sparkSession
    out = shared_folder(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_folder(spark, f"{label}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    target = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], stream.schema)  # no batch was run
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(out)
    if mode == "complete":
        last = found.agg(F.max("batch")).first()[0]
        found = found.filter(F.col("batch") == (-1 if last is None else last))
    return found.drop("batch")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files in the folder ``path``, or the file ``path`` by its name within its folder, as a stream of rows."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def binned(records: DataFrame, n_detectors: int, frames: list[tuple[float, float]], **options) -> DataFrame:
    """Running histogram (complete mode); the state is bounded by the scanner's bins times the frames."""
    return run_available(listmode.bin_events(records, n_detectors, frames, **options), "stream-bins", "complete")


def count_rates(records: DataFrame, step: str, late: str) -> DataFrame:
    """Prompts and delayeds per window of event time ``ts`` (append mode); windows close once ``late`` has passed.

    Windows still open at the end are not given out; a later run from the same checkpoint gives them.
    """
    per = records.withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"))
    rates = per.agg(F.count_if("is_prompt").alias("prompts"), F.count_if(~F.col("is_prompt")).alias("delayeds"))
    return run_available(rates.select(F.col("w.start").alias("start"), "prompts", "delayeds"), "stream-rates", "append")
