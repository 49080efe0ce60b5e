"""Exact deduplication with disk-backed streaming state.

A table of digests streams through a keyed aggregation whose state lives in RocksDB and never expires: per digest it
retains the row to keep (stable identifier and content locator) and the number of rows seen. Digests met more than
once are hits; for them the full bytes of the texts are compared. Only DataFrame operations run on the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinoflow.llm import common

_STATE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Number of state stores, and the rows that each is meant for. A store keeps a file of some MB however few its keys.
_STORES = "spark.sql.streaming.internal.stateStore.partitions"
LEAST_STORES, ROWS_PER_STORE = 12, 500_000
#: All stores of an executor share this much memory; what is more lies on its disk.
_SHARED = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128"}
#: Most repeated digests (about 60 bytes each) that are broadcast; beyond that they are joined by shuffle.
BROADCAST_DIGESTS = 400_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def stream_groups(spark: SparkSession, path: str, schema) -> DataFrame:
    """Run the digests written at ``path`` through the keyed state; per digest: keep (doc_id, row, file) and group_size.

    The digests are read as a stream until none is left. Each micro-batch writes the keys that it touched under its
    own number, so a repeated batch overwrites itself; both values only grow, so the last state is their maximum.
    """
    before = {k: spark.conf.get(k, None) for k in (_STATE, _STORES, *_SHARED)}
    for k, v in ({_STATE: _ROCKSDB} | _SHARED).items():
        spark.conf.set(k, v)
    spark.conf.set(_STORES, max(LEAST_STORES, spark.read.schema(schema).parquet(path).count() // ROWS_PER_STORE))
    out = common.fresh_path(spark, "dedup-groups")
    try:
        grouped = (
            spark.readStream.schema(schema)
            .parquet(path)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "row", "file")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        )
        query = (
            grouped.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", common.fresh_path(spark, "dedup-state"))
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
            .start()
        )
        query.awaitTermination()
        batches = 1 + (query.lastProgress["batchId"] if query.lastProgress else 0)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = "digest binary, keep struct<doc_id: bigint, row: bigint, file: string>, group_size long, batch int"
    groups = spark.read.schema(fields).parquet(out)
    if batches == 1:
        return groups.drop("batch")
    return groups.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def dedup_table(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest doc_id stays; null doc_ids come last; of rows
    that repeat both doc_id and text exactly one is kept. Texts that share a digest and differ are told apart
    by their bytes. An empty table gives an empty table. ``digest`` may be replaced to test that.
    """
    spark = docs.sparkSession
    rows = common.texts(docs).select(
        "doc_id", digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("file")
    )
    path = common.fresh_path(spark, "dedup-digests")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    groups = stream_groups(spark, path, rows.schema)
    hits = common.materialize(groups.filter("group_size > 1").select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size"), "dedup-hits")
    few = hits.count() <= BROADCAST_DIGESTS
    sized = F.broadcast if few else (lambda df: df)

    keyed = common.texts(docs).withColumn("digest", digest(F.col("text")))
    # equal bytes throughout a group if its least and greatest text are equal; partial sums keep hot groups local
    differing = (
        keyed.join(sized(hits.select("digest")), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .filter("least <> greatest")
        .select("digest")
    )
    differing = common.materialize(differing, "dedup-differing")
    collided = differing.limit(1).count() > 0

    sha_of = (lambda c: F.lower(F.hex(c))) if digest is sha256 else None
    plain = rows.join(differing, "digest", "left_anti") if collided else rows
    if sha_of is None:
        # with another digest the published column still is SHA-256
        plain = plain.join(keyed.select("digest", F.sha2("text", 256).alias("sha")).distinct().join(differing, "digest", "left_anti"), "digest")
    sha = sha_of(F.col("digest")) if sha_of else F.col("sha")
    single = F.col("group_size").isNull()
    out = plain.join(sized(hits), "digest", "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        sha.alias("text_sha256"),
    )
    return out.unionByName(_by_bytes(keyed.join(differing, "digest", "left_semi"))) if collided else out


def _by_bytes(rows: DataFrame) -> DataFrame:
    """The same result for rows whose digests collide, grouped by their whole texts."""
    per_doc = rows.groupBy("text", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = per_doc.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return (
        per_doc.join(kept, "text")
        .select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def keep_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group of equal texts. Of rows that repeat doc_id and text one stays."""
    kept = dedup_table(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    kept = common.materialize(kept, "dedup-kept")
    rows = docs.withColumn("__id", F.col("doc_id").cast("long"))
    ids = common.materialize(rows.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("__id").alias("kept_id")), "dedup-repeated")
    same_id = F.col("__id").eqNullSafe(F.col("kept_id"))
    once = kept.select("kept_id").distinct()
    if not ids.limit(1).count():
        return rows.join(once, same_id, "left_semi").drop("__id")
    # a doc_id on several rows does not tell them apart: there the text decides as well
    single = rows.join(ids, same_id, "left_anti").join(once, same_id, "left_semi").drop("__id")
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    several = rows.join(ids, same_id, "left_semi").withColumn("__sha", sha)
    several = several.join(kept, same_id & (F.col("__sha") == F.col("kept_sha")), "left_semi").dropDuplicates(["__id", "__sha"])
    return single.unionByName(several.drop("__id", "__sha"))
