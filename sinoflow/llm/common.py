"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python, so that very long texts cannot fill a worker.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sinoflow-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage durably.

    Shuffle files of the write go as soon as it ends: nothing reads them again.
    """
    spark = session_of(df)
    path = fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a table that ``materialize`` wrote and no returned frame reads."""
    if isinstance(df_or_path, DataFrame):
        spark = session_of(df_or_path)
        files = df_or_path.inputFiles()
        if not files:
            return
        path = files[0].rsplit("/", 1)[0]
    else:
        path = df_or_path
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as byte planes, as many as the largest number needs, under zstandard."""
    import zstandard

    widths = [(int(c.max()).bit_length() + 7) // 8 if len(c) else 0 for c in columns]
    planes = [np.ascontiguousarray(c, np.uint64).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for c, w in zip(columns, widths, strict=True)]
    head = np.array([len(columns), *(x for c, w in zip(columns, widths, strict=True) for x in (len(c), w))], np.uint64)
    return zstandard.compress(head.tobytes() + b"".join(planes), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns that ``pack`` was given, as unsigned 64-bit integers."""
    import zstandard

    raw = zstandard.decompress(data)
    head = np.frombuffer(raw, np.uint64, 1 + 2 * int(np.frombuffer(raw, np.uint64, 1)[0]))
    at, out = 8 * len(head), []
    for n, w in head[1:].reshape(-1, 2).tolist():
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T
        out.append(wide.view(np.uint64).ravel())
        at += n * w
    return out


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """n integers that ``repartition(n, key)`` deals out to n different partitions, so that none gets two."""
    part = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
    found = spark.range(0, 20 * n + 200, numPartitions=1).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    of = {r.part: r.id for r in found}
    return [of.get(k, -k - 1) for k in range(n)]


def released(run):
    """``run`` for mapInArrow; at its end the worker, which is kept for later tasks, gives unused memory back to the system."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return wrapped


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: long documents, not row counts, decide a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` long and ``text`` string with null as empty; other columns, whatever their names, are left out."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array column, folded in blocks so that the cost stays near linear."""
    return bound(values, lambda v: _prefix_sums(v, block))


def _prefix_sums(values: Column, block: int) -> Column:

    def fold(part: Column, start: Column) -> Column:
        empty = F.array().cast("array<long>")
        return F.aggregate(
            part,
            F.struct(start.cast("long").alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")
            ),
        )["out"]

    n = F.size(values)
    zero = F.lit(0).cast("long")
    firsts = F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))
    part = lambda b: F.slice(values, b * block + 1, F.lit(block))
    totals = F.transform(firsts, lambda b: F.aggregate(part(b), zero, lambda a, x: a + x))
    before = F.concat(F.array(zero), fold(totals, zero))
    many = bound(before, lambda known: F.flatten(F.transform(firsts, lambda b: fold(part(b), F.element_at(known, b + 1)))))
    return F.when(n <= 0, F.array().cast("array<long>")).when(n <= block, fold(values, zero)).otherwise(many)
