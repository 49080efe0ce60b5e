"""Benchmark decontamination: containment of short test items in documents.

Items are partitioned by size. An item of n shingles is contained to 0.8 if at most m = floor(n / 5) of them are
missing, so its MinHash sketch of the 2m + 2 least shingle hashes must show at least m + 2 in the document (all but m
of a shorter sketch). Searching only for sketch hashes proposes (document, item) pairs without missing any; exact
containment of the item's shingles then decides. Only DataFrame operations run on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoflow.llm import common

SHINGLE = 5
#: Most sketch rows (about 50 bytes each) and candidate documents that are broadcast.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(rows: DataFrame) -> DataFrame:
    """Replaces ``text`` by ``hashes``: of every five words in a row, or of all words if they are fewer."""
    rows = rows.withColumn("w", F.transform(words(F.col("text")), lambda x: F.xxhash64(x))).drop("text")
    n = F.size("w")
    five = lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(SHINGLE)))
    many = F.transform(F.sequence(F.lit(0), n - SHINGLE), five)
    few = F.array(F.xxhash64("w"))
    return rows.withColumn("hashes", F.when(n >= SHINGLE, many).when(n > 0, few).otherwise(F.array().cast("array<long>"))).drop("w")


def _item_shingles(items: DataFrame) -> DataFrame:
    """Distinct shingles of each item as text, words joined by a space."""
    rows = items.select(F.col("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    n = F.size("w")
    many = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(SHINGLE)), " "))
    whole = F.array(F.array_join("w", " "))
    return rows.filter(n > 0).select("item_id", (n >= SHINGLE).alias("cut"), F.array_distinct(F.when(n >= SHINGLE, many).otherwise(whole)).alias("shingles"))


def sketches(items: DataFrame, share: float = 0.2) -> DataFrame:
    """Sketch rows: hash, item_id, n, band (power of two that bounds n) and the hits that a document must show."""
    # written first: a filter on derived arrays would be pushed below them and compute them again for every element
    hashed = common.materialize(_hashed(items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))), "decontam-items")
    sized = hashed.select("item_id", F.array_sort(F.array_distinct("hashes")).alias("h")).withColumn("n", F.size("h")).filter("n > 0")
    missing = F.floor(F.col("n") * F.lit(share) + 1e-9).cast("int")
    sized = sized.withColumn("band", F.ceil(F.log2("n")).cast("int")).withColumn("m", missing)
    sized = sized.withColumn("k", F.least("n", 2 * F.col("m") + 2))
    return sized.select("item_id", "n", "band", (F.col("k") - F.col("m")).alias("least"), F.explode(F.slice("h", F.lit(1), F.col("k"))).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs doc_id, item_id with n_item (shingles of the item), n_found (of them in the document) and containment.

    Words are lower-cased and cut at ASCII white space; shingles are five words, and an item of fewer words is one
    shingle that only a document of just these words holds. Null, empty and wordless texts are in no pair. Rows that
    share a doc_id count as one document with the best containment of its rows; of rows that share an item_id too.
    Empty tables give no pairs.
    """
    index = common.materialize(sketches(items, 1 - threshold), "decontam-sketches")
    small = index.count() <= BROADCAST_ROWS
    proposed = (
        _hashed(common.texts(docs))
        # explode_outer, as explode would have Catalyst test the array's size below its making; null hashes join nothing
        .select("doc_id", F.explode_outer("hashes").alias("hash"))
        .join(F.broadcast(index) if small else index, "hash")
        .groupBy("doc_id", "item_id", "n", "band", "least")
        .agg(F.count_distinct("hash").alias("hits"))
        .filter("hits >= least")
        .select("doc_id", "item_id")
        .distinct()
    )
    proposed = common.materialize(proposed, "decontam-candidates")
    found_in = proposed.count() <= BROADCAST_ROWS
    # white space in front and behind, so that a shingle is met at word borders only
    normal = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    wanted = proposed.withColumnRenamed("doc_id", "of").join(_item_shingles(items), "item_id")
    rows = common.texts(docs).join(
        (F.broadcast if found_in else lambda df: df)(proposed.select(F.col("doc_id").alias("of")).distinct()), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi"
    ).select("doc_id", normal.alias("body"))
    joined = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")))
    holds = lambda s: F.when(F.col("cut"), F.contains(F.col("body"), F.concat(F.lit(" "), s, F.lit(" ")))).otherwise(F.col("body") == F.concat(F.lit(" "), s, F.lit(" ")))
    counted = joined.select("doc_id", "item_id", F.size("shingles").alias("n_item"), F.size(F.filter("shingles", holds)).alias("n_found"))
    best = counted.withColumn("share", F.col("n_found") / F.col("n_item")).groupBy("doc_id", "item_id").agg(
        F.max_by("n_item", "share").cast("long").alias("n_item"), F.max_by("n_found", "share").cast("long").alias("n_found"), F.max("share").alias("containment")
    )
    return best.filter(F.col("containment") >= threshold)


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs``, all columns, without the rows whose doc_id is in a contaminated pair."""
    bad = common.materialize(contaminated(docs, items, threshold).select(F.col("doc_id").alias("__bad")).distinct(), "decontam-bad")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")), "left_anti")
