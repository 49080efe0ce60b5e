"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text. Of every SPAN neighbouring words, the one before which the hash is least begins
a chunk, the last of equal ones. So no chunk inside a text has more than SPAN words, a passage that repeats itself
has borders at its period, and insertions move no borders beyond their surroundings. Chunks with a digest that several documents have are repeats; neighbouring repeats are
joined, and a run of enough words is reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.llm import common

#: Bytes that the gear hash depends on, and words of which one begins a chunk. In a passage of 50 words whose first 11 hold
#: WINDOW bytes, the borders that do not depend on the text around it span 50 + 1 - 11 - 2 * SPAN = 16 words at least.
WINDOW, SPAN = 16, 12
#: Words of a run of repeated chunks that make it a repeated passage.
MIN_WORDS = 16
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _gear() -> np.ndarray:
    """256 mixed 64-bit words from a counter (splitmix)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash after each byte: the gear words of the last WINDOW bytes, each shifted by its age, summed."""
    h, span = GEAR[data], 1
    while span < WINDOW:
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint64(span))  # the right side is read in full before the assignment
        span *= 2
    return h


def _least(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the least value, the last of equal ones, of every SPAN neighbours of one text."""
    if len(h) < SPAN:
        return np.zeros(0, np.int64)
    place, width = np.arange(len(h)), 1
    while width < SPAN:
        step = min(width, SPAN - width)
        left, right = place[:-step], place[step:]
        place = np.where(h[right] <= h[left], right, left)
        width += step
    return np.unique(place[text[: len(place)] == text[SPAN - 1 :]])


def borders(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of chunks in a buffer of texts, ascending and with every non-empty text's start; words up to each byte; the text of each border."""
    space = _SPACES[data]
    first = ~space
    first[1:] &= space[:-1]
    full = starts < ends
    first[starts[full]] = ~space[starts[full]]
    words = np.cumsum(first)
    at = np.flatnonzero(first)
    at = at[at > 0]
    text = np.searchsorted(starts[full], at, side="right") - 1
    begins = starts[full][text] if len(at) else at
    inside = at - begins >= WINDOW  # nearer the start the hash would see the text before
    at, text = at[inside], text[inside]
    at = at[_least(gear_hash(data)[at - 1], text)]
    at = np.union1d(at, starts[full])
    return at, words, np.searchsorted(starts[full], at, side="right") - 1


def chunks(docs: DataFrame) -> DataFrame:
    """row, doc_id, idx, digest, start and stop (code points) and words of every chunk; written to the shared folder."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        import xxhash
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in (b.slice(low, 256) for b in batches for low in range(0, b.num_rows, 256)):
            texts = [v.as_py().encode("utf-8", "surrogatepass") for v in batch.column(1)]
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            starts, joined = ends - sizes, b"".join(texts)
            data = np.frombuffer(joined, np.uint8)
            if len(data):
                at, words, text = borders(data, starts, ends)
                full = np.flatnonzero(starts < ends)
                owner = full[text]
                stop = np.append(at[1:], len(data))
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                counted = np.concatenate([[0], words])
                base = chars[starts[owner]]
                view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
                new = np.ones(len(at), bool)
                new[1:] = owner[1:] != owner[:-1]
                idx = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                digests = np.fromiter((digest(view[a:b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)), np.uint64, len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + owner), batch.column(0).take(pa.array(owner)), pa.array(idx.astype(np.int32)), pa.array(digests.view(np.int64)),
                        pa.array((chars[at] - base).astype(np.int32)), pa.array((chars[stop] - base).astype(np.int32)), pa.array((counted[stop] - counted[at]).astype(np.int32)),
                    ],
                    names=["row", "doc_id", "idx", "digest", "start", "stop", "words"],
                )
            row += len(texts)

    schema = "row long, doc_id long, idx int, digest long, start int, stop int, words int"
    return common.materialize(common.texts(docs).mapInArrow(run, schema), "chunks")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that several rows share: doc_id, start, stop (code points, end exclusive), n_words, n_chunks, first_doc_id, first.

    A passage is a run of neighbouring repeated chunks with ``min_words`` words at least. ``first_doc_id`` is the least
    doc_id that has its chunks, ``first`` whether that is this document: dropping the passages that are not first leaves
    each once. Null, empty and short texts have none; repeated rows repeat each other. A text without white space is
    one chunk. Empty tables give no passages.
    """
    rows = chunks(docs)
    shared = rows.groupBy("digest").agg(F.min("row").alias("r1"), F.max("row").alias("r2"), F.min("doc_id").alias("first_doc_id"))
    shared = shared.filter("r1 < r2").select("digest", "first_doc_id")
    # one row per digest on the right; a digest with many chunks is split by adaptive skew handling on the left
    found = rows.join(shared, "digest").select("row", "doc_id", "idx", "start", "stop", "words", "first_doc_id")
    by = Window.partitionBy("row").orderBy("idx")
    runs = found.withColumn("run", F.col("idx") - F.row_number().over(by))
    return (
        runs.groupBy("row", "run")
        .agg(
            F.max("doc_id").alias("doc_id"), F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"),
            F.sum("words").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min("first_doc_id").alias("first_doc_id"),
        )
        .filter(F.col("n_words") >= min_words)
        .select("doc_id", "start", "stop", "n_words", "n_chunks", "first_doc_id", F.col("doc_id").eqNullSafe(F.col("first_doc_id")).alias("first"))
    )
