"""Token ids in bit-plane shuffled, compressed binary chunks with an index.

A file holds chunks. A chunk holds whole documents; its ids are cut into blocks of a fixed number of ids, each
block is transposed into byte planes (or bit planes), and each plane is compressed with zstandard. High planes of
small ids are constant and take no room. The chunk's row carries the index: shard, first id in the shard, number of
ids, the documents with their lengths, and the size of every plane, so that a reader can seek to any block. Chunks
are rows of Parquet files with uncompressed binary payload, so that Spark's committer decides which attempt of a
lost task counts and any store that Spark can write will do.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sinoflow.llm import bpe, common

BLOCK_IDS = 1 << 16
CHUNK_IDS = 1 << 20
CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n_ids long, block_ids int, bits boolean, doc_ids array<long>, "
    "doc_sizes array<long>, plane_sizes array<int>, payload binary"
)


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> tuple[list[int], bytes]:
    """Sizes of the compressed planes, block by block, and the planes. Size 0 stands for a plane of zeros."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    sizes, out = [], []
    for at in range(0, len(ids), block_ids):
        cells = np.ascontiguousarray(ids[at : at + block_ids], dtype="<u4").view(np.uint8).reshape(-1, 4)
        if bits:
            planes = np.packbits(np.unpackbits(cells, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(cells.T)
        for plane in planes:
            data = compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(data))
            out.append(data)
    return sizes, b"".join(out)


def unpack(sizes: list[int], payload: bytes, n_ids: int, block_ids: int = BLOCK_IDS, bits: bool = False) -> np.ndarray:
    """The ids that ``pack`` was given."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    ids, at = np.zeros(n_ids, "<u4"), 0
    n_planes = 32 if bits else 4
    for k, first in enumerate(range(0, n_ids, block_ids)):
        n = min(block_ids, n_ids - first)
        planes = np.zeros((n_planes, (n + 7) // 8 if bits else n), np.uint8)
        for j in range(n_planes):
            size = sizes[k * n_planes + j]
            if size:
                planes[j] = np.frombuffer(expand(payload[at : at + size]), np.uint8)
                at += size
        if bits:
            planes = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
        ids[first : first + n] = np.ascontiguousarray(planes.T).view("<u4")[:, 0]
    return ids


#: Entries of one generation of a worker's cache.
CACHE_PIECES = 400_000
#: A word and the marks behind it, which this kind of vocabulary never joins.
_MARKED = re.compile(r"([A-Za-z]+)([.,;:!?#$%&*]+)")


class PieceIds:
    """Little-endian ids of white-space separated pieces as the tokenizers library encodes them.

    A vocabulary that lower-cases and cuts marks from words lets "The," share the entries of "the" and ",". New words of a
    document are then encoded in one call: each ends in a token that carries the vocabulary's word end, so the ids are
    cut there. The cache has two generations: when the young one is full it becomes the old one, and pieces still
    in use move over from there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        cuts = [x["pattern"].get("Regex", "") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if "pattern" in x]
        self.plain = bool(suffix) and "Lowercase" in json.dumps(spec["normalizer"]) and any(c.endswith(r"[^\s\p{L}\p{N}]+") for c in cuts)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        if self.plain:
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
        # plain dicts: a set subtracts them by look-ups
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encoded(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def document(self, pieces: list[str]) -> bytes:
        """Ids of all pieces of a document."""
        if len(self.young) >= CACHE_PIECES:
            self.old, self.young = self.young, {}
        young = self.young
        if fresh := set(pieces).difference(young):
            short = [p for p in fresh if len(p) <= bpe.CACHE_CHARS]
            self._learn(short)
            if len(short) < len(fresh):  # pieces too long to be kept
                return b"".join([young[p] if p in young else self._encoded(p).tobytes() for p in pieces])
        return b"".join(map(young.__getitem__, pieces))

    def _learn(self, pieces: list[str]) -> None:
        parts, single, young = {}, set(), self.young
        for piece in pieces:
            if (known := self.old.get(piece)) is not None:
                young[piece] = known
            elif not self.plain or not piece.isascii():
                single.add(piece)  # other letters may become letters and marks when normalised
            elif marked := _MARKED.fullmatch(piece):
                parts[piece] = (marked[1].lower(), marked[2])
            elif piece.isalpha() and not piece.islower():
                parts[piece] = (piece.lower(),)
            else:
                single.add(piece)
        for words in parts.values():
            single.update(words)
        # letters alone never mix with their neighbours
        joint, odd = [], []
        for word in single:
            if word not in young:
                if (known := self.old.get(word)) is not None:
                    young[word] = known
                elif self.plain and word.isalpha():
                    joint.append(word)
                else:
                    odd.append(word)
        if joint:
            ids = self._encoded(" ".join(joint))
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(joint):
                data, at = ids.tobytes(), 0
                for word, stop in zip(joint, (4 * stops).tolist(), strict=True):
                    young[word], at = data[at:stop], stop
            else:  # a letter whose lower case is more than letters
                odd += joint
        for word in odd:
            young[word] = self._encoded(word).tobytes()
        for piece, words in parts.items():
            young[piece] = b"".join([young[w] for w in words])


@lru_cache(maxsize=4)
def _piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def write_planes(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    end_id: int = 1,
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
    bits: bool = False,
) -> None:
    """Encode the documents, end each with ``end_id`` and write them to ``out`` in ascending doc_id order.

    Documents are dealt to shards by ranges of doc_id; a shard's number is its place in the order. Null and empty
    texts hold the end id alone. Rows with equal doc_id follow one another in the order of a hash of their texts, then
    of the texts, whatever the number of shards; null doc_ids come first. An empty table writes files without chunks.
    """
    common.bounded_batches(docs.sparkSession)
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]

    def run(batches):
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), _piece_ids(tokenizer).document
        end = np.array([end_id], "<u4").tobytes()
        chunk = first = waiting = 0
        names: list = []
        lengths: list[int] = []
        parts: list[bytes] = []

        def flush():
            nonlocal chunk, first, waiting, names, lengths, parts
            ids = np.frombuffer(b"".join(parts), "<u4")
            sizes, payload = pack(ids, block_ids, bits)
            row = {
                "shard": shard, "chunk": chunk, "first": first, "n_ids": len(ids), "block_ids": block_ids, "bits": bits,
                "doc_ids": names, "doc_sizes": lengths, "plane_sizes": sizes, "payload": payload,
            }
            chunk, first, waiting, names, lengths, parts = chunk + 1, first + len(ids), 0, [], [], []
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(bpe.pieces(value.as_py())) + end
                names.append(name)
                lengths.append(len(data) // 4)
                parts.append(data)
                waiting += len(data) // 4
                if waiting >= chunk_ids:
                    yield flush()
        if names:
            yield flush()

    rows = common.texts(docs).repartitionByRange(*by).sortWithinPartitions(*by, "text")
    rows.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(out)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("block_ids", pa.int32()), ("bits", pa.bool_()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("plane_sizes", pa.list_(pa.int32())), ("payload", pa.binary()),
    ]
)


def read_planes(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids if asked for."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", common.BATCH_BYTES)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    # one row a shard: their number is the number of write tasks, whatever the documents
    per_shard = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = per_shard.select(
        "shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["plane_sizes"], row["payload"], row["n_ids"], row["block_ids"], row["bits"])
                ends = np.cumsum(row["doc_sizes"], dtype=np.int64)
                starts = ends - np.array(row["doc_sizes"], np.int64)
                view, n = memoryview(ids.tobytes()), len(starts)
                columns = [
                    pa.array([row["shard"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + row["first"]),
                    pa.array(row["doc_sizes"], pa.int64()),
                    pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                ]
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "shard int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = chunks.select(CHUNK_NAMES).mapInArrow(run, schema)
    out = rows.join(F.broadcast(before), "shard").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
    return out


CHUNK_NAMES = [x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the documents as files in the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = common.fresh_path(spark, "tokens")
    write_planes(docs, path, tokenizer, end_id)
    return read_planes(spark, path)
