"""Exact Jaccard join of documents on word shingles, and the components of its links.

1. Each document becomes a set of 64-bit shingle hashes. Equal sets form a class; one set per class goes on.
2. Sets are ordered by a common order of shingles. Two sets of similarity 0.8 share one of their first
   n - ceil(0.8 n) + 1 shingles; only those are posted, and postings that no other class has are dropped.
3. Neighbours in size within two postings of each class are compared first. That joins most near copies, and pairs
   inside a component need no further look, so a group of copies does not cost its square.
4. Postings are cut into tiles by size band: bands grow by the ratio of sizes that similar sets can have, so a set meets
   those of its own band and of the next. Only tiles with two components go on; a tile with too many members is cut further.
   Members sorted by size are compared: parity bitmaps bound the overlap from above by their differing bits. Pairs that
   survive are verified by intersecting the sorted hash arrays. Early rounds take of each tile only a spanning forest of
   such pairs, at most one a member; their links contract what is still apart, and a last round takes all pairs between
   what is left.

Postings are sorted and dealt out by range, so that one with very many members is spread over partitions.

Step 2's order puts shingles that a bounded sample shows to be frequent last. Any order is right; this one keeps
shared passages out of the postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.llm import common
from sinoflow.llm.components import components

SHINGLE = 5
#: Similarity as a fraction, so that the test is in whole numbers.
PART, WHOLE = 4, 5
#: Shingles of the smallest set that a larger one can be similar to: the least n with n / (n + 1) >= PART / WHOLE.
LEAST = -(-PART // (WHOLE - PART))
#: The planning sample of step 2 (documents; least share of them that makes a shingle frequent; most such shingles).
SAMPLE_DOCS, FREQUENT, MOST_FREQUENT = 4000, 0.0015, 20_000
#: Members of a size band of a posting compared in one piece; larger bands are dealt out as pairs of such tiles.
TILE_MEMBERS = 2048
#: Rounds of spanning forests (each rereads the texts of its pairs) before all remaining pairs are taken.
FOREST_ROUNDS = 1
BROADCAST_IDS = 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Fewest and most bits of a parity bitmap (a power of two, at least the set), and bytes of text hashed at once.
BITS, MOST_BITS, SLICE_BYTES = 1024, 1 << 15, 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def _byte_values() -> np.ndarray:
    """A 64-bit value for each byte, upper-case ASCII as lower."""
    values = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0]))
    values[65:91] = values[97:123]
    return values


_BYTES = _byte_values()
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        base = int(_ODD[1])
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64))]
    return _powers


def shingle_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Distinct shingle hashes of each text in ascending order; of fewer than five words one hash of all; else none.

    Word hashes are differences of a running polynomial hash over all bytes, so nothing loops over words.
    """
    out: list[np.ndarray] = []
    low = 0
    while low < len(texts):
        high, total = low, 0
        while high < len(texts) and (high == low or total + len(texts[high]) < SLICE_BYTES):
            total += len(texts[high]) + 1
            high += 1
        out += _sliced_hashes(texts[low:high])
        low = high
    return out


def _sliced_hashes(texts: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    power, inverse = _power_tables(len(data) + 1)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]  # every text ends in a space
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * power[: len(data)])])
    words = _mixed((run[ends] - run[starts]) * inverse[starts])
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    n = max(0, len(words) - SHINGLE + 1)
    hashes = words[:n] * _ODD[0]
    for k in range(1, SHINGLE):
        hashes = hashes + words[k : k + n] * _ODD[k]
    hashes = _mixed(hashes).view(np.int64)
    first = np.concatenate([[0], np.cumsum(n_words)])
    out = []
    for i, count in enumerate(n_words.tolist()):
        at = first[i]
        if count >= SHINGLE:
            own = np.sort(hashes[at : at + count - SHINGLE + 1])
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[fresh])
        elif count:
            acc = np.full(1, count, np.uint64)
            for w in words[at : at + count]:
                acc = _mixed(acc * _ODD[4] + w)
            out.append(acc.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _utf8(column: pa.Array) -> list[bytes]:
    return [v.as_buffer().to_pybytes() for v in column.cast(pa.binary())]


def least_overlap(n):
    """Least overlap of a set of n with any set similar to it."""
    return -(-PART * n // WHOLE)


def size_band(n: str) -> Column:
    """Sets whose sizes allow similarity are in one band or in two that follow each other; no power of the ratio is whole."""
    return F.floor(F.log(n) / F.log(F.lit(WHOLE / PART))).cast("int")


def set_key(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes)) - (1 << 63)


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of hashes fall on i; differing bits bound the symmetric difference from below."""
    bits = min(MOST_BITS, max(BITS, 1 << (len(hashes) - 1).bit_length()))
    return np.packbits(np.bincount(hashes & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer words: halves laid over each other keep parity."""
    while len(bitmap) > size:
        bitmap = bitmap[: len(bitmap) // 2] ^ bitmap[len(bitmap) // 2 :]
    return bitmap


def _prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    length = len(hashes) - least_overlap(len(hashes)) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        late = frequent[at] == hashes
        if late.any():
            hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[:length]


def _frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles that many documents of a bounded sample share; only the order of step 2 depends on them."""
    total = rows.count()
    step = max(1, total // SAMPLE_DOCS)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0) if step > 1 else rows

    def run(batches):
        for batch in batches:
            for hashes in shingle_hashes(_utf8(batch.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], names=["h"])

    counted = sample.mapInArrow(common.released(run), "h long").groupBy("h").count()
    least = max(3, int(FREQUENT * min(total, SAMPLE_DOCS)))
    top = counted.filter(F.col("count") >= least).orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.sort(np.array([r.h for r in top], np.int64))


def keyed_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n and key of its set; written to the shared folder."""
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = shingle_hashes(_utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_key(x) if len(x) else 0 for x in sets], pa.int64())], names=["doc_id", "n", "key"]
            )

    return common.materialize(common.texts(docs).mapInArrow(common.released(run), "doc_id long, n int, key long"), "jaccard-sets")


def _of_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ``ids`` (doc_id)."""
    ids = ids.select(F.col("doc_id").alias("id"))
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return common.texts(docs).join(near, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")


def set_classes(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """key, n, doc_id, bitmap and prefix postings of each class of equal sets, from its document with the least doc_id.

    Sets of fewer than ``LEAST`` shingles are similar only if equal and need none.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent_shingles(common.texts(docs)))
    least = common.materialize(sets.filter(f"n >= {LEAST}").groupBy("key").agg(F.min("doc_id").alias("doc_id")), "jaccard-least")

    def run(batches):
        for batch in batches:
            sets = shingle_hashes(_utf8(batch.column(1)))
            keep = [i for i, x in enumerate(sets) if len(x) >= LEAST]
            sets = [sets[i] for i in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), batch.column(0).take(pa.array(keep, pa.int64())),
                    pa.array([parity_bitmap(x) for x in sets], pa.binary()), pa.array([_prefix(x, frequent.value) for x in sets], pa.list_(pa.int64())),
                ],
                names=["key", "n", "doc_id", "bitmap", "prefix"],
            )

    made = _of_documents(docs, least).mapInArrow(common.released(run), "key long, n int, doc_id long, bitmap binary, prefix array<long>")
    made = common.materialize(made, "jaccard-classes")
    # rows that repeat a doc_id can bring a class twice
    return made if made.count() == least.count() else common.materialize(made.dropDuplicates(["key"]), "jaccard-classes")


def _shared_postings(classes: DataFrame) -> DataFrame:
    """h, key, n of postings that at least two classes have, and some at the ends of partitions that one has."""
    posted = classes.select(F.explode("prefix").alias("h"), "key", "n").repartitionByRange("h", "key").sortWithinPartitions("h")

    def run(batches):
        held, last = None, None  # the last row, and whether its run has been given out so far
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            equal = h[1:] == h[:-1]
            same[1:] |= equal
            same[:-1] |= equal
            if held is None:
                same[0] = True  # its run may have begun in the partition before
            elif h[0] == last[0]:
                same[0] = True
                if not last[1]:
                    yield held
            keep = batch.filter(pa.array(same))
            held, last = batch.slice(len(h) - 1, 1), (h[-1], bool(same[-1]))
            if keep.num_rows:
                yield keep
        if held is not None and not last[1]:
            yield held  # its run may go on in the next partition

    return common.materialize(posted.mapInArrow(common.released(run), "h long, key long, n int"), "jaccard-postings")


def _similar_sizes(n1: np.ndarray, n2: np.ndarray, differ: np.ndarray) -> np.ndarray:
    overlap = (n1 + n2 - differ) // 2
    return WHOLE * overlap >= PART * (n1 + n2 - overlap)


class Bitmaps:
    """Bitmaps of different sizes, compared at the smaller size of a pair: first at the least size, then at that."""

    def __init__(self, column: pa.Array):
        self.full = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
        self.size = np.array([len(x) for x in self.full], np.int64)
        self.small = np.stack([folded(x, BITS // 64) for x in self.full]) if self.full else np.zeros((0, BITS // 64), np.uint64)

    def possible(self, x: np.ndarray, other: Bitmaps, y: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
        """Whether the pairs (x[i], y[i]) leave room for similarity: the overlap is at most (n1 + n2 - differing bits) / 2."""
        good = _similar_sizes(n1, n2, np.bitwise_count(self.small[x] ^ other.small[y]).sum(axis=1, dtype=np.int64))
        size = np.minimum(self.size[x], other.size[y])
        for width in np.unique(size[good & (size > BITS // 64)]).tolist():
            at = np.flatnonzero(good & (size == width))
            (ux, ix), (uy, iy) = np.unique(x[at], return_inverse=True), np.unique(y[at], return_inverse=True)
            left, right = np.stack([folded(self.full[i], width) for i in ux]), np.stack([folded(other.full[i], width) for i in uy])
            for low in range(0, len(at), 4096):
                part = slice(low, low + 4096)
                differ = np.bitwise_count(left[ix[part]] ^ right[iy[part]]).sum(axis=1, dtype=np.int64)
                good[at[part]] = _similar_sizes(n1[at[part]], n2[at[part]], differ)
        return good


def _arrays(docs: DataFrame, classes: DataFrame, keys: DataFrame) -> DataFrame:
    """key and sorted hashes of each class in ``keys``, taken from one document of the class."""
    rows = _of_documents(docs, common.materialize(classes.join(keys, "key", "left_semi").select("doc_id").distinct(), "jaccard-needed"))

    def run(batches):
        for batch in batches:
            sets = [x for x in shingle_hashes(_utf8(batch.column(1))) if len(x) >= LEAST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "hashes"]
            )

    made = common.materialize(rows.mapInArrow(common.released(run), "key long, hashes binary"), "jaccard-arrays")
    if made.count() == made.select("key").distinct().count():
        return made
    # rows that repeat a doc_id can bring a class twice
    once = common.materialize(made.dropDuplicates(["key"]), "jaccard-arrays")
    common.discard(made)
    return once


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs a, b whose sets are similar, by exact intersection of their sorted arrays."""
    arrays = _arrays(docs, classes, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
    side = lambda s: arrays.select(F.col("key").alias(s), F.col("hashes").alias(f"{s}_hashes"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            links = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (2, 3))
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                links[i] = WHOLE * both >= PART * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[links], pa.int64()), pa.array(b[links], pa.int64())], names=["a", "b"])

    common.bounded_batches(pairs.sparkSession)
    checked = joined.select("a", "b", "a_hashes", "b_hashes").mapInArrow(common.released(run), "a long, b long")
    links = common.materialize(checked, "jaccard-links")
    common.discard(arrays)  # as long as the texts they come from, and of no use to later rounds
    return links


def _first_pairs(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of neighbours in size, at distances 1, 2 and 4, within the two first postings of each class, that pass the bitmap bound."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("h"))
    near = postings.withColumn("rank", rank).filter("rank <= 2").drop("rank")
    near = near.select("h", "key", "n").repartitionByRange("h", "n", "key").sortWithinPartitions("h", "n", "key")

    def neighbours(batches):
        tail = None
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2)])
            whole = new if tail is None else np.concatenate([tail, new], axis=1)
            old, (h, key, n) = whole.shape[1] - new.shape[1], whole
            found = []
            for d in (1, 2, 4):
                i = np.arange(max(0, old - d), max(0, len(h) - d))
                i = i[(h[i] == h[i + d]) & (key[i] != key[i + d]) & (WHOLE * n[i] >= PART * n[i + d])]
                found.append(np.stack([key[i], key[i + d]], axis=1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            tail = whole[:, -4:]

    pairs = near.mapInArrow(common.released(neighbours), "a long, b long").distinct()
    side = lambda s: classes.select(F.col("key").alias(s), F.col("n").alias(f"{s}_n"), F.col("bitmap").alias(f"{s}_map"))

    def run(batches):
        for batch in batches:
            n1, n2 = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            at = np.arange(batch.num_rows)
            good = Bitmaps(batch.column(4)).possible(at, Bitmaps(batch.column(5)), at, n1, n2)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_n", "b_n", "a_map", "b_map")
    return common.materialize(known.mapInArrow(common.released(run), "a long, b long"), "jaccard-first")


class Forest:
    """Union-find over the components of the members of tiles."""

    def __init__(self, run: np.ndarray, label: np.ndarray):
        _, self.part = np.unique(np.stack([run.astype(np.int64), label]), axis=1, return_inverse=True)
        self.part = self.part.ravel()
        self.up = np.arange(len(self.part))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.up[self.part[x]] != self.up[self.part[y]]

    def take(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Places of the pairs that join two trees when taken in order; joins them."""
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while i in up:
                i = up[i]
            return i

        taken = []
        for k, (i, j) in enumerate(zip(self.up[self.part[x]].tolist(), self.up[self.part[y]].tolist(), strict=True)):
            i, j = root(i), root(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                taken.append(k)
        if up:
            joined = np.arange(len(self.up))
            joined[list(up)] = [root(i) for i in up]
            self.up = joined[self.up]
        return taken


def _size_tiles(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """h, band, guest, key, n, label of the members of postings that have a member of another label and a size that can be similar; written.

    A member stands in its own band if that partner is there or below, and as a guest in the next band if it is there.
    Where a run of h may go on in the next partition, members that could have a partner there are kept.
    """
    known = postings.join(labels.withColumnRenamed("node", "key"), "key", "left").select("h", "key", "n", F.coalesce("label", "key").alias("label"), size_band("n").alias("band"))
    known = known.repartitionByRange("h", "n", "key").sortWithinPartitions("h", "n", "key")

    def of_runs(whole: np.ndarray, opens: bool, ends: bool) -> pa.RecordBatch | None:
        h, key, n, label, band = whole
        run = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) << 40
        at, change = np.arange(len(h)), np.cumsum(np.concatenate([[0], label[1:] != label[:-1]]))
        low, high = np.searchsorted(run + n, run + -(-PART * n // WHOLE)), np.searchsorted(run + n, run + WHOLE * n // PART, "right")
        border = np.searchsorted(run + band, run + band, "right")
        home = change[np.minimum(high, border) - 1] != change[low]
        next_at = np.minimum(border, len(h) - 1)
        guest = (high > border) & ((change[high - 1] != change[next_at]) | (label[next_at] != label))
        if opens:
            home |= low == 0
        if ends:
            reach = high == len(h)
            home, guest = home | reach, guest | reach
        rows = np.concatenate([at[home], at[guest]])
        if not len(rows):
            return None
        is_guest = np.repeat([0, 1], [home.sum(), guest.sum()])
        columns = (h[rows], (band[rows] + is_guest).astype(np.int32), is_guest.astype(np.int32), key[rows], n[rows].astype(np.int32), label[rows])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "band", "guest", "key", "n", "label"])

    def run(batches):
        waiting, opens = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(5)])
            whole = new if waiting is None else np.concatenate([waiting, new], axis=1)
            last = int(np.searchsorted(whole[0], whole[0, -1]))  # the last run may go on in the next batch
            if last:
                if (out := of_runs(whole[:, :last], opens, False)) is not None:
                    yield out
                opens = False
            waiting = whole[:, last:]
        if waiting is not None and (out := of_runs(waiting, opens, True)) is not None:
            yield out

    return common.materialize(known.mapInArrow(common.released(run), "h long, band int, guest int, key long, n int, label long"), "jaccard-tiles")


def _other_pairs(postings: DataFrame, labels: DataFrame, classes: DataFrame, forest_round: int | None = None) -> DataFrame:
    """All pairs of classes in different components that share a posting and pass the bitmap bound.

    With ``forest_round``, only pairs that join trees within their tile; rounds after the first look at half of all
    pairs, each round at another, lest the same dissimilar pairs stand in the way again.
    """
    known = _size_tiles(postings, labels)
    large = known.groupBy("h", "band").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > TILE_MEMBERS)
    large = large.select("h", "band", F.ceil(F.col("members") / TILE_MEMBERS).cast("int").alias("tiles"))
    known_tiles = known.join(large, ["h", "band"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    part = F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    # a band of many members is dealt out as pairs of tiles
    dealt = known_tiles.withColumn("part", part).select("h", "band", "key", "n", "label", "guest", "part", other.alias("with"))
    dealt = dealt.select("h", "band", F.least("part", "with").alias("t"), F.greatest("part", "with").alias("u"), "key", "n", "label", "part", "guest")
    tile = ["h", "band", "t", "u"]
    dealt = dealt.join(classes.select("key", "bitmap"), "key").repartition(*tile).sortWithinPartitions(*tile, "n", "key")

    columns = [*tile, "key", "n", "label", "part", "guest", "bitmap"]

    def compare(batch: pa.RecordBatch, run: np.ndarray):
        """Members of a run stand in order of size; those d places apart are compared for d = 1, 2, ..."""
        key, n, label, part, guest, t, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "label", "part", "guest", "t", "u"))
        n, maps, found = n.astype(np.int64), Bitmaps(batch.column("bitmap")), []
        forest = None if forest_round is None else Forest(run, label)
        i = np.arange(len(n))
        for d in range(1, len(n)):
            i = i[i + d < len(n)]
            # a member whose d-th neighbour is of another run or too large has no similar member further on
            i = i[(run[i] == run[i + d]) & (WHOLE * n[i] >= PART * n[np.minimum(i + d, len(n) - 1)])]
            if not len(i):
                break
            j = i + d
            some = (label[i] != label[j]) & ((t[i] == u[i]) | (part[i] != part[j])) & ((guest[i] == 0) | (guest[j] == 0))
            if forest is not None:
                some &= forest.apart(i, j)
                if forest_round:
                    some &= ((key[i] ^ key[j]) >> forest_round) & 1 == 1
            a, b = i[some], j[some]
            for low in range(0, len(a), 1 << 16):
                x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                good = maps.possible(x, maps, y, n[x], n[y])
                x, y = x[good], y[good]
                if forest is not None and len(x):
                    taken = forest.take(x, y)
                    x, y = x[taken], y[taken]
                if len(x):
                    found.append(np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y])], axis=1))
        if not found:
            return None
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        waiting: list[pa.RecordBatch] = []

        def runs(batch):
            new = np.zeros(batch.num_rows, bool)
            for c in tile:
                v = batch.column(c).to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            return np.cumsum(new)

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*waiting, batch]).combine_chunks().to_batches()[0]
            number = runs(whole)
            last = int(np.searchsorted(number, number[-1]))  # the last run may go on in the next batch
            if last and (out := compare(whole.slice(0, last), number[:last])) is not None:
                yield out
            waiting = [whole.slice(last)]
        if waiting and (out := compare(waiting[0], runs(waiting[0]))) is not None:
            yield out

    pairs = common.materialize(dealt.select(*columns).mapInArrow(common.released(run), "a long, b long").distinct(), "jaccard-pairs")
    common.discard(known)
    return pairs


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after its components are contracted and the new links join them."""
    of = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    links = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    second = components(links.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    top = second.select(F.col("node").alias("label"), F.col("label").alias("top"))
    known = labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = second.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return common.materialize(known.unionByName(alone), "jaccard-labels")


def component_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable over links of similarity 0.8 or more).

    Null, empty and wordless texts have no shingles and are alone; texts of one to four words are one shingle.
    Rows of equal sets are linked whatever their doc_ids; null doc_ids count in no minimum unless all of a component
    are null. An empty table gives an empty table.
    """
    sets = keyed_sets(docs)
    classes = set_classes(docs, sets)
    postings = _shared_postings(classes)
    whole, classes = classes, common.materialize(classes.drop("prefix"), "jaccard-bitmaps")
    common.discard(whole)
    labels = components(_verified(docs, classes, _first_pairs(postings, classes)))
    for forest_round in (*range(FOREST_ROUNDS), None):
        pairs = _other_pairs(postings, labels, classes, forest_round)
        if not pairs.isEmpty():
            labels = _joined(labels, _verified(docs, classes, pairs))
        elif not forest_round:  # the first round and the last look at all pairs
            break
    smallest = sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    known = smallest.join(labels.withColumnRenamed("node", "key"), "key", "left")
    known = known.select("key", "least", F.coalesce("label", "key").alias("label"))
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = common.materialize(known.join(least, "label").select("key", "component_id"), "jaccard-components")
    # one row per class on the right; a class of many copies is split by adaptive skew handling on the left
    some = sets.filter("n > 0").join(of_class, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = sets.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def keep_documents(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one document of each component: that with the least doc_id.

    Rows that share the kept doc_id all stay; documents without words stay.
    """
    kept = component_table(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    kept = common.materialize(kept, "jaccard-kept")
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__kept")), "left_semi")
