"""Quality classifier: perplexity under interpolated modified Kneser-Ney models of trusted text.

The models are of pairs of words. The vocabulary are words that occur in ``RARE`` trusted documents of a
language, however many there are; each other word stands as its class (case, signs, length and
ending), whose probability is shared by as many spellings as trusted text shows. Trusted documents are dealt out to two
models by a hash of doc_id, and each document, trusted or not, is scored by the model that its doc_id does not belong
to: no model judges texts that it was fitted on, and all trusted text counts.

Counts of pairs are sharded by a hash of the pair, so that a frequent word is spread over all shards. The ``FREQUENT`` most
frequent pairs are broadcast and scored where the document is; for all others documents ask the
shards and get back partial sums of log probabilities. Both travel packed: pairs of a block of documents
sorted, as differences in byte planes. What the models know of single words is broadcast, up to a bound of words; of a
larger vocabulary the ``HEAD_WORDS`` most frequent are, and the few other words of each block of documents are joined with
their codes and counts (``divided_perplexities``). The model is the same.
A document is rejected above a high quantile of the perplexities of trusted documents of its language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinoflow.llm import common

QUANTILE = 0.99
#: A word of the vocabulary is in RARE trusted documents of a language at least. That does not grow with their number, as it did by its square root over SPARSE.
RARE, SPARSE = 3, float("inf")
#: Most ids of trusted documents (8 bytes each) that are broadcast; beyond it documents are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Most words of the vocabulary (56 bytes each) that are broadcast.
BROADCAST_WORDS = 2_000_000
#: Words that are broadcast of a larger vocabulary, about; perplexities are the same with any number of them.
HEAD_WORDS = 1 << 20
#: Pairs of words (16 bytes each) that are broadcast with their counts; scores are the same with any number of them.
FREQUENT = 1 << 20
#: Trusted words a shard, tokens and documents of a block, words that a worker remembers, ids in a piece of the word statistics.
SHARD_WORDS, BLOCK_TOKENS, BLOCK_DOCS, CACHE_WORDS, PIECE = 1 << 20, 1 << 19, 1 << 14, 150_000, 1 << 16
#: Characters of texts split into words at once.
SLICE_CHARS = 1 << 20
_CASES = ("lower", "title", "upper", "digits", "signs", "mixed")
_TAILS = (".", ",", "")
CLASSES = len(_CASES) * len(_TAILS) * 4
#: Code of the first word of the vocabulary; 0 is the beginning of a text, 1 to CLASSES are classes.
FIRST = CLASSES + 1
_MODEL, _LEFT, _MASK = np.uint64(62), np.uint64(31), np.uint64((1 << 31) - 1)
_SCORES = "doc_id long, lang string, n_words long, perplexity double"


def word_class(word: str) -> int:
    """1 to CLASSES: by case or signs, ending and length of a word."""
    core = word.rstrip(".,;:!?")
    end = word[len(core) :]
    if core.isalpha():
        case = "lower" if core.islower() else "upper" if core.isupper() and len(core) > 1 else "title" if core.istitle() else "mixed"
    elif core.isdigit():
        case = "digits"
    else:
        case = "mixed" if core.replace("-", "").replace("'", "").replace("’", "").isalnum() else "signs"
    if end not in (".", ",", ""):
        case = "signs" if len(end) > 1 else case
        end = "." if end in ("?", "!", ":", ";") else ","
    length = 0 if len(core) < 4 else 1 if len(core) < 8 else 2 if len(core) < 13 else 3
    return 1 + (_CASES.index(case) * len(_TAILS) + _TAILS.index(end)) * 4 + length


class Words(dict):
    """Remembers the values of words: 57 bits of hash with the class below them."""

    def values_of(self, new: list[str]) -> np.ndarray:
        return self.hashes(new) | np.fromiter(map(word_class, new), np.uint64, len(new))

    @staticmethod
    def hashes(words: list[str]) -> np.ndarray:
        import xxhash

        return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) & ~np.uint64(127)

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each text the values of its words, the beginning's 0 in front."""
        held, size = [], 0
        for text in texts:
            held.append(text.as_py().split())
            size += len(text.as_py())
            if size > SLICE_CHARS:
                yield from self._of(held)
                held, size = [], 0
        yield from self._of(held)

    def _of(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*texts).difference(self))
        self.update(zip(new, self.values_of(new).tolist(), strict=True))
        for words in texts:
            out = np.zeros(len(words) + 1, np.uint64)
            out[1:] = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
            yield out


class Codes(Words):
    """Remembers the codes of words: their place in ``vocabulary`` (sorted values of ``Words``), or their class."""

    def __init__(self, vocabulary: np.ndarray):
        super().__init__()
        self.vocabulary = vocabulary

    def values_of(self, new: list[str]) -> np.ndarray:
        h = self.hashes(new)
        at = np.searchsorted(self.vocabulary, h)
        known = at < len(self.vocabulary)
        known[known] = self.vocabulary[at[known]] & ~np.uint64(127) == h[known]
        out = (at + FIRST).astype(np.uint64)
        other = np.flatnonzero(~known)
        out[other] = np.fromiter((word_class(new[i]) for i in other.tolist()), np.uint64, len(other))
        return out


class Open(Codes):
    """As ``Codes``, but a word outside ``vocabulary`` keeps its value in ``Words``, which is above all codes."""

    def values_of(self, new: list[str]) -> np.ndarray:
        h, out = self.hashes(new), super().values_of(new)
        other = (out < FIRST) & (h > _MASK)
        out[other] |= h[other]
        return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """good_id of documents that a label calls good and none calls bad or toxic; written to the shared folder."""
    per = labels.groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return common.materialize(per.filter("good_id is not null and q = 1 and coalesce(t, 0) = 0").select("good_id"), "quality-trusted")


def trusted_documents(docs: DataFrame, good: DataFrame) -> DataFrame:
    """doc_id, text, lang and half of the documents in ``good``."""
    near = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    return _rows(docs).join(near, F.col("doc_id") == F.col("good_id"), "left_semi")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(2)).cast("int").alias("half"),
    )


def _batch(names: str, *columns) -> pa.RecordBatch:
    plain = [pa.array(c.view(np.int64)) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays(plain, names=names.split())


def word_documents(trusted: DataFrame) -> DataFrame:
    """tongue (a hash of lang), w (its value in ``Words``) and in how many documents, n."""

    def run(batches):
        words, held, size = Words(), {}, 0

        def out():
            for tongue, parts in held.items():
                w, n = np.unique(np.concatenate(parts), return_counts=True)
                yield _batch("tongue w n", np.full(len(w), tongue, np.int64), w, n.astype(np.int64))

        for batch in batches:
            for w, tongue in zip(words.of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                held.setdefault(tongue, []).append(np.unique(w[1:]))
                size += len(held[tongue][-1])
                if size > BLOCK_TOKENS:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = trusted.select("text", F.xxhash64("lang").alias("tongue")).mapInArrow(common.released(run), "tongue long, w long, n long")
    return rows.groupBy("tongue", "w").agg(F.sum("n").alias("n"))


def vocabulary_table(trusted: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """w of the vocabulary with n, its number of documents, the spellings of each class outside it, and a bound on distinct pairs of words."""
    words = word_documents(trusted).groupBy("w").agg(F.max(F.col("n") >= RARE).alias("known"), F.sum("n").alias("n"))
    words = common.materialize(words, "quality-words")
    known = common.materialize(words.filter("known").select("w", "n"), "quality-vocabulary")
    spellings, total = np.ones(FIRST), 0
    for r in words.groupBy("known", F.expr("cast(w & 127 as int)").alias("k")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect():  # two rows a class
        spellings[r.k] += 0 if r.known else r.words
        total += r.n
    common.discard(words)
    return known, spellings, total


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """D1, D2, D3+ of an order from its counts of counts."""
    n1, n2, n3, n4 = (max(1.0, float(n)) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return [min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def _taken(n: np.ndarray, d: list[float]) -> np.ndarray:
    """What discounting takes from counts n."""
    return np.minimum(np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)], n)


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:5].tolist()


def _dealt(g: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The shards of pairs, and the places of each shard's in order."""
    x = g * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    shard = (x >> np.uint64(33)) % np.uint64(shards)
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint32)  # 16 bits are sorted by counting
    at = np.argsort(shard, kind="stable")
    shard = shard[at]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), shard[1:] != shard[:-1]]))
    return zip(shard[first].tolist(), np.split(at, first[1:]), strict=True) if len(g) else iter(())


def _summed(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.argsort(g, kind="stable")
    g, n = g[at], n[at]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n, first) if len(g) else n


def _gaps(g: np.ndarray) -> np.ndarray:
    return np.diff(g, prepend=np.uint64(0))


def pair_counts(trusted: DataFrame, vocabulary, keys: list[int]) -> DataFrame:
    """A row a shard: its pairs g (model, left, right word) and counts, packed, and per model their counts of counts; written."""

    def documents(batches):
        words = Codes(vocabulary.value)
        for batch in batches:
            yield from zip(words.of(batch.column(0)), batch.column(1).to_pylist(), strict=True)

    common.bounded_batches(trusted.sparkSession)
    return _pair_counts(trusted.select("text", "half"), documents, keys)


def _pair_counts(rows: DataFrame, documents, keys: list[int]) -> DataFrame:
    """``documents`` makes codes and half of each document out of batches of rows."""

    def run(batches):
        held, size = [], 0

        def out():
            g, n = np.unique(np.concatenate(held), return_counts=True)
            for s, at in _dealt(g, len(keys)):
                yield _batch("shard data", np.array([keys[s]], np.int32), [common.pack(_gaps(g[at]), n[at])])

        for w, half in documents(batches):
            held.append((np.uint64(half) << _MODEL) | (w[:-1] << _LEFT) | w[1:])
            size += len(w)
            if size > BLOCK_TOKENS:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def merge(batches):
        now, held = None, []

        def whole():
            g, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held[:] = [(g, n)]
            return g, n

        def out():
            g, n = whole()
            per = [_counts_of_counts(n[g >> _MODEL == m]) for m in (0, 1)]
            yield _batch("shard data ones", np.array([now], np.int32), [common.pack(_gaps(g), n)], [sum(per, [])])

        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != now and held:
                    yield from out()
                    held.clear()
                now = shard
                gaps, n = common.unpack(data.as_py())
                held.append((np.cumsum(gaps), n.astype(np.int64)))
                if sum(len(x) for x, _ in held[1:]) > max(BLOCK_TOKENS, len(held[0][0])):
                    whole()
        if held:
            yield from out()

    rows = rows.mapInArrow(common.released(run), "shard int, data binary")
    rows = rows.repartition(len(keys), "shard").sortWithinPartitions("shard").mapInArrow(common.released(merge), "shard int, data binary, ones array<long>")
    return common.materialize(rows, "quality-pairs")


def _model_discounts(counts: DataFrame) -> list[list[float]]:
    row = counts.agg(*(F.coalesce(F.sum(F.col("ones")[i]), F.lit(0)).alias(f"n{i}") for i in range(8))).first()
    return [discounts(*row[4 * m : 4 * m + 4]) for m in (0, 1)]


def word_statistics(counts: DataFrame, taken: list[list[float]], codes: int) -> np.ndarray:
    """Per model and code below ``codes``: how often it stands left, what discounting takes of that, and how many words stand left of it.

    Shards sum pieces of the codes; pieces are summed over the shards, and come as 3 numbers a code, which
    ``BROADCAST_WORDS`` bounds.
    """
    pieces = -(-codes // PIECE)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                gaps, n = common.unpack(data.as_py())
                g, n = np.cumsum(gaps), n.astype(np.int64)
                for m in (0, 1):
                    own = g >> _MODEL == m
                    left, right, k = ((g[own] >> _LEFT) & _MASK).astype(np.int64), (g[own] & _MASK).astype(np.int64), n[own]
                    near = left < codes
                    left, k, right = left[near], k[near], right[right < codes]
                    sums = [np.bincount(left, k, codes), np.bincount(left, _taken(k, taken[m]), codes), np.bincount(right, minlength=codes)]
                    for p in range(pieces):
                        part = np.stack([x[p * PIECE : (p + 1) * PIECE] for x in sums])
                        at = np.flatnonzero(part.any(axis=0))
                        if len(at):
                            yield _batch("piece data", np.array([m * pieces + p], np.int32), [common.pack(_gaps(at.astype(np.uint64)), *part[:, at].astype(np.float64).view(np.uint64))])

    def merge(batches):
        now, total = None, None
        out = lambda: _batch("piece data", np.array([now], np.int32), [common.pack(*total.view(np.uint64))])
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, total = piece, np.zeros((3, PIECE))
                gaps, *part = common.unpack(data.as_py())
                total[:, np.cumsum(gaps).astype(np.int64)] += np.stack(part).view(np.float64)
        if now is not None:
            yield out()

    rows = counts.select("data").mapInArrow(common.released(run), "piece int, data binary").repartition("piece").sortWithinPartitions("piece")
    whole = np.zeros((2, 3, pieces * PIECE))
    for r in rows.mapInArrow(common.released(merge), "piece int, data binary").collect():
        m, p = divmod(r.piece, pieces)
        whole[m, :, p * PIECE : (p + 1) * PIECE] = np.stack(common.unpack(bytes(r.data))).view(np.float64)
    return whole[:, :, :codes]


class Pairs:
    """Pairs in order and their counts; pickled as ``common.pack`` does, as each executor keeps broadcasts on its disk."""

    def __init__(self, g: np.ndarray, n: np.ndarray):
        self.g, self.n = g, n

    def __reduce__(self):
        return Pairs.packed, (common.pack(_gaps(self.g), self.n),)

    @staticmethod
    def packed(data: bytes) -> Pairs:
        gaps, n = common.unpack(data)
        return Pairs(np.cumsum(gaps), n.astype(np.int64))

    def counts(self, g: np.ndarray) -> np.ndarray:
        """Of pairs g, 0 where they are not among these."""
        if not len(self.g):
            return np.zeros(len(g), np.int64)
        at = np.minimum(np.searchsorted(self.g, g), len(self.g) - 1)
        return np.where(self.g[at] == g, self.n[at], 0)


def frequent_pairs(counts: DataFrame, shards: int, most: int) -> Pairs:
    """About ``most`` pairs in all: the most frequent of each shard, to which a hash dealt them."""
    per = -(-most // shards)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                gaps, n = common.unpack(data.as_py())
                at = np.sort(np.argsort(-n.astype(np.int64), kind="stable")[:per])
                yield _batch("data", [common.pack(_gaps(np.cumsum(gaps)[at]), n[at])])

    rows = counts.select("data").mapInArrow(common.released(run), "data binary").collect()  # a row a shard
    found = [Pairs.packed(bytes(r.data)) for r in rows] or [Pairs(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    g, n = np.concatenate([x.g for x in found]), np.concatenate([x.n for x in found])
    at = np.argsort(g)
    return Pairs(g[at], n[at])


def _parts(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model, left and right word of pairs."""
    return (g >> _MODEL).astype(np.int64), ((g >> _LEFT) & _MASK).astype(np.int64), (g & _MASK).astype(np.int64)


class SingleWords:
    """What each model knows of single codes: total as left word, weight ``back`` of the lower order, lower-order share ``one`` over a code's spellings."""

    def __init__(self, statistics: np.ndarray, spellings: np.ndarray, others: int = 0, beyond: np.ndarray | None = None):
        """others: codes that follow those of ``statistics``; beyond: per model how many of them have 1, 2, 3, 4, 3 or more words left of them, and all these words."""
        codes = statistics.shape[2] + others
        beyond = np.zeros((2, 6)) if beyond is None else beyond
        self.total = statistics[:, 0].copy()  # without the other numbers
        self.back = np.where(self.total > 0, statistics[:, 1] / np.maximum(self.total, 1), 1.0)
        self.one, self.lower = np.empty((2, statistics.shape[2])), []  # lower: what gives ``one`` of another code
        self.spelled = spellings  # of codes below FIRST; others have one
        for m in (0, 1):
            c = statistics[m, 2]
            d = discounts(*(_counts_of_counts(c[c > 0]) + beyond[m, :4]))
            off = _taken(c, d)
            whole = max(1.0, c.sum() + beyond[m, 5])
            rest = ((off.sum() + beyond[m, [0, 1, 4]] @ d) / whole if c.any() or beyond[m, 5] else 1.0) / max(1, codes - 1)
            self.one[m] = (c - off) / whole + rest
            self.lower.append((d, whole, rest))
        self.judge = bool(self.total.any(axis=1).all())

    def __reduce__(self):
        """Most words are rare and share few values: pickled as the different ones and places among them."""
        parts = [np.unique(x, return_inverse=True) for m in (0, 1) for x in (self.total[m], self.back[m], self.one[m])]
        return SingleWords.packed, (common.pack(*(c for values, at in parts for c in (values.view(np.uint64), at))), self.spelled, self.judge)

    @classmethod
    def packed(cls, data: bytes, spelled: np.ndarray, judge: bool) -> SingleWords:
        new, parts = cls.__new__(cls), common.unpack(data)
        new.total, new.back, new.one = (np.stack([parts[6 * m + 2 * i].view(np.float64)[parts[6 * m + 2 * i + 1].astype(np.int64)] for m in (0, 1)]) for i in range(3))
        new.spelled, new.judge = spelled, judge
        return new

    def costs(self, g: np.ndarray, seen: np.ndarray, taken: list[list[float]], n: np.ndarray, far=None) -> np.ndarray:
        """Minus the log probability, n times, of pairs g that their models counted ``seen`` times.

        far: the places of pairs with other codes, their lower-order probabilities, and the totals of their left words.
        """
        m, left, right = _parts(g)
        near = slice(None) if far is None else np.delete(np.arange(len(g)), far[0])
        p, total = np.empty(len(g)), np.empty(len(g))
        p[near], total[near] = self.back[m[near], left[near]] * self.one[m[near], right[near]], self.total[m[near], left[near]]
        if far is not None:
            p[far[0]], total[far[0]] = far[1:]
        for k in (0, 1):
            own = np.flatnonzero((seen > 0) & (m == k))
            p[own] += (seen[own] - _taken(seen[own], taken[k])) / total[own]
        few = np.flatnonzero(right < len(self.spelled))
        p[few] /= self.spelled[right[few]]
        return -n.astype(np.float64) * np.log(p)


def sharded_scores(docs: DataFrame, counts: DataFrame, vocabulary, single, frequent, taken: list[list[float]], keys: list[int]) -> DataFrame:
    """doc_id, lang, n_words, perplexity of every row; perplexity is null without words."""

    def blocks(batches):
        for block, about, held in _blocks(batches, Codes(vocabulary.value), BLOCK_TOKENS, BLOCK_DOCS):
            yield block, about, held, None

    common.bounded_batches(docs.sparkSession)
    return _scores(_rows(docs), blocks, counts, single, frequent, taken, keys)


def _blocks(batches, words: Words, tokens: int, documents: int) -> Iterator[tuple[int, list[tuple], list[np.ndarray]]]:
    """Number, (doc_id, lang, number of words, half) and words of the documents of each block; batches as of ``_rows``."""
    from pyspark import TaskContext

    block, held, about, size = TaskContext.get().partitionId() << 31, [], [], 0
    for batch in batches:
        for doc_id, w, lang, half in zip(batch.column(0).to_pylist(), words.of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            held.append(w)
            about.append((doc_id, lang, len(w) - 1, half))
            size += len(w)
            if size > tokens or len(about) >= documents:
                yield block, about, held
                held, about, size, block = [], [], 0, block + 1
    if about:
        yield block, about, held


def _scores(rows: DataFrame, blocks, counts: DataFrame, single, frequent, taken: list[list[float]], keys: list[int]) -> DataFrame:
    """``blocks`` makes, out of batches of rows, what ``_blocks`` does with codes for words, and what finds ``far`` of pairs, or None."""

    def ask(batches):
        know, known = single.value, frequent.value

        def out(block, about, held, find):
            g = np.concatenate([(np.uint64(1 - half) << _MODEL) | (w[:-1] << _LEFT) | w[1:] for w, (_, _, _, half) in zip(held, about, strict=True)])
            owner = np.repeat(np.arange(len(held)), [len(w) - 1 for w in held])
            at = np.argsort(g, kind="stable")  # equal pairs stay in order of their documents
            g, owner = g[at], owner[at]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]))
            n = np.diff(np.append(first, len(g)))
            g, owner = g[first], owner[first]
            seen = known.counts(g)
            at, rest = np.flatnonzero(seen), np.flatnonzero(seen == 0)
            costs = np.bincount(owner[at], know.costs(g[at], seen[at], taken, n[at], find and find(know, g[at])), len(about))
            g, owner, n = g[rest], owner[rest], n[rest]
            home = block % len(keys)
            parts = {home: np.zeros(0, np.int64)} | dict(_dealt(g, len(keys)))
            for s, at in parts.items():
                told = [*map(list, zip(*(x[:3] for x in about), strict=True)), costs.tolist()] if s == home else [None] * 4
                far = find and find(know, g[at])
                packed = None if far is None else common.pack(_gaps(far[0].astype(np.uint64)), far[1].view(np.uint64), far[2].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[s]], pa.int32()), pa.array([1], pa.int32()), pa.array([block], pa.int64()), pa.array([common.pack(_gaps(g[at]), owner[at], n[at])], pa.binary()), pa.array([told[0]], pa.list_(pa.int64())), pa.array([told[1]], pa.list_(pa.string())), pa.array([told[2]], pa.list_(pa.int64())), pa.array([told[3]], pa.list_(pa.float64())), pa.array([packed], pa.binary())],
                    names=["shard", "kind", "block", "data", "ids", "langs", "sizes", "costs", "far"],
                )

        for found in blocks(batches):
            yield from out(*found)

    def answer(batches):
        know, now, seen = single.value, None, None
        for batch in batches:
            for i, (shard, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if kind == 0:
                    now, seen = shard, Pairs.packed(batch.column(3)[i].as_py())
                    continue
                if shard != now:  # no trusted pair fell into this shard
                    now, seen = shard, Pairs(np.zeros(0, np.uint64), np.zeros(0, np.int64))
                got = common.unpack(batch.column(3)[i].as_py())
                g = np.cumsum(got[0])
                far = batch.column(8)[i].as_py()
                if far is not None:
                    far = common.unpack(far)
                    far = np.cumsum(far[0]).astype(np.int64), far[1].view(np.float64), far[2]
                cost = know.costs(g, seen.counts(g), taken, got[2], far)
                owner = got[1].astype(np.int64)
                sums = np.bincount(owner, cost) if len(owner) else np.zeros(0)
                at = np.flatnonzero(np.bincount(owner)) if len(owner) else np.zeros(0, np.int64)
                data = common.pack(_gaps(at.astype(np.uint64)), sums[at].astype(np.float32).view(np.uint32))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1), pa.array([data], pa.binary()), *(batch.column(c).slice(i, 1) for c in (4, 5, 6, 7))], names=["block", "data", "ids", "langs", "sizes", "costs"])

    def gather(batches):
        now, sums, told = None, None, None

        def out():
            n = np.array(told[2], np.int64)
            cost = [float(np.exp(c / k)) if k else None for c, k in zip((sums[: len(n)] + told[3]).tolist(), n.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(told[0], pa.int64()), pa.array(told[1], pa.string()), pa.array(n), pa.array(cost, pa.float64())], names=["doc_id", "lang", "n_words", "perplexity"])

        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block != now:
                    if now is not None:
                        yield out()
                    now, sums, told = block, np.zeros(BLOCK_DOCS), None
                gaps, cost = common.unpack(batch.column(1)[i].as_py())
                sums[np.cumsum(gaps).astype(np.int64)] += cost.astype(np.uint32).view(np.float32)
                told = told or (batch.column(2)[i].is_valid and [batch.column(c)[i].as_py() for c in (2, 3, 4, 5)] or None)
        if now is not None:
            yield out()

    asked = rows.mapInArrow(common.released(ask), "shard int, kind int, block long, data binary, ids array<long>, langs array<string>, sizes array<long>, costs array<double>, far binary")
    null = lambda kind: F.lit(None).cast(kind)
    known = counts.select("shard", F.lit(0).alias("kind"), null("long").alias("block"), "data", null("array<long>").alias("ids"), null("array<string>").alias("langs"), null("array<long>").alias("sizes"), null("array<double>").alias("costs"), null("binary").alias("far"))
    dealt = known.unionByName(asked).repartition(len(keys), "shard").sortWithinPartitions("shard", "kind")
    told = dealt.mapInArrow(common.released(answer), "block long, data binary, ids array<long>, langs array<string>, sizes array<long>, costs array<double>")
    return told.repartition("block").sortWithinPartitions("block").mapInArrow(common.released(gather), _SCORES)


def divided_vocabulary(vocabulary: DataFrame, size: int, most: int) -> tuple[np.ndarray, DataFrame]:
    """Values in ``Words`` of about the ``most`` frequent words, sorted; w and code of all others, whose codes follow; written."""
    spark = vocabulary.sparkSession
    cut = vocabulary.agg(F.percentile_approx("n", 1 - min(1.0, most / size), 100_000)).first()[0]
    head = np.sort(vocabulary.filter(F.col("n") > cut).select("w").toArrow().column("w").to_numpy().view(np.uint64))
    parts = max(1, (size - len(head)) // PIECE)
    tail = vocabulary.filter(F.col("n") <= cut).select("w", F.pmod(F.xxhash64("w"), F.lit(parts)).alias("part"))
    starts, at = [], FIRST + len(head)
    for r in tail.groupBy("part").count().collect():  # a row for PIECE words
        starts.append((r.part, at))
        at += r["count"]
    by = Window.partitionBy("part").orderBy("w")
    tail = tail.join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    return head, common.materialize(tail.select("w", (F.col("start") + F.row_number().over(by) - 1).alias("code")), "quality-tail")


def coded_blocks(rows: DataFrame, head) -> DataFrame:
    """Blocks of the documents of ``_rows`` in codes of ``head``, a packed row each, and a row for each other word (h) of a block; written."""

    def run(batches):
        for block, about, held in _blocks(batches, Open(head.value), BLOCK_TOKENS, BLOCK_DOCS):
            values, at, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, langs, sizes, halves = map(list, zip(*about, strict=True))
            open_ = values[values > _MASK]
            data = common.pack(_gaps(values), rank, rank[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([None], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([langs], pa.list_(pa.string())), pa.array([sizes], pa.list_(pa.int64())), pa.array([halves], pa.list_(pa.int64()))],
                names=["block", "h", "data", "ids", "langs", "sizes", "halves"],
            )
            null = lambda kind: pa.nulls(len(open_), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(open_), block)), pa.array(open_.view(np.int64)), null(pa.binary()), null(pa.list_(pa.int64())), null(pa.list_(pa.string())), null(pa.list_(pa.int64())), null(pa.list_(pa.int64()))],
                names=["block", "h", "data", "ids", "langs", "sizes", "halves"],
            )

    common.bounded_batches(rows.sparkSession)
    schema = "block long, h long, data binary, ids array<long>, langs array<string>, sizes array<long>, halves array<long>"
    return common.materialize(rows.mapInArrow(common.released(run), schema), "quality-coded")


def _with_tail(coded: DataFrame, tail: DataFrame) -> DataFrame:
    """Rows of ``coded_blocks``, of other words those in ``tail`` with its columns; a block's words stand before the block."""
    more = [c for c in tail.columns if c != "w"]
    words = coded.filter("h is not null").select("block", "h").join(tail.withColumnRenamed("w", "h"), "h").select("block", "h", *more)
    whole = coded.filter("h is null").select("block", "data", "ids", "langs", "sizes", "halves")
    rows = words.unionByName(whole, allowMissingColumns=True).select("block", "data", "ids", "langs", "sizes", "halves", "h", *more)
    return rows.repartition("block").sortWithinPartitions("block", F.col("h").isNull())


def _uncoded(batches) -> Iterator[tuple[int, list[tuple], list[np.ndarray], np.ndarray]]:
    """Of rows of ``_with_tail``: as ``_blocks`` does, with the codes of all words; and the tail's columns but h, by code."""
    held = []
    for batch in batches:
        start = 0
        for i in np.flatnonzero(batch.column(1).is_valid()).tolist():
            held.append(batch.slice(start, i - start))
            start = i + 1
            words = np.stack([np.concatenate([x.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for x in held]) for c in range(6, batch.num_columns)])
            held = []
            h, codes = words[0].view(np.uint64), words[1].view(np.uint64)
            by = np.argsort(h)
            h, codes = h[by], codes[by]
            gaps, rank, at = common.unpack(batch.column(1)[i].as_py())
            values = np.cumsum(gaps)
            other = np.flatnonzero(values > _MASK)
            found = np.searchsorted(h, values[other])
            known = found < len(h)
            known[known] = h[found[known]] == values[other][known]
            values[other[~known]] &= np.uint64(127)
            values[other[known]] = codes[found[known]]
            ranked = np.empty(len(values), np.uint64)
            ranked[rank.astype(np.int64)] = values
            about = list(zip(*(batch.column(c)[i].as_py() for c in (2, 3, 4, 5)), strict=True))
            ends = np.cumsum([n + 1 for _, _, n, _ in about])
            yield batch.column(0)[i].as_py(), about, np.split(ranked[at.astype(np.int64)], ends[:-1]), words[1:, np.argsort(words[1])]
        held.append(batch.slice(start))


def tail_statistics(counts: DataFrame, codes: int) -> DataFrame:
    """Of each code from ``codes`` on, and each model m: how often it stands left (total_m), in how many pairs once, twice, more often (a_m, b_m, c_m), and how many words stand left of it (follow_m)."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                gaps, n = common.unpack(data.as_py())
                g, n = np.cumsum(gaps), n.astype(np.int64)
                m, left, right = _parts(g)
                at, to = np.flatnonzero(left >= codes), np.flatnonzero(right >= codes)
                keys, place = np.unique(np.concatenate([2 * left[at] + m[at], 2 * right[to] + m[to]]), return_inverse=True)
                of_left, of_right = place[: len(at)], place[len(at) :]
                count = lambda some: np.bincount(of_left[some], minlength=len(keys))
                total = np.bincount(of_left, n[at], len(keys)).astype(np.int64)
                for k in range(0, len(keys), PIECE):
                    yield _batch("code m total a b c follow", *(x[k : k + PIECE].astype(np.int64) for x in (keys >> 1, keys & 1, total, count(n[at] == 1), count(n[at] == 2), count(n[at] > 2), np.bincount(of_right, minlength=len(keys)))))

    rows = counts.select("data").mapInArrow(common.released(run), "code long, m long, total long, a long, b long, c long, follow long")
    return rows.groupBy("code").agg(*(F.sum(F.when(F.col("m") == m, F.col(x)).otherwise(0)).alias(f"{x}_{m}") for m in (0, 1) for x in ("total", "a", "b", "c", "follow")))


def divided_perplexities(docs: DataFrame, trusted: DataFrame, vocabulary: DataFrame, size: int, spellings: np.ndarray, words: int) -> tuple[DataFrame, bool]:
    """As ``perplexities``, for a vocabulary of any size: what each block needs of its less frequent words is joined to it."""
    context = docs.sparkSession.sparkContext
    hashes, tail = divided_vocabulary(vocabulary, size, min(HEAD_WORDS, BROADCAST_WORDS))
    head, codes = context.broadcast(hashes), FIRST + len(hashes)
    keys = common.spread_keys(docs.sparkSession, max(1, -(-words // SHARD_WORDS)))

    def documents(batches):
        for _, about, held, _ in _uncoded(batches):
            yield from zip(held, (x[3] for x in about), strict=True)

    coded = coded_blocks(trusted, head)
    counts = _pair_counts(_with_tail(coded, tail), documents, keys)
    common.discard(coded)
    taken = _model_discounts(counts)
    found = tail.join(tail_statistics(counts, codes), "code", "left").na.fill(0)
    found = common.materialize(found.select("w", "code", *(f"{x}_{m}" for m in (0, 1) for x in ("total", "a", "b", "c", "follow"))), "quality-tail")
    common.discard(tail)
    of = lambda f, m: F.coalesce(F.sum(F.when(f(F.col(f"follow_{m}")), 1).otherwise(0)), F.lit(0))
    beyond = [[*(of(lambda c, k=k: c == k, m) for k in (1, 2, 3, 4)), of(lambda c: c >= 3, m), F.coalesce(F.sum(f"follow_{m}"), F.lit(0))] for m in (0, 1)]
    beyond = np.array(found.agg(*(x.alias(f"n{i}") for i, x in enumerate(sum(beyond, [])))).first(), float).reshape(2, 6)
    known = SingleWords(word_statistics(counts, taken, codes), spellings, size - len(hashes), beyond)
    single, frequent, lower = context.broadcast(known), context.broadcast(frequent_pairs(counts, len(keys), FREQUENT)), known.lower

    def blocks(batches):
        for block, about, held, of in _uncoded(batches):
            own, of = of[0], of[1:].reshape(2, 5, -1)
            total = of[:, 0].astype(float)
            back = np.stack([np.where(of[m, 0] > 0, np.array(taken[m]) @ of[m, 1:4] / np.maximum(of[m, 0], 1), 1.0) for m in (0, 1)])
            one = np.stack([(of[m, 4] - _taken(of[m, 4], lower[m][0])) / lower[m][1] + lower[m][2] for m in (0, 1)])

            def find(know, g, own=own, total=total, back=back, one=one):
                m, left, right = _parts(g)
                at = np.flatnonzero((left >= codes) | (right >= codes))
                if not len(at):
                    return None
                m, left, right = m[at], left[at], right[at]

                def pick(code, near, far):
                    out, beyond = np.empty(len(code)), code >= codes
                    out[~beyond] = near[m[~beyond], code[~beyond]]
                    out[beyond] = far[m[beyond], np.searchsorted(own, code[beyond])]
                    return out

                return at, pick(left, know.back, back) * pick(right, know.one, one), pick(left, know.total, total)

            yield block, about, held, find

    coded = coded_blocks(_rows(docs), head)
    scores = common.materialize(_scores(_with_tail(coded, found), blocks, counts, single, frequent, taken, keys), "quality-scores")
    for table in (coded, found, vocabulary, counts):
        common.discard(table)
    for sent in (head, single, frequent):
        sent.destroy()
    return scores, known.judge


def perplexities(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, lang, n_words and perplexity (null without words) of every row, and whether both models have words; written."""
    context = docs.sparkSession.sparkContext
    vocabulary, spellings, words = vocabulary_table(trusted)
    size = vocabulary.count()
    if size > BROADCAST_WORDS:
        return divided_perplexities(docs, trusted, vocabulary, size, spellings, words)
    hashes = context.broadcast(np.sort(vocabulary.select("w").toArrow().column("w").to_numpy().view(np.uint64)))  # as rows they would take many times their 8 bytes
    keys = common.spread_keys(docs.sparkSession, max(1, -(-words // SHARD_WORDS)))
    counts = pair_counts(trusted, hashes, keys)
    taken = _model_discounts(counts)
    known = SingleWords(word_statistics(counts, taken, FIRST + size), spellings)
    single, frequent = context.broadcast(known), context.broadcast(frequent_pairs(counts, len(keys), FREQUENT))
    scores = common.materialize(sharded_scores(docs, counts, hashes, single, frequent, taken, keys), "quality-scores")
    for table in (vocabulary, counts):
        common.discard(table)
    for sent in (hashes, single, frequent):
        sent.destroy()
    return scores, known.judge


def quality_table(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row: doc_id, lang, n_words, perplexity, threshold, kept.

    Words are what Python's ``str.split`` yields. Texts without words (null, empty, white space alone) have no
    perplexity and are rejected. The threshold is the quantile over the trusted documents of the row's language;
    without such, or with null lang, over all trusted documents. Without trusted documents in both halves nothing is
    rejected but texts without words. Repeated rows are judged alike; each gives a row. Very long texts are scored whole.
    """
    good = trusted_ids(labels)
    scored, judge = perplexities(docs, trusted_documents(docs, good))
    near = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    # a model of no text judges nothing
    known = scored.join(near, F.col("doc_id") == F.col("good_id"), "left_semi").filter(F.col("perplexity").isNotNull() & F.lit(judge))
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    per = common.materialize(known.groupBy("lang").agg(cut.alias("cut")), "quality-cuts")
    whole = known.agg(cut.alias("c")).first()["c"]
    whole = float("inf") if whole is None else whole
    out = scored.join(per.filter("lang is not null"), "lang", "left")  # a row a language
    threshold = F.when(F.col("perplexity").isNotNull(), F.coalesce("cut", F.lit(whole)))
    out = out.withColumn("threshold", threshold)
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs``, all columns, without the rows that the classifier rejects. Rows that share a doc_id go together if any is rejected."""
    bad = quality_table(docs, labels, quantile).filter(~F.col("kept")).select(F.col("doc_id").alias("__bad")).distinct()
    bad = common.materialize(bad, "quality-rejected")
    if bad.count() <= 1_000_000:
        bad = F.broadcast(bad)
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")), "left_anti")
