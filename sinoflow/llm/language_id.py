"""Language identification with unigrams marginalised over segmentations.

A public vocabulary of pieces is fixed. Each language has a probability for every piece. The probability of a word is
the sum over all ways to cut it into pieces, computed by a forward recursion; a text's is the product over its words.
The piece probabilities are fitted by expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinoflow.llm import common

_WORD = re.compile(r"[^\W\d_]+")
#: The probability of a letter without a piece.
UNKNOWN = 1e-7
#: Bounds of the fit: labelled documents of a language (about so many), different words of them, letters of a word; and its rounds.
SAMPLE_DOCS, FIT_WORDS, FIT_CHARS, ROUNDS = 300, 500_000, 24, 2
#: Positions of words whose pieces are held at once, and steps between rescalings of the recursion.
WINDOW, RESCALE = 1 << 12, 16
CACHE_WORDS = 400_000
_BASE = np.uint64(0x100000001B3)


def letters(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # the pattern also takes signs like ² and ½ that are numbers, not letters
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Pieces:
    """Letter pieces of a vocabulary, found in words by rolling hashes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
        self.names = sorted(p for p in names if p.replace("▁", "").isalpha() and "▁" not in p[1:])
        self.longest = max(map(len, self.names))
        hashes = np.array([self._hash(p) for p in self.names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)  # id 0: no piece
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        return h

    def lattice(self, words: list[str], first: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids[word, start - first, length - 1] of the pieces at the starts in [first, stop), and the words' lengths, each with a mark in front."""
        size = np.array([len(w) + 1 for w in words])
        stop = int(size.max()) if stop is None else stop
        wide, reach = stop - first, stop - first + self.longest
        there = np.clip(size - first, 0, reach)
        codes = np.zeros((len(words), reach), np.uint64)
        flat = "".join(("▁" + w[: first + reach - 1] if first == 0 else w[first - 1 : first + reach - 1]) for w in words)
        codes[np.arange(reach)[None, :] < there[:, None]] = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes *= np.uint64(0x9E3779B97F4A7C15)
        ids = np.zeros((len(words), wide, self.longest), np.int32)
        h = np.zeros((len(words), wide), np.uint64)
        for length in range(1, self.longest + 1):
            h = h * _BASE + codes[:, length - 1 : length - 1 + wide]
            here = self.seen[h >> np.uint64(44)] & (np.arange(wide)[None, :] + length <= there[:, None])
            w, s = np.nonzero(here)
            found = h[w, s]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            ids[w, s, length - 1] = np.where(self.hashes[at] == found, self.ids[at], 0)
        return ids, size

    def _step(self, ids: np.ndarray, end: int, first: int, before: list[np.ndarray], prob: np.ndarray) -> np.ndarray:
        """alpha of the first ``end`` characters from ``before``, those of shorter ends, the last of them last."""
        one = ids[:, end - 1 - first, 0]
        total = before[-1] * np.where((one == 0)[:, None], UNKNOWN, prob[one])
        for length in range(2, min(end, self.longest) + 1):
            piece = ids[:, end - length - first, length - 1]
            some = np.flatnonzero(piece)
            if len(some):
                total[some] += before[-length][some] * prob[piece[some]]
        return total

    def forward(self, ids: np.ndarray, size: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """alpha[word, end, language]: the probability of all segmentations of the first ``end`` characters. prob[piece, language]; row 0 is 0."""
        ends = [np.ones((len(size), prob.shape[1]))]
        for end in range(1, ids.shape[1] + 1):
            ends.append(self._step(ids, end, 0, ends, prob))
        return np.stack(ends, axis=1)

    def log_probabilities(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log of the probability of all segmentations of words of any length, by language; pieces are held a window of positions at a time."""
        size = np.array([len(w) + 1 for w in words])
        top, shape = int(size.max()), (len(words), prob.shape[1])
        out, scale, before = np.zeros(shape), np.zeros(shape), [np.ones(shape)]
        for low in range(0, top, WINDOW):
            first, stop = max(0, low - self.longest + 1), min(top, low + WINDOW)
            ids, _ = self.lattice(words, first, stop)
            for end in range(low + 1, stop + 1):
                before = [*before[1 - self.longest :], self._step(ids, end, first, before, prob)]
                if end % RESCALE == 0:
                    high = np.maximum(before[-1], 1e-300)
                    scale += np.log(high)
                    before = [x / high for x in before]
                done = size == end
                if done.any():
                    out[done] = np.log(np.maximum(before[-1][done], 1e-300)) + scale[done]
        return out

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations of the words, one language."""
        out = np.zeros(len(self.names) + 1)
        for low in range(0, len(words), 20_000):
            ids, size = self.lattice(words[low : low + 20_000])
            n, top = ids.shape[:2]
            alpha = self.forward(ids, size, prob[:, None])[:, :, 0]
            beta = np.zeros((n, top + 1 + self.longest))
            beta[np.arange(n), size] = 1.0
            whole = alpha[np.arange(n), size]
            scale = np.where(whole > 0, counts[low : low + n] / np.maximum(whole, 1e-300), 0.0)
            for start in range(top - 1, -1, -1):
                for length in range(1, self.longest + 1):
                    piece = ids[:, start, length - 1]
                    p = prob[piece]
                    if length == 1:
                        p = np.where((piece == 0) & (start < size), UNKNOWN, p)
                    use = p * beta[:, start + length]
                    beta[:, start] += use
                    np.add.at(out, piece, use * alpha[:, start] * scale)
        out[0] = 0
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the doc_id as text leaves 1 modulo 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and prob[piece, language], fitted on about ``sample_docs`` documents of each, chosen by a hash of doc_id and text.

    Of these the FIT_WORDS most frequent words of at most FIT_CHARS letters are used.
    """
    common.bounded_batches(docs.sparkSession)
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(sizes)
    rank = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(7)), F.lit(1_000_000))
    some = F.lit(False)
    for name in names:
        some = some | ((F.col("lang") == name) & (rank < int(1_000_000 * min(1.0, sample_docs / sizes[name])) + 1))
    sample = usable.filter(some).select(F.col("text").cast("string"), "lang")

    def run(batches):
        from collections import Counter

        for batch in batches:
            counted: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counted.update((lang, w) for w in letters(text) if len(w) <= FIT_CHARS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in counted]), pa.array([k[1] for k in counted]), pa.array(list(counted.values()), pa.int64())], names=["lang", "word", "n"]
            ) if counted else pa.RecordBatch.from_pylist([], schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    words = sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang", "word").limit(FIT_WORDS).toPandas()
    known = pieces(path)
    prob = np.zeros((len(known.names) + 1, max(1, len(names))))
    for k, name in enumerate(names):
        mine = words[words["lang"] == name].sort_values("word")
        p = np.full(len(known.names) + 1, 1.0 / (len(known.names) + 1))
        p[0] = 0
        if len(mine):
            for _ in range(ROUNDS):
                use = known.expected(mine["word"].tolist(), mine["n"].to_numpy(float), p) + 0.01
                use[0] = 0
                p = use / use.sum()
        prob[:, k] = p
    return names, prob


def language_table(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (posterior of the predicted language under equal priors).

    ``und`` with score 0 for a null text, one without letters, or without any language to learn from. Ties go to the
    language first in the alphabet. Rows that share a doc_id are judged each by its text. Words of any length are summed
    whole. An empty table gives an empty table.
    """
    names, prob = train(docs, path, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(prob)  # vocabulary by languages
    state: dict = {}

    def run(batches):
        if not state:
            state.update(at={}, table=np.zeros((CACHE_WORDS, len(names))))
        at, table, known = state["at"], state["table"], pieces(path)

        def learn(words):
            low = 0  # words come by length
            while low < len(words):
                high = low + 1
                while high < len(words) and high - low < 8192 and (high - low) * min(WINDOW, len(words[high])) < 1 << 18:
                    high += 1
                part = words[low:high]
                table[len(at) : len(at) + len(part)] = known.log_probabilities(part, shared.value)
                for w in part:
                    at[w] = len(at)
                low = high

        for batch in batches:
            out_lang, out_score = [], []
            for low in range(0, batch.num_rows, 200):
                rows = [letters(t) for t in batch.column(2).slice(low, 200).to_pylist()]
                new = {w for row in rows for w in row if w not in at}
                if len(at) + len(new) > CACHE_WORDS:
                    at.clear()
                    new = {w for row in rows for w in row}
                    if len(new) > len(table):
                        table = state["table"] = np.zeros((2 * len(new), len(names)))
                if names:
                    learn(sorted(new, key=len))
                for row in rows:
                    if not row or not names:
                        out_lang.append("und")
                        out_score.append(0.0)
                        continue
                    total = table[np.fromiter(map(at.__getitem__, row), np.int64, len(row))].sum(axis=0)
                    best = int(total.argmax())
                    out_lang.append(names[best])
                    out_score.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"]
            )

    rows = common.texts(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
