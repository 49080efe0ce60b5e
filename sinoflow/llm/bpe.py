"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a word has exactly one BPE encoding, hence one last token. The last tokens are found left to
right: an automaton over the vocabulary lists the tokens that are suffixes of the prefix, and a candidate is the
last token if it is compatible with the last token of the prefix before it, i.e. if BPE applied to the two
side by side would not merge across their border. Back-pointers over the stored tokens give the ids. The cost is
linear in the word, with no priority queue and no repeated merging.

White space never joins two words in this vocabulary, so the text is cut there and the encodings of recurring
words are kept in a bounded cache of the Python worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import string
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sinoflow.llm import common

#: Private-use code points mark the last symbol of a word in the automaton.
_LAST = 0xE000
#: Entries of a worker's caches (of pieces, twice as many), and the longest word that is kept.
CACHE_WORDS = 220_000
CACHE_CHARS = 64
#: Controls that Python's str.split takes for white space and the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


class PrefixBPE:
    """A word-level BPE vocabulary file of the tokenizers library, encoded by prefix dynamic programming."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self._normalize = library.normalizer.normalize_str if library.normalizer else str
        self._pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self._special_at = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None

        self._plain = self._letter_table()

        vocab: dict[str, int] = model["vocab"]
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self._special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._rank: dict[tuple[int, int], int] = {}
        made, left, right = {}, {}, {}
        for rank, (a, b) in enumerate(merges):
            t = vocab[a + b]
            self._rank[vocab[a], vocab[b]] = rank
            if t in made:
                raise ValueError("a token is made by more than one merge")
            made[t], left[t], right[t] = rank, vocab[a], vocab[b]
        self._made, self._left, self._right = made, left, right
        self._pairs: dict[int, bool] = {}

        whole: dict[int, bool] = {}
        self._ids: dict[str, int] = {}
        automaton = ahocorasick.Automaton()
        for t in sorted(vocab.values(), key=lambda t: made.get(t, -1)):
            # a token can end an encoding only if BPE turns its own string into it
            whole[t] = t not in made or (
                whole[left[t]] and whole[right[t]] and self._compatible(left[t], right[t], made[t])
            )
            if whole[t] and (s := self._symbols(self.token_of[t])):
                self._ids[s] = t
                automaton.add_word(s, (t, len(s)))
        automaton.make_automaton()
        self._suffixes = automaton.iter
        self._words: dict[str, tuple[int, ...]] = {}

    def _letter_table(self) -> dict[int, str] | None:
        """What normalising makes of ASCII letters, if it takes them one by one and words of them, before a full stop or comma or not, stay whole."""
        table = {ord(c): self._normalize(c) for c in string.ascii_letters}
        cut = lambda text: [w for w, _ in self._pre_tokenize(text)]
        for text in (string.ascii_letters, string.ascii_letters.swapcase()):
            plain = text.translate(table)
            if self._normalize(text) != plain or cut(plain) != [plain] or any(self._normalize(text + c) != plain + c or cut(plain + c) != [plain, c] for c in ".,"):
                return None
        return table

    def _symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(_LAST + ord(token[-1]))
        return token

    def _compatible(self, l: int, r: int, limit: float = float("inf")) -> bool:
        """Whether BPE keeps the border between tokens l and r, looking only at merges before ``limit``."""
        made, rank = self._made, self._rank
        while True:
            if rank.get((l, r), limit) < limit:
                return False
            made_l, made_r = made.get(l, -1), made.get(r, -1)
            if made_l > made_r:
                l, limit = self._right[l], made_l  # undo the later merge; of equal merges the left one comes first
            elif made_r < 0:
                return True
            else:
                r, limit = self._left[r], made_r + 1

    def compatible(self, l: int, r: int) -> bool:
        known = self._pairs.get(l << 32 | r)
        if known is None:
            if len(self._pairs) >= 4 * CACHE_WORDS:
                self._pairs.clear()
            known = self._pairs[l << 32 | r] = self._compatible(l, r)
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token, given in the alphabet of the vocabulary."""
        ids = self._words.get(word)
        if ids is not None:
            return ids
        symbols = word[:-1] + chr(_LAST + ord(word[-1])) if self.suffix else word
        only = self._ids.get(symbols)
        ids = (only,) if only is not None else self._prefixes(symbols)
        if len(word) <= CACHE_CHARS:
            if len(self._words) >= CACHE_WORDS:  # most recurring words are kept as pieces already
                self._words.clear()
            self._words[word] = ids
        return ids

    def _prefixes(self, symbols: str) -> tuple[int, ...]:
        last: list[int | None] = [None] * (len(symbols) + 1)
        size = [0] * (len(symbols) + 1)
        compatible, known = self.compatible, self._pairs.get
        for end, (token, length) in self._suffixes(symbols):
            end += 1
            if last[end] is None:
                start = end - length
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    fits = known(before << 32 | token)
                    if not (compatible(before, token) if fits is None else fits):
                        continue
                last[end], size[end] = token, length
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= size[at]
        return tuple(reversed(ids))

    def encode_piece(self, piece: str) -> Sequence[int]:
        """Ids of a text without white space, or of any text."""
        if self._plain and piece.isascii():  # most pieces need no library
            if piece.isalpha():
                return self.encode_word(piece.translate(self._plain))
            if piece[-1:] in (".", ",") and piece[:-1].isalpha():
                return self.encode_word(piece[:-1].translate(self._plain)) + self.encode_word(piece[-1])
        ids: list[int] = []
        for part in self._special_at.split(piece) if self._special_at and "<" in piece else (piece,):
            if part in self._special:
                ids.append(self._special[part])
            elif part:
                for word, _ in self._pre_tokenize(self._normalize(part)):
                    ids += self.encode_word(word)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for piece in pieces(text) for i in self.encode_piece(piece)]

    def decode(self, ids) -> str:
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


def pieces(text: str) -> list[str]:
    """The text cut at white space."""
    if _NOT_SPACE.search(text):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


@lru_cache(maxsize=4)
def encoder(path: str) -> PrefixBPE:
    return PrefixBPE(path)


class PieceCache(dict):
    """Remembers what ``make`` returns for short pieces in two generations: when the younger is full, the older goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=4)
def _digest_cache(path: str) -> PieceCache:
    bpe = encoder(path)
    token_of, said = bpe.token_of, {i: str(i) for i in bpe.token_of}

    def make(piece: str) -> tuple[str, str, int]:
        ids = bpe.encode_piece(piece)  # of the vocabulary, so each has a token
        if len(ids) == 1:
            return said[ids[0]], token_of[ids[0]], 1
        return " ".join([said[i] for i in ids]), " ".join([token_of[i] for i in ids]), len(ids)

    return PieceCache(make)


def digest_table(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its decimal ids and of its decoded text.

    The round trip runs piece by piece: ids and decoded tokens of a piece are made once and joined per document,
    so that no list of ids is held. Null and empty texts have 0 tokens and the digests of the empty string; rows
    with equal doc_id stay separate rows; the row order does not matter; an empty table gives an empty table.
    """
    common.bounded_batches(docs.sparkSession)

    def run(batches):
        known = _digest_cache(path)
        get = known.__getitem__
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for value in batch.column(1):
                ids, tokens, n = tuple(zip(*map(get, pieces(value.as_py())))) or ((), (), ())
                counts.append(sum(n))
                of_ids.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                of_text.append(hashlib.sha256(" ".join(tokens).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.texts(docs).mapInArrow(common.released(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
