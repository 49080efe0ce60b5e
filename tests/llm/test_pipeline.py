"""The corpus pipeline as a whole against plain Python: what the classifier keeps, put through brute-force versions of the later stages."""

import hashlib
import re

import corpus_pipeline
from sinoflow.llm.queries import WORD_BPE, vocabulary

DATA = "/root/testdata/sf0.001"


def shingles(words):
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def words_of(text, lower):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


def one_of_each_text(texts):
    last = {t: i for i, t in sorted(texts.items())}
    return {i: t for t, i in last.items()}


def one_of_each_component(texts):
    ascii_lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {i: shingles(words_of(t, ascii_lower)) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: texts[i] for i in ids if root(i) == i}


def without_items(texts, items):
    wanted = [(len(words_of(t or "", str.lower)) >= 5, shingles(words_of(t or "", str.lower))) for t in items]

    def holds(text):
        words = words_of(text, str.lower)
        own = shingles(words)
        return any(s and (5 * len(own & s) >= 4 * len(s) if cut else own == s) for cut, s in wanted)

    return {i: t for i, t in texts.items() if not holds(t)}


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = corpus_pipeline.quality_stage(spark, docs, DATA)
    assert good.columns == docs.columns
    start = {r.doc_id: r.text or "" for r in good.collect()}
    once = one_of_each_text(start)
    apart = one_of_each_component(once)
    clean = without_items(apart, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    assert len(start) > len(once) > len(apart) > len(clean) > 0  # every stage has something to do
    library = Tokenizer.from_file(vocabulary(WORD_BPE))
    library.no_truncation()
    library.no_padding()
    want = set()
    for i, t in clean.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got} == want
    assert len(got) == len(want)
