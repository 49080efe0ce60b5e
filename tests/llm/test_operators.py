"""The operators on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinoflow.llm import bpe, chunk_dedup, common, decontaminate, exact_dedup, jaccard_join, language_id, pii, quality, token_planes, url_filter
from sinoflow.llm.queries import PIECES, WORD_BPE, vocabulary

PATH = vocabulary(WORD_BPE)
DATA = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, key string, n int, hash string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y", 3, "z") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(WORDS[:100])
    near = base.replace("w50 ", "changed ")
    return [
        (1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "One TWO"), (6, base), (7, base), (7, base), (8, near), (None, "Straße ΑΣ <|endoftext|>x"), (9, "y" * 50_000),
        (10, " ".join(WORDS * 20)), (11, "mail me: a.b@c.de, b@x.org.y_z@q.com or +49 (30) 1234567; card 4111 1111 1111 1111 ip 1.2.3.4 1.2.3.400 iban DE89 3704 0044 0532 0130 00"),
        (12, None), (13, "\x1cab\x85cd é"),
    ]


def test_prefix_encoding_is_exact():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), bpe.encoder(PATH)
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abtheinrao 'ÀéΑΣİ日12.,!<|endoftext|>\x1c\x85́"), 60)) for _ in range(1500)] + ["a" * 3000, ""]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, bpe.digest_table(rows(spark, odd), PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in odd:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.digest_table(rows(spark, []), PATH).count() == 0


def test_piece_cache_is_exact(monkeypatch):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(PATH), token_planes.PieceIds(PATH)
    monkeypatch.setattr(token_planes, "CACHE_PIECES", 50)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abtheinrao  'ÀéİΑΣﬁ̂日12.,!#<|endoftext|>\x1c\x85́ªʰ"), 80)) for _ in range(800)] + ["", "<|endoftext|>", "İstanbul The, the THE. the,", "y" * 3000]
    for t in texts + texts[:20]:
        assert np.frombuffer(own.document(bpe.pieces(t)), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    ids = np.random.default_rng(1).integers(0, 1 << 31, 70_001).astype("<u4")
    for x in (ids, ids[:0], ids[:1] * 0, ids % 49_000):
        sizes, data = token_planes.pack(x, 1 << 12, bits)
        assert (token_planes.unpack(sizes, data, len(x), 1 << 12, bits) == x).all()


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = {(r.start, r.doc_id): (r.n_tokens, r.ids_crc32) for r in token_planes.token_table(rows(spark, odd), PATH).collect()}
    at, want = 0, {}
    for i, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[at, i] = (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert got == want
    assert token_planes.token_table(rows(spark, []), PATH).count() == 0


def test_personal_data(spark, odd):
    found = {r.doc_id: r for r in pii.pii_table(rows(spark, odd)).collect()}
    text = dict(odd)[11]
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    spans = sorted((m.start(), k, n, m.end()) for k, (n, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text) if ok(m[0]))
    base = ",".join(f"{n}:{s}:{e}" for s, _, n, e in spans)
    assert found[11].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert (found[11].n_email, found[11].n_ip, found[11].n_card, found[11].n_phone, found[11].n_iban) == (3, 1, 1, 1, 1)
    assert found[1].spans == "" and found[2].n_email == 0 and len(found) == len({i for i, _ in odd})
    assert pii.pii_table(rows(spark, [])).count() == 0
    many = "1.1.1.1 é " * 3000
    assert pii.pii_table(rows(spark, [(1, many)])).first().n_ip == 3000


def test_exact_dedup(spark, odd):
    got = exact_dedup.dedup_table(rows(spark, odd)).collect()
    assert len(got) == len(odd)
    by = {}
    for i, t in odd:
        by.setdefault(t or "", []).append(i)
    for r in got:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by)
    kept = exact_dedup.keep_documents(rows(spark, odd))
    assert kept.columns == rows(spark, odd).columns and kept.count() == len(by)
    assert exact_dedup.dedup_table(rows(spark, [])).count() == 0


def test_exact_dedup_compares_bytes(spark):
    texts = [(i, f"t{i % 5}") for i in range(20)]
    weak = lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0)  # every text gets the same digest
    got = exact_dedup.dedup_table(rows(spark, texts), digest=weak).collect()
    assert sorted(r.keep_id for r in got if r.kept) == [15, 16, 17, 18, 19] and {r.group_size for r in got} == {4}


def brute_components(texts):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [(i, shingles(t)) for i, t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 80 * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(s), least.get(root(k))) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard_components(spark, odd):
    rng = np.random.default_rng(3)
    texts = list(odd)
    for k in range(60):  # a group of near copies, and documents that share a passage
        w = WORDS[:200].copy()
        for at in rng.choice(200, int(rng.integers(0, 8)), replace=False):
            w[at] = f"n{k}_{at}"
        texts.append((100 + k, " ".join(w)))
        texts.append((200 + k, " ".join([f"o{k}_{i}" for i in range(int(rng.integers(5, 60)))] + WORDS[300:330])))
    got = sorted(map(tuple, jaccard_join.component_table(rows(spark, texts)).collect()), key=str)
    assert got == brute_components(texts)


def test_jaccard_over_many_partitions(spark, monkeypatch):
    """Runs of one posting that go over borders of partitions, and bands cut into tiles."""
    rng = np.random.default_rng(5)
    texts = []
    for k in range(150):  # all share their first words; sizes differ; some are alike
        words = [f"c{i}" for i in range(12)] + [f"g{k // 3}_{i}" for i in range(int(rng.integers(2, 30)))]
        texts.append((k, " ".join(words)))
    monkeypatch.setattr(jaccard_join, "TILE_MEMBERS", 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = sorted(map(tuple, jaccard_join.component_table(rows(spark, texts)).collect()), key=str)
            assert got == brute_components(texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_jaccard_of_four_shingles(spark):
    texts = [
        (1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "z a b c d e f g h"), (4, "a b c d e f g"), (5, "p q r s t u v"), (6, "p q r s t u v w"),
        (7, "k l m n o k l m n o k l"), (8, "k l m n o k l m n o x"), (9, "x k l m n o k l m"), (10, "A b C d e f g h"),
    ]
    got = sorted(map(tuple, jaccard_join.component_table(rows(spark, texts)).collect()), key=str)
    assert got == brute_components(texts)
    assert {r[0] for r in got if r[2] == 1} == {1, 2, 3, 10}


def test_jaccard_of_nothing(spark):
    assert jaccard_join.component_table(rows(spark, [])).count() == 0
    got = jaccard_join.component_table(rows(spark, [(1, None), (2, ""), (3, "a b"), (4, "A b")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3)]


def test_contamination(spark, odd):
    items = spark.createDataFrame([(1, " ".join(WORDS[20:60])), (2, " ".join(WORDS[20:55] + ["q"] * 3)), (3, None), (4, "ONE two"), (5, "zz yy xx ww vv uu")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontaminate.contaminated(rows(spark, odd), items).collect())
    assert got == sorted([(d, i, n, f) for d in (6, 7, 10) for i, n, f in ((1, 36, 36), (2, 34, 31))] + [(8, 1, 36, 31), (8, 2, 34, 26)][:1] + [(4, 4, 1, 1), (5, 4, 1, 1)])
    assert decontaminate.clean_documents(rows(spark, odd), items).count() == len(odd) - 7
    assert decontaminate.contaminated(rows(spark, []), items).count() == 0 == decontaminate.contaminated(rows(spark, odd), items.limit(0)).count()


def test_urls(spark):
    urls = ["http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "http://x.com/fr/", "x.com/de/", None, "http://y.com/de/1", "http://y.com#a", "http://org/", "http://b.net/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdict_table(pages).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("com/fr/", "allow")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[5][3] == "block" and got[6][:3] == ("y.com", "", None) and got[7][2] == "org/"
    assert all(v[3] in ("allow", "block") for v in got.values()) and url_filter.verdict_table(pages.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage = [fresh(55) for _ in range(40)]
    texts = [(2 * i + k, f"{fresh(int(rng.integers(10, 90)))} {p} {fresh(30)}") for i, p in enumerate(passage) for k in (0, 1)]
    clean = [(1000 + i, fresh(200)) for i in range(50)] + [(2000, None), (2001, ""), (2002, "z" * 9000)]
    got = chunk_dedup.repeated_passages(rows(spark, texts + clean)).collect()
    ids = {r.doc_id for r in got}
    assert not ids & {i for i, _ in clean} and len(ids) >= 78
    for r in got:
        assert dict(texts)[r.doc_id][r.start : r.stop].strip() in passage[r.doc_id // 2] + " "
        assert r.first == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id // 2 * 2
    assert chunk_dedup.repeated_passages(rows(spark, [])).count() == 0


@pytest.mark.parametrize("period", [1, 2, 3, 5, 8, 60])
def test_periodic_passages(spark, period):
    rng = np.random.default_rng(period)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9))))
    fresh = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for i in range(40):
        line = fresh(period).split()
        passage = " ".join((line * 60)[:60])
        texts += [(2 * i + k, f"{fresh(int(rng.integers(10, 90)))} {passage} {fresh(30)}") for k in (0, 1)]
    got = chunk_dedup.repeated_passages(rows(spark, texts)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in texts}


def test_forward_sums_all_segmentations():
    known = language_id.pieces(vocabulary(PIECES))
    rng = np.random.default_rng(2)
    prob = np.concatenate([[[0.0]], rng.random((len(known.names), 1))])
    at = {p: i + 1 for i, p in enumerate(known.names)}

    def brute(s):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, min(len(s), known.longest) + 1):
            p = prob[at[s[:n]], 0] if s[:n] in at else language_id.UNKNOWN if n == 1 else 0.0
            total += p * brute(s[n:]) if p else 0.0
        return total

    words = ["the", "über", "a", "xq", "strasse", "日本"]
    ids, size = known.lattice(words)
    alpha = known.forward(ids, size, prob)
    for i, w in enumerate(words):
        assert alpha[i, size[i], 0] == pytest.approx(brute("▁" + w))
        assert known.log_probabilities(words, prob)[i, 0] == pytest.approx(np.log(brute("▁" + w)))


def test_long_words_are_summed_whole(monkeypatch):
    known = language_id.pieces(vocabulary(PIECES))
    prob = np.concatenate([np.zeros((1, 2)), np.random.default_rng(3).random((len(known.names), 2)) / 50])
    words = ["unbelievable" * 5, "q" * 70, "straße" * 9, "a"]
    whole = known.log_probabilities(words, prob)
    for i, w in enumerate(words):  # one by one, without rescaling
        ids, size = known.lattice([w])
        assert whole[i] == pytest.approx(np.log(known.forward(ids, size, prob)[0, size[0]]))
    monkeypatch.setattr(language_id, "WINDOW", 7)
    assert known.log_probabilities(words, prob) == pytest.approx(whole)


def test_letters():
    assert language_id.letters("Ab²c ½ Ⅷ ① x1y_z ǅ") == ["ab", "c", "x", "y", "z", "ǆ"]


def test_languages_by_brute_force(spark):
    """The table against a plain posterior from the fitted pieces."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names, prob = language_id.train(docs, vocabulary(PIECES))
    known = language_id.pieces(vocabulary(PIECES))
    texts = docs.collect()
    got = language_id.language_table(docs, vocabulary(PIECES)).collect()
    assert len(got) == len(texts)
    want = {}
    for r in texts:
        words = language_id.letters(r.text or "")
        if not words:
            want[r.doc_id] = ("und", 0.0)
            continue
        total = np.zeros(len(names))
        for w in words:
            ids, size = known.lattice([w])
            total += np.log(known.forward(ids, size, prob)[0, size[0]])
        want[r.doc_id] = (names[int(total.argmax())], float(1 / np.exp(total - total.max()).sum()))
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], rel=1e-6)


def test_redaction_is_by_row(spark):
    texts = [(1, "write to x@y.zz now"), (1, "nothing here at all to hide"), (2, None), (3, "a@b.cc" * 2), (4, "")]
    got = sorted((r.doc_id, r.text) for r in pii.redact(rows(spark, texts)).collect())
    assert got == sorted([(1, "write to ██████ now"), (1, "nothing here at all to hide"), (2, ""), (3, "█" * 7 + "@b.cc"), (4, "")])  # the leftmost match ends in the next address


def test_token_order_is_fixed(spark, tmp_path):
    """Equal doc_ids come in one order, however many files are written."""
    texts = [(k // 6, f"text {k} " * (k % 7)) for k in range(60)]
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 9):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, token_planes.token_table(rows(spark, texts), PATH).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.language_table(docs, vocabulary(PIECES)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and held and sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r.lang_pred for r in language_id.language_table(rows(spark, odd), vocabulary(PIECES)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[6] == "en"
    assert language_id.language_table(rows(spark, []), vocabulary(PIECES)).count() == 0


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_table(docs, labels).collect()}
    marks = labels.collect()
    clean, bad = [r.doc_id for r in marks if r.quality == 1 and r.toxic == 0], [r.doc_id for r in marks if r.quality == 0]
    assert np.mean([got[i].kept for i in clean]) >= 0.97 and np.mean([got[i].kept for i in bad]) <= 0.3
    none = {r.doc_id: r.kept for r in quality.quality_table(rows(spark, odd), labels.limit(0)).collect()}
    assert none[1] is False and none[3] is False and none[6] is True and none[10] is True and len(none) == len({i for i, _ in odd})
    assert quality.quality_table(rows(spark, []), labels).count() == 0


def test_quality_knows_words(spark):
    """Texts of wrong words of ordinary length and endings are no trusted text; words beyond the commonest 200 are known."""
    rng = np.random.default_rng(8)
    made = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(4, 8))))
    known, wrong = ([made(x) for _ in range(600)] for x in ("abcdefgh", "stuvwxyz"))
    text = lambda words: " ".join(rng.choice(words, 80)) + "."
    texts = [(i, text(known)) for i in range(600)] + [(1000 + i, text(wrong)) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(500)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_table(rows(spark, texts), labels).collect()}
    assert np.mean([got[i].kept for i in range(500, 600)]) >= 0.95 and not any(got[1000 + i].kept for i in range(50))
    assert all(got[i].perplexity < 1000 for i in range(600)) and len(got) == len(texts)


def test_quality_vocabulary_of_any_size(spark):
    """A word of three trusted documents of a language is known, among 3000 documents as among 30."""
    seldom = int(quality.Words().values_of(["seldom"]).view(np.int64)[0])
    for n in (30, 3000):
        docs = rows(spark, [(i, f"often here{' seldom' * (i < 3)}{' twice' * (i < 2)}") for i in range(n)])
        labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
        known = quality.vocabulary_table(quality.trusted_documents(docs, quality.trusted_ids(labels)))[0]
        assert known.count() == 3 and known.filter(F.col("w") == seldom).count() == 1


def brute_perplexities(texts, good):
    """Interpolated modified Kneser-Ney over pairs, in plain Python; half of a document as Spark's hash gives it."""
    docs = {i: (t or "").split() for i, (t, _) in texts.items()}
    df = {}
    for i in good:
        for w in set(docs[i]):
            df[w] = df.get(w, 0) + 1
    least = max(quality.RARE, int(np.ceil(np.sqrt(len(good)) / quality.SPARSE)))
    known = {w for w, n in df.items() if n >= least}
    spelled = {}
    for w in set(df) - known:
        spelled[quality.word_class(w)] = spelled.get(quality.word_class(w), 1) + 1
    code = lambda w: w if w in known else quality.word_class(w)
    codes = quality.CLASSES + len(known)

    def cut(counts):
        d = quality.discounts(*(sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)))
        return {g: min(n, d[min(n, 3) - 1]) for g, n in counts.items()}

    def model(half):
        two, follow = {}, {}
        for i in good:
            if texts[i][1] == half:
                c = [0, *map(code, docs[i])]
                for g in zip(c, c[1:], strict=False):
                    two[g] = two.get(g, 0) + 1
        for _, w in two:
            follow[w] = follow.get(w, 0) + 1
        off2, off1 = cut(two), cut(follow)
        total, off = {}, {}
        for (v, w), n in two.items():
            total[v] = total.get(v, 0) + n
            off[v] = off.get(v, 0) + off2[v, w]
        whole = sum(follow.values())

        def p(v, w):
            one = (follow.get(w, 0) - off1.get(w, 0)) / whole + sum(off1.values()) / whole / codes
            return one if v not in total else (two.get((v, w), 0) - off2.get((v, w), 0)) / total[v] + off[v] / total[v] * one

        return p

    models, out = [model(0), model(1)], {}
    for v in ([0, *sorted(known)[:3]]):
        assert sum(models[0](v, w) for w in [*range(1, quality.CLASSES + 1), *known]) == pytest.approx(1.0)
    for i, words in docs.items():
        c = [0, *map(code, words)]
        cost = [-np.log(models[1 - texts[i][1]](v, w) / spelled.get(w, 1)) for v, w in zip(c, c[1:], strict=False)]
        out[i] = float(np.exp(np.mean(cost))) if cost else None
    return out


def test_perplexities_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    odds = 1 / np.arange(1, 121)
    text = lambda k: " ".join(rng.choice([f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)], k, p=odds / odds.sum()))
    texts = [(i, text(int(rng.integers(1, 60))) + f" Once{i}x $$ 12{i}.") for i in range(120)] + [(200, None), (201, "\u3000\x1c"), (202, ""), (203, "never seen words"), (204, text(3000))]
    docs = rows(spark, [*texts, texts[123], texts[123]])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.half for r in quality._rows(docs).collect()}
    want = brute_perplexities({i: (t, half[i]) for i, t in texts}, range(80))
    for most in (quality.BROADCAST_WORDS, 0):  # packed and sharded; plain joins
        monkeypatch.setattr(quality, "BROADCAST_WORDS", most)
        got, judge = quality.perplexities(docs, quality.trusted_documents(docs, quality.trusted_ids(labels)))
        got = got.collect()
        assert judge and len(got) == len(texts) + 2 and sum(r.doc_id == 203 for r in got) == 3
        for r in got:
            assert (r.perplexity is None) == (want[r.doc_id] is None) and (r.perplexity is None or r.perplexity == pytest.approx(want[r.doc_id], rel=1e-5)), r
            assert r.n_words == len((dict(texts)[r.doc_id] or "").split())
    monkeypatch.setattr(quality, "SHARD_WORDS", 100)
    monkeypatch.setattr(quality, "BLOCK_DOCS", 7)
    monkeypatch.setattr(quality, "PIECE", 50)
    monkeypatch.setattr(quality, "BROADCAST_WORDS", 10_000)
    for r in quality.perplexities(docs, quality.trusted_documents(docs, quality.trusted_ids(labels)))[0].collect():
        assert r.perplexity is None or r.perplexity == pytest.approx(want[r.doc_id], rel=1e-5)


def test_a_vocabulary_beyond_its_broadcast_travels_packed(spark, monkeypatch):
    """Beyond BROADCAST_WORDS perplexities are the same, and a pair of words takes a few bytes of shuffles, not a row of each of several joins."""
    rng = np.random.default_rng(6)
    odds = 1 / np.arange(1, 4001)
    word = [f"w{i * 7919 % 99991:x}" for i in range(4000)]
    texts = [(i, " ".join(rng.choice(word, 300, p=odds / odds.sum())) + f" once{i}") for i in range(2000)]
    path = common.fresh_path(spark, "packed-test")
    rows(spark, texts).repartition(4).write.parquet(path)
    docs, labels = spark.read.parquet(path), spark.createDataFrame([(i, 1, 0) for i in range(1500)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_documents(docs, quality.trusted_ids(labels))
    store, got, moved = spark.sparkContext._jsc.sc().statusStore(), {}, {}
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    for most in (quality.BROADCAST_WORDS, 500, 0):
        monkeypatch.setattr(quality, "BROADCAST_WORDS", most)
        before = stages()
        got[most] = {r.doc_id: r.perplexity for r in quality.perplexities(docs, trusted)[0].collect()}
        moved[most] = sum(n for k, n in stages().items() if k not in before)
    packed = max(got)
    assert len(got[packed]) == 2000 and all(got[most] == pytest.approx(got[packed], rel=1e-5) for most in (500, 0))
    assert moved[500] < 2 * sum(len(t) for _, t in texts), moved


@pytest.mark.parametrize("shards", [1, 9])
def test_frequent_pairs_are_scored_where_the_document_is(spark, monkeypatch, shards):
    """Shards are asked for the other pairs alone; perplexities do not depend on how many pairs are broadcast."""
    docs = rows(spark, [(i, "the old red fox saw the old red hen " * 30 + f"and number {i * i} once{i} of the {i % 9}") for i in range(120)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    trusted = quality.trusted_documents(docs, quality.trusted_ids(labels))
    got, asked, scores = {}, {}, quality.sharded_scores
    for most in (0, 40, 1 << 20):
        seen = []
        monkeypatch.setattr(quality, "FREQUENT", most)
        monkeypatch.setattr(quality, "SHARD_WORDS", -(-120 * 280 // shards))
        monkeypatch.setattr(quality, "sharded_scores", lambda *given: seen.append(len(given[4].value.g)) or scores(*given))
        got[most] = {r.doc_id: r.perplexity for r in quality.perplexities(docs, trusted)[0].collect()}
        asked[most] = seen
    assert asked[0] == [0] and 0 < asked[40][0] <= 40 + shards and asked[40][0] < asked[1 << 20][0]
    assert len(got[0]) == 120 and all(got[most] == pytest.approx(got[0], rel=1e-5) for most in (40, 1 << 20))


def test_broadcasts_of_the_model_are_small():
    """Each executor writes them to its disk; they come back as they were."""
    import pickle

    rng = np.random.default_rng(3)
    n = rng.zipf(1.5, (2, 1, 200_000)).clip(0, 1 << 20).astype(float)
    know = quality.SingleWords(np.concatenate([n, np.ceil(n / 2) * 0.7, np.ceil(n / 3)], axis=1), np.arange(1.0, quality.FIRST + 1))
    data = pickle.dumps(know)
    back = pickle.loads(data)
    assert len(data) < 200_000 * 14  # 56 as plain numbers
    assert all((getattr(know, x) == getattr(back, x)).all() for x in ("total", "back", "one", "spelled")) and back.judge == know.judge
    pairs = quality.Pairs(np.unique(rng.integers(0, 1 << 50, 10_000)).astype(np.uint64), np.arange(1, 10_001))
    again = pickle.loads(pickle.dumps(pairs))
    assert (again.g == pairs.g).all() and (again.n == pairs.n).all()
    assert again.counts(np.array([pairs.g[7], pairs.g[7] + np.uint64(1)])).tolist() == [8, 0]


def test_vocabulary_reaches_the_driver_without_rows(spark, monkeypatch):
    """A row of Python takes many times the 8 bytes of its word."""
    many = [" ".join(f"w{k:x}" for k in range(5000)) for _ in range(20)]
    docs, labels = rows(spark, enumerate(many)), spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    trusted, sizes, collect = quality.trusted_documents(docs, quality.trusted_ids(labels)), [], type(docs).collect

    def counted(df):
        out = collect(df)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "collect", counted)
    quality.perplexities(docs, trusted)
    assert sizes and max(sizes) <= 2 * (quality.CLASSES + 1)


def test_packed_columns():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 62, 1000)).astype(np.uint64), np.zeros(5, np.uint64), np.zeros(0, np.uint64), np.array([255, 256, (1 << 64) - 1], np.uint64)]
    for a, b in zip(common.unpack(common.pack(*columns)), columns, strict=True):
        assert (a == b).all() and len(a) == len(b)
