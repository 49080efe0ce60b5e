"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score.

All of it is DataFrame functions. A text is cut at the matches of a pattern; running sums over the lengths of pieces
and matches give the positions in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinoflow.llm import common

# The first four patterns are the base kinds, written so that Java's matcher runs in linear time and without recursion:
# a match begins where its first run of characters begins or the previous match ended, and runs are possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A text without this cannot match; it is tested before the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Score without context, and the words that raise it when they stand shortly before the span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": r"\b(e-?mail|contact|write|correo|courriel)\b",
    "ip": r"\b(ip|address|host|server|adresse)\b",
    "card": r"\b(card|credit|visa|mastercard|karte|carte|tarjeta)\b",
    "phone": r"\b(phone|call|tel|mobile|telefon|téléphone|teléfono)\b",
    "iban": r"\b(iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"\b(ssn|social security|tax id)\b",
}
CONTEXT_CHARS, CONTEXT_BONUS, MIN_SCORE = 40, 0.3, 0.5


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, doubled at every second place from the right, sum to a multiple of ten."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, is 1 mod 97."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))

    def add(rest, c):
        letter = F.ascii(c) - 55
        return F.when(letter >= 10, (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    characters = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))
    return F.aggregate(characters, F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        n = F.length(F.replace(match, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34), mod97(match)).otherwise(F.lit(False))
    return F.lit(True)


_SPAN = "array<struct<start: bigint, kind_no: int, kind: string, end: bigint, score: double>>"


def _spans(kind: str, text: Column) -> Column:
    """Confirmed spans of a kind in order, with their scores."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)

    def place(found, between):
        ends = common.prefix_sums(F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: (F.length(m) + F.length(b)).cast("long")))
        return F.zip_with(
            F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.right(b, F.lit(CONTEXT_CHARS)).alias("before"))),
            ends,
            lambda x, e: F.struct(
                (e - F.length(x["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), e.alias("end"),
                (F.lit(SCORES[kind]) + F.when(F.lower(x["before"]).rlike(CONTEXT[kind]), CONTEXT_BONUS).otherwise(0.0)).alias("score"), x["m"].alias("m"),
            ),
        )

    pieces = F.struct(found.alias("found"), between.alias("between"))
    placed = F.filter(common.bound(pieces, lambda p: place(p["found"], p["between"])), lambda s: _confirmed(kind, s["m"]))
    if kind not in BASE:
        placed = F.filter(placed, lambda s: s["score"] >= MIN_SCORE)
    out = F.transform(placed, lambda s: F.struct(s["start"], s["kind_no"], s["kind"], s["end"], s["score"])).cast(_SPAN)
    possible = F.instr(text, _NEEDS[kind]) > 0 if kind in _NEEDS else F.lit(True)
    return F.when(possible & text.rlike(PATTERNS[kind]), out).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (start, kind, end in code points, score) of every row, by start and then kind.

    Null and empty texts have no spans. Repeated rows are searched like any other. Base kinds stay whatever their
    score; the kinds that the method adds need a score of at least MIN_SCORE.
    """
    return _searched(docs).drop("text")


def _searched(docs: DataFrame) -> DataFrame:
    rows = common.texts(docs)
    for kind in KINDS:
        rows = rows.withColumn(f"of_{kind}", _spans(kind, F.col("text")))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*(F.col(f"of_{k}") for k in KINDS))).alias("spans"))


def redact(docs: DataFrame, mask: str = "█") -> DataFrame:
    """``doc_id`` and the text with every character of a span masked; each row by its own spans, repeated doc_ids too."""
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(
                a["out"],
                F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")),
                F.repeat(F.lit(mask), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0)).cast("int")),
            ).alias("out"),
        ),
    )
    rest = lambda c: F.concat(c["out"], F.substring(F.col("text"), (c["at"] + 1).cast("int"), F.length("text")))
    return _searched(docs).select("doc_id", common.bound(cut, rest).alias("text"))


def pii_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; beside them n_iban, n_ssn and max_score."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find(docs).select(
        "doc_id",
        *(n(k) for k in BASE),
        F.sha2(said(F.filter("spans", lambda s: s["kind_no"] < len(BASE))), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        *(n(k) for k in KINDS if k not in BASE),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("max_score"),
    )
