"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sinoflow.llm import (
    bpe,
    chunk_dedup,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    pii,
    quality,
    token_planes,
    url_filter,
)
from sinoflow.llm.common import table

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
END_ID = 1


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_table(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_table(table(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_table(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), END_ID)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.component_table(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdict_table(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_table(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_table(table(spark, sf_dir, "documents"), vocabulary(PIECES))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_pii, op3_token_planes, op4_jaccard_join, op5_decontaminate, op6_url_filter, op7_exact_dedup, op8_quality,
        op9_chunk_dedup, op10_language_id,
    )
}

_BASE_SQL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_TEST = {
    "email": "true",
    "ip": "list_bool_and([try_cast(p AS HUGEINT) <= 255 AND try_cast(p AS HUGEINT) IS NOT NULL FOR p IN string_split(m, '.')])",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT * 2 - CASE WHEN substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT > 4 THEN 9 ELSE 0 END "
    f"ELSE substr({_DIGITS}, length({_DIGITS}) - i, 1)::INT END FOR i IN range(length({_DIGITS}))]) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    # the number's letters as two digits each make at most 68 digits: the rest is taken digit by digit
    "iban": "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce([0] || [CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END FOR c IN string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')], "
    "lambda a, b: CASE WHEN b >= 10 THEN (a * 100 + b) % 97 ELSE (a * 10 + b) % 97 END) = 1",
    "ssn": "true",
}


def _pii_sql() -> str:
    kinds = []
    for no, kind in enumerate(pii.KINDS):
        pattern = _BASE_SQL.get(kind, pii.PATTERNS[kind])
        kinds.append(
            f"SELECT doc_id, {no} AS kind_no, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}')) AS m, "
            f"generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i, regexp_split_to_array(text, '{pattern}') AS p FROM d"
        )
    at = "(length(array_to_string(p[1:i], '')))"
    tests = " ".join(f"WHEN '{k}' THEN {t}" for k, t in _SQL_TEST.items())
    score = " ".join(f"WHEN '{k}' THEN {s} + CASE WHEN regexp_matches(lower(right(p[i], {pii.CONTEXT_CHARS})), '{pii.CONTEXT[k]}') THEN {pii.CONTEXT_BONUS} ELSE 0.0 END" for k, s in pii.SCORES.items())
    base = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no)"
    n = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({" UNION ALL ".join(kinds)}),
placed AS (SELECT doc_id, kind_no, kind, m, {at} + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  CAST(CASE kind {score} END AS DOUBLE) AS score FROM raw),
ok AS (SELECT *, s + length(m) AS e FROM placed WHERE CASE kind {tests} END AND (kind_no < {len(pii.BASE)} OR score >= {pii.MIN_SCORE})),
g AS (SELECT doc_id, {base}, {said} FILTER (kind_no < {len(pii.BASE)}) AS b, {said} AS spans, max(score) AS max_score FROM ok GROUP BY doc_id)
SELECT d.doc_id, {n}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, max_score FROM d LEFT JOIN g USING (doc_id)
"""


_JACCARD_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT DISTINCT x, x AS y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
c AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

_LEAKS_SQL = """
WITH t AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT k, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT DISTINCT k, id, len(w) >= 5 AS cut, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 'b' GROUP BY 1),
f AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS f FROM s d JOIN s b ON d.k = 'd' AND b.k = 'b' AND d.s = b.s AND d.cut = b.cut GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, f AS n_found, f / n AS containment FROM f JOIN n ON n.id = item_id WHERE f / n >= 0.8
"""

_DEDUP_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def _url_sql() -> str:
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN ['{h}{p}', '{v}']" for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))]
    low, high = url_filter.STRENGTH

    def level(name: str, source: str, key: str, parent: str, parent_key: str) -> str:
        by = f"GROUP BY {parent_key}" if parent_key else ""
        pick = f"{parent_key}, " if parent_key else ""
        rate = "((s2 - n * (g / n) * (g / n)) / ((g / n) * (1 - g / n)) - (k - 1)) / (n - k)"
        on_parent, on_spread = (f"LEFT JOIN {parent} p USING ({parent_key})", f"LEFT JOIN {name}_s USING ({parent_key})") if parent_key else (f"CROSS JOIN {parent} p", f"CROSS JOIN {name}_s")
        return f"""
{name}_t AS (SELECT {pick}sum(good) AS g, sum(good + bad) AS n, count(*) AS k, sum((good + bad) * (good / (good + bad)) ** 2) AS s2 FROM {source} WHERE good + bad > 0 {by}),
{name}_s AS (SELECT {pick}CASE WHEN k > 1 AND n > k AND g > 0 AND g < n AND {rate} > 0 THEN greatest({low}, least({high}, 1 / ({rate}) - 1)) ELSE {high} END AS strength FROM {name}_t),
{name} AS (SELECT x.{key}, good + coalesce(strength, {high}) * p.a / (p.a + p.b) AS a, bad + coalesce(strength, {high}) * (1 - p.a / (p.a + p.b)) AS b FROM {source} x {on_parent} {on_spread})"""

    return f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, CASE {" ".join(fits)} END AS fit FROM h),
hosts AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix,
  count(*) FILTER (fit[2] = 'allow')::DOUBLE AS good, count(*) FILTER (fit[2] = 'block')::DOUBLE AS bad FROM v GROUP BY host),
domains AS (SELECT domain, suffix, sum(good) AS good, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(good) AS good, sum(bad) AS bad FROM domains GROUP BY ALL),
world AS (SELECT coalesce(sum(good), 0) + {url_filter.GOOD0} AS a, coalesce(sum(bad), 0) + {url_filter.BAD0} AS b FROM suffixes),
{level("ls", "suffixes", "suffix", "world", "")},
{level("ld", "domains", "domain", "ls", "suffix")},
{level("lh", "hosts", "host", "ld", "domain")},
o AS (SELECT host, a / (a + b) AS mean, a / (a + b) - {url_filter.Z} * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM lh)
SELECT page_id, host, path, fit[1] AS rule, coalesce(fit[2], CASE WHEN bound >= {url_filter.THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict, round(mean, 9) AS host_mean, round(bound, 9) AS host_bound
FROM v LEFT JOIN o USING (host)
"""


ORACLE = {
    "op2_pii": _pii_sql(),
    "op4_jaccard_join": _JACCARD_SQL,
    "op5_decontaminate": _LEAKS_SQL,
    "op6_url_filter": _url_sql(),
    "op7_exact_dedup": _DEDUP_SQL,
}
