"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontaminate import leaks
from .packing import pack
from .quality_lm import classify
from .quality_rules import quality_rules
from .simhash import hex_fingerprint, simhash_components
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import held_out, toxicity
from .url_filter import ListRule, url_filter
from .warc import round_trip

URL_RULES = [
    ListRule("allow", "com", "/"),
    ListRule("block", "example.com", "/en/"),
    ListRule("allow", "www.example.com", "/en/"),
    ListRule("block", "net", "/es/"),
    ListRule("block", "net", "/fr/"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"), least_bytes=0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, x = suffix_dedup(docs, length=200, with_bytes=False)
    return found.select("doc_id", f"{x}.n_bytes", f"{x}.n_removed", F.size(f"{x}.spans").cast("long").alias("n_spans"), f"{x}.kept_sha256")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = toxicity(read_table(spark, sf_dir, "documents"), labels, threshold=0.7)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found, x = substring_dedup(docs, joined=True)
    return found.select("doc_id", f"{x}.n_words", f"{x}.n_removed", F.sha2(F.col(f"{x}.kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"), distance=2, shingle=3)
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found, x = classify(docs, trusted)
    return found.select("doc_id", "lang", f"{x}.perplexity", f"{x}.low", f"{x}.high", f"{x}.kept")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read_table(spark, sf_dir, "pages"), URL_RULES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_quality_rules, op2_warc, op3_suffix_dedup, op4_best_fit_packing, op5_decontamination, op6_toxicity, op7_substring_dedup, op8_simhash, op9_quality_classifier, op10_url_filter, pipeline]
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_OP1 = rf"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT k, i, list_slice(w, i, i + 7) AS s FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + d) AS n FROM rep, range(8) AS r(d) GROUP BY k),
lines AS (SELECT k, len(l) - len(list_distinct(l)) AS dup, total FROM (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, len(string_split(text, chr(10))) AS total FROM t)),
m AS (SELECT doc_id, text, w, total, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, dup AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM t JOIN lines USING (k) LEFT JOIN cov USING (k)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_symbols * 100 > 30 * n_words OR n_dup_lines * 100 > 50 * total
  OR (n_words >= 50 AND len(list_distinct(w)) * 10 < n_words) OR len(regexp_extract_all(text, '[A-Z]{{3,}}')) * 10 > 5 * n_words
  OR length(regexp_replace(text, '[^0-9]+', '', 'g')) * 10 > word_chars * 5) AS kept FROM b
"""

_BASE32 = "list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda q: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * g + 1, 5))::INT >> (15 - 5 * q)::INT) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '')"
_OP2 = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
d AS (SELECT page_id, octet_length(encode(p)) AS payload_bytes, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS first FROM t)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
_OP3 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM t)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM win) WHERE c > 1),
mark AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 200, true) AS new FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
isle AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM isle GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM span
  UNION ALL SELECT doc_id, max(b), 1000000000 FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS y FROM gap JOIN t USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
_OP7 = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t)),
cut AS (SELECT DISTINCT doc_id, i + d AS p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM win) q, range(50) AS r(d) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS y, count(*) AS n FROM word ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(y, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op2_warc": _OP2, "op3_suffix_dedup": _OP3, "op7_substring_dedup": _OP7}
