"""The operators of this subpackage as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, language_id, near_dedup, packing, quality_classifier, quality_rules, secret_scan, token_store, url_rules, warc
from tessera.llm.storage import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge_quality(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of op5 at a limit of one document a host, which lines pass on small tables too."""
    found = quality_rules.judge_quality(_table(spark, sf_dir, "documents"), max_docs=1, max_removed_percent=10)
    return found.select("doc_id", "n_words", "base_failed", "kept", "removed_words")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_rules.judge_urls(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path)
    return token_store.read_store(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_benchmark_decontamination, op3_warc, op4_packing, op5_quality_rules, op6_minhash_near_dedup,
        op7_quality_classifier, op8_url_filters, op9_language_id, op10_token_store, line_frequency, pipeline,
    )
}


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.MIN_REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

#: DuckDB's RE2 spells the gaps as hex escapes; [^...] there would otherwise match as the words' pattern does.
_W = r"[^\x20\x09-\x0D]+"
_TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
def _quality_sql(max_docs: int, max_removed_percent: int) -> str:
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_W}') AS ws FROM t),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
rep AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE n > 1) GROUP BY r),
l AS (SELECT r, host, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_W}'))) AS line FROM t),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r),
h AS (SELECT r, host, substr(md5(regexp_replace(lower(regexp_replace(line, '{_TRIM}', '', 'g')), '[0-9]+', '0', 'g')), 1, 16) AS h,
        len(regexp_extract_all(line, '{_W}')) AS words FROM l),
k AS (SELECT r, md5(array_to_string(list_sort(list(DISTINCT h)), ',')) AS doc FROM h GROUP BY r),
c AS (SELECT host, h FROM h JOIN k USING (r) GROUP BY host, h HAVING count(DISTINCT doc) > {max_docs}),
rm AS (SELECT r, CAST(sum(words) AS BIGINT) AS removed_words FROM h JOIN c USING (host, h) GROUP BY r),
m AS (
  SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(removed_words, 0) AS removed_words
  FROM t JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN rm USING (r)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * removed_words > {max_removed_percent} * n_words) AS kept, removed_words
FROM b
"""


QUALITY_SQL = _quality_sql(quality_rules.MAX_DOCS, quality_rules.MAX_REMOVED_PERCENT)
LINES_SQL = f"SELECT doc_id, n_words, base_failed, kept, removed_words FROM ({_quality_sql(1, 10)})"


def _url_sql() -> str:
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    site = sorted(url_rules.SITE_RULES, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in site)
    pattern = " ".join(f"WHEN regexp_matches(lowered, '{r.pattern}') THEN '{r.pattern}'" for r in url_rules.PATTERN_RULES)
    verdict = " ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in site)
    return f"""
WITH u AS (SELECT page_id, url, {lower("url")} AS lowered, coalesce(url LIKE '%://%', false) AS whole FROM pages),
p AS (SELECT page_id, lowered,
  CASE WHEN whole THEN {lower(r"regexp_extract(url, '://([^/?#]*)', 1)")} ELSE '' END AS host,
  CASE WHEN whole THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE {rule} END AS rule, CASE {pattern} END AS pattern FROM p)
SELECT page_id, host, path, rule,
  CASE {verdict} WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM r
"""


ORACLE_SQL: dict[str, str] = {"op3_warc": WARC_SQL, "op5_quality_rules": QUALITY_SQL, "op8_url_filters": _url_sql(), "line_frequency": LINES_SQL}
