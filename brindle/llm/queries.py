"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, media, minhash, mixing, quality, secret_scan, suffix_dedup, toxicity, url_filter
from ._session import cut, table

VOCABULARY = "byte_bpe_50k.json"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), shingle=4)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(langid.fold() != 1))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (langid.fold() == 1).alias("held_out"), "score", "predicted")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = secret_scan.dictionary(docs)
    # where a document comes from is the only path that it has
    return secret_scan.report(docs, secret_scan.fit(spark, words=words), path_col="source", words=words)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold() != 1))
    return langid.identify(docs, model).select("doc_id", (langid.fold() == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")))
    mixed = mixing.mix(sized, F.array("source"), F.col("size"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_quality_rules,
        op3_minhash_near_dedup,
        op4_toxicity,
        op5_secret_scans,
        op6_suffix_dedup,
        op7_media_columns,
        op8_language_id,
        op9_source_mixing,
        op10_bpe,
    )
}
_RULES = sorted(url_filter.PATH_RULES, key=lambda r: -len(r[0]))


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"


_URLS = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
   coalesce(nullif(regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1), ''), '?') AS query FROM r),
 t AS (SELECT *, CASE {" ".join(f"WHEN {_fits(rule)} THEN '{rule}'" for rule, _ in _RULES)} END AS rule, path || query AS tail FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ({", ".join(f"'{rule}'" for rule, allow in _RULES if allow)}) THEN 'allow' ELSE 'block' END
 WHEN host = '' OR contains(host, 'spam') OR contains(host, 'casino') OR contains(tail, '/wp-admin/') OR contains(tail, '/login') OR tail LIKE '%.exe_%' OR tail LIKE '%.zip_%' OR contains(query, 'sessionid=') OR contains(query, 'utm_source=') THEN 'block' ELSE 'allow' END AS verdict FROM t""".replace("\\\\", "\\")

_QUALITY = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
 g AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
 d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
 v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM d, range(8) r(k) GROUP BY 1),
 b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
   (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
   length(regexp_replace(t, '[^A-Za-z]', '', 'g')) + strlen(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS letters, strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS solid, length(regexp_replace(t, '[^!]', '', 'g')) AS shouts FROM w LEFT JOIN v USING (doc_id)),
 f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 2 * caps > letters OR 2 * shouts > n_words OR 2 * letters < solid) AS kept FROM f"""

ORACLES: dict[str, str] = {"op1_url_filters": _URLS, "op2_quality_rules": _QUALITY}
