"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe_chunks, divergence, exact_dedup, fingerprints, language_id, line_dedup, ngram_join, open_windows, packing, token_counts, toxicity, url_filters, whitening
from tracewright.storage import table

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, num=3, den=4)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_texts(docs, net, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.round_trip(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, vocabulary="byte_bpe_50k.json", end_id=0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


DEDUP_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_neighbours(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary="piece_bpe_32k.model", limit=4096)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


URL_SQL = """
WITH parts AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM parts
), rules(r_host, r_path, r_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT s.*, r_host || r_path AS rule, r_verdict FROM split s
    LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, r_host || r_path) = 1
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fits
"""


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_windows.pack(table(spark, sf_dir, "documents"), capacity=4096, vocabulary="word_bpe_49k.json", end_id=2)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=10, top=10)


DIVERGENCE_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
    SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM d
), kept AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10
), groups AS (
    SELECT DISTINCT lang, source FROM d
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), wholes AS (
    SELECT c.lang, c.source, sum(c.n) + 2 * any_value(l.v) AS whole, any_value(l.n) + 2 * any_value(l.v) AS whole_lang FROM cells c JOIN langs l USING (lang) GROUP BY c.lang, c.source
), shares AS (
    SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // whole)::BIGINT AS p, (1 + (1000000000::HUGEINT * (total + 2)) // whole_lang)::BIGINT AS q FROM cells JOIN wholes USING (lang, source)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM kept)
), found AS (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_line_dedup": op2_line_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_language_id": op6_language_id,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_fingerprints": op8_fingerprints,
        "op9_token_counts": op9_token_counts,
        "op10_url_filters": op10_url_filters,
        "op11_packing": op11_packing,
        "op12_whitening": op12_whitening,
        "op13_divergence": op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": DEDUP_SQL, "op10_url_filters": URL_SQL, "op13_divergence": DIVERGENCE_SQL}
