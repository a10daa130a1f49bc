"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversations, exact_dedup, license_lookup, mixing, near_join, packing, quality, secret_scan, spelling, suffix_dedup, topk_search, url_reputation, warc


TOKENIZER = "byte_bpe_50k.json"
#: Target shares of `documents`, op10's and the pipeline's.
MIX_TARGETS = {
    "source": {**{f"src{i}": 1.0 for i in range(20)}, "src0": 2.0, mixing.OTHER: 1.0},
    "lang": {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15, mixing.OTHER: 0.02},
    "topic": {t: 1.0 for t in mixing.TOPICS},
}

#: Rules of op11, action and host/path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(common.documents(spark, sf_dir)).drop("secrets")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(common.documents(spark, sf_dir))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return warc.captures(spark, path, with_capture=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(common.documents(spark, sf_dir))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 100 = 0")


def op9_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_lookup.lookup(common.documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(common.documents(spark, sf_dir), MIX_TARGETS, public_tokenizers.path(TOKENIZER)).drop("text_key")


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # pages have no labels of their own: the label of the same id stands for the outcome of the page
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    judged = url_reputation.judge_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(spelling.misspell(spelling.runs(common.documents(spark, sf_dir))))
    return spelling.group_variants(words)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(damaged, times_col="times")


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_suffix_dedup, op3_secret_scan, op4_quality, op5_exact_dedup, op6_warc, op7_near_join, op8_topk_search, op9_license_lookup, op10_mixing, op11_url_reputation, op12_spelling, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


#: Strength of the prior of a level, of rows good, n and m.
_STRENGTH = """SELECT CASE WHEN coalesce(pairs, 0) = 0 OR over <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, pairs / over - 1)) END AS w
          FROM (SELECT sum(pow(good - n * m, 2) / (m * (1 - m)) - n) AS over, sum(n * (n - 1.0)) AS pairs FROM {} WHERE n > 0)"""
ORACLES = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
          doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
          CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op8_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_url_reputation": f"""
        WITH p AS (SELECT row_number() OVER () AS line, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        told AS (SELECT doc_id AS id, sum(quality) AS good, count(*) AS n FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
        counted AS (SELECT host, coalesce(sum(good), 0) AS good, coalesce(sum(n), 0) AS n FROM p LEFT JOIN told ON page_id = id GROUP BY 1),
        split AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':\\d*$', ''), '.') AS labels FROM counted),
        paired AS (SELECT *, array_to_string(labels[-2:], '.') IN ({", ".join(f"'{x}'" for x in url_reputation.TWO_PART_SUFFIXES)}) AS two FROM split),
        hosts AS (SELECT host, good, n, array_to_string(labels[(CASE WHEN two THEN -2 ELSE -1 END):], '.') AS suffix, array_to_string(labels[(CASE WHEN two THEN -3 ELSE -2 END):], '.') AS domain FROM paired),
        mean AS (SELECT (sum(good) + 0.5) / (sum(n) + 1) AS m FROM hosts),
        suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n, any_value(m) AS m FROM hosts, mean GROUP BY 1),
        tops AS (SELECT suffix, (good + w * m) / (n + w) AS m FROM suffixes, ({_STRENGTH.format("suffixes")})),
        domains AS (SELECT domain, any_value(suffix) AS suffix, sum(good) AS good, sum(n) AS n, any_value(m) AS m FROM hosts JOIN tops USING (suffix) GROUP BY 1),
        shares AS (SELECT domain, (good + w * m) / (n + w) AS m FROM domains, ({_STRENGTH.format("domains")})),
        known AS (SELECT host, good, n, m FROM hosts JOIN shares USING (domain)),
        posterior AS (SELECT host, good + w * m AS a, n - good + w * (1 - m) AS b FROM known, ({_STRENGTH.format("known")})),
        below AS (SELECT host, list_sum(list_transform(range(3000), lambda i: exp(a * ln(0.5) + b * ln(0.5) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a + 1) + lgamma(a + b + i) - lgamma(a + 1 + i) + i * ln(0.5)))) AS p FROM posterior),
        rules(action, rule) AS (VALUES {", ".join(f"('{a}', '{r}')" for a, r in URL_RULES)}),
        fit AS (SELECT line, rule, action FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
          QUALIFY row_number() OVER (PARTITION BY line ORDER BY length(rule) DESC, length(split_part(rule, '/', 1)) DESC, action DESC) = 1)
        SELECT page_id, host, path, rule, coalesce(action, CASE WHEN below.p >= 0.95 THEN 'block' ELSE 'allow' END) AS verdict FROM p JOIN below USING (host) LEFT JOIN fit USING (line)""",
}
