"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact, licenses, lm, minhash, packing, quality, rans, sharding, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_interleaved_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op3_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(_table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(_table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "size", "text_crc32", "'bytes' AS law", "shard", "slot", "cast(NULL AS int) AS grown_shard")


def op7_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op8_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op9_merge_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"), keep="max")


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_length_buckets, op2_interleaved_rans, op3_log_bilinear, op4_signature_rules, op5_weak_labels,
        op6_kd_shards, op7_min_max_hash, op8_host_trust, op9_merge_index, op10_spaced_seeds)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _near_sql(percent: int) -> str:
    """Two-word shingles, all pairs that share one, and the closure of the links."""
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ 	-
]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, b FROM reach r JOIN both_ways ON a = r.other)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def _trust_sql() -> str:
    """The rules, and both propagations as one recursion in whole numbers, until nothing is handed on."""
    host = f"coalesce(translate(regexp_extract({{0}}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '')"
    link = urls.LINK.replace("'", "''")
    rule = verdict = "NULL"
    for kind, h, p in sorted(urls.RULES, key=lambda r: len(r[1]) + len(r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    return f"""
WITH RECURSIVE parsed AS (SELECT page_id, html, {host.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, {rule} AS rule, {verdict} AS by_rule FROM parsed),
linked AS (SELECT src, {host.format("':' || url")} AS dst FROM (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS url FROM judged WHERE host <> '')),
labels AS (SELECT DISTINCT string_split(host, '.') AS l FROM judged WHERE host <> ''),
up AS (SELECT DISTINCT array_to_string(s, '.') AS src, array_to_string(s[2:], '.') AS dst FROM (SELECT l[i + 1:] AS s FROM (SELECT l, unnest(range(0, greatest(len(l) - 1, 1))) AS i FROM labels)) WHERE len(s) > 2),
edges AS (SELECT src, dst, sum(n)::BIGINT AS n FROM (SELECT src, dst, count(*) AS n FROM linked WHERE dst <> '' AND dst <> src GROUP BY ALL
    UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) GROUP BY ALL),
flow AS (SELECT *, sum(n) OVER (PARTITION BY kind, src)::BIGINT AS total FROM
    (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges)),
walk AS (SELECT CASE by_rule WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, (count(*) * {urls.SCALE})::BIGINT AS mass
        FROM judged WHERE host <> '' AND by_rule IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT f.kind, f.dst, sum(((w.mass // 1000 * {urls.DAMPING} + w.mass % 1000 * {urls.DAMPING} // 1000)::HUGEINT * f.n // f.total)::BIGINT)::BIGINT
        FROM walk w JOIN flow f ON f.kind = w.kind AND f.src = w.host WHERE w.mass >= {urls.LEAST} GROUP BY 1, 2),
marks AS (SELECT host, sum(mass) FILTER (kind = 'trust') AS t, sum(mass) FILTER (kind = 'distrust') AS d FROM walk GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d, 0) > coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(t, 0)::BIGINT AS trust, coalesce(d, 0)::BIGINT AS distrust
FROM judged j LEFT JOIN marks m ON m.host = j.host"""


ORACLES = {
    "op7_min_max_hash": _near_sql(80),
    "op8_host_trust": _trust_sql(),
    "op9_merge_index": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
