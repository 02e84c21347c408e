"""Headline queries, timed: one JSON line on stdout.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. `pool_112k` is the candidate pool of 20,000 +
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from entwine import queries
from entwine.config import BlockingConfig
from entwine.operators import evaluation, retrieval
from entwine.plans import normalize, pool
from entwine.sources import records

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
TABLE_QUERIES = ("clean_name", "phonetic_hash", "tokenize", "geo_block_key_joint", "threshold_sweep", "true_pairs", "sample_anchors")


PUBLISHED = {"normalize_112k": 1.582, "bm25_112k": 3.648, "geo_112k": 3.038, "pool_112k": 9.296, "pool_112k_s1_only": 7.1}


def timed(times: dict[str, float], name: str, action):
    began = time.perf_counter()
    out = action()
    times[name] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in TABLE_QUERIES:
        timed(times, name, lambda n=name: drain(queries.QUERIES[n](spark, SF_DIR)))

    sources = records.synthetic(spark)
    raw = normalize.union_sources(*sources[:3]).repartition(2 * int(CPUS)).cache()
    raw.count()
    config, lean = BlockingConfig(), BlockingConfig(include_s2_s3=False)
    report, pairs_found = None, 0
    for _ in range(2):  # the first run compiles; the second one's times stay
        rows = normalize.normalize(raw, config).cache()
        timed(times, "normalize_112k", rows.count)
        timed(times, "bm25_112k", lambda: drain(pool.global_pool(rows, config)))
        timed(times, "geo_112k", lambda: drain(retrieval.geo_top_k(rows, config)))
        pairs = pool.candidate_pool(rows, config).cache()
        pairs_found = timed(times, "pool_112k", pairs.count)
        timed(times, "pool_112k_s1_only", lambda: drain(pool.candidate_pool(rows, lean)))
        if report is None:
            report = timed(times, "recall_112k", lambda: evaluation.recall_report(pairs, evaluation.true_pairs(sources[3], rows), rows).first())
            records_ = rows.count()
            asked = sum(rows.where(f"source = {q}").count() for q, _ in config.jobs)
        pairs.unpersist()
        rows.unpersist()
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR, "recall": report["recall"], "candidate_pairs": pairs_found}
    out["records_per_second"] = {"normalize_112k": round(records_ / times["normalize_112k"])}
    out["queries_per_second"] = {"bm25_112k": round(2 * asked / times["bm25_112k"]), "geo_112k": round(asked / times["geo_112k"])}
    out["ratio_to_published"] = {k: round(times[k] / v, 2) for k, v in PUBLISHED.items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
