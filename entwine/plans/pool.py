"""The candidate pool: three retrievers' pairs, merged by full outer joins or one below the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BlockingConfig
from ..operators.retrieval import BROADCAST_ROWS, bm25_top_k, geo_top_k, word_tfidf_top_k
from ..sources import files

SCORES = ("bm25_text_score", "bm25_phonetic_score", "geo_ngram_score")


def merge_pools(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join on the pair; a score that one side lacks is 0."""
    out = left.join(right, ["entity_A", "entity_B"], "full")
    return out.na.fill(0.0, [c for c in out.columns if c not in ("entity_A", "entity_B")])


def global_pool(rows: DataFrame, config: BlockingConfig = BlockingConfig(), tfidf: bool = False) -> DataFrame:
    """Text and phonetic matches of each country; tfidf takes the word TF-IDF retriever in place of BM25."""
    if tfidf:
        text = word_tfidf_top_k(rows, "search_document", SCORES[0], config, max_df=0.8, min_df=2)
        return merge_pools(text, word_tfidf_top_k(rows, "phonetic_hash", SCORES[1], config))
    return merge_pools(bm25_top_k(rows, "search_document", SCORES[0], config), bm25_top_k(rows, "phonetic_hash", SCORES[1], config))


def candidate_pool(rows: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """All candidate pairs of normalized records with their three scores. entity_id must be unique."""
    return merge_pools(global_pool(rows, config), geo_top_k(rows, config)).select("entity_A", "entity_B", *SCORES)


def found_pairs(rows: DataFrame, config: BlockingConfig = BlockingConfig(), scores: tuple[str, ...] = SCORES) -> DataFrame:
    """The pairs of candidate_pool one below the other: a row for each retriever that finds a pair, with that retriever's
    score and 0 for the others. No joins, so what reads a pair's highest scores or any score above a threshold takes this
    in the pool's place. Retrievers of scores that are not named do not run."""
    retrievers = {
        SCORES[0]: lambda: bm25_top_k(rows, "search_document", SCORES[0], config),
        SCORES[1]: lambda: bm25_top_k(rows, "phonetic_hash", SCORES[1], config),
        SCORES[2]: lambda: geo_top_k(rows, config, SCORES[2]),
    }
    each = [retrievers[own]().select("entity_A", "entity_B", *[F.col(c) if c == own else F.lit(0.0).alias(c) for c in scores]) for own in scores]
    return reduce(DataFrame.unionByName, each)


def strong_queries(rows: DataFrame, config: BlockingConfig, thresholds: dict[str, float]) -> DataFrame:
    """(entity_id): the queries of which candidate_pool has a pair with any score above its threshold. A query that a retriever
    settles is not matched by the next, and each tells of one pair."""
    asking, goals, found = sorted({q for q, _ in config.jobs}), sorted({t for _, t in config.jobs}), []
    for score, least in thresholds.items():
        if score == SCORES[2]:
            own = geo_top_k(rows, config, score)
        else:
            own = bm25_top_k(rows, "search_document" if score == SCORES[0] else "phonetic_hash", score, config, least)
        found.append(files.written(own.where(F.col(score) > least).select(F.col("entity_A").alias("entity_id")).distinct(), "strong"))
        left = files.written(rows.where(F.col("source").isin(asking)).select("entity_id").join(found[-1], "entity_id", "left_anti").withColumn("_left", F.lit(True)), "left")
        left = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
        rows = rows.join(left, "entity_id", "left").where(F.col("source").isin(goals) | F.col("_left")).drop("_left")
    return reduce(DataFrame.unionByName, found).distinct()


def pair_scan(a: DataFrame, b: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Both BM25 modalities for one pair of normalized sources."""
    rows = a.withColumn("source", F.lit(0).cast("tinyint")).unionByName(b.withColumn("source", F.lit(1).cast("tinyint")))
    return global_pool(rows, config)
