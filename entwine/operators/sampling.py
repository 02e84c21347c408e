"""Anchored samples: ground-truth rows, the records they name, and noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import strip


def drawn(key: str, seed: int = 42) -> Column:
    """A reproducible random order of a key's values."""
    return F.md5(F.concat(F.col(key), F.lit(f"/{seed}")))


def sample_truth(truth: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n ground-truth rows with matches; fewer where there are fewer."""
    return truth.na.drop(subset=["matched_entity_ids"]).orderBy(drawn("source1_entity_id", seed), "source1_entity_id").limit(n)


def anchor_ids(sampled: DataFrame) -> DataFrame:
    """Distinct ids that sampled ground-truth rows name, on either side."""
    own = sampled.select(F.col("source1_entity_id").alias("entity_id"))
    matched = sampled.select(F.explode(F.split("matched_entity_ids", ",")).alias("entity_id")).select(strip(F.col("entity_id")).alias("entity_id")).where("entity_id <> ''")
    return own.union(matched).distinct()


def anchors(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids, "entity_id", "left_semi")


def noise(records: DataFrame, ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n random records that are no anchors, or all of them where there are fewer. A null id is no anchor."""
    return records.join(ids, "entity_id", "left_anti").orderBy(drawn("entity_id", seed), "entity_id").limit(n)


def anchored_sample(sources: list[DataFrame], truth: DataFrame, truth_rows: int = 1500, noise_rows: int = 8500, seed: int = 42) -> tuple[list[DataFrame], DataFrame]:
    """Per source its anchors and noise; and the sampled ground truth. Every sampled pair that exists in the sources
    exists in the sample."""
    sampled = sample_truth(truth, truth_rows, seed)
    ids = anchor_ids(sampled)
    return [anchors(s, ids).unionByName(noise(s, ids, noise_rows, seed)) for s in sources], sampled
