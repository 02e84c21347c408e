"""Normalized records: cleaned text, phonetic codes, search documents and geographic block keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BlockingConfig
from ..functions import geo, text


def add_text(rows: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """clean_name, clean_address, phonetic_hash, search_document, geo and base_key beside the record's columns.

    Narrow: no shuffle. Null names and addresses count as empty.
    """
    cleaned = rows.withColumn("clean_name", text.clean_name(F.col("business_name")))
    address = text.clean_name if config.suffix_address else text.clean_address
    cleaned = cleaned.withColumn("clean_address", address(F.col("business_address")))
    cleaned = cleaned.withColumn("phonetic_hash", text.metaphone(F.col("clean_name")))
    cleaned = cleaned.withColumn("search_document", text.search_document(F.col("clean_name"), F.col("clean_address")))
    cleaned = cleaned.withColumn("geo", geo.layers(F.col("business_address"), F.col("country")))
    return cleaned.withColumn("base_key", geo.base_key(F.col("geo"))).drop("business_name", "business_address")


def normalize(rows: DataFrame, config: BlockingConfig = BlockingConfig(), among: DataFrame | None = None) -> DataFrame:
    """Normalize the union of all sources (a `source` column tells them apart), or some rows among all records, of which
    no more than block keys need is read.

    With joint thresholds, blocks are sized over all sources, so equal addresses get equal keys everywhere; else over
    each source alone.
    """
    scope = [] if config.joint_thresholds else ["source"]
    headed = lambda rows: add_text(rows.withColumn("_first", text.first_letter(F.col("business_name"))), config)
    keyed = geo.assign_block_keys(headed(rows), config.upper_threshold, config.lower_threshold, scope, F.col("_first"), None if among is None else headed(among))
    return keyed.select("entity_id", "source", "country", "clean_name", "clean_address", "geo_block_key", "phonetic_hash", "search_document")


def select_coded(rows: DataFrame, *columns: str) -> DataFrame:
    """columns of normalized records, with phonetic_hash, if it is among them, worked out again by the distinct words of
    clean_name: rules for every place of a text cost several times as much."""
    if "phonetic_hash" not in columns:
        return rows.select(*columns)
    other = rows.select(*[c for c in columns if c != "phonetic_hash"], "clean_name")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in other.schema if f.name != "clean_name")
    return other.mapInArrow(text.with_codes, f"{kinds}, phonetic_hash string").select(*columns)


def matched(rows: DataFrame, config: BlockingConfig, *columns: str) -> DataFrame:
    """entity_id, source, country and these of geo_block_key, phonetic_hash and search_document, as normalize has them.

    Texts are cleaned in the batches of one pass: expressions look at every character once for each of their patterns. Block
    keys are expressions; they read addresses and the first letters of names.
    """
    own, made = rows, [c for c in ("phonetic_hash", "search_document") if c in columns]
    if "geo_block_key" in columns:
        own = rows.withColumn("geo", geo.layers(F.col("business_address"), F.col("country"))).withColumn("_first", text.first_letter(F.col("business_name")))
        own = geo.assign_block_keys(own.withColumn("base_key", geo.base_key(F.col("geo"))), config.upper_threshold, config.lower_threshold, [] if config.joint_thresholds else ["source"], F.col("_first"))
    kept = ["entity_id", "source", "country", *[c for c in columns if c not in made]]
    own = own.select(*kept, "business_name", "business_address")
    kinds = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in kept], *[f"{c} string" for c in made]])
    return own.mapInArrow(text.with_texts(tuple(made), config.suffix_address), kinds).select("entity_id", "source", "country", *columns)


def check_ids(rows: DataFrame) -> DataFrame:
    """rows, or ValueError where an entity_id is null or repeated: retrievers would add up the records' postings."""
    bad = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR entity_id IS NULL").limit(3).collect()
    if bad:
        raise ValueError(f"entity_id must be unique and not null: {[r['entity_id'] for r in bad]}")
    return rows


def normalize_one(rows: DataFrame, config: BlockingConfig = BlockingConfig()) -> DataFrame:
    """Normalize a single source without a source column."""
    return normalize(rows.withColumn("source", F.lit(0).cast("tinyint")), config).drop("source")


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources in order, numbered 0, 1, 2 in a `source` column."""
    columns = ["entity_id", "business_name", "business_address", "country"]
    tagged = [s.select(*columns, F.lit(i).cast("tinyint").alias("source")) for i, s in enumerate(sources)]
    out = tagged[0]
    for s in tagged[1:]:
        out = out.unionByName(s)
    return out
