"""Exact duplicates through a log-structured merge index; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_row, join_spread, numbered, outnumbered, passing, stage, stage_path, without

#: Runs that one compaction merges.
FANOUT = 16
#: Slots of the hit filter: 64 to a row, so that at most 262,144 rows of two numbers are broadcast (some 15 MB).
SLOTS = 1 << 24

_BEST = {"min": F.min, "max": F.max}


def _bytes(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def _write_run(rows: DataFrame, name: str) -> DataFrame:
    """Sorted by run and digest inside each file, with a bloom filter on the digest for lookups."""
    path = stage_path(rows.sparkSession, name)
    rows.sortWithinPartitions("run", "digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def flush_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Level 0: one sorted digest run per input task (doc_id, digest, run).

    Each task is a memtable: its rows are sorted by digest and written as one run, with no shuffle. Parquet
    min/max statistics and a bloom filter on the digest let `lookup` skip runs and row groups.
    """
    digest = F.unhex(F.sha2(_bytes(text_column), 256))
    return _write_run(docs.select(F.col(id_column).alias("doc_id"), digest.alias("digest"), F.spark_partition_id().alias("run")), "runs")


def compact(runs: DataFrame, keep: str = "min", fanout: int = FANOUT) -> DataFrame:
    """Merge level by level until one run is left: (digest, keep_id, n).

    Every level merges groups of `fanout` runs into one sorted run each, in which a digest stands once with its smallest
    (or, for "max", largest) identifier and its number of entries. Partial aggregation merges inside each task first,
    so a digest that holds a third of all rows reaches a level's shuffle as one row per task.
    """
    left = (runs.agg(F.max("run")).first()[0] or 0) + 1
    level = runs.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    while True:
        left = -(-left // fanout)
        merged = level.withColumn("run", F.floor(F.col("run") / fanout).cast("int")).groupBy("run", "digest")
        level = _write_run(merged.agg(_BEST[keep]("keep_id").alias("keep_id"), F.sum("n").alias("n")), "level")
        if left == 1:
            return level.drop("run")


def lookup(runs: DataFrame, digests: list[bytes]) -> DataFrame:
    """Rows of the index with one of a bounded list of digests; the filter reaches statistics and bloom filters."""
    return runs.where(F.col("digest").isin([bytearray(d) for d in digests]))


def digest_filter(digests: DataFrame, slots: int) -> DataFrame:
    """A filter over digests as at most slots / 64 rows (word, bits): bit by bit the slots that some digest hashes to."""
    slot = digests.select(F.pmod(F.xxhash64("digest"), F.lit(slots)).alias("slot"))
    return slot.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits"))


def probe(rows: DataFrame, filtered: DataFrame, slots: int) -> DataFrame:
    """rows (with a digest) and whether the filter has their digest: false for certain, or true perhaps."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(slots))
    marked = rows.withColumn("_slot", slot).withColumn("word", F.floor(F.col("_slot") / 64)).join(F.broadcast(filtered), "word", "left")
    return marked.withColumn("perhaps", F.coalesce(F.expr("getbit(bits, cast(_slot % 64 AS int)) = 1"), F.lit(False))).drop("_slot", "word", "bits")


def exact_groups(docs: DataFrame, keep: str = "min") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Documents with equal UTF-8 texts form a group; keep names the doc_id that stays, "min" (the index's own rule)
    or "max". Digests that compaction met more than once are hits. A filter over the hits, of a fixed number of slots,
    goes to every executor: entries and documents that it does not claim are unique and are done. The others, that is
    the hits and a few more, are verified byte by byte: they are grouped again by digest and text, so that two texts
    under one digest would part.

    Null text counts as empty. An empty table gives no rows. Repeated rows (same doc_id and text) each give one
    row and each count in group_size; all of those with the kept doc_id are kept. A null doc_id is kept only if
    its whole group has null ids. Only doc_id and text are read; other columns may have any name.
    """
    own = docs.select("doc_id", "text")
    runs = flush_runs(own)
    hits = compact(runs, keep).where("n > 1")
    filtered = stage(digest_filter(hits, SLOTS), "filter")
    entries = probe(runs.drop("run"), filtered, SLOTS)
    out = entries.where("NOT perhaps").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))

    again = probe(own.select("doc_id", _bytes().alias("bytes")).withColumn("digest", F.unhex(F.sha2("bytes", 256))), filtered, SLOTS).where("perhaps").drop("perhaps")
    checked = stage(again.groupBy("digest", "bytes").agg(_BEST[keep]("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "verified")
    kinds = stage(checked.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds"), F.first("keep_id").alias("keep_id"), F.first("n").alias("n")), "kinds")
    one = kinds.where("kinds = 1").select("digest", "keep_id", F.col("n").alias("size"), "n")
    out = out.union(join_spread(entries.where("perhaps").drop("perhaps"), one, "digest", "size", "doc_id").select("doc_id", "digest", "keep_id", "n"))
    torn = kinds.where("kinds > 1").select("digest")  # two texts under one digest: none is known
    if not torn.isEmpty():
        out = out.union(again.join(torn, "digest").join(checked, ["digest", "bytes"]).select("doc_id", "digest", "keep_id", "n"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "min", repeats: bool = True) -> DataFrame:
    """docs without the exact copies: of each group the row with the kept doc_id stays, with all its columns.

    Decided by row, so that a row with a null doc_id goes too, and a doc_id with several texts loses none of them by
    another's copy. Where the kept doc_id itself is repeated, every row of that doc_id and text stays with repeats,
    else one of them.
    """
    rows = numbered(docs)
    with passing(docs.sparkSession):
        groups = exact_groups(by_row(rows)).where("group_size > 1").select("doc_id", F.col("keep_id").alias("group"))
        return without(rows, outnumbered(rows, groups, keep, repeats))
