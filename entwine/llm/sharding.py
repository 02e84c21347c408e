"""Shards by a k-d tree over metadata, split at distributed weighted medians; equal texts stay together."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless, join_spread, stage, utf8

#: Bits of a split key: the dimension's value, then a hash of the text, which orders ties.
VALUE_BITS, TEXT_BITS = 22, 40
KEY_BITS = VALUE_BITS + TEXT_BITS
#: A level's histogram has at most shards * 2**DIGIT rows on the driver.
DIGIT = 12
DIMENSIONS = ("d_bytes", "d_source", "d_lang", "d_id")
#: Groups of equal texts with more than a shard's bytes over this are placed first; there are at most shards * HEAVY.
HEAVY = 8


def _scaled(value: Column, low: float, high: float) -> Column:
    span = max(float(high) - float(low), 1e-9)
    return F.floor((F.coalesce(value.cast("double"), F.lit(float(low))) - low) / span * ((1 << VALUE_BITS) - 1)).cast("long")


def _case(node: Column, table: dict[int, int | str], other) -> Column:
    out = None
    for k, v in table.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(node == k, v) if out is None else out.when(node == k, v)
    return F.lit(other) if out is None else out.otherwise(other)


def place(heavy: list[tuple[int, int, int]], shards: int, target: float) -> tuple[list[tuple[int, int, int, int]], list[float]]:
    """Heavy groups (group, rows, bytes), largest first, each into the shard with the most room; one that is larger than a
    shard is parted by rows into as many as it fills. Returns (group, first row, last row + 1, shard), and the shards' loads."""
    room, out, load = [(0.0, s) for s in range(shards)], [], [0.0] * shards
    heapq.heapify(room)
    for group, rows, size in sorted(heavy, key=lambda g: (-g[2], g[0])):
        done, each = 0, size / rows
        while done < rows:
            filled, s = heapq.heappop(room)
            n = rows - done if size <= target else min(rows - done, max(1, round((target - filled) / each)))
            out.append((group, done, done + n, s))
            done, load[s] = done + n, filled + n * each
            heapq.heappush(room, (load[s], s))
    return out, load


class Node:
    """A subtree with leaves for the shards from `first`, of which each has room for some bytes."""

    def __init__(self, first: int, room: list[float]):
        self.first, self.room = first, room

    def halves(self) -> tuple["Node", "Node", float]:
        """Both halves, and the share of bytes that the left one takes."""
        k, total = len(self.room) // 2, sum(self.room)
        return Node(self.first, self.room[:k]), Node(self.first + k, self.room[k:]), sum(self.room[:k]) / total if total else 1.0


def kd_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = 0.002) -> DataFrame:
    """Shards of nearly equal bytes: doc_id, size, text_crc32, shard, slot, parted.

    Rows of equal text are one point of the tree: its place is that of the group's smallest doc_id, its weight the
    group's bytes. A group goes to one shard whole; only one that is larger than a shard is parted (parted is true
    for its rows). Groups above an eighth of a shard, of which there are few, are placed first, each into the emptiest
    shard; the tree deals all others into the room that is left.

    The root must yield all leaves. A node with more than one leaf is split along its widest dimension (bytes on a log
    scale, source, language, doc_id; each scaled to the whole table's range) at the weighted quantile that gives each
    side bytes in proportion to its leaves' room; a side that has reached one leaf's bytes is a leaf. The quantile is
    found by radix descent over a 62-bit key (the dimension's value, a hash of the text): each round is one aggregation
    of bytes by node and 12-bit digit, and only the chosen digit is looked into further, until its bytes are below
    `tolerance` of a shard; where a single group is left, the cut takes its nearer side.

    Size is the text's UTF-8 bytes plus overhead; null text counts as none and equals empty text. Null source, language
    or doc_id take the low end. Slots run from 0 in each shard without gaps; rows that agree in every column may swap slots.
    Repeated rows count as often as they occur. Fewer groups than shards leave shards empty. Extra columns are
    ignored; source and lang may be absent.
    """
    text = utf8()
    name = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) if c in docs.columns else F.lit(0).cast("long")
    meta = docs.select("doc_id", (F.length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), name("source").alias("_s"), name("lang").alias("_l"))
    meta = stage(meta, "meta")
    groups = meta.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.min(F.struct(F.isnull("doc_id").alias("x"), "doc_id", "_s", "_l")).alias("p"))
    groups = stage(groups.select("group", "n", "size", "p.doc_id", "p._s", "p._l"), "groups")
    low = groups.agg(F.sum("n").alias("n"), F.sum("size").alias("total"), *[f(c).alias(f"{k}_{a}") for a, c in (("size", F.col("size") / F.col("n")), ("_s", "_s"), ("_l", "_l"), ("doc_id", "doc_id")) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    rows, total = low["n"] or 0, low["total"] or 0
    target = total / shards
    span = lambda c: (low[f"lo_{c}"] or 0, low[f"hi_{c}"] or 0)
    heavy = groups.where(F.col("size") > target / HEAVY)
    placed, load = place([(r["group"], r["n"], r["size"]) for r in heavy.select("group", "n", "size").collect()], shards, target)
    tie = F.pmod(F.col("group"), F.lit(1 << TEXT_BITS))
    keyed = groups.where(F.col("size") <= target / HEAVY).select(
        "group", "n", "size", tie.alias("_tie"), _scaled(F.log1p(F.col("size") / F.col("n")), *[math.log1p(x) for x in span("size")]).alias("d_bytes"),
        _scaled(F.col("_s"), *span("_s")).alias("d_source"), _scaled(F.col("_l"), *span("_l")).alias("d_lang"), _scaled(F.col("doc_id"), *span("doc_id")).alias("d_id"),
    )
    at, tree = stage(keyed.withColumn("_node", F.lit(1)), "level"), {1: Node(0, [max(0.0, target - x) for x in load])}
    while rows and any(len(n.room) > 1 for n in tree.values()):
        at, tree = _level(at, tree, target * tolerance)
    light = at.select("group", "n", _case(F.col("_node"), {k: n.first for k, n in tree.items()}, 0).cast("int").alias("shard"))

    spark, parts = docs.sparkSession, {}
    for group, first, last, shard in placed:
        parts.setdefault(group, []).append((group, first, last, shard))
    whole = [(g, p[0][2], p[0][3]) for g, p in parts.items() if len(p) == 1]
    one = light.union(spark.createDataFrame(whole, "group long, n long, shard int"))
    columns = ["doc_id", "size", "text_crc32", "shard", "parted"]
    out = join_spread(meta.select("group", "doc_id", "size", "text_crc32"), stage(one, "places"), "group", "n", "doc_id").withColumn("parted", F.lit(False)).select(*columns)
    torn = [x for p in parts.values() if len(p) > 1 for x in p]
    if torn:  # at most one group for each shard
        table = F.broadcast(spark.createDataFrame(torn, "group long, first long, last long, shard int"))
        own = meta.where(F.col("group").isin(sorted({x[0] for x in torn}))).select("group", "doc_id", "size", "text_crc32")
        ranked = gapless(own, "group", ["doc_id", "size"], rows, "at").withColumnRenamed("group", "g")
        out = out.union(ranked.join(table, (F.col("g") == F.col("group")) & (F.col("at") >= F.col("first")) & (F.col("at") < F.col("last"))).withColumn("parted", F.lit(True)).select(*columns))
    return gapless(stage(out, "dealt"), "shard", ["doc_id", "text_crc32", "size"], rows, "slot").select("doc_id", "size", "text_crc32", "shard", "slot", "parted")


def _level(rows: DataFrame, tree: dict[int, Node], enough: float) -> tuple[DataFrame, dict[int, Node]]:
    """Split every node that has more than one leaf to yield. The level's rows are staged, else each level's
    plan would hold the CASE expressions of all levels above it, once per branch."""
    spread = rows.groupBy("_node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
    found = {r["_node"]: r for r in spread}
    open_ = {k: n for k, n in tree.items() if len(n.room) > 1}
    widest = {k: max(DIMENSIONS, key=lambda d: found[k][d]) if k in found else DIMENSIONS[0] for k in open_}
    keys = {k: F.col(d) * (1 << TEXT_BITS) + F.col("_tie") for k, d in widest.items()}
    at = rows.where(F.col("_node").isin(list(open_))).withColumn("_key", _case(F.col("_node"), keys, F.lit(0)))
    halves = {k: n.halves() for k, n in open_.items()}
    want = {k: found[k]["w"] * halves[k][2] if k in found else 0 for k in open_}
    cut, below, live, shift = dict.fromkeys(open_, 0), dict.fromkeys(open_, 0), [k for k in open_ if k in found], KEY_BITS
    while live and shift > 0:
        shift = max(0, shift - DIGIT)
        digit = F.shiftright("_key", shift)
        part = at.where(F.col("_node").isin(live))
        if shift + DIGIT < KEY_BITS:
            part = part.where(F.shiftright("_key", shift + DIGIT) == _case(F.col("_node"), {k: F.lit(cut[k] >> (shift + DIGIT)).cast("long") for k in live}, F.lit(-1).cast("long")))
        bins: dict[int, list] = {}
        for r in part.groupBy("_node", digit.alias("_bin")).agg(F.sum("size").alias("w")).collect():
            bins.setdefault(r["_node"], []).append((r["_bin"], r["w"]))
        on = []
        for k in live:
            for b, w in sorted(bins.get(k, [])):
                if below[k] + w > want[k]:
                    cut[k] = b << shift
                    if w > enough and shift:
                        on.append(k)
                    elif want[k] - below[k] > w / 2:  # the nearer side of the last digit
                        cut[k] = (b + 1) << shift
                    break
                below[k] += w
                cut[k] = (b + 1) << shift
        live = on
    new, tests = {k: n for k, n in tree.items() if len(n.room) == 1}, {}
    for k in open_:
        tests[k] = F.when(keys[k] < F.lit(cut[k]).cast("long"), 2 * k).otherwise(2 * k + 1)
        new[2 * k], new[2 * k + 1] = halves[k][:2]
    return stage(rows.withColumn("_node", _case(F.col("_node"), tests, F.col("_node"))), "level"), new
