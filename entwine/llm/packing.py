"""Packing into optimal length buckets with token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, gapless, stage


def word_tokens(column: str = "text") -> Column:
    """Words of a text by the white-space rule, and one end token. Null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long") + 1


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least padding over a histogram.

    Dynamic programming over the distinct lengths: best[j] is the least number of padded tokens for all
    sequences up to length j in k buckets; a bucket (i, j] costs lengths[j] * (rows in it). Exact, in integers.
    """
    order = np.argsort(np.asarray(lengths, dtype=np.int64))
    top, n = np.asarray(lengths, dtype=np.int64)[order], np.asarray(counts, dtype=np.int64)[order]
    if not len(top):
        return []
    upto = np.concatenate([[0], np.cumsum(n)])
    width = top[None, :] * (upto[None, 1:] - upto[:-1, None])  # [i, j]: lengths i..j in one bucket
    width[np.tril_indices(len(top), -1)] = np.iinfo(np.int64).max // 4
    best, back = width[0], []
    for _ in range(min(buckets, len(top)) - 1):
        cost = np.concatenate([[0], best[:-1]])[:, None] + width
        cost[0] = width[0]
        back.append(cost.argmin(axis=0))
        best = np.take_along_axis(cost, back[-1][None, :], axis=0)[0]
    bounds, j = [], len(top) - 1
    for starts in [*reversed(back), np.zeros(len(top), dtype=np.int64)]:
        bounds.append(int(top[j]))
        j = int(starts[j]) - 1
        if j < 0:
            break
    return bounds[::-1]


def pack(docs: DataFrame, length: Column | None = None, budget: int = 65_536, max_len: int = 2_048, buckets: int = 16) -> DataFrame:
    """Deal every token of every document into length buckets and token-budget batches.

    A document longer than max_len is cut into pieces of max_len tokens (no token is dropped). One job counts the
    pieces of each length: the histogram has at most max_len rows, whatever the input, and goes to the driver,
    where dynamic programming chooses the bucket bounds with the least padding. Inside each bucket, batches take
    budget // bound sequences (at least one), so that bound * sequences never passes the budget.

    Returns doc_id, piece, start, n_tokens, bucket, bucket_len, batch_id, batch_row (batch_id runs from 0 over all
    buckets without gaps). `length` gives a document's tokens; words and one end token by default. Null or empty
    text: one piece with the end token; a null or negative length counts as 0 and gives no piece. Repeated rows
    are packed as often as they occur. Empty table: no rows. Only doc_id and what length reads are used.
    """
    n = F.greatest(F.coalesce((word_tokens() if length is None else length).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    cut = docs.select("doc_id", n.alias("_n")).where("_n > 0")
    cut = cut.select("doc_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {max_len}"))).alias("piece"))
    cut = cut.select("doc_id", "piece", (F.col("piece") * max_len).alias("start"), F.least(F.lit(max_len).cast("long"), F.col("_n") - F.col("piece") * max_len).alias("n_tokens"))
    cut = stage(cut, "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = optimal_bounds(list(histogram), list(histogram.values()), buckets)
    first, room, total = [], [], 0
    for low, high in zip([0, *bounds[:-1]], bounds):
        rows = sum(c for k, c in histogram.items() if low < k <= high)
        room.append(max(1, budget // high))
        first.append(total)
        total += -(-rows // room[-1])
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs or [0]])
    bucket = F.size(F.filter(longs(bounds), lambda b: b < F.col("n_tokens")))
    dealt = cut.withColumn("bucket", bucket) if bounds else cut.withColumn("bucket", F.lit(0))
    dealt = gapless(dealt, "bucket", ["doc_id", "piece", "n_tokens"], sum(histogram.values()), "_rank")
    size, at = F.get(longs(room), F.col("bucket")), F.get(longs(first), F.col("bucket"))
    return dealt.select(
        "doc_id", "piece", "start", "n_tokens", "bucket", F.get(longs(bounds), F.col("bucket")).alias("bucket_len"),
        (at + F.floor(F.col("_rank") / size)).alias("batch_id"), (F.col("_rank") % size).alias("batch_row"),
    )
