"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, ROW, by_row, numbered, passing, stage, utf8, without

#: Fixed masks over word positions: 1 is hashed, 0 is ignored, so that a substituted word there does no harm. Within
#: the tolerance below, every pattern of substitutions leaves some place of some mask untouched (a test goes through
#: them all): three masks of weight 5 for items that fill a window, lighter ones for shorter items.
MASKS = ("110111", "111011", "1100001011")
SHORT_MASKS = ("1111", "10111", "11011", "11101", "100111", "1100011")
#: A leak: in some run of WINDOW words of an item (the whole item where it is shorter) this share of the words stand
#: at the same places in the document.
WINDOW, SHARE = 13, 0.75
#: Items with fewer words must stand in the document exactly, as a phrase.
TOLERANT = 5
#: Benchmark words in one broadcast block (about 100 MB in a Python worker); a larger benchmark goes in several blocks.
BLOCK_WORDS = 1_000_000
#: Document words hashed at once in a task, and candidates (or their words) verified at once.
CHUNK, PORTION = 500_000, 1_000_000


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def masks_for(n: int) -> tuple[str, ...]:
    """The masks by which an item of n words is looked for."""
    return MASKS if n >= WINDOW else SHORT_MASKS if n >= TOLERANT else ("1" * n,)


class SeedIndex:
    """The benchmark's seeds: sorted mask hashes with the item and place of each. Items of equal words are one entry."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        ids: dict[bytes, set[int]] = {}
        for item_id, text in items:
            w = words(text)
            if w:
                ids.setdefault(b" ".join(w), set()).add(item_id)
        texts = sorted(ids, key=lambda t: (min(ids[t]), t))
        self.ids = [sorted(ids[t]) for t in texts]
        self.items = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in t.split(b" ")], dtype=np.int64) for t in texts]
        self.flat = np.concatenate([*self.items, np.empty(0, dtype=np.int64)])
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.least = np.array([0, *(n if n < TOLERANT else math.ceil(SHARE * n) for n in range(1, WINDOW + 1))], dtype=np.int64)
        rng = np.random.default_rng(7)
        self.codes = np.concatenate([[0], rng.integers(1, 1 << 63, len(self.vocabulary), dtype=np.uint64)]).astype(np.uint64)
        self.factors = rng.integers(0, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        seeds: dict[str, list] = {}
        for i, x in enumerate(self.items):
            for mask in masks_for(len(x)):
                h, ok = self.hashed(x, mask)
                at = np.flatnonzero(ok)
                seeds.setdefault(mask, []).append((h[at], np.full(len(at), i, dtype=np.int64), at))
        self.seeds = []
        for mask, parts in seeds.items():
            keys, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys, kind="stable")
            self.seeds.append((mask, keys[order].astype(np.uint64), item[order], place[order]))

    def hashed(self, x: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """The mask's hash at each place of x, and whether all its hashed words are benchmark words."""
        n = max(0, len(x) - len(mask) + 1)
        h, ok = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        for o, bit in enumerate(mask):
            if bit == "1":
                h += self.codes[x[o : o + n]] * self.factors[o]
                ok &= x[o : o + n] > 0
        return h, ok

    def leaks(self, x: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, place, matching words, window) of the documents concatenated in x; ends: their last places
        + 1. Hits are aligned and verified in bounded portions, whatever number of items share a seed."""
        out: dict[tuple[int, int], tuple] = {}
        for mask, keys, item, place in self.seeds:
            h, ok = self.hashed(x, mask)
            at = np.flatnonzero(ok)
            low = np.searchsorted(keys, h[at])
            hit = low < len(keys)
            hit[hit] = keys[low[hit]] == h[at[hit]]
            at, low = at[hit], low[hit]
            many = np.searchsorted(keys, h[at], side="right") - low
            upto = np.cumsum(many)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PORTION, side="right")))
                m = many[lo:hi]
                entry = np.repeat(low[lo:hi], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                spot = np.repeat(at[lo:hi], m)
                found = np.unique(np.stack([np.searchsorted(ends, spot, side="right"), item[entry], spot - place[entry]], axis=1), axis=0)
                size = np.cumsum(self.sizes[found[:, 1]]) // PORTION
                for part in np.split(found, np.flatnonzero(np.diff(size)) + 1):
                    for doc, i, start, same, w in self._verified(part, x, ends):
                        best = out.get((doc, i))
                        if best is None or (-same, start) < (-best[3], best[2]):
                            out[doc, i] = doc, i, start, same, w
                lo = hi
        return sorted(out.values())

    def _verified(self, found: np.ndarray, x: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Of candidates (document, item, place of the item's first word), those with a window that agrees enough: the
        first of its best windows."""
        doc, i, start = found.T
        n, first = self.sizes[i], np.where(doc > 0, ends[doc - 1], 0)
        row, upto = np.repeat(np.arange(len(i)), n), np.cumsum(n)
        inside = np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n)
        at = start[row] + inside
        held = (at >= first[row]) & (at < ends[doc][row])
        same = np.zeros(len(at), dtype=np.int64)
        same[held] = x[at[held]] == self.flat[self.starts[i][row] + inside][held]
        sums, w = np.concatenate([[0], np.cumsum(same)]), np.minimum(n, WINDOW)
        here = np.flatnonzero(inside + w[row] <= n[row])  # places where a window begins
        score = sums[here + w[row[here]]] - sums[here]
        good = score >= self.least[w[row[here]]]
        here, score = here[good], score[good]
        order = np.lexsort((here, -score, row[here]))
        for k in order[np.flatnonzero(np.diff(row[here[order]], prepend=-1))] if len(order) else ():
            r = row[here[k]]
            yield int(doc[r]), int(i[r]), int(start[r] - first[r] + inside[here[k]]), int(score[k]), int(w[r])


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: SeedIndex = index.value
        for batch in batches:
            texts, hits, run_, lengths, base = batch.column(1).to_pylist(), {}, [], [], 0

            def flush():
                nonlocal base
                x = np.fromiter(run_, dtype=np.int64, count=len(run_))
                for doc, *rest in ix.leaks(x, np.cumsum(lengths)):
                    hits.setdefault(base + doc, []).append(rest)
                base += len(lengths)
                run_.clear()
                lengths.clear()

            for text in texts:
                w = words(text)
                run_.extend(map(ix.vocabulary.get, w, [0] * len(w)))
                lengths.append(len(w))
                if len(run_) >= CHUNK:
                    flush()
            if lengths:
                flush()
            doc_ids = batch.column(0).to_pylist()
            rows = []
            for i in range(len(texts)):
                own = [(ix.ids[r[0]][0], *r[1:]) for r in sorted(hits.get(i, []), key=lambda r: (-r[2] / r[3], ix.ids[r[0]][0], r[1]))]
                rows.append((doc_ids[i], len({k for r in hits.get(i, []) for k in ix.ids[r[0]]}), *(own[0] if own else (None,) * 4)))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_items", "item_id", "start_word", "matched", "window"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, kept, n_items, item_id, start_word, matched, window.

    kept is false where the document holds a benchmark passage: a run of 13 item words (or a whole item of 5 to 12
    words) of which three in four or more stand at the same relative places in the document, found around a hit of
    any spaced seed; or all words of an item of 1 to 4 words, in order and side by side. item_id, start_word, matched
    and window tell of the best such place (highest share, then smallest item_id, then first), n_items how many items
    leak; null and 0 without one.

    The benchmark is a query set: its seed hashes are broadcast in blocks of a bounded number of words (an item is not
    cut), and each block meets every document, in one pass without a shuffle. With several blocks rows are numbered
    first and what the blocks found is merged by row, so that verdicts do not depend on the number of blocks: a row's
    doc_id may be null or repeated. Null or empty texts hold nothing; null or empty items are not looked for; an empty
    benchmark keeps all; items with equal text each count. Only doc_id and text, and item_id and text, are read.
    """
    own = docs.select("doc_id", utf8().alias("text"))
    items = benchmark.select("item_id", utf8().alias("text")).where("item_id IS NOT NULL")
    n = items.agg(F.coalesce(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-n // BLOCK_WORDS))
    sc, schema = docs.sparkSession.sparkContext, "doc_id long, n_items long, item_id long, start_word long, matched long, window long"

    def search(rows: DataFrame, block: int) -> DataFrame:
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        return rows.mapInArrow(_search(sc.broadcast(SeedIndex([(r["item_id"], bytes(r["text"])) for r in part]))), schema)

    if blocks == 1:
        out = search(own, 0)
    else:
        rows = stage(own.withColumn(ROW, F.monotonically_increasing_id()), "rows")
        found = None
        for i in range(blocks):
            hits = search(rows.select(F.col(ROW).alias("doc_id"), "text"), i).where("n_items > 0")
            found = hits if found is None else found.union(hits)
        best = F.min(F.struct((-F.col("matched") / F.col("window")).alias("s"), "item_id", "start_word", "matched", "window")).alias("b")
        merged = found.groupBy(F.col("doc_id").alias(ROW)).agg(F.sum("n_items").alias("n_items"), best)
        merged = merged.select(ROW, "n_items", "b.item_id", "b.start_word", "b.matched", "b.window")
        out = rows.select("doc_id", ROW).join(merged, ROW, "left").na.fill(0, ["n_items"])
    return out.select("doc_id", (F.col("n_items") == 0).alias("kept"), "n_items", "item_id", "start_word", "matched", "window")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark passage, all columns as they were."""
    rows = numbered(docs)
    with passing(docs.sparkSession):
        return without(rows, leaks(by_row(rows), benchmark).where("NOT kept").select(F.col("doc_id").alias(ROW)))
