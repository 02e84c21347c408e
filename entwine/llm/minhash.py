"""Near duplicates by min-max hashing: banded candidates, links confirmed on full shingle sets, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, by_row, components, join_spread, numbered, outnumbered, passing, stage, utf8, without

#: Permutations. Each gives its minimum and its maximum, so a signature has twice as many values.
PERMUTATIONS = 128
#: Signature values per band; 2 * 128 // 6 = 42 bands. A pair at similarity 0.8 shares no band with probability 3e-6.
ROWS = 6
#: Rows up to which a list of keys with two numbers each may be broadcast (some 50 MB in an executor).
BROADCAST_ROWS = 400_000
#: Shingles in a block of the second round (1 MB, and as much again for the block it meets).
BLOCK_ITEMS = 1 << 17
#: Members of a pivot that one task holds against it; a larger group is dealt over several.
MEMBERS = 2_000
#: Words whose hashes a Python worker remembers; beyond that it starts anew.
CACHE = 200_000

_hashes: dict[bytes, int] = {}
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words the whole sequence is one."""
    words = text.lower().split()  # bytes.lower takes A-Z only, bytes.split takes \x20 and \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    try:
        ids = list(map(_hashes.__getitem__, words))
    except KeyError:
        if len(_hashes) > CACHE:
            _hashes.clear()
        for w in words:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh64_intdigest(w)
        ids = list(map(_hashes.__getitem__, words))
    at = np.array(ids, dtype=np.uint64)
    n = max(1, len(at) - k + 1)
    out = np.full(n, min(k, len(at)), dtype=np.uint64)
    for i in range(min(k, len(at))):
        out = (out ^ at[i : i + n]) * _PRIME
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(items: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """min_0, max_0, min_1, max_1, ... over x -> a * x + b modulo 2**32, a odd. The share of equal values of two
    signatures estimates their sets' similarity without bias, from one hash evaluation for two values."""
    a, b = _multipliers(permutations)
    x = (items >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 0xFFFFFFFF, dtype=np.uint32), np.zeros(permutations, dtype=np.uint32)
    for i in range(0, len(x), 2048):  # bounded memory for very long texts
        v = a[:, None] * x[None, i : i + 2048] + b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, salted by the band's number."""
    bands = len(sig) // rows
    v = sig[: bands * rows].astype(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
    for i in range(rows):
        out = (out ^ v[:, i]) * _PRIME
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                items = shingles(text, k)
                n.append(len(items))
                digests.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                keys.append(band_keys(signature(items)) if len(items) else np.empty(0, dtype=np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n", "digest", "keys"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text, k).view(np.int64) for text in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "items"])

    return run


def _bounded(keys: DataFrame) -> DataFrame:
    """keys (a staged table), marked for broadcast where its size allows it."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets have 100 * intersection >= percent * union. An `a` of many pairs is dealt
    over several tasks, and its set is sent once to each."""
    left = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    both = join_spread(pairs.join(right, "b"), left, "a", "c", "b", MEMBERS)
    both = both.select("a", "b", F.size(F.array_intersect("items_a", "items_b")).cast("long").alias("i"), (F.size("items_a") + F.size("items_b")).cast("long").alias("s"))
    return both.where(F.col("i") * 100 >= (F.col("s") - F.col("i")) * percent).select("a", "b")


def _rest(member: DataFrame, part: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a pivot and lie in different components.

    member: (pivot, node, n), without the pivots themselves, which were held against all their members. A pivot's
    members are cut into blocks of about BLOCK_ITEMS shingles: first those outside its largest component, then that
    component's (all in one block where they fit). Every block of the first kind meets itself and all other blocks,
    one task per pair of blocks, streamed in sorted order, so that neither a bucket nor a task's memory is bound to
    the size of a group. Rows made: members times the blocks they meet.
    """
    member = member.join(part, "node", "left").select("pivot", "node", "n", F.coalesce("component", "node").alias("part"))
    per = member.groupBy("pivot", "part").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("items"))
    mixed = per.groupBy("pivot").agg(F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("c", "part")).alias("main"), F.max_by("items", F.struct("c", "part")).alias("main_items"), F.sum("items").alias("items"), F.sum("c").alias("c"))
    blocks = lambda c: F.ceil(c / BLOCK_ITEMS)
    small = F.col("items") <= BLOCK_ITEMS
    mixed = mixed.where("parts > 1").select(
        "pivot", "c", "main", F.when(small, 1).otherwise(blocks(F.col("items") - F.col("main_items"))).alias("n_rest"), F.when(small, 0).otherwise(blocks(F.col("main_items"))).alias("n_main")
    )
    dealt = join_spread(member, stage(mixed, "mixed"), "pivot", "c", "node")
    hashed = F.xxhash64("node", F.lit(11))
    outside = (F.col("part") != F.col("main")) | (F.col("n_main") == 0)
    dealt = dealt.withColumn("block", F.when(outside, F.pmod(hashed, F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(hashed, F.greatest("n_main", F.lit(1)))))
    meets = F.sequence(F.lit(0).cast("long"), F.when(F.col("block") < F.col("n_rest"), F.col("n_rest") + F.col("n_main")).otherwise(F.col("n_rest")) - 1)
    rows = dealt.select("pivot", "node", "part", "block", F.explode(meets).alias("other"))
    rows = rows.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part").join(sets, "node")
    rows = rows.select("pivot", "i", "j", "block", "node", "part", "items").repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return rows.mapInArrow(_blocks(percent), "a long, b long").distinct()


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links in one pair of blocks, one for each two components. rows: (is first block, is second block, node, part, items)."""
    sizes = np.array([len(r[4]) for r in rows])
    _, index = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    part, second = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    here, out = np.zeros(index.max() + 1, dtype=np.int64), {}
    for k, (first, _, node, own, items) in enumerate(rows):
        if not first:
            continue
        at = index[starts[k] : starts[k] + sizes[k]]
        here[at] = 1
        both = np.add.reduceat(here[index], starts)
        here[at] = 0
        for x in np.flatnonzero(second & (part != own) & (100 * both >= percent * (sizes + sizes[k] - both))):
            out.setdefault((min(own, part[x]), max(own, part[x])), (min(node, rows[x][2]), max(node, rows[x][2])))
    return list(out.values())


def _blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            links = _block_links(rows, percent) if len({r[3] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        key, rows = None, []
        for batch in batches:
            items = batch.column(6)
            ends, flat = items.offsets.to_numpy(), items.values.to_numpy()
            cols = [batch.column(c).to_pylist() for c in range(6)]
            for k, (pivot, i, j, block, node, part) in enumerate(zip(*cols)):
                if key != (pivot, i, j):
                    if rows:
                        yield out(rows)
                    key, rows = (pivot, i, j), []
                rows.append((block == i, block == j, node, part, flat[ends[k] : ends[k + 1]]))
        if rows:
            yield out(rows)

    return run


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where the Jaccard similarity of their k-word shingle sets is percent / 100 or more;
    component_id is the smallest doc_id that links reach, and that document is kept.

    Documents with equal sets are one class, so exact copies are never paired. Classes meet in bands of their
    min-max signatures. Links are confirmed on full sets in two rounds. First each bucket's smallest class is
    held against the bucket's others (one pair per member, whatever the bucket's size). Then, in buckets that
    still hold more than one component, every class outside the largest component is held against the classes of
    other components, so that no candidate pair across components stays untested; pairs inside the largest
    component change nothing and are left out. That second round works block against block and emits no pairs but
    links (see _rest). No bucket is capped.

    Null or empty text, or white space only: n_shingles 0, linked with nothing, kept. Where a doc_id is null or
    repeated, rows are numbered first and linked by number, so a doc_id may have several texts: component_id is then
    the smallest doc_id of the linked rows, null where all of them are null; rows with that doc_id are kept, and those
    of a component of null ids. Empty table: no rows. Other columns are ignored.
    """
    if _repeats(docs):
        return _by_number(docs, k, percent)
    own = docs.select("doc_id", utf8().alias("text"))
    sketch = stage(own.mapInArrow(_sketch(k), "doc_id long, n long, digest binary, keys array<long>"), "sketch")
    # A class is named by its smallest doc_id.
    classes = stage(sketch.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("c")), "classes")
    named = classes.select(F.col("node").alias("doc_id"), "digest")
    banded = sketch.where("n > 0").join(named, ["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("node", "n")).alias("p")).where("c > 1")
    shared = stage(shared.select("key", "c", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "keys")
    few = shared.count() <= BROADCAST_ROWS
    met = banded.join(F.broadcast(shared), "key") if few else join_spread(banded, shared, "key", "c", "node")
    buckets = stage(met.select("key", "node", "n", "pivot", "pivot_n"), "buckets")
    nodes = stage(buckets.select("node").distinct(), "nodes")
    texts = own.join(_bounded(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    sets = stage(texts.mapInArrow(_sets(k), "node long, items array<long>"), "sets")

    sized = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    first = buckets.where((F.col("node") != F.col("pivot")) & sized("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = stage(first, "pairs")
    links = stage(_confirm(first, sets, percent), "links")
    part = stage(components(links), "parts")

    extra = stage(_rest(buckets.where("node <> pivot").select("pivot", "node", "n").distinct(), part, sets, percent), "links")
    part = components(links.union(extra))

    places = stage(classes.join(part, "node", "left").select("digest", "c", F.coalesce("component", "node").alias("component")), "places")
    whole = join_spread(sketch.select("doc_id", "n", "digest"), places, "digest", "c", "doc_id")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id is null or repeated."""
    return not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 OR doc_id IS NULL").isEmpty()


def _by_number(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """near_groups() over rows that are numbered, with doc_ids in place of the numbers."""
    rows = numbered(docs.select("doc_id", "text"))
    groups = near_groups(by_row(rows), k, percent).withColumnRenamed("doc_id", ROW)
    members = stage(rows.select(ROW, "doc_id").join(groups, ROW), "members")
    least = stage(members.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")), "least")
    out = join_spread(members.select(ROW, "doc_id", "n_shingles", "component_id"), least, "component_id", "c", ROW)
    return out.select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull()).alias("kept"))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80, repeats: bool = True) -> DataFrame:
    """docs with one document of each group of near duplicates, all columns as they were. Decided by row, as in
    exact.drop_copies: rows that repeat the kept doc_id stay with repeats, else one of them."""
    rows = numbered(docs)
    with passing(docs.sparkSession):
        groups = near_groups(by_row(rows), k, percent).select("doc_id", F.col("component_id").alias("group"))
        return without(rows, outnumbered(rows, groups, "min", repeats))
