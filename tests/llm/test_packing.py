import itertools
import random
from collections import defaultdict

import pytest

from entwine.llm import packing


def padded(lengths, counts, bounds):
    return sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), 9))
    counts = [rng.randint(1, 50) for _ in lengths]
    for k in (1, 2, 3, 4, 12):
        bounds = packing.optimal_bounds(lengths, counts, k)
        best = min(padded(lengths, counts, (*c, lengths[-1])) for r in range(min(k, 9)) for c in itertools.combinations(lengths[:-1], r))
        assert len(bounds) <= k and bounds == sorted(set(bounds)) and padded(lengths, counts, bounds) == best
    assert packing.optimal_bounds([], [], 3) == []


def test_pack_holds_every_token_once(docs, rows):
    got = [r.asDict() for r in packing.pack(docs, budget=256, max_len=64, buckets=4).collect()]
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start"], r["n_tokens"]))
    for doc_id in {r[0] for r in rows}:
        times = sum(r[0] == doc_id for r in rows)
        n = len(next(r[1] or "" for r in rows if r[0] == doc_id).encode().split()) + 1
        one = [(s, min(64, n - s)) for s in range(0, n, 64)]
        assert sorted(spans[doc_id]) == sorted(one * times)
    batches = defaultdict(list)
    for r in got:
        batches[r["batch_id"]].append(r)
        assert r["n_tokens"] <= r["bucket_len"] <= 64
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r["bucket"] for r in b}) == 1 and sorted(r["batch_row"] for r in b) == list(range(len(b)))
        assert sum(r["bucket_len"] for r in b) <= 256
    full = defaultdict(list)
    for k, b in batches.items():
        full[b[0]["bucket"]].append(len(b))
    assert all(len(set(sorted(sizes)[1:])) <= 1 for sizes in full.values())


def test_bucket_bounds_are_the_histograms_optimum(docs):
    got = packing.pack(docs, budget=256, max_len=64, buckets=4).select("n_tokens", "bucket_len").collect()
    lengths = sorted({r[0] for r in got})
    counts = [sum(r[0] == n for r in got) for n in lengths]
    assert sum(r[1] for r in got) == padded(lengths, counts, packing.optimal_bounds(lengths, counts, 4))


def test_empty_and_null(spark, empty, nullish):
    assert packing.pack(empty).count() == 0
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in packing.pack(nullish).collect()) == [("1", 1), ("None", 1), ("None", 3)]
