import random

import numpy as np
import pytest

from entwine.llm import minhash
from entwine.llm.common import components, join_spread
from tests.llm.conftest import SCHEMA, edited, prose


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(rows, k):
    sets, parent = [shingle_set(r[1], k) for r in rows], {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = root(rows[i][0]), root(rows[j][0])
                parent[max(x, y)] = min(x, y)
    return sorted((r[0], len(s), root(r[0]), root(r[0]) == r[0]) for r, s in zip(rows, sets))


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_brute_force(docs, rows, k):
    assert sorted(map(tuple, minhash.near_groups(docs, k).collect())) == brute(rows, k)


@pytest.mark.parametrize(("block", "hot", "few"), [(1 << 17, 2000, 400_000), (300, 5, 0)])
def test_large_near_group_with_outsiders(spark, monkeypatch, block, hot, few):
    """Members that only reach the group through others, and documents just outside; small blocks split the group,
    small limits deal its pivot, keys and classes over several tasks."""
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", block)
    monkeypatch.setattr(minhash, "MEMBERS", hot)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", few)
    monkeypatch.setattr(minhash, "join_spread", lambda *a: join_spread(*a[:5], hot=hot))
    rng = random.Random(4)
    base = prose(rng, 80)
    texts = [edited(rng, base, share) for share in [0.02] * 25 + [0.05] * 25 + [0.08] * 25 + [0.12] * 15]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = sorted(map(tuple, minhash.near_groups(spark.createDataFrame(rows, SCHEMA), 2).collect()))
    assert got == brute(rows, 2)
    assert len({r[2] for r in got}) > 2


def test_ids_with_several_texts_and_null_ids(spark):
    """Linked by row; named by the smallest doc_id of the linked rows."""
    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (3, f"{b} more"), (None, f"{a} more"), (None, c), (9, f"{c} more"), (9, f"{c} more"), (7, None), (7, " ")]
    got = minhash.near_groups(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA), 2).collect()
    want = [(5, 5, True), (5, 3, False), (3, 3, True), (None, 5, False), (None, 9, False), (9, 9, True), (9, 9, True), (7, 7, True), (7, 7, True)]
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(want, key=repr)


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sa, sb = (minhash.signature(np.unique(x)) for x in (a[:700], a[200:]))
    assert abs((sa == sb).mean() - 500 / 900) < 0.08
    assert (minhash.signature(a[:1])[0::2] == minhash.signature(a[:1])[1::2]).all()


def test_long_text_signature_does_not_depend_on_chunks():
    a = np.arange(1, 10_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    halves = minhash.signature(a[:5000]), minhash.signature(a[5000:])
    whole = minhash.signature(a)
    assert (whole[0::2] == np.minimum(halves[0][0::2], halves[1][0::2])).all() and (whole[1::2] == np.maximum(halves[0][1::2], halves[1][1::2])).all()


def test_empty_and_null(empty, nullish):
    assert minhash.near_groups(empty).count() == 0
    got = {tuple(r) for r in minhash.near_groups(nullish, 2).collect()}
    assert got == {(None, 0, None, True), (None, 1, None, True), (1, 0, 1, True)}


def test_drop_near_keeps_columns(docs, rows):
    out = minhash.drop_near(docs, 2)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in brute(rows, 2) if r[3])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
