import itertools
import math
import random

import numpy as np
import pytest

from entwine.llm import decontam
from tests.llm.conftest import SCHEMA, edited, prose


def brute(docs, items):
    """Every alignment of every item with every document, without seeds."""
    out = {}
    for doc_id, text in docs:
        w, best = decontam.words((text or "").encode()), []
        for item_id, t in items:
            x = decontam.words((t or "").encode())
            if not x:
                continue
            n = min(decontam.WINDOW, len(x))
            for start in range(-len(x), len(w)):
                same = [0 <= start + i < len(w) and w[start + i] == x[i] for i in range(len(x))]
                for i in range(len(x) - n + 1):
                    if sum(same[i : i + n]) >= (n if n < 5 else decontam.SHARE * n):
                        best.append(item_id)
        out[doc_id] = sorted(set(best))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice((5, 8, 12, 20, 50)))) for i in range(12)] + [(100, "too short"), (101, None), (102, ""), (103, "Theand, erinst"), (104, "onea"), (105, "reou the inly ANSWER"), (7, "another, under a known id"), (106, "too short")]
    docs = [(i, prose(rng, rng.choice((0, 3, 40, 90)))) for i in range(30)]
    for i in range(30, 60):
        passage = items[i % 12][1]
        docs.append((i, f"{prose(rng, 20)} {edited(rng, passage, (0, 0.05, 0.1, 0.5)[i % 4]).upper()}, {prose(rng, 15)}"))
    docs += [(60, items[0][1]), (61, None), (62, " ".join(x[1] for x in items[:5])), (63, items[4][1][: len(items[4][1]) // 2])]
    docs += [(64, "it is too, short"), (65, "too long short"), (66, "reou the inly answer"), (67, "reou then inly answer"), (68, "short too"), (69, "another under a known id")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, None, None, None) for d in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, planted):
    docs, items = planted
    want = brute(docs, items)
    got = {r["doc_id"]: r for r in decontam.leaks(*frames(spark, docs, items)).collect()}
    assert {d: r["n_items"] for d, r in got.items()} == {d: len(x) for d, x in want.items()}
    assert all(r["kept"] == (not want[d]) and (r["item_id"] in want[d] or r["kept"]) for d, r in got.items())


def test_blocks_of_the_benchmark_agree(spark, planted, monkeypatch):
    docs, items = planted
    whole = sorted(map(tuple, decontam.leaks(*frames(spark, docs, items)).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    monkeypatch.setattr(decontam, "CHUNK", 50)
    assert sorted(map(tuple, decontam.leaks(*frames(spark, docs, items)).collect())) == whole


def test_rows_with_repeated_and_null_ids(spark, planted, monkeypatch):
    """Decided by row, with one block as with several."""
    docs, items = planted
    leak, clean = items[4][1], "nothing of that kind in here"
    rows = [(None, leak), (None, clean), (1, leak), (1, clean), (1, clean), (2, None), (2, leak)]
    want = [(None, False), (None, True), (1, False), (1, True), (1, True), (2, True), (2, False)]
    ids = lambda: sorted(((r["doc_id"], r["kept"]) for r in decontam.leaks(*frames(spark, rows, items)).collect()), key=repr)
    assert ids() == sorted(want, key=repr)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    assert ids() == sorted(want, key=repr)
    assert sorted(r["text"] for r in decontam.drop_leaks(*frames(spark, rows, items)).where("text IS NOT NULL").collect()) == [clean] * 3


def test_portions_agree(spark, planted, monkeypatch):
    docs, items = planted
    index = decontam.SeedIndex([(i, (t or "").encode()) for i, t in items])
    x = [index.vocabulary.get(w, 0) for _, t in docs for w in decontam.words((t or "").encode())]
    ends = np.cumsum([len(decontam.words((t or "").encode())) for _, t in docs])
    whole = index.leaks(np.array(x), ends)
    monkeypatch.setattr(decontam, "PORTION", 7)
    assert index.leaks(np.array(x), ends) == whole


@pytest.mark.parametrize("n", range(1, 14))
def test_every_substitution_pattern_within_tolerance_is_found(n):
    item = [f"w{i}" for i in range(n)]
    index = decontam.SeedIndex([(1, " ".join(item).encode())])
    for bad in itertools.combinations(range(n), n - math.ceil(decontam.SHARE * n) if n >= 5 else 0):
        x = np.array([0 if i in bad else index.vocabulary[w.encode()] for i, w in enumerate(item)])
        assert index.leaks(x, np.array([n])), bad


def test_drop_leaks_keeps_columns(spark, docs):
    items = spark.createDataFrame([(1, "none of these words occur anywhere here")], "item_id long, text string")
    out = decontam.drop_leaks(docs, items)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty_and_null(spark, empty, nullish):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.leaks(empty, some).count() == 0
    assert [r["kept"] for r in decontam.leaks(nullish, none).collect()] == [True] * 3
    assert decontam.leaks(nullish, some).where("kept").count() == 3
