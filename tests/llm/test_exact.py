import hashlib
from collections import defaultdict

import pytest

from entwine.llm import common, exact


@pytest.mark.parametrize("keep", ["min", "max"])
def test_groups_against_brute_force(docs, rows, keep):
    ids = defaultdict(list)
    for r in rows:
        ids[r[1] or ""].append(r[0])
    best = {"min": min, "max": max}[keep]
    want = sorted((r[0], best(ids[r[1] or ""]), len(ids[r[1] or ""]), r[0] == best(ids[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted(map(tuple, exact.exact_groups(docs, keep).collect())) == want


def test_drop_copies_keeps_columns_and_first_rows(docs, rows):
    out = exact.drop_copies(docs, "min")
    assert out.columns == docs.columns
    first = {}
    for r in rows:
        first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r[0] for r in rows if first[r[1] or ""] == r[0])


def test_lookup_finds_indexed_digests(docs, rows):
    runs = exact.flush_runs(docs)
    digest = hashlib.sha256((rows[5][1] or "").encode()).digest()
    assert {r["doc_id"] for r in exact.lookup(runs, [digest]).collect()} == {r[0] for r in rows if (r[1] or "") == (rows[5][1] or "")}
    assert exact.lookup(runs, [b"\0" * 32]).count() == 0


def test_empty_and_null(empty, nullish):
    assert exact.exact_groups(empty).count() == 0
    got = sorted(map(tuple, exact.exact_groups(nullish, "max").select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 1, 2, False), (1, 1, 2, True), (None, None, 1, True)], key=str)


def test_compaction_by_levels(spark, docs):
    """Many runs, merged two at a time, give what one merge gives; every level's runs are sorted."""
    runs = exact.flush_runs(docs.repartition(9))
    assert runs.select("run").distinct().count() == 9
    one = sorted(map(tuple, exact.compact(runs, "max", 100).collect()))
    assert sorted(map(tuple, exact.compact(runs, "max", 2).collect())) == one and any(r[2] > 1 for r in one)


@pytest.mark.parametrize("slots", [64, 1 << 24])
def test_filter_prunes_and_loses_nothing(docs, rows, monkeypatch, slots):
    """A filter claims all hits; a wide one claims little else, and a narrow one changes no row."""
    want = sorted(map(tuple, exact.exact_groups(docs).collect()))
    monkeypatch.setattr(exact, "SLOTS", slots)
    runs = exact.flush_runs(docs)
    hits = exact.compact(runs).where("n > 1")
    seen = exact.probe(runs, exact.digest_filter(hits, slots), slots).collect()
    hit = {bytes(r["digest"]) for r in hits.collect()}
    assert all(r["perhaps"] for r in seen if bytes(r["digest"]) in hit) and len(seen) == len(rows)
    if slots > 64:
        assert not any(r["perhaps"] for r in seen if bytes(r["digest"]) not in hit)
    assert sorted(map(tuple, exact.exact_groups(docs).collect())) == want


def test_hot_digest_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(exact, "join_spread", lambda *a: common.join_spread(*a, hot=7))
    texts = ["same"] * 60 + ["other"] * 3 + [f"t{i}" for i in range(20)]
    got = exact.exact_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "max").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(i, max(k for k, u in enumerate(texts) if u == t), texts.count(t)) for i, t in enumerate(texts)]
