"""The pipeline over planted documents; each stage against a brute-force version of its rule."""

import random

import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, edited, prose
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_quality import junk


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(i, prose(rng, 30)) for i in range(5)]
    rows = [(i, prose(rng, 70)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200 + i, edited(rng, rows[i + 10][1], 0.01)) for i in range(10)]
    rows += [(300 + i, f"{prose(rng, 30)} {bench[i % 5][1]} {prose(rng, 10)}") for i in range(6)]
    rows += [(400 + i, junk(rng, i % 4)) for i in range(12)] + [(500, None), (501, "")]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, bench


def test_stages_against_brute_force(spark, folder):
    path, rows, bench = folder
    docs, text = spark.read.parquet(f"{path}/documents.parquet"), dict(rows)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, path)
        assert out.columns == docs.columns
        before, kept[name] = sorted(r["doc_id"] for r in docs.collect()), sorted(r["doc_id"] for r in out.collect())
        if name == "quality classifier":
            assert set(before) - set(kept[name]) == {*range(400, 412), 500, 501}
        if name == "exact dedup":
            assert kept[name] == sorted(min(i for i in before if text[i] == t) for t in {text[i] for i in before})
        if name == "near dedup":
            assert kept[name] == [r[0] for r in brute_near([(i, text[i]) for i in before], 5) if r[3]]
        if name == "benchmark decontamination":
            found = brute_leaks([(i, text[i]) for i in before], bench)
            assert kept[name] == [i for i in before if not found[i]] and any(found.values())
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, whole.collect()))
    assert {r["doc_id"] for r in whole.collect()} == set(kept["benchmark decontamination"])


def test_stages_decide_by_row(spark, folder):
    """Repeated rows, a doc_id with several texts, and null ids."""
    rng = random.Random(13)
    a, b, c, d = (prose(rng, 70) for _ in range(4))
    near = f"{c} tail"
    frame = lambda rows: spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    stages, texts = dict(corpus_pipeline.STAGES), lambda out: sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    run = lambda name, rows: texts(stages[name](spark, frame(rows), folder[0]))
    order = lambda rows: sorted(rows, key=repr)
    assert run("exact dedup", [(5, a), (5, b), (3, b), (5, a), (None, b), (None, d), (None, d)]) == order([(5, a), (3, b), (None, d)])
    assert run("near dedup", [(1, c), (1, c), (2, near), (2, a), (None, near), (None, d), (None, d), (7, None), (8, "")]) == order([(1, c), (2, a), (None, d), (7, None), (8, "")])
    leak = f"{prose(rng, 30)} {folder[2][0][1]}"
    assert run("benchmark decontamination", [(1, a), (1, leak), (None, leak), (None, b)]) == order([(1, a), (None, b)])
    good = [(i, t) for i, t in folder[1] if i < 400 and i % 2]
    bad = junk(rng, 0)
    got = run("quality classifier", [*good, (1, bad), (None, bad), (None, a)])
    assert bad not in {t for _, t in got} and (None, a) in got and set(good) <= set(got)


def test_stages_keep_only_what_their_result_reads(spark):
    """Of what a stage writes, two tables are left: its numbered rows and the numbers that go."""
    import os

    from entwine.llm import common, exact

    folder = common.work_dir(spark).removeprefix("file:") + "/entwine"
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (None, "")], "doc_id long, text string")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = exact.drop_copies(docs)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["gone", "rows"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]
