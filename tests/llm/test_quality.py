import random

import pytest

from entwine.llm import quality
from tests.llm.conftest import SCHEMA, edited, prose


def junk(rng, kind):
    words = prose(rng, rng.randint(40, 150)).split()
    if kind == 0:
        return " ".join(w + rng.choice(("***", "$$$", "%%%", "&&&")) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 2:
        return " | ".join(w for w in words if len(w) > 3)
    return " ".join(w for w in words[:10] for _ in range(12))


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice((4, 20, 80, 300))), None, None, None) for i in range(300)]
    rows += [(1000 + i, junk(rng, i % 4), None, None, None) for i in range(60)]
    rows += [(2000, None, None, None, None), (2001, " \n", None, None, None)]
    return {r["doc_id"]: r.asDict() for r in quality.grade(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_clean_documents_stay_and_junk_goes(graded):
    clean = [graded[i]["kept"] for i in range(300)]
    bad = [graded[1000 + i]["kept"] for i in range(60)]
    assert sum(clean) >= 297 and sum(bad) <= 3
    assert not graded[2000]["kept"] and graded[2001]["score"] == 0


def test_held_out_labels(spark):
    """Accuracy on the driver's quality labels, which the model never sees."""
    from pathlib import Path

    data = Path("/root/testdata/sf0.01")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    got = quality.grade(spark.read.parquet(f"{data}/documents.parquet")).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    bad = [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.1


def test_em_finds_accuracies():
    """Three labellers with known accuracies; one of them is no better than chance."""
    rng = random.Random(1)
    counts = {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        vote = lambda right: "+" if (rng.random() < right) == good else "-"
        p = vote(0.95) + vote(0.9) + vote(0.85) + vote(0.5) + "0" * (len(quality.LABELLERS) - 4)
        counts[p] = counts.get(p, 0) + 1
    got = list(quality.LabelModel(counts, trust=0).accuracies().values())
    assert [abs(g - w) < 0.05 for g, w in zip(got, (0.95, 0.9, 0.85, 0.5))] == [True] * 4


def test_shape_of_results(docs, rows, empty, nullish):
    out = quality.grade(docs).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["posterior"] is not None for r in out)
    assert quality.grade(empty).count() == 0 and quality.grade(nullish).count() == 3
    assert quality.drop_junk(docs).columns == docs.columns


def test_edits_do_not_matter():
    rng = random.Random(3)
    text = prose(rng, 60)
    a, b = (quality.describe(t.encode())[0] for t in (text, edited(rng, text, 0.1)))
    assert a["n"] == b["n"] and abs(a["short"] - b["short"]) < 0.1
