import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from entwine.llm import lm
from tests.llm.conftest import SCHEMA


def brute_base(rows):
    tokens = [[*(r[1] or "").encode().lower().split(), b"\n"] for r in rows]
    out = [zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    counts = Counter(w for held, t in zip(out, tokens) if not held for w in t)
    n, v = sum(counts.values()), len(counts)
    return sorted((r[0], held, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for r, held, t in zip(rows, out, tokens))


@pytest.fixture(autouse=True)
def short(monkeypatch):
    monkeypatch.setattr(lm, "LEAST_POSITIONS", 1 << 16)


@pytest.mark.parametrize("held", [200_000, 30, 0])
def test_counts_and_base_against_brute_force(docs, rows, monkeypatch, held):
    """Also where most words meet their counts in the join."""
    monkeypatch.setattr(lm, "HELD", held)
    got = lm.score(docs).collect()
    assert sorted((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == brute_base(rows)
    assert all(r["score"] < 0 for r in got)


def brute_scores(model, rows):
    """Each token by itself: its context's vector, all targets' scores, its target's share, its share of the target."""
    counts = Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in lm.tokens((r[1] or "").encode()))
    held, p = model.shared["words"].to_pylist(), {k: v.astype(np.float64) for k, v in model.par.items()}
    targets, ending = held[: model.shared["targets"]], lambda w: model.shared["endings"].get(w[-2:], lm.ENDINGS - 1)
    mass = Counter()
    for w, c in counts.items():
        if w not in targets:
            mass[ending(w)] += c + 1
    context = lambda w: held.index(w) if w in held[: lm.SINGLES] else lm.SINGLES + ending(w)
    out = {}
    for doc_id, text, *_ in rows:
        total, before = 0.0, [0, 0]
        for w in lm.tokens((text or "").encode()):
            scores = (p["R"][before[0]] @ p["C2"] + p["R"][before[1]] @ p["C1"]) @ p["Q"].T + p["b"]
            t = targets.index(w) if w in targets else len(targets) + ending(w)
            total += (scores[t] - np.log(np.exp(scores).sum())) / math.log(10)
            if w not in targets:
                total += math.log10((counts[w] + 1) / (mass[ending(w)] + 1))
            before = [before[1], context(w)]
        out[doc_id, text] = total
    return out


@pytest.mark.parametrize(("held", "least"), [(200_000, 4096), (60, 20)])
def test_scores_against_brute_force(spark, rows, monkeypatch, held, least):
    monkeypatch.setattr(lm, "HELD", held)
    monkeypatch.setattr(lm, "LEAST_TARGETS", least)
    monkeypatch.setattr(lm, "SLICE", 700)
    few = [r for r in rows if len(r[1] or "") < 2000]
    frame = spark.createDataFrame(few, SCHEMA)
    model = lm.fit(frame)
    want = brute_scores(model, few)
    got = lm.apply(frame.select("doc_id", "text"), model).join(frame.distinct(), "doc_id").collect()
    assert len(got) == len(few) and all(abs(r["score"] - want[r["doc_id"], r["text"]]) < 1e-3 * max(1, r["n_tokens"] / 50) for r in got)


def test_probabilities_sum_to_one(spark, rows):
    model = lm.fit(spark.createDataFrame(rows, SCHEMA))
    p = {k: v.astype(np.float64) for k, v in model.par.items()}
    for two, one in ((0, 0), (3, 130), (200, 1)):
        scores = (p["R"][two] @ p["C2"] + p["R"][one] @ p["C1"]) @ p["Q"].T + p["b"]
        assert abs(np.exp(scores - model.log_z[two, one]).sum() - 1) < 1e-4


def test_training_learns_context():
    """Target 1 follows class 0, target 0 follows class 1, whatever stands two before."""
    rng = np.random.default_rng(1)
    one = rng.integers(0, 2, 60_000)
    trainer = lm.Trainer(lm.initial(np.array([0.5, 0.5])), np.array([0.5, 0.5]), 3)
    trainer.feed(rng.integers(0, 2, 60_000), one, 1 - one)
    p = trainer.par
    for two in (0, 1):
        for c in (0, 1):
            s = (p["R"][two] @ p["C2"] + p["R"][c] @ p["C1"]) @ p["Q"].T + p["b"]
            assert s[1 - c] - s[c] > 2


def test_averages_weigh_by_use():
    """Two tasks' parameters: a target that one of them met alone keeps that one's vector."""
    par = lm.initial(np.full(3, 1 / 3))
    a, b = {k: v.copy() for k, v in par.items()}, {k: v.copy() for k, v in par.items()}
    a["Q"][0], b["Q"][0], a["Q"][1], a["b"][:] = 1, 3, 5, 7
    batches = [lm._pack(a, np.array([1, 2, 0]), 3), lm._pack(b, np.array([3, 0, 0]), 3)]
    out = lm._unpack(par, pa.Table.from_batches(lm._averaged(iter(batches))))
    assert np.allclose(out["Q"][0], 2.5) and np.allclose(out["Q"][1], 5) and np.allclose(out["Q"][2], 0) and np.allclose(out["R"], par["R"])


def test_vectors_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_TARGETS", 10)
    frame = lambda n: spark.createDataFrame([(7 * i, f"w{i} x y z a b c d e", None, None, None) for i in range(n)], SCHEMA)
    assert [lm.fit(frame(n)).shared["targets"] for n in (20, 400)] == [math.isqrt(10 * learnt) for learnt in (sum(zlib.crc32(str(7 * i).encode()) % 7 != 2 for i in range(n)) for n in (20, 400))]


def test_held_out_gain(spark):
    """Two languages: context tells which, so the model beats the unigram on documents it has not seen."""
    import random

    rng = random.Random(2)
    words = [[f"{p}{i}{p}" for i in range(30)] for p in ("a", "z")]
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(80)), None, None, None) for i in range(200)]
    got = lm.score(spark.createDataFrame(rows, SCHEMA)).where("held_out").collect()
    assert len(got) > 10 and sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


def test_empty_and_null(empty, nullish):
    assert lm.score(empty).count() == 0
    got = lm.score(nullish).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 1), ("None", 1), ("None", 3)]
