"""Quality by weak labels: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, numbered, passing, stage, utf8, without

#: Hashed feature dimensions.
DIMENSIONS = 1 << 13
#: Documents that the scorer is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 20_000
CACHE = 150_000

SYMBOLS = b"#$%&*@|~^<>{}[]\\=+_"
#: A-Z become X, a-z and non-ASCII bytes x, digits 9; the rest stays.
SHAPE = bytes(120 if b > 127 or 97 <= b < 123 else 88 if 65 <= b < 91 else 57 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_words: dict[bytes, tuple] = {}


def _word(w: bytes) -> tuple[int, int, int, int, int, int, bytes]:
    """letters, capitals, symbols, exclamation marks, is short, ends a sentence, shape."""
    s = w.translate(SHAPE)
    caps = s.count(b"X")
    return caps + s.count(b"x"), caps, len(w) - len(w.translate(None, SYMBOLS)), w.count(b"!"), len(w) <= 3, w[-1:] in b".?", _RUN.sub(rb"\1", s)[:12]


def describe(text: bytes) -> tuple[dict[str, float], Counter]:
    """The text's measurements, and its word shapes with their counts."""
    words = text.split()
    counts, n = Counter(words), len(words)
    if len(_words) > CACHE:
        _words.clear()
    letters = caps = symbols = bangs = short = ends = 0
    shapes: Counter = Counter()
    for w, c in counts.items():
        x = _words.get(w)
        if x is None:
            x = _words[w] = _word(w)
        letters += c * x[0]
        caps += c * x[1]
        symbols += c * x[2]
        bangs += c * x[3]
        short += c * x[4]
        ends += c * x[5]
        shapes[x[6]] += c
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(n, 1)
    return {
        "n": n, "caps": caps / max(letters, 1), "symbols": symbols / m, "bangs": bangs / m, "short": short / m, "ends": ends / m,
        "letters": letters / m, "top": max(counts.values(), default=0) / m, "distinct": len(counts) / m,
        "stutter": sum(map(eq, words, words[1:])) / m, "cells": counts[b"|"] / m,
        "lines": len(lines), "repeated": 1 - len(set(lines)) / max(len(lines), 1), "other": 1 - letters / max(sum(map(len, words)), 1) if n else 1.0,
    }, shapes


def _bands(junk_from: float, good_to: float, x: float) -> int:
    return -1 if x >= junk_from else 1 if x <= good_to else 0


#: Heuristic labellers: 1 good, -1 junk, 0 no opinion. They overlap on purpose; EM weighs them.
LABELLERS = {
    "empty": lambda f: -1 if f["n"] == 0 else 0,
    "symbols": lambda f: _bands(0.15, 0.03, f["symbols"]) if f["n"] else 0,
    "capitals": lambda f: _bands(0.5, 0.15, f["caps"]) if f["n"] >= 3 else 0,
    "shouting": lambda f: _bands(0.2, 0.02, f["bangs"]) if f["n"] >= 3 else 0,
    "top word": lambda f: _bands(0.35, 0.15, f["top"]) if f["n"] >= 20 else 0,
    "variety": lambda f: (-1 if f["distinct"] < 0.1 else 1 if f["distinct"] > 0.3 else 0) if 20 <= f["n"] <= 5000 else 0,
    "short words": lambda f: 1 if f["n"] >= 20 and 0.2 <= f["short"] <= 0.75 else 0,
    "sentences": lambda f: 1 if f["n"] >= 50 and 0.02 <= f["ends"] <= 0.3 else 0,
    "repeated lines": lambda f: _bands(0.4, 0.1, f["repeated"]) if f["lines"] >= 4 else 0,
    "stutter": lambda f: _bands(0.2, 0.05, f["stutter"]) if f["n"] >= 10 else 0,
    "cells": lambda f: _bands(0.15, 0.02, f["cells"]) if f["n"] >= 10 else 0,
    "not letters": lambda f: _bands(0.3, 0.1, f["other"]) if f["n"] >= 3 else 0,
}


def features(f: dict[str, float], shapes: Counter) -> tuple[list[int], list[float]]:
    """Hashed features: square roots of the word shapes' shares, and one-hot bands of the measurements."""
    out: dict[int, float] = {}
    n = max(f["n"], 1)
    for s, c in shapes.items():
        k = zlib.crc32(s) % DIMENSIONS
        out[k] = out.get(k, 0.0) + (c / n) ** 0.5
    long_ = f["n"] >= 20
    for name in ("caps", "symbols", "bangs", "short", "ends", "top", "distinct", "stutter", "cells", "repeated", "other"):
        k = zlib.crc32(f"{name}:{min(9, int(f[name] * 10))}:{long_}".encode()) % DIMENSIONS
        out[k] = out.get(k, 0.0) + 1.0
    k = zlib.crc32(f"n:{int(f['n']).bit_length()}".encode()) % DIMENSIONS
    out[k] = out.get(k, 0.0) + 0.3
    return list(out), list(out.values())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, votes, idx, val = [], [], [], []
        for text in batch.column(1).to_pylist():
            f, shapes = describe(text)
            n.append(f["n"])
            votes.append("".join("-0+"[g(f) + 1] for g in LABELLERS.values()))
            i, v = features(f, shapes)
            idx.append(i)
            val.append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(votes, pa.string()), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32())), *batch.columns[2:]],
            names=["doc_id", "n_words", "votes", "idx", "val", *batch.schema.names[2:]],
        )


class LabelModel:
    """Class-conditional label model: labellers vote independently given the hidden class (Dawid & Skene, 1979).
    No opinion counts as a missing vote, so a short text is not judged by what could not be measured on it.

    Works on counts of vote patterns, of which there are at most 3 ** labellers whatever the number of documents,
    so it sees all of them.

    Votes for junk are made to be precise. That is a Beta prior on each labeller's rate of junk votes among good
    documents, worth `trust` times those documents without a junk vote: without it, a kind of junk that is rare and
    that a single labeller knows would pass for an error of that labeller.
    """

    def __init__(self, counts: dict[str, int], rounds: int = 200, trust: float = 50.0):
        self.patterns = sorted(counts)
        votes = np.array([["-0+".index(c) for c in p] for p in self.patterns], dtype=np.int64).reshape(len(self.patterns), len(LABELLERS))
        w = np.array([counts[p] for p in self.patterns], dtype=np.float64)
        good = np.array([0.95, 0.4, 0.1])[np.minimum((votes == 0).sum(axis=1), 2)]  # to begin with: few votes for junk mean good
        self.prior, self.rates = 0.5, None
        for _ in range(rounds if len(w) else 0):
            post = np.stack([1 - good, good])
            mass = post * w
            self.prior = float((mass[1].sum() + 1) / (w.sum() + 2))
            rates = np.stack([[(mass * (votes[:, j] == v)).sum(axis=1) + 0.5 for v in (0, 2)] for j in range(votes.shape[1])])
            rates[:, 1, 1] += trust * mass[1].sum()
            rates = rates / rates.sum(axis=1, keepdims=True)
            self.rates = np.stack([rates[:, 0], np.ones_like(rates[:, 0]), rates[:, 1]], axis=1)  # [labeller, vote, class]
            logs = np.log([1 - self.prior, self.prior])[:, None] + sum(np.log(self.rates[j, votes[:, j], :].T) for j in range(votes.shape[1]))
            before, good = good, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            if np.abs(good - before).max() < 1e-9:
                break
        self.posterior = dict(zip(self.patterns, good.tolist()))

    def accuracies(self) -> dict[str, float]:
        """Of each labeller, the estimated share of its votes that agree with the hidden class."""
        out = {}
        for j, name in enumerate(LABELLERS):
            r = self.rates[j]
            right = (1 - self.prior) * r[0, 0] + self.prior * r[2, 1]
            out[name] = float(right / (right + (1 - self.prior) * r[2, 0] + self.prior * r[0, 1]))
        return out


def fit_scorer(idx: list, val: list, target: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic weights (the last is the bias) on soft targets, by full-batch Adam."""
    w = np.zeros(DIMENSIONS + 1)
    if not len(idx):
        return w
    sizes = np.array([len(i) for i in idx])
    row, col, x = np.repeat(np.arange(len(idx)), sizes), np.concatenate(idx).astype(np.int64), np.concatenate(val).astype(np.float64)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, x * w[col], len(idx)) + w[-1]
        d = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
        g = np.append(np.bincount(col, x * d[row], DIMENSIONS), d.sum()) / len(idx) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _scored(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            lists, vals = batch.column(3), batch.column(4)
            sizes = np.diff(lists.offsets.to_numpy())
            col, x = lists.flatten().to_numpy(), vals.flatten().to_numpy()
            z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), x * w[col], len(sizes)) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50)))), *batch.columns[5:]], names=["doc_id", "n_words", "votes", "score", *batch.schema.names[5:]])

    return run


def grade(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, n_words, votes, posterior, score, kept.

    Twelve heuristic labellers vote on every document; vote patterns are counted over all documents and
    expectation-maximisation estimates how accurate each labeller is, without any given labels. posterior is the
    resulting probability that the document is good. A hashed linear scorer is fitted on the posteriors of at most
    SAMPLE documents and scores all; kept is score >= threshold.

    Null or empty text, or white space only: never kept, score 0. Repeated rows give repeated rows. Empty table: no
    rows. Only doc_id and text are read; the numbers of numbered() rows are handed on.
    """
    spark = docs.sparkSession
    number = [ROW] if ROW in docs.columns else []
    more = "".join(f", {c} long" for c in number)
    seen = docs.select("doc_id", utf8().alias("text"), *number).mapInArrow(_measured, f"doc_id long, n_words long, votes string, idx array<int>, val array<float>{more}")
    seen = stage(seen, "features")
    counts = {r["votes"]: r["c"] for r in seen.groupBy("votes").agg(F.count(F.lit(1)).alias("c")).collect()}
    model = LabelModel(counts)
    # Twice the wanted share of hashes first: a limit alone would send SAMPLE rows of every partition to the driver.
    share = min(1.0, 2 * SAMPLE / max(sum(counts.values()), 1))
    few = seen.where("n_words > 0").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = few.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "votes").limit(SAMPLE).select("votes", "idx", "val").toPandas()
    weights = fit_scorer(list(sample["idx"]), list(sample["val"]), np.array([model.posterior[v] for v in sample["votes"]]))
    scored = seen.mapInArrow(_scored(spark.sparkContext.broadcast(weights)), f"doc_id long, n_words long, votes string, score double{more}")
    posterior = spark.createDataFrame(list(model.posterior.items()) or [("", 0.0)], "votes string, posterior double")
    score = F.when(F.col("n_words") == 0, 0.0).otherwise(F.col("score"))
    out = scored.join(F.broadcast(posterior), "votes", "left").withColumn("score", score)  # at most 3 ** labellers rows
    return out.select("doc_id", "n_words", "votes", "posterior", "score", (F.col("score") >= threshold).alias("kept"), *number)


def drop_junk(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the documents that the scorer rejects, all columns as they were."""
    rows = numbered(docs)
    with passing(docs.sparkSession):
        return without(rows, grade(rows, threshold).where("NOT kept"))
