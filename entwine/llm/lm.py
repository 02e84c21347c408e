"""Language-model scores: a log-bilinear model over tokens, trained by noise-contrastive estimation in numpy."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, utf8

#: The end token's key; no word can hold a line feed.
END = b"\n"
#: Context classes: END and the most frequent words have one each, all other words share one by their last two bytes.
SINGLES, ENDINGS = 128, 128
CONTEXTS = SINGLES + ENDINGS
#: Words that every Python worker holds with their counts, at most; rarer ones meet their counts in a join.
HELD = 200_000
#: Words with vectors of their own: the square root of the training tokens, and at least so many (at most HELD).
LEAST_TARGETS = 4096
#: Counts of a task are handed on once it holds as many different words.
FLUSH = 300_000
#: Bytes of text, and then positions, that a task works on at once.
SLICE, CHUNK = 400_000, 16_384
WIDTH, NOISE, BATCH, RATE = 32, 64, 2048, 0.1
#: Rounds of training by thousandths of the documents; after each the tasks' parameters are averaged.
ROUNDS = ((0, 60), (60, 300), (300, 1000))
#: Positions trained on at least; a smaller corpus is gone through several times.
LEAST_POSITIONS = 1 << 20
#: Targets in one row of parameters that travels.
BLOCK = 8192


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased words by the white-space rule, then the end token."""
    return [*text.lower().split(), END]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            if len(counts) > FLUSH:
                yield out()
    yield out()


class Words:
    """Numbers of words: a held word's rank (END is 0), or the number of held words plus the class of its ending.
    By number: context class, target of the model, log10(count + 1), and whether it was seen in training."""

    def __init__(self, shared: dict):
        words, v = shared["words"].to_pylist(), shared["targets"]
        self.known, self.endings = {w: i for i, w in enumerate(words)}, shared["endings"]
        self.n, self.v, at, rest = len(words), v, np.arange(len(words)), np.arange(ENDINGS)
        tail = np.array([self.tail(w) for w in words], dtype=np.int64)
        self.context = np.concatenate([np.where(at < SINGLES, at, SINGLES + tail), SINGLES + rest])
        self.target = np.concatenate([np.where(at < v, at, v + tail), v + rest])
        self.log_count = np.concatenate([np.log10(shared["counts"] + 1.0), np.zeros(ENDINGS)])
        self.seen = np.concatenate([shared["counts"] > 0, np.zeros(ENDINGS, dtype=bool)])

    def tail(self, word: bytes) -> int:
        return self.endings.get(word[-2:], ENDINGS - 1)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Numbers of all tokens, the documents' starts and the end, and the tokens."""
        flat, starts = [], [0]
        for text in texts:
            flat += text.lower().split()
            flat.append(END)
            starts.append(len(flat))
        ids = np.fromiter(map(self.known.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        for k in np.flatnonzero(ids < 0).tolist():
            ids[k] = self.n + self.tail(flat[k])
        return ids, np.array(starts), flat

    def positions(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token the classes two before and one before (END stands before a document) and its target."""
        c, first = self.context[ids], starts[:-1]
        one, two = np.zeros(len(c), dtype=np.int64), np.zeros(len(c), dtype=np.int64)
        one[1:], two[2:] = c[:-1], c[:-2]
        one[first] = two[first] = 0
        two[(first + 1)[first + 1 < starts[1:]]] = 0
        return two, one, self.target[ids]


_held: dict[str, Words] = {}


def _words(shared: dict) -> Words:
    """The worker's table; one is remembered."""
    if shared["key"] not in _held:
        _held.clear()
        _held[shared["key"]] = Words(shared)
    return _held[shared["key"]]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts) in runs of about SLICE bytes."""
    texts, size, at = [], 0, 0
    for k, text in enumerate(column.to_pylist()):
        texts.append(text)
        size += len(text)
        if size >= SLICE:
            yield at, texts
            texts, size, at = [], 0, k + 1
    if texts:
        yield at, texts


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct entries of index, and the sums of their values."""
    order = np.argsort(index, kind="stable")
    s = index[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.add.reduceat(values[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(unigram: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters that score as the unigram does: target vectors are 0, biases its logarithms. g_*: sums of squared gradients."""
    rng, m = np.random.default_rng(seed), len(unigram)
    par = {"Q": np.zeros((m, WIDTH)), "b": np.log(unigram), "R": rng.normal(0, 0.3, (CONTEXTS, WIDTH)), "C1": np.eye(WIDTH), "C2": 0.5 * np.eye(WIDTH)}
    par |= {"g_Q": np.zeros(m), "g_b": np.zeros(m), "g_R": np.zeros(CONTEXTS), "g_C1": np.zeros((WIDTH, WIDTH)), "g_C2": np.zeros((WIDTH, WIDTH))}
    return {k: v.astype(np.float32) for k, v in par.items()}


class Trainer:
    """Noise-contrastive estimation (Mnih & Teh, 2012) of a log-bilinear model (Mnih & Hinton, 2007).

    A context's vector is R[two before] C2 + R[one before] C1, a target's score its product with Q[target] plus a
    bias. Each token is told from NOISE targets that a batch draws from the unigram. Steps by AdaGrad, with one rate
    for each vector.
    """

    def __init__(self, par: dict[str, np.ndarray], unigram: np.ndarray, seed: int):
        self.par, self.rng = {k: v.copy() for k, v in par.items()}, np.random.default_rng(seed)
        self.shift, self.upto = np.log(NOISE * unigram).astype(np.float32), np.cumsum(unigram)
        self.weight, self.n = np.zeros(len(unigram), dtype=np.float32), 0

    def feed(self, two: np.ndarray, one: np.ndarray, target: np.ndarray) -> None:
        order = self.rng.permutation(len(target))
        for lo in range(0, len(order), BATCH):
            at = order[lo : lo + BATCH]
            self._step(two[at], one[at], target[at])

    def _step(self, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> None:
        p = self.par
        v = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE), side="right"), len(self.upto) - 1)
        ri, rj, qw, qv = p["R"][i], p["R"][j], p["Q"][w], p["Q"][v]
        h = ri @ p["C2"] + rj @ p["C1"]
        dw = _sigmoid(np.einsum("ij,ij->i", h, qw) + p["b"][w] - self.shift[w]) - 1
        dv = _sigmoid(h @ qv.T + (p["b"][v] - self.shift[v]))
        gh = dw[:, None] * qw + dv @ qv
        self._rows("Q", *_sums(np.concatenate([w, v]), np.concatenate([dw[:, None] * h, dv.T @ h])))
        self._rows("b", *_sums(np.concatenate([w, v]), np.concatenate([dw, dv.sum(axis=0)])))
        self._rows("R", *_sums(np.concatenate([i, j]), np.concatenate([gh @ p["C2"].T, gh @ p["C1"].T])))
        for name, g in (("C1", rj.T @ gh), ("C2", ri.T @ gh)):
            p[f"g_{name}"] += g * g
            p[name] -= 0.1 * RATE * g / np.sqrt(p[f"g_{name}"] + 1e-6)
        self.weight += np.bincount(w, minlength=len(self.weight))
        self.n += len(w)

    def _rows(self, name: str, rows: np.ndarray, g: np.ndarray) -> None:
        sums, values = self.par[f"g_{name}"], self.par[name]
        sums[rows] += (g * g).mean(axis=1) if g.ndim > 1 else g * g
        rate = RATE / np.sqrt(sums[rows] + 1e-6)
        values[rows] -= (rate[:, None] if g.ndim > 1 else rate) * g


_DENSE = ("R", "g_R", "C1", "g_C1", "C2", "g_C2")


def _pack(par: dict[str, np.ndarray], weight: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows (block, weights, values): block 0 the dense parameters, the others BLOCK targets each."""
    table = np.column_stack([par["Q"], par["b"], par["g_Q"], par["g_b"]]).astype("<f4")
    blocks, weights, data = [0], [np.array([n], dtype="<f4").tobytes()], [np.concatenate([par[k].ravel() for k in _DENSE]).astype("<f4").tobytes()]
    for lo in range(0, len(table), BLOCK):
        own = weight[lo : lo + BLOCK].astype("<f4")
        if own.any():
            blocks.append(1 + lo // BLOCK)
            weights.append(own.tobytes())
            data.append(table[lo : lo + BLOCK].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(weights, pa.binary()), pa.array(data, pa.binary())], names=["block", "weights", "values"])


def _unpack(par: dict[str, np.ndarray], rows: pa.Table) -> dict[str, np.ndarray]:
    """par with the averages in rows; a target that no task was given stays."""
    out = {k: v.copy() for k, v in par.items()}
    for block, weights, values in zip(*(c.to_pylist() for c in rows.columns)):
        w, x = np.frombuffer(weights, dtype="<f4"), np.frombuffer(values, dtype="<f4")
        if block == 0:
            for k in _DENSE:
                out[k], x = x[: out[k].size].reshape(out[k].shape).copy(), x[out[k].size :]
            continue
        at = (block - 1) * BLOCK + np.flatnonzero(w)
        x = x.reshape(len(w), WIDTH + 3)[w > 0]
        out["Q"][at], out["b"][at], out["g_Q"][at], out["g_b"][at] = x[:, :WIDTH], x[:, WIDTH], x[:, WIDTH + 1], x[:, WIDTH + 2]
    return out


def _trained(shared, par, epochs: int, seed: int):
    """A task's parameters after its documents, and how often it met each target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared.value)
        trainer, few = Trainer(par.value, shared.value["unigram"], seed + TaskContext.get().partitionId()), []
        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                at = words.positions(*words.numbers(texts)[:2])
                if epochs == 1:
                    trainer.feed(*at)
                else:  # of a corpus below LEAST_POSITIONS
                    few.append(at)
        for _ in range(epochs if few else 0):
            trainer.feed(*(np.concatenate(x) for x in zip(*few)))
        if trainer.n:
            yield _pack(trainer.par, trainer.weight, trainer.n)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block the weighted mean over tasks, added up row by row as they come."""
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, weights, values in zip(*(c.to_pylist() for c in batch.columns)):
            w = np.frombuffer(weights, dtype="<f4").astype(np.float64)
            x = np.frombuffer(values, dtype="<f4").reshape(len(w), -1) * w[:, None]
            sums[block] = (sums[block][0] + w, sums[block][1] + x) if block in sums else (w, x)
    blocks = sorted(sums)
    weights = [sums[b][0].astype("<f4").tobytes() for b in blocks]
    values = [(sums[b][1] / np.maximum(sums[b][0], 1e-9)[:, None]).astype("<f4").tobytes() for b in blocks]
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(weights, pa.binary()), pa.array(values, pa.binary())], names=["block", "weights", "values"])


def log_sums(par: dict[str, np.ndarray], two: int) -> np.ndarray:
    """Of each context with class `two` two before: the logarithm of the sum of exp(score) over all targets."""
    h = (par["R"][two] @ par["C2"] + par["R"] @ par["C1"]).astype(np.float32)
    top, total = np.full(CONTEXTS, -np.inf), np.zeros(CONTEXTS)
    for lo in range(0, len(par["b"]), BLOCK):
        s = h @ par["Q"][lo : lo + BLOCK].T + par["b"][lo : lo + BLOCK]
        now = np.maximum(top, s.max(axis=1))
        total = total * np.exp(top - now) + np.exp(s - now[:, None].astype(np.float32)).sum(axis=1, dtype=np.float64)
        top = now
    return top + np.log(total)


def _normalised(par):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = batch.column(0).to_pylist()
            if two:
                yield pa.RecordBatch.from_arrays([pa.array(two, pa.int64()), pa.array([log_sums(par.value, i) for i in two], pa.list_(pa.float64()))], names=["two", "sums"])

    return run


@dataclass
class Model:
    """What fit() learns. shared: held words with counts, endings and their masses; counts: all words, staged."""

    n: int
    v: int
    shared: dict
    par: dict[str, np.ndarray]
    log_z: np.ndarray
    counts: DataFrame
    rare: Column


def _remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7


def _shared(counts: DataFrame, n: int) -> tuple[dict, Column]:
    """The held words and what is known of all others by ending; and the test for words that are not held."""
    steps = counts.groupBy(F.floor(F.log(F.col("c").cast("double")) * 64).alias("step")).agg(F.count(F.lit(1)).alias("words"), F.min("c").alias("least")).collect()
    bound, words = 1, 0
    for s in sorted(steps, key=lambda s: -s["step"]):
        if words + s["words"] > HELD:
            break
        bound, words = s["least"], words + s["words"]
    enough = F.col("c") >= bound if words else F.lit(False)
    held = counts.where(enough & (F.col("word") != F.lit(END))).select(F.col("word"), F.col("c")).toArrow()  # at most HELD rows
    held = held.take(pc.sort_indices(held, sort_keys=[("c", "descending"), ("word", "ascending")]))
    end = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    names = pa.concat_arrays([pa.array([END], pa.binary()), held["word"].combine_chunks().cast(pa.binary())])
    c = np.concatenate([[end], held["c"].to_numpy()]).astype(np.int64)
    targets = min(len(c), max(LEAST_TARGETS, math.isqrt(n)))
    ending = F.when(F.length("word") > 2, F.expr("substring(word, -2)")).otherwise(F.col("word"))
    masses = counts.groupBy(ending.alias("e")).agg(F.sum(F.col("c") + 1).alias("m")).toArrow()  # at most 65,793 endings
    by_ending = dict(zip(masses["e"].to_pylist(), masses["m"].to_pylist()))
    for w, k in zip(names[:targets].to_pylist(), c.tolist()):
        if w[-2:] in by_ending:
            by_ending[w[-2:]] -= k + 1
    endings = {e: i for i, (e, _) in enumerate(sorted(by_ending.items(), key=lambda x: (-x[1], x[0]))[: ENDINGS - 1])}
    mass = np.zeros(ENDINGS)
    for e, m in by_ending.items():
        mass[endings.get(e, ENDINGS - 1)] += m
    unigram = np.concatenate([c[:targets] + 1.0, mass + 1])
    shared = {"key": uuid.uuid4().hex, "words": names, "counts": c, "targets": targets, "endings": endings, "log_mass": np.log10(mass + 1), "unigram": unigram / unigram.sum()}
    return shared, ~enough


def fit(docs: DataFrame) -> Model:
    """Learn counts and model from the documents whose remainder is not 2."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    learnt = docs.select("doc_id", utf8().alias("text")).where(_remainder() != 2)
    counts = stage(learnt.select("text").mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    shared, rare = _shared(counts, n)
    par = initial(shared["unigram"])
    epochs, held = max(1, math.ceil(LEAST_POSITIONS / max(n, 1))), sc.broadcast(shared)
    for k, (low, high) in enumerate(ROUNDS if n else ()):
        own = learnt.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1000)).between(low, high - 1)).select("text")
        sent = sc.broadcast(par)
        found = own.mapInArrow(_trained(held, sent, epochs, 1000 * k), "block int, weights binary, values binary")
        par = _unpack(par, found.repartition("block").mapInArrow(_averaged, "block int, weights binary, values binary").toArrow())
        sent.destroy()
    sent = sc.broadcast(par)
    sums = spark.range(0, CONTEXTS, 1, min(CONTEXTS, 2 * sc.defaultParallelism)).mapInArrow(_normalised(sent), "two long, sums array<double>").toArrow()
    sent.destroy()
    held.destroy()
    log_z = np.zeros((CONTEXTS, CONTEXTS))
    for two, s in zip(sums["two"].to_pylist(), sums["sums"].to_pylist()):
        log_z[two] = s
    return Model(n, v, shared, par, log_z, counts, rare)


def _scored(shared, model):
    """Of each document all that does not need a rare word's count, and its rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, par, mass = _words(shared.value), model.value, shared.value["log_mass"]
        far, near, log_z, row = par["R"] @ par["C2"], par["R"] @ par["C1"], par["log_z"].ravel(), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for at, texts in _slices(batch.column(1)):
                ids, starts, flat = words.numbers(texts)
                two, one, target = words.positions(ids, starts)
                p = np.empty(len(ids))
                for lo in range(0, len(ids), CHUNK):
                    i, j, t = (x[lo : lo + CHUNK] for x in (two, one, target))
                    p[lo : lo + CHUNK] = np.einsum("ij,ij->i", far[i] + near[j], par["Q"][t]) + par["b"][t] - log_z[i * CONTEXTS + j]
                p /= np.log(10)
                logs, inside = words.log_count[ids], target >= words.v
                p[inside] += logs[inside] - mass[target[inside] - words.v]
                first, unknown = starts[:-1], np.flatnonzero(ids >= words.n)
                rare: list[Counter] = [Counter() for _ in texts]
                for k, doc in zip(unknown.tolist(), (np.searchsorted(starts, unknown, side="right") - 1).tolist()):
                    rare[doc][flat[k]] += 1
                cols = [
                    pa.array(np.arange(row, row + len(texts))), pa.array(ids_of[at : at + len(texts)], pa.int64()), pa.array(np.diff(starts)),
                    pa.array(np.add.reduceat(words.seen[ids].astype(np.int64), first)), pa.array(np.add.reduceat(logs, first)), pa.array(np.add.reduceat(p, first)),
                    pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.int64())),
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_tokens", "n_held", "logs", "model", "rare", "times"])

    return run


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of docs under a model; see score()."""
    spark: SparkSession = docs.sparkSession
    held, sent = spark.sparkContext.broadcast(model.shared), spark.sparkContext.broadcast({k: v for k, v in model.par.items() if not k.startswith("g_")} | {"log_z": model.log_z})
    schema = "row long, doc_id long, n_tokens long, n_held long, logs double, model double, rare array<binary>, times array<long>"
    part = stage(docs.select("doc_id", utf8().alias("text")).mapInArrow(_scored(held, sent), schema), "scored")
    held.destroy()
    sent.destroy()
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    known = rare.join(model.counts.where(model.rare), "word")
    known = known.groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c").cast("double") + 1)).alias("rare_logs"))
    out = part.drop("rare", "times").join(known, "row", "left").na.fill(0, ["n_rare", "rare_logs"])
    return out.select(
        "doc_id", (_remainder() == 2).alias("held_out"), "n_tokens", (F.col("n_held") + F.col("n_rare")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * float(np.log10(model.n + model.v + 1))).alias("base_score"), (F.col("model") + F.col("rare_logs")).alias("score"),
    )


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents with crc32(doc_id as text) mod 7 = 2 are held out; all others are learnt from, whole. Word counts are a
    distributed aggregation. The model is trained in the workers on every token of those documents: each task goes
    through its own (a small corpus several times), and after each of three rounds the tasks' parameters are averaged,
    every target's by how often a task met it. So draws grow with the corpus; vectors grow with the square root of
    its tokens, up to HELD.

    p(token | two tokens before) = p(target | classes of the two) * p(token | target). The first factor is the
    model's, over all targets, normalised exactly (one batched matrix product for all CONTEXTS ** 2 contexts). Frequent
    words are targets of their own, with a second factor of 1; the others share a target with those of like endings
    and have (c + 1) / (sum of c + 1 over its training words, + 1), the last 1 being its share for unseen words. Sums
    to 1 over the training vocabulary and one unseen word per ending class. base_score is the add-one unigram. Both
    are log10 sums over the document's tokens, the end token included.

    Words with counts below a bound found from the count histogram (so that HELD words or fewer lie above) are joined
    with their counts by the cluster; the others are held by each worker. Null or empty text: the end token alone.
    Null doc_id counts as an empty text for the remainder. Repeated rows are scored as often and learnt from as
    often. Without training documents train_tokens is 0 and both scores follow from empty counts. Empty table: no
    rows. Only doc_id and text are read. Which documents share a task decides scores in their last digits.
    """
    return apply(docs, fit(docs))
