"""Retrievers, pool, evaluation, sampling and files."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entwine.config import BlockingConfig
from entwine.operators import evaluation, retrieval, sampling
from entwine.plans import normalize, pool
from entwine.sources import files, records
from entwine.streaming.records import clean_stream

CONFIG = BlockingConfig(upper_threshold=40, lower_threshold=2, top_k=3)


@pytest.fixture(scope="module")
def small(spark):
    first, second, third, truth = records.synthetic(spark, 60, 120, 130, seed=3)
    rows = normalize.normalize(normalize.union_sources(first, second, third), CONFIG).cache()
    yield rows, truth
    rows.unpersist()


def brute_bm25(rows, column, k, jobs):
    docs = {}
    for r in rows.where("country IS NOT NULL").collect():
        words = [w for w in _words(r[column]) if w not in CONFIG.stopwords]
        docs.setdefault((r["country"].lower(), r["source"]), {})[r["entity_id"]] = Counter(words)
    out = {}
    for (country, source), targets in docs.items():
        n, avg = len(targets), sum(sum(c.values()) for c in targets.values()) / len(targets)
        df = Counter(w for c in targets.values() for w in c)
        for q, t in jobs:
            if t != source:
                continue
            for a, query in docs.get((country, q), {}).items():
                scores = []
                for b, c in targets.items():
                    s = 0
                    for w, times in query.items():
                        if w in c:
                            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                            s += times * round(1e6 * idf * (c[w] / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg))))
                    if s > 0:
                        scores.append((-s, b))
                for s, b in sorted(scores)[:k]:
                    out[a, b] = -s / 1e6
    return out


def _words(text):
    import re

    return re.findall(r"[a-z0-9_]{2,}", (text or "").lower())


@pytest.mark.parametrize("column", ["search_document", "phonetic_hash"])
def test_bm25_against_brute_force(small, column):
    rows, _ = small
    got = {(r[0], r[1]): r[2] for r in retrieval.bm25_top_k(rows, column, "s", CONFIG).collect()}
    want = brute_bm25(rows, column, 3, CONFIG.jobs)
    assert got.keys() == want.keys()
    assert all(abs(got[p] - want[p]) < 1e-5 for p in got)


def test_skipping_jobs_drops_their_pairs_only(small):
    rows, _ = small
    both = {tuple(r) for r in retrieval.bm25_top_k(rows, "search_document", "s", CONFIG).collect()}
    less = {tuple(r) for r in retrieval.bm25_top_k(rows, "search_document", "s", BlockingConfig(top_k=3, include_s2_s3=False)).collect()}
    assert less == {p for p in both if p[0].startswith("S1-")}


def test_geo_scores_are_cosines_in_one_block(small):
    rows, _ = small
    block = {r["entity_id"]: r["geo_block_key"] for r in rows.collect()}
    got = retrieval.geo_top_k(rows, CONFIG).collect()
    assert got and all(0 < r["geo_ngram_score"] <= 1.00001 and block[r["entity_A"]] == block[r["entity_B"]] for r in got)
    assert not any(block[r["entity_A"]].endswith("_unknown") for r in got)


def brute_grams(document):
    from collections import Counter

    return Counter(f" {w} "[i : i + n] for w in document.lower().split() for n in (2, 3, 4) for i in range(len(w) + 3 - n))


def test_gram_counts_against_brute_force():
    documents = ["alpha beta alpha", "", "a", "  é\tbé  a ", "x" * 50, "日本 語", "beta"]
    row, gram, count, size = retrieval._gram_counts(documents, 2, 4)
    want = [brute_grams(d) for d in documents]
    assert [sorted(count[row == i].tolist()) for i in range(len(documents))] == [sorted(w.values()) for w in want]
    assert size == len({g for w in want for g in w}) and [len(set(gram[row == i])) for i in range(len(documents))] == list(map(len, want))
    assert set(gram[row == 6]) <= set(gram[row == 0]) and not set(gram[row == 4]) & set(gram[row == 0])


def test_geo_against_brute_force(small):
    """Cosines of one block, worked out record by record."""
    import math

    rows, _ = small
    records = [r for r in rows.collect() if not r["geo_block_key"].endswith("_unknown")]
    want = {}
    for q_source, t_source in CONFIG.jobs:
        for block in {r["geo_block_key"] for r in records}:
            queries, targets = ([r for r in records if r["geo_block_key"] == block and r["source"] == s] for s in (q_source, t_source))
            grams = {r["entity_id"]: brute_grams(r["search_document"]) for r in queries + targets}
            df = {g: sum(g in grams[t["entity_id"]] for t in targets) for t in targets for g in grams[t["entity_id"]]}
            idf = {g: math.log((1 + len(targets)) / (1 + n)) + 1 for g, n in df.items()}
            vectors = {i: {g: c * idf[g] for g, c in x.items() if g in idf} for i, x in grams.items()}
            norms = {i: math.sqrt(sum(v * v for v in x.values())) or 1 for i, x in vectors.items()}
            for q in queries:
                a = vectors[q["entity_id"]]
                for t in targets:
                    b = vectors[t["entity_id"]]
                    want[q["entity_id"], t["entity_id"]] = sum(v * b.get(g, 0) for g, v in a.items()) / norms[q["entity_id"]] / norms[t["entity_id"]]
    got = {(r[0], r[1]): r[2] for r in retrieval.geo_top_k(rows, CONFIG).collect()}
    assert got and all(abs(s - want[p]) < 1e-4 for p, s in got.items())
    for (q, t), s in want.items():
        kept = sorted((x for (a, b), x in got.items() if a == q and b[:2] == t[:2]), reverse=True)
        assert (q, t) in got or s < 1e-5 or (len(kept) == CONFIG.top_k and s <= kept[-1] + 1e-4)


def test_size_limits_change_no_pair(spark, monkeypatch):
    """Both geographic branches, and a scan of many blocks and chunks against one of each."""
    names = ["red house bakery", "red house books", "blue house", "green bakery", "blue books bakery", "house"]
    rows = [(f"S{1 + i % 3}-{i}", i % 3, "fr", f"fr_{i % 2}", names[i % 6] + f" {i % 5}") for i in range(36)]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, geo_block_key string, search_document string").cache()
    geo = lambda: sorted(map(tuple, retrieval.geo_top_k(df, CONFIG).collect()))
    text = lambda: sorted(map(tuple, retrieval.bm25_top_k(df, "search_document", "s", CONFIG).collect()))
    whole = geo(), text()
    monkeypatch.setattr(retrieval, "BLOCK_RECORDS", 0)
    monkeypatch.setattr(retrieval, "TARGET_POSTINGS", 9)
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 7)
    monkeypatch.setattr(retrieval, "CELLS", 40)
    monkeypatch.setattr(retrieval, "SUMS", 40)
    assert whole[0] and whole[1] and (geo(), text()) == whole


def test_ids_must_be_unique(spark):
    from entwine.plans.normalize import check_ids

    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "entity_id string")
    assert check_ids(frame(["a", "b"])).count() == 2
    for bad in (["a", "a"], ["a", None]):
        with pytest.raises(ValueError):
            check_ids(frame(bad))


def test_equal_documents_have_cosine_one(spark):
    rows = [("S1-1", 0, "fr", "fr_x", "alpha beta"), ("S2-1", 1, "fr", "fr_x", "alpha beta"), ("S2-2", 1, "fr", "fr_x", "gamma")]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, geo_block_key string, search_document string")
    got = {(r[0], r[1]): r[2] for r in retrieval.geo_top_k(df, CONFIG).collect()}
    assert abs(got["S1-1", "S2-1"] - 1) < 1e-4


def test_at_most_k_and_pool_is_the_union(small):
    rows, _ = small
    parts = [retrieval.bm25_top_k(rows, "search_document", "s", CONFIG), retrieval.bm25_top_k(rows, "phonetic_hash", "s", CONFIG), retrieval.geo_top_k(rows, CONFIG, "s")]
    for p in parts:
        per = p.groupBy("entity_A", F.substring("entity_B", 1, 2).alias("t")).count().agg(F.max("count")).first()[0]
        assert per <= 3
    pairs = {(r[0], r[1]) for p in parts for r in p.collect()}
    got = pool.candidate_pool(rows, CONFIG).collect()
    assert {(r[0], r[1]) for r in got} == pairs and len(got) == len(pairs)
    assert all(None not in tuple(r) for r in got)


def test_word_tfidf_needs_a_common_kept_term(spark):
    rows = [("S1-1", 0, "fr", "rare word"), ("S2-1", 1, "fr", "rare other"), ("S3-1", 2, "fr", "thing else"), ("S2-2", 1, "fr", "thing word")]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, doc string")
    got = {(r[0], r[1]) for r in retrieval.word_tfidf_top_k(df, "doc", "s", CONFIG, max_df=0.8, min_df=2).collect()}
    assert got == {("S1-1", "S2-1"), ("S1-1", "S2-2"), ("S2-2", "S3-1")}


def test_recall_on_synthetic_records(small):
    rows, truth = small
    report = evaluation.recall_report(pool.candidate_pool(rows, CONFIG), evaluation.true_pairs(truth, rows), rows).first()
    assert report["true_pairs"] > 20 and report["recall"] > 0.9 and 0 < report["reduction_ratio"] < 1


def test_evaluation_by_hand(spark):
    truth = spark.createDataFrame([("S1-1", "S2-1, S3-1,,S2-9"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    ids = spark.createDataFrame([("S1-1", 0), ("S1-2", 0), ("S2-1", 1), ("S3-1", 2)], "entity_id string, source int")
    pairs = evaluation.true_pairs(truth, ids)
    assert sorted(map(tuple, pairs.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-1")]
    pool_ = spark.createDataFrame([("S1-1", "S2-1", 20.0, 0.0, 0.0), ("S2-1", "S1-1", 1.0, 2.0, 0.0), ("S1-2", "S3-1", 1.0, 0.0, 0.6)], "entity_A string, entity_B string, bm25_text_score double, bm25_phonetic_score double, geo_ngram_score double")
    report = evaluation.recall_report(pool_, pairs, ids).first().asDict()
    assert (report["candidate_pairs"], report["true_pairs"], report["recall"]) == (2, 2, 0.5)
    assert report["reduction_ratio"] == 1 - 2 / 5 and report["recall_geo_only_signal"] == 0
    assert [tuple(r) for r in evaluation.captured_pairs(pool_, pairs).collect()] == [("S1-1", "S2-1")]
    assert [tuple(r) for r in evaluation.missed_pairs(pool_, pairs).collect()] == [("S1-1", "S3-1")]
    sent = {r[0]: r[1] for r in evaluation.submission(pool_, ids).collect()}
    assert sent == {"S1-1": "S2-1", "S1-2": "S3-1"}
    assert evaluation.submission(pool_.drop("geo_ngram_score"), ids).where("source1_entity_id = 'S1-2'").first()[1] == ""


def test_anchored_sample_keeps_existing_pairs(spark):
    sources = records.synthetic(spark, 80, 100, 100, seed=9)
    sample, truth = sampling.anchored_sample(list(sources[:3]), sources[3], truth_rows=10, noise_rows=15)
    ids = {r[0] for s in sample for r in s.select("entity_id").collect()}
    assert truth.count() == 10
    for r in truth.collect():
        assert r["source1_entity_id"] in ids and set(r["matched_entity_ids"].split(",")) <= ids
    assert all(15 <= s.count() <= 25 for s in sample)


def test_noise_keeps_null_ids(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "entity_id string")
    got = sampling.noise(rows, rows.where("entity_id = 'a'"), 10)
    assert {r[0] for r in got.collect()} == {None, "b"}


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", ' a "b"\n', "x, y", "India"), ("S1-2", None, "NA", "US")], files.SOURCE)
    files.write_tsv(rows, str(tmp_path / "out"), single=True)
    got = {r[0]: tuple(r) for r in files.read_source(spark, str(tmp_path / "out")).collect()}
    assert got == {"S1-1": ("S1-1", ' a "b"\n', "x, y", "India"), "S1-2": ("S1-2", None, None, "US")}


def test_synthetic_is_reproducible(spark):
    a, b = (records.synthetic(spark, 30, 40, 40, seed=5) for _ in range(2))
    assert all(sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str) for x, y in zip(a, b))


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("S1-1", "Acme Pvt. Ltd.", "x, Pune 411001", "India")], files.SOURCE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.SOURCE).parquet(str(tmp_path / "in"))
    q = clean_stream(stream).writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("cleaned").select("clean_name", "base_key").first()) == ("acme ltd", "india_411001")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], files.SOURCE)
    rows = normalize.normalize(normalize.union_sources(empty, empty, empty), CONFIG)
    assert pool.candidate_pool(rows, CONFIG).count() == 0
    truth = spark.createDataFrame([], files.TRUTH)
    report = evaluation.recall_report(pool.candidate_pool(rows, CONFIG), evaluation.true_pairs(truth, rows), rows).first()
    assert report["recall"] is None and report["candidate_pairs"] == 0


def test_command_line(spark, tmp_path, capsys):
    from entwine.__main__ import main
    from entwine.sources import load

    *sources, truth = records.synthetic(spark, 40, 60, 60, seed=11)
    load.save(sources, truth, str(tmp_path / "in"), "train")
    main(["sample", str(tmp_path / "in"), str(tmp_path / "small"), "--truth-rows", "8", "--noise-rows", "10"])
    assert load.exists(spark, str(tmp_path / "small/sample_source1.tsv"))
    main(["pool", str(tmp_path / "small"), str(tmp_path / "out"), "--top-k", "3"])
    assert '"recall"' in capsys.readouterr().out
    submitted = files.read_tsv(spark, str(tmp_path / "out/matching_results.tsv"), files.TRUTH)
    assert submitted.count() == files.read_source(spark, str(tmp_path / "small/sample_source1.tsv")).count()
    main(["sweep", str(tmp_path / "small"), "--thresholds", "2", "5"])
    assert "max_block_size" in capsys.readouterr().out


def test_load_falls_back_to_synthetic(spark, tmp_path):
    from entwine.sources import load

    assert load.load(spark, str(tmp_path / "none"), n1=5, n2=6, n3=7)[2].count() == 7


def test_block_keys_shuffle_no_texts(spark):
    """Rows travel to their keys only where there are too many keys to broadcast."""
    rows = spark.createDataFrame([(f"S1-{i}", f"name {i}", f"area {i % 3}, city, {10000 + i % 4}", "fr", i % 3) for i in range(30)], "entity_id string, business_name string, business_address string, country string, source int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = normalize.normalize(rows, CONFIG)
        assert "Exchange hashpartitioning" not in keyed._jdf.queryExecution().executedPlan().toString()
        assert keyed.count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_records_travel_packed(spark, monkeypatch):
    """Three bytes for a frequent token however often it occurs; the rest comes back as it was, counts past a byte too."""
    import numpy as np
    import pyarrow as pa

    class Held:
        value = ["alpha", "beta"]

    words = [["beta", "alpha", "beta", "rare", "rare"], [], ["alpha"] * 600 + ["x1"]]
    batch = pa.RecordBatch.from_arrays([pa.array(["fr"] * 3), pa.array([1] * 3, pa.int32()), pa.array(["a", "b", "c"]), pa.array(words, pa.list_(pa.string()))], names=["part", "source", "entity", "words"])
    (got,) = retrieval._packed(Held)([batch])
    assert [len(x) for x in got["codes"].to_pylist()] == [4, 0, 6] and [len(x) for x in got["times"].to_pylist()] == [2, 0, 3]
    row, code, times, rare_row, rare = retrieval._Block._read(got)
    counts = Counter()
    for r, c, t in zip(row.tolist(), code.tolist(), times.tolist()):
        counts[r, Held.value[c]] += t
    counts.update(zip(rare_row.tolist(), rare.to_pylist()))
    assert counts == Counter((i, w) for i, x in enumerate(words) for w in x) and np.all(got["dl"].to_numpy() == [5, 0, 601])


@pytest.mark.parametrize("codes", [1, 4])
def test_few_codes_change_no_pair(spark, monkeypatch, codes):
    """Tokens that travel as words score as those that travel as codes, in one block and in several."""
    names = ["red house bakery", "red house books", "blue house", "green bakery", "blue books bakery", "house", "red red red lone"]
    rows = [(f"S{1 + i % 3}-{i}", i % 3, "fr", names[i % 7] + f" n{i % 5} u{i}") for i in range(42)]
    df = spark.createDataFrame(rows, "entity_id string, source int, country string, search_document string").cache()
    both = lambda: [sorted(map(tuple, f(df, "search_document", "s", CONFIG).collect())) for f in (retrieval.bm25_top_k, retrieval.word_tfidf_top_k)]
    whole = both()
    monkeypatch.setattr(retrieval, "CODES", codes)
    monkeypatch.setattr(retrieval, "TARGET_POSTINGS", 30)
    assert all(whole) and both() == whole


def test_gram_slices_change_no_count(monkeypatch):
    documents = ["alpha beta alpha", "", "a", "  é\tbé  a ", "x" * 50, "beta gamma", "beta"]
    monkeypatch.setattr(retrieval, "GRAM_CHARACTERS", 5)
    row, gram, count, size = retrieval._gram_counts(documents, 2, 4)
    want = [brute_grams(d) for d in documents]
    assert [sorted(count[row == i].tolist()) for i in range(len(documents))] == [sorted(w.values()) for w in want]
    assert size == len({g for w in want for g in w}) and set(gram[row == 6]) <= set(gram[row == 0])


def test_bundles_are_smaller_and_hold_the_same():
    """Records of one bucket travel together and compressed, in every role; each group gets each of its records once."""
    import numpy as np
    import pyarrow as pa

    class Held:
        value = [f"w{i}" for i in range(2000)]

    draw = np.random.default_rng(1)
    words = [[f"w{i}" for i in draw.zipf(1.3, 200) % 2000] + [f"rare{i}", "once"] for i in range(300)] + [[]]
    batch = pa.RecordBatch.from_arrays([pa.array(["fr"] * 301), pa.array([1] * 301, pa.int32()), pa.array([f"S2-{i:09d}" for i in range(301)]), pa.array(words, pa.list_(pa.string()))], names=["part", "source", "entity", "words"])
    (packed,) = retrieval._packed(Held)([batch])
    (got,) = retrieval._bundled({("fr", 1): [(1, 10, 2, 3), (2, 100, 1, 4)]})([packed])
    want = dict(zip(packed["entity"].to_pylist(), zip(*(packed[c].to_pylist() for c in ("dl", "codes", "times", "rare")))))
    for kind, groups in ((1, range(10, 16)), (2, range(100, 104))):
        seen = Counter()
        for i, row in enumerate(got.to_pylist()):
            if row["kind"] == kind:
                for records in retrieval._unbundled(got.slice(i, 1)):
                    for e, *rest in zip(*(records[c].to_pylist() for c in ("entity", "dl", "codes", "times", "rare"))):
                        assert tuple(rest) == want[e]
                        seen.update((e, row["first"] + j * row["step"]) for j in range(row["many"]))
        assert set(seen.values()) == {1} and {g for _, g in seen} == set(groups)
        assert len(seen) == 301 * (3 if kind == 1 else 1)
    plain = sum(len(b) for c in ("codes", "times") for b in packed[c].to_pylist()) + sum(len(r) for r in packed["rare"].to_pylist())
    assert sum(len(r["head"]) + len(r["flat"]) for r in got.to_pylist() if r["kind"] == 1) < 0.75 * plain


def test_targets_move_no_more_for_several_blocks(monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_TERMS", 1)
    terms = {("fr", s): 1_000 for s in range(3)}
    for size in (1_000, 100):
        monkeypatch.setattr(retrieval, "TARGET_POSTINGS", size)
        assert [(t, blocks, chunks) for _, t, blocks, chunks in retrieval._cuts(terms, 10_000, CONFIG)] == [(1, 1_000 // size, 2), (2, 1_000 // size, 4)]


@pytest.mark.parametrize("first", [None, 1])
def test_misses_move_no_other_documents(spark, first):
    """Only the documents of missed pairs travel."""
    rows = spark.createDataFrame([(f"S{1 + i % 3}-{i}", f"document {i}", f"b{i}") for i in range(30)], "entity_id string, search_document string, geo_block_key string")
    truth = spark.createDataFrame([("S1-0", "S2-1"), ("S1-3", "S2-4"), ("S1-6", "S2-7")], "u string, v string")
    found = spark.createDataFrame([("S2-1", "S1-0", 1.0)], "entity_A string, entity_B string, bm25_text_score double")
    got = evaluation.miss_report(found, truth, rows, first)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    want = [("S2-4", "S1-3", "document 3", "b3", "document 4", "b4"), ("S2-7", "S1-6", "document 6", "b6", "document 7", "b7")]
    assert sorted((r["v"], r["u"], r["u_document"], r["u_block"], r["v_document"], r["v_block"]) for r in got.collect()) == want[: first or 2]


def test_spelled_grams_are_those_of_each_document(monkeypatch):
    documents = ["alpha beta alpha", "", "a", "  é\tbé  a ", "x" * 50, "beta gamma", "beta"]
    want = [brute_grams(d) for d in documents]
    for cells, characters in ((1 << 22, 500_000), (1, 5)):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        monkeypatch.setattr(retrieval, "GRAM_CHARACTERS", characters)
        got = [Counter() for _ in documents]
        for at, _, row, gram, count, words in retrieval._spelled(documents, 2, 4):
            for r, g, c in zip(row.tolist(), gram.tolist(), count.tolist()):
                got[at + r][words[g].as_py()] += c
        assert got == want


def test_large_blocks_are_cut(spark, monkeypatch):
    """No join on n-grams: a large block's targets come in pieces, its queries in chunks, and no pair changes."""
    rows = [(f"S{1 + i % 3}-{i}", i % 3, "fr_1", f"name {i % 7} of {i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id string, source int, geo_block_key string, search_document string").cache()
    pairs = lambda: sorted(map(tuple, retrieval.geo_top_k(df, CONFIG).collect()))
    whole = pairs()
    monkeypatch.setattr(retrieval, "BLOCK_CHARACTERS", 10)
    monkeypatch.setattr(retrieval, "TARGET_POSTINGS", 100)
    assert "Join" not in retrieval.geo_top_k(df, CONFIG)._jdf.queryExecution().optimizedPlan().toString().replace("Join LeftSemi", "").replace("Join LeftAnti", "")
    assert whole and pairs() == whole


def test_found_pairs_are_the_pool_without_joins(small):
    rows, _ = small
    merged, found = pool.candidate_pool(rows, CONFIG), pool.found_pairs(rows, CONFIG)
    assert "FullOuter" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, evaluation.canonical(found).collect())) == sorted(map(tuple, evaluation.canonical(merged).collect()))


def best_sums(seed, targets, terms, common, scale):
    """Postings of many targets, some equal, of which `common` terms stand in most targets; queries; and the matches by whole sums."""
    import numpy as np

    rng = np.random.default_rng(seed)
    share = np.where(np.arange(terms) < common, 0.6, 0.02)
    held = rng.random((targets, terms)) < share
    post = np.where(held, rng.integers(1, scale, (targets, terms)), 0)
    post[targets // 2 :] = post[: targets - targets // 2]
    asked = np.where(rng.random((40, terms)) < np.maximum(share, 0.1), rng.integers(1, 9, (40, terms)), 0)
    row, term = np.nonzero(post)
    query, own = np.nonzero(asked)
    built = retrieval._Postings(row.astype(np.int32), term, post[row, term].astype(float), targets, terms)
    got = built.matches(np.searchsorted(query, np.arange(41)), own, asked[query, own].astype(float), 7)
    sums, want = asked @ post.T, []
    for q in range(40):
        want += [(q, t, int(sums[q, t])) for t in sorted(range(targets), key=lambda t: (-sums[q, t], t))[:7] if sums[q, t] > 0]
    return built, list(zip(*(x.astype(int).tolist() for x in got))), want


def in_lists(built):
    """Shares of the targets that hold the terms whose postings are added up one by one."""
    return built.rare / built.n


@pytest.mark.parametrize("scale", [3, 14_000_000])
def test_scan_of_many_targets_is_exact(scale):
    """however many targets a block has, frequent terms are not added up one by one; estimates decide no match and no tie."""
    built, got, want = best_sums(1, 6_000, 1_000, 900, scale)
    assert got == want and max(in_lists(built)) <= 0.05


@pytest.mark.parametrize("limit", ["GROUP", "TABLE", "ROOM"])
def test_limits_of_the_scan_of_many_targets_change_no_match(monkeypatch, limit):
    """queries one by one, a table that holds a few of the frequent terms, and sums of few queries."""
    monkeypatch.setattr(retrieval, limit, {"GROUP": 1, "TABLE": 20_000, "ROOM": 9_000}[limit])
    _, got, want = best_sums(2, 4_000, 700, 500, 1_000_000)
    assert got == want


def test_small_and_large_blocks_match_alike(monkeypatch):
    """the same pairs whether sums are estimated first or not."""
    _, whole, want = best_sums(3, 300, 80, 40, 50)
    monkeypatch.setattr(retrieval, "FEW", 0)
    built, got, _ = best_sums(3, 300, 80, 40, 50)
    assert whole == got == want and built.table.dtype == "float32"


@pytest.mark.parametrize("cells", [1 << 22, 200_000, 1])
def test_known_grams_are_looked_up(monkeypatch, cells):
    """a large block's n-grams are told by a table of their letters and not spelled and sorted; those no target has are left out."""
    import pyarrow as pa

    documents = ["alpha beta alpha", "", "a", "  é\tbé  a ", "x" * 50, "beta gamma", "日本 beta"]
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "GRAM_CHARACTERS", 20)
    if cells > 1:
        monkeypatch.setattr(retrieval, "_spelled", lambda *a: pytest.fail("spelled n-grams"))
    grams = sorted(brute_grams("alpha bet é a xx"))
    got = [Counter() for _ in documents]
    for at, _, row, gram, count in retrieval._known_grams(documents, pa.array(grams, pa.string()), 2, 4):
        assert row.tolist() == sorted(row.tolist())
        for r, g, c in zip(row.tolist(), gram.tolist(), count.tolist()):
            got[at + r][grams[g]] += c
    assert got == [Counter({g: c for g, c in brute_grams(d).items() if g in grams}) for d in documents]


def test_tallies_in_cells_and_sorted(monkeypatch):
    """counts of pairs are the same in cells of a few documents at once, in all cells, and sorted."""
    import numpy as np

    rng = np.random.default_rng(4)
    doc, gram = np.sort(rng.integers(0, 30, 4_000)), rng.integers(0, 70, 4_000)
    want = sorted((d, g, c) for (d, g), c in Counter(zip(doc.tolist(), gram.tolist())).items())
    for cells in (1 << 22, 600, 1):
        monkeypatch.setattr(retrieval, "CELLS", cells)
        assert list(zip(*(x.tolist() for x in retrieval._tallied(doc, gram, 30, 70)))) == want
    assert list(zip(*(x.tolist() for x in retrieval._tallied(doc, gram, 30, 70_000)))) == want


@pytest.mark.parametrize("weighed", [1, 1 << 19])
def test_block_is_built_batch_by_batch(monkeypatch, weighed):
    """terms are summed and weighed a few records at once, whatever the size of a block; no more than a batch's are sorted."""
    import numpy as np
    import pyarrow as pa

    class Told:
        value = ["red", "house", "blue"]

    monkeypatch.setattr(retrieval, "WEIGHED", weighed, raising=False)
    texts = {f"S2-{i * 37 % 100:02d}": " ".join(np.random.default_rng(i).choice(["red", "house", "blue", "bakery", "books"], i % 9)) for i in range(100)}
    counted, sizes = retrieval._Block._summed, []
    monkeypatch.setattr(retrieval._Block, "_summed", staticmethod(lambda row, *a: sizes.append(len(set(row.tolist()))) or counted(row, *a)))
    words = [c.split() for c in texts.values()]
    block = retrieval._Block(retrieval.Bm25(CONFIG, {("fr", 1): (100, sum(map(len, words)) / 100)}), "fr", 1, 3)
    df = Counter(w for c in words for w in set(c))
    block.df[:3] = [df[w] for w in Told.value]
    block.told.append((pa.array(["bakery", "books"]), np.array([df["bakery"], df["books"]], dtype=float)))
    for lo in range(0, 100, 25):
        own = list(texts.items())[lo : lo + 25]
        batch = pa.RecordBatch.from_pydict({"part": ["fr"] * 25, "source": pa.array([1] * 25, pa.int32()), "entity": [k for k, _ in own], "words": [v for _, v in own]})
        block.add(*retrieval._packed(Told)([batch]))
    query = pa.RecordBatch.from_pydict({"part": ["fr"], "source": pa.array([0], pa.int32()), "entity": ["S1-0"], "words": ["red red bakery"]})
    got = block.match(*retrieval._packed(Told)([query])).to_pylist()
    assert max(sizes) <= 25
    score, avg, weight = {}, sum(map(len, words)) / 100, lambda w: math.log(1 + (100 - df[w] + 0.5) / (df[w] + 0.5))
    for name, c in zip(texts, words):
        tf = Counter(c)
        score[name] = sum(n * math.floor(1e6 * weight(w) * (tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * len(c) / avg))) + 0.5) for w, n in (("red", 2), ("bakery", 1)) if tf[w])
    want = sorted(((-s, n) for n, s in score.items() if s))[:3]
    assert [(-r["_s"], r["entity_B"]) for r in got] == want


def test_batches_are_parted_in_pieces(monkeypatch):
    """a batch's texts are cleaned, parted into words and packed a few records at once, with the same outcome."""
    import pyarrow as pa

    from entwine.functions import text

    class Told:
        value = ["red", "house"]

    sizes, inner = [], text.batch_tokens
    names = [None if i == 4 else f"Red house, {i % 3} bakery é {i}" for i in range(25)]
    raw = pa.RecordBatch.from_pydict({"entity": [f"S2-{i}" for i in range(25)], "business_name": pa.array(names, pa.string()), "business_address": pa.array([None] * 25, pa.string())})
    rows = pa.RecordBatch.from_pydict({"part": ["fr"] * 25, "source": pa.array([1] * 25, pa.int32()), "entity": raw["entity"], "words": pa.array(names, pa.string())})

    def outcomes():
        cleaned = pa.Table.from_batches(text.with_texts(("phonetic_hash", "search_document"), False)([raw])).to_pylist()
        counted = [sorted(map(str, b.to_pylist())) for b in retrieval._counted([1], ("red",))([rows.select(["part", "source", "words"])])]
        return cleaned, counted, [b.to_pylist() for b in retrieval._packed(Told)([rows])]

    whole = outcomes()
    monkeypatch.setattr(retrieval, "READ_ROWS", 10)
    monkeypatch.setattr(text, "CLEANED_ROWS", 10, raising=False)
    monkeypatch.setattr(text, "batch_tokens", lambda texts, *a: sizes.append(len(texts)) or inner(texts, *a))
    assert outcomes() == whole and max(sizes) <= 10
