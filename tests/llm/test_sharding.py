import math
import random
import zlib
from collections import defaultdict

import xxhash

from entwine.llm import sharding
from tests.llm.conftest import SCHEMA, prose


def brute(rows, shards):
    """The same tree over lists: groups sorted by key, cut where the left side comes nearest to its share."""
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").encode()].append(r)
    total = sum((len(t) + 16) * len(g) for t, g in groups.items())
    points = {}
    for t, g in groups.items():
        first = min(g, key=lambda r: r[0])
        values = (math.log1p(len(t) + 16), zlib.crc32((first[3] or "").encode()), zlib.crc32((first[2] or "").encode()), first[0])
        points[xxhash.xxh64_intdigest(t, seed=42)] = ((len(t) + 16) * len(g), len(g), values)
    ranges = [(min(p[2][d] for p in points.values()), max(p[2][d] for p in points.values())) for d in range(4)]
    scaled = {h: [math.floor((v - lo) / max(hi - lo, 1e-9) * ((1 << 22) - 1)) for v, (lo, hi) in zip(p[2], ranges)] for h, p in points.items()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    target = total / shards
    heavy = [(signed(h), p[1], p[0]) for h, p in points.items() if p[0] > target / 8]
    placed, load = sharding.place(heavy, shards, target)
    out = {(g, at): s for g, lo, hi, s in placed for at in range(lo, hi)}

    def split(node, hashes):
        if len(node.room) == 1:
            out.update({(signed(h), at): node.first for h in hashes for at in range(points[h][1])})
            return
        left, right, share = node.halves()
        widths = [max(scaled[h][d] for h in hashes) - min(scaled[h][d] for h in hashes) if hashes else 0 for d in range(4)]
        d = widths.index(max(widths))
        order = sorted(hashes, key=lambda h: (scaled[h][d], h % (1 << 40)))
        want, below, cut = share * sum(points[h][0] for h in order), 0, 0
        for h in order:
            w = points[h][0]
            if below + w > want:
                cut += want - below > w / 2
                break
            below, cut = below + w, cut + 1
        split(left, order[:cut])
        split(right, order[cut:])

    split(sharding.Node(0, [max(0.0, target - x) for x in load]), [h for h, p in points.items() if p[0] <= target / 8])
    return {(t, at): out[signed(xxhash.xxh64_intdigest(t, seed=42)), at] for t, g in groups.items() for at in range(len(g))}


def test_against_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice((3, 10, 20, 40))) for _ in range(300)]
    rows = [(i, texts[i % 300] if i % 3 else rng.choice(texts), rng.choice(("en", "fr", None)), f"src{rng.randrange(9)}", None) for i in range(500)]
    rows += [(1000 + i, "one text with very many copies", "en", "src0", None) for i in range(250)] + [(2000, None, None, None, None), (2001, "", "en", None, None)]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8, tolerance=0).collect()
    want, text = brute(rows, 8), {r[0]: (r[1] or "").encode() for r in rows}
    ours, theirs, found = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in got:
        ours[text[r["doc_id"]]].append(r["shard"])
        found[text[r["doc_id"]]].add(r["parted"])
    for (t, _), s in want.items():
        theirs[t].append(s)
    assert {t: sorted(s) for t, s in ours.items()} == {t: sorted(s) for t, s in theirs.items()}
    assert {t for t, s in ours.items() if len(set(s)) > 1} == {b"one text with very many copies"} == {t for t, p in found.items() if p == {True}}


def test_no_group_that_fits_a_shard_is_parted():
    placed, load = sharding.place([(1, 1000, 5000), (2, 1, 700), (3, 10, 900), (4, 7, 300)], 10, 1000)
    shards = {g: {s for k, _, _, s in placed if k == g} for g in (1, 2, 3, 4)}
    assert [len(shards[g]) for g in (1, 2, 3, 4)] == [5, 1, 1, 1] and sum(load) == 6900 and max(load) <= 1000


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "w" * (i * 37 % 400), ("en", "fr")[i % 2], "src0" if i % 3 else f"src{i % 9}", None) for i in range(4000)]
    out = [r.asDict() for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 40).collect()]
    assert sorted(r["doc_id"] for r in out) == list(range(4000))
    assert all(r["size"] == len(rows[r["doc_id"]][1]) + 16 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode()) for r in out)
    size, slots = defaultdict(int), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size.values()) / 40
    assert set(size) == set(range(40)) and max(size.values()) < 1.1 * mean and min(size.values()) > 0.9 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(docs, rows):
    out = [r.asDict() for r in sharding.kd_shards(docs, 7).collect()]
    assert sorted((r["doc_id"], r["size"]) for r in out) == sorted((r[0], len((r[1] or "").encode()) + 16) for r in rows)
    assert {r["shard"] for r in out} <= set(range(7))


def test_same_shards_each_time(docs):
    a, b = ({(r["doc_id"], r["shard"]) for r in sharding.kd_shards(docs, 5).collect()} for _ in range(2))
    assert a == b


def test_empty_and_null(empty, nullish):
    assert sharding.kd_shards(empty).count() == 0
    assert sorted(r["size"] for r in sharding.kd_shards(nullish, 2).collect()) == [16, 16, 19]
