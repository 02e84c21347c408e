import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from entwine.llm import rans  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [0, 1, 15, 16, 1000, 30_000, 300_001])
def test_round_trip_of_ids(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, n), 60_000).astype(np.uint32)
    table = rans.Frequencies.from_counts(np.bincount(ids, minlength=1 << 16))
    sections = rans.encode(ids, table, lanes=64, step=32)
    lanes = max(1, min(64, -(-n // 16)))
    assert len(sections) == -(-n // (lanes * 32))
    parts = [rans.decode(x, table) for x in reversed(sections)][::-1]  # each by itself, in any order
    assert n == 0 or (np.concatenate(parts) == ids).all()


@pytest.mark.parametrize("sizes", [(0, 0), (3, 0), (0, 5), (7, 1), (1000, 12345)])
def test_joined_checksums(sizes):
    x, y = (np.random.default_rng(n + 1).bytes(n) for n in sizes)
    assert rans.joined_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_damage_is_noticed():
    ids = np.arange(5000) % 50
    table = rans.Frequencies.from_counts(np.bincount(ids, minlength=1 << 16))
    block = bytearray(rans.encode(ids, table)[0])
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)
    other = rans.Frequencies.from_counts(np.bincount(ids % 7, minlength=1 << 16))
    with pytest.raises(ValueError):
        rans.decode(rans.encode(ids, table)[0], other)


def test_frequencies_keep_rare_tokens():
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[:40_000] = 1
    counts[7] = 10**12
    freq = rans.Frequencies.from_counts(counts).freq
    assert int(freq.sum()) == 1 << rans.PROB_BITS and (freq[:40_000] >= 1).all() and (freq[40_000:] == 0).all()


def test_files_against_whole_texts(docs, rows):
    tokenizer, want, at = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in sorted((r[0], r[1] or "") for r in rows):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rans.round_trip(docs, PATH).collect())) == want


def test_long_documents_go_over_sections_and_blocks(docs, monkeypatch):
    want = sorted(map(tuple, rans.round_trip(docs, PATH).collect()))
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(rans, "LANES", 3)
    monkeypatch.setattr(rans, "STEP", 4)
    assert sorted(map(tuple, rans.round_trip(docs, PATH).collect())) == want


def test_chunks_equal_the_tokenizer():
    ids, tokenizer = rans.Ids(PATH), Tokenizer.from_file(PATH)
    chunks = ["The", "the,", "l'été", "ÉCOLE.", "naïve...", "don't", "a1b2", "日本語", "İstanbul", "x.,.", "ß", "Ñandú,", "<|endoftext|>", "e\u0301", "\u0301x", "ÿ", "×", "ﬁ"]
    for c, got in zip(chunks, ids._known(chunks)):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(c, add_special_tokens=False).ids, c


def test_other_tokenizers_go_by_whole_texts(tmp_path, rows):
    """One that does not lower-case; one whose ids do not fit is refused."""
    import json

    import pyarrow as pa

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(spec))
    tokenizer, ids = Tokenizer.from_file(str(tmp_path / "cased.json")), rans.Ids(str(tmp_path / "cased.json"))
    texts = [r[1] or "" for r in rows[:30]] + ["The Cat's  9 lives", "a\x0bB"]
    got = ids(pa.array(texts), 2).to_pylist()
    assert not ids.chunks and rans.Ids(PATH).chunks
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    spec["added_tokens"] += [{**spec["added_tokens"][0], "id": 49408 + i, "content": f"<|x{i}|>"} for i in range(20_000)]
    (tmp_path / "wide.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        rans.Ids(str(tmp_path / "wide.json"))


def test_empty_and_null(empty, nullish):
    assert rans.round_trip(empty, PATH).count() == 0
    got = sorted((str(r["doc_id"]), r["start"], r["n_tokens"]) for r in rans.round_trip(nullish, PATH).collect())
    assert got == [("1", 4, 1), ("None", 0, 1), ("None", 1, 3)]
