"""Token ids in a compressed binary format: static range asymmetric numeral system with shared frequency tables.

A block holds a bounded number of tokens and is independent of other blocks: its tokens are dealt to interleaved lanes
(token i to lane i mod lanes), each lane with a 64-bit state that is renormalised by 32-bit words. Every STEP steps is a
checkpoint: all lane states and the words up to the next one. A checkpoint with its words is a section, which is decoded by
itself and has checksums of its own, so that the sections of one block, and of one long document, are decoded in parallel.

Section layout, little-endian: header (magic, prob_bits u16, lanes u32, tokens u64, words u64, crc32 of words u32, crc32 of
ids u32, crc32 of the table u32), then `lanes` states u64, then the words u32.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .common import stage, stage_path

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

PROB_BITS = 20
LANES = 2048
#: Interleaved steps between checkpoints.
STEP = 128
#: Tokens of a block; a document that does not fit goes on in the next.
BLOCK_TOKENS = 1 << 19
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sHIQQIII")
MAGIC = b"RAS2"
#: Chunks between white space, and words inside them, whose ids a Python worker remembers (the first ones it meets,
#: which are the frequent ones); and bytes of text that it takes at once.
CACHE, WORDS, SLICE = 400_000, 900_000, 8_000_000


class Frequencies:
    """Token frequencies scaled to a sum of 2 ** PROB_BITS; every counted token has at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> "Frequencies":
        total, goal = int(counts.sum()), 1 << PROB_BITS
        if not total:
            return cls(np.zeros(len(counts), dtype=np.int64))
        if int((counts > 0).sum()) > goal:
            raise ValueError("more distinct tokens than the table has places")
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts / total * goal)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - goal
        while over > 0:  # the ones given to rare tokens come from the frequent ones
            for k in order[freq[order] > 1]:
                take = min(over, int(freq[k]) // 64 + 1, int(freq[k]) - 1)
                freq[k] -= take
                over -= take
                if over <= 0:
                    break
        freq[order[0]] -= over
        return cls(freq)


def encode(ids: np.ndarray, table: Frequencies, lanes: int = LANES, step: int = STEP) -> list[bytes]:
    """One block from token ids, as its sections in order."""
    n = len(ids)
    lanes = max(1, min(lanes, -(-n // 16)))
    x = np.full(lanes, LOW, dtype=np.uint64)
    words, sections, bits = [], [], np.uint64(PROB_BITS)
    ids = ids.astype(np.int64)
    for t in range(-(-n // lanes) - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        f, y = table.freq[s], x[: len(s)]
        full = y >= (f << np.uint64(63 - PROB_BITS))
        words.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[: len(s)] = (q << bits) + (y - q * f) + table.start[s]
        if t % step == 0:
            body, own = np.concatenate(words[::-1]).tobytes(), ids[t * lanes : (t + step) * lanes].astype("<u4").tobytes()
            sections.append(HEADER.pack(MAGIC, PROB_BITS, lanes, len(own) // 4, len(body) // 4, zlib.crc32(body), zlib.crc32(own), table.crc) + x.astype("<u8").tobytes() + body)
            words = []
    return sections[::-1]


def tokens_in(section: bytes) -> int:
    return HEADER.unpack_from(section)[3]


def decode(section: bytes, table: Frequencies) -> np.ndarray:
    """A section's token ids (u4), checked against both checksums."""
    magic, bits, lanes, n, n_words, crc_words, crc_ids, crc_table = HEADER.unpack_from(section)
    if magic != MAGIC or bits != PROB_BITS or crc_table != table.crc:
        raise ValueError("not a section of this format and table")
    body = memoryview(section)[HEADER.size + 8 * lanes :]
    if len(body) != 4 * n_words or zlib.crc32(body) != crc_words:
        raise ValueError("damaged section: words")
    words, out = np.frombuffer(body, dtype="<u4"), np.empty(n, dtype="<u4")
    x, pos, mask = np.frombuffer(section, dtype="<u8", count=lanes, offset=HEADER.size).copy(), 0, np.uint64((1 << bits) - 1)
    for at in range(0, n, lanes):
        k = min(lanes, n - at)
        y = x[:k]
        slot = y & mask
        s = table.slots[slot]
        y = table.freq[s] * (y >> np.uint64(bits)) + slot - table.start[s]
        need = np.flatnonzero(y < LOW)
        y[need] = (y[need] << np.uint64(32)) | words[pos : pos + len(need)]
        pos += len(need)
        x[:k] = y
        out[at : at + k] = s
    if zlib.crc32(out.tobytes()) != crc_ids:
        raise ValueError("damaged section: ids")
    return out


def _product(a: int, b: int) -> int:
    """Of two polynomials over GF(2), modulo that of crc32; the highest bit is the constant."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The crc32 of two pieces, one after the other, from theirs and the second's bytes: first * x ** (8 * size) + second."""
    shift, power = 1 << 31, 1 << 23
    while size:
        if size & 1:
            shift = _product(shift, power)
        power, size = _product(power, power), size >> 1
    return _product(shift, first) ^ second


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabets write printable Latin-1 bytes as themselves and all others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: Chunks that the pre-tokenizer cuts in two at most: letters whose lower case is plain, then full stops or commas.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)").fullmatch
_tokenizers: dict[str, tuple] = {}
#: What a tokenizer file must say for chunks between white space to be tokenized by themselves, in lower case.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _by_chunks(spec: dict) -> bool:
    """Whether the tokenizer lower-cases, cuts at white space and spells words by bytes."""
    cut = spec.get("pre_tokenizer") or {}
    kinds = [p.get("type") for p in cut.get("pretokenizers", ())]
    splits = [p["pattern"].get("Regex", "") for p in cut.get("pretokenizers", ()) if p.get("type") == "Split"]
    model = spec["model"]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS and kinds == ["Split", "ByteLevel"] and not cut["pretokenizers"][1]["add_prefix_space"]
        and splits[0].endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and model["type"] == "BPE" and not model.get("dropout")
    )


class Ids:
    """Token ids of whole texts, as 16-bit numbers; a tokenizer with larger ids is refused.

    A lower-casing byte-level BPE tokenizer whose tokens never cross white space goes by chunks; any other by whole
    texts, in the library. By chunks, texts are split and their chunks dictionary-encoded in Arrow; only a slice's distinct chunks are looked up in
    Python, those never seen are tokenized, and numpy puts the ids together.
    """

    def __init__(self, path: str):
        if path not in _tokenizers:
            tokenizer = Tokenizer.from_file(path)
            if max(tokenizer.get_vocab().values(), default=0) >= 1 << 16:
                raise ValueError("this format holds ids below 65,536")
            with open(path, encoding="utf-8") as f:
                _tokenizers[path] = tokenizer, {}, {}, _by_chunks(json.load(f))
        self.tokenizer, self.seen, self.parts, self.chunks = _tokenizers[path]
        self.model = self.tokenizer.model

    def __call__(self, texts: pa.StringArray, end: int) -> pa.BinaryArray:
        """Of each text its ids and the end id, as little-endian 16-bit numbers."""
        if not self.chunks:
            codes = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return pa.array([np.array([*e.ids, end], dtype="<u2").tobytes() for e in codes], pa.binary())
        odd = pc.match_substring_regex(texts, "[\x0b\x0c]")  # white space for Arrow, perhaps not for the tokenizer
        if pc.any(odd).as_py():
            whole = {i: self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
            rest = self(pc.if_else(odd, "", texts), end).to_pylist()
            return pa.array([np.array([*whole[i], end], dtype="<u2").tobytes() if i in whole else r for i, r in enumerate(rest)], pa.binary())
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 2
        flat = np.frombuffer(b"".join(known), dtype="<u2")
        index = coded.indices.to_numpy()
        size = sizes[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[index] - upto[:-1], size) + np.arange(upto[-1])]
        offsets = chunks.offsets.to_numpy()
        edges = upto[offsets - offsets[0]]  # of the documents, in ids
        out = np.empty(len(ids) + len(texts), dtype="<u2")
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(edges))] = ids
        ends = edges + np.arange(len(texts) + 1)  # with one end id for each
        out[ends[1:] - 1] = end
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((2 * ends).astype("<i4")), pa.py_buffer(out)])

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Each chunk's ids."""
        out = list(map(self.seen.get, chunks))
        new = {c: None for c, x in zip(chunks, out) if x is None}
        hard = []
        for c in new:
            m = _PLAIN(c)
            if m is None:
                hard.append(c)
            else:
                new[c] = self._part(m[1].lower()) + (self._part(m[2]) if m[2] else b"")
        if hard:
            codes = self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)
            new.update((c, array("H", e.ids).tobytes()) for c, e in zip(hard, codes))
        if len(self.seen) < CACHE:
            self.seen.update(new)
        return [new[c] if x is None else x for c, x in zip(chunks, out)] if new else out

    def _part(self, word: str) -> bytes:
        x = self.parts.get(word)
        if x is None:
            letters = word if word.isascii() else "".join(map(_LETTERS.__getitem__, word.encode()))
            x = array("H", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.parts) < WORDS:
                self.parts[word] = x
        return x


def _tokenized(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy()) // SLICE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                if len(part):
                    at, n = int(part[0]), len(part)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), ids(texts.slice(at, n), end)], names=["doc_id", "ids"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << 16, dtype=np.int64)
    for batch in batches:
        counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u2"), minlength=1 << 16)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["token", "n"])


SECTIONS = "part long, block long, section long, start long, n_tokens long, doc_nos array<long>, doc_ids array<long>, totals array<long>, offsets array<long>, lengths array<long>, data binary"


def _blocks(table):
    """Sections of the task's documents in order. doc_nos count the documents of the part; of each piece of a document
    in a section: the document's tokens, those before the piece, and the piece's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, part = Frequencies(table.value), TaskContext.get().partitionId()
        held, size, start, number, doc_no = [], 0, 0, 0, 0  # held: (doc_no, doc_id, ids, offset in the document)

        def block(wanted: int) -> pa.RecordBatch:
            """From the first `wanted` held tokens; the rest stays held."""
            nonlocal held, size, start, number
            now, taken, rest = [], 0, []
            for no, doc, ids, at in held:
                n = min(len(ids) - at, wanted - taken)
                if n:
                    now.append((no, doc, ids, at, n, taken))
                    taken += n
                if at + n < len(ids):
                    rest.append((no, doc, ids, at + n))
            flat, rows, low = np.concatenate([ids[at : at + n] for _, _, ids, at, n, _ in now]), [], 0
            for k, data in enumerate(encode(flat, freq, LANES, STEP)):
                high = low + tokens_in(data)
                pieces = []
                for no, doc, ids, at, n, before in now[bisect_right([x[5] for x in now], low) - 1 : bisect_left([x[5] for x in now], high)]:
                    lo, hi = max(low, before), min(high, before + n)
                    pieces.append((no, doc, len(ids), at + lo - before, hi - lo))
                rows.append((part, number, k, start + low, high - low, *map(list, zip(*pieces)), data))
                low = high
            held, size, start, number = rest, size - taken, start + taken, number + 1
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SECTIONS.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_no, doc, np.frombuffer(ids, dtype="<u2"), 0))
                size, doc_no = size + len(ids) // 2, doc_no + 1
                while size >= BLOCK_TOKENS:
                    yield block(BLOCK_TOKENS)
        if size:
            yield block(size)

    return run


PIECES = "part long, doc_no long, doc_id long, total long, start long, n_tokens long, ids_crc32 long"


def _read(table):
    """Pieces of documents, a section at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = Frequencies(table.value)
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, out = decode(row["data"], freq), 0, []
                for no, doc, total, n in zip(row["doc_nos"], row["doc_ids"], row["totals"], row["lengths"]):
                    out.append((row["part"], no, doc, total, row["start"] + at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, start, n_tokens, pieces in order) to (part, doc_id, start, n_tokens, ids_crc32)."""
    for batch in batches:
        out = []
        for pieces in batch.column(4).to_pylist():
            crc = 0
            for p in pieces:
                crc = joined_crc(crc, p["ids_crc32"], 4 * p["n_tokens"])
            out.append(crc)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = 2) -> None:
    """Tokenize all texts and write them under path: `table` (one row: the shared frequencies) and `blocks`.

    Texts are tokenized once, into a staged table. Tokens are counted over all documents (at most 65,536 sums reach
    the driver). Then the ids are dealt into ranges of doc_id, each range is sorted and its blocks are encoded in
    that order; part numbers ascend with doc_id.
    The blocks' sections are rows of Parquet files with a binary column, so that Spark's committer covers retried tasks and any
    file system will do. Null text counts as empty; null doc_ids come first; repeated rows are written as often.
    """
    spark = docs.sparkSession
    raw = stage_path(spark, "ids")
    docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_tokenized(tokenizer_path, end), "doc_id long, ids binary").write.option("compression", "zstd").parquet(raw)
    own = spark.read.schema("doc_id long, ids binary").parquet(raw)
    counted = own.select("ids").mapInArrow(_counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    freq = Frequencies.from_counts(counts).freq.astype(np.int64)
    spark.createDataFrame([([int(f) for f in freq],)], "freq array<long>").coalesce(1).write.parquet(f"{path}/table")
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_blocks(spark.sparkContext.broadcast(freq)), SECTIONS).write.parquet(f"{path}/blocks")


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    Sections are decoded each by itself. Documents that lie in one section are done there; the others' pieces meet by
    document, and their checksums are joined in order. start counts the ids of all documents before it: the place in
    its part, plus the parts before it (one sum per part, a number that the cluster's partition count bounds).
    """
    freq = np.array(spark.read.parquet(f"{path}/table").first()["freq"], dtype=np.int64)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = stage(blocks.mapInArrow(_read(spark.sparkContext.broadcast(freq)), PIECES), "pieces")
    whole = rows.where("n_tokens = total").select("part", "doc_id", "start", "n_tokens", "ids_crc32")
    pieces = rows.where("n_tokens < total").groupBy("part", "doc_no").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("pieces")
    )
    joined = pieces.select("part", "doc_id", "start", "n_tokens", "pieces").mapInArrow(_put_together, "part long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return whole.union(joined).join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Write docs as token files under the shared folder and read them back. An empty table gives no rows."""
    path = stage_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end)
    return read_tokens(docs.sparkSession, path)
