"""Text normalization as column expressions: folding, cleaning, phonetic codes, tokens, n-grams. No UDFs."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of folded (ASCII) text, as a character class.
SPACE = r"[\x09-\x0D\x1C-\x20]"

#: Ordered (pattern, replacement) pairs of company and street suffixes.
SUFFIXES = (
    (r"\bprivate limited\b", "ltd"), (r"\bpvt ltd\b", "ltd"), (r"\bpvt\.?\s*ltd\.?\b", "ltd"),
    (r"\bcorporation\b", "corp"), (r"\bincorporated\b", "inc"), (r"\bstreet\b", "st"),
    (r"\broad\b", "rd"), (r"\bavenue\b", "ave"), (r"\bboulevard\b", "blvd"),
)

#: Letters that do not decompose into an ASCII letter and marks, and typographic punctuation.
SPECIAL = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D",
    "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ſ": "s",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "–": "-", "—": "--", "…": "...", "«": "<<", "»": ">>", " ": " ",
    "¡": "!", "¿": "?", "©": "(c)", "®": "(r)", "°": "deg", "€": "EUR", "£": "PS", "½": "1/2", "¼": "1/4", "¾": "3/4", "×": "x", "·": "*",
}


@cache
def fold_table() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(letters, their one-letter folds, longer replacements): Latin letters by canonical decomposition, and SPECIAL."""
    one = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFKD", chr(code))
        plain = "".join(c for c in base if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and chr(code) not in SPECIAL:
            one[chr(code)] = plain
    one |= {k: v for k, v in SPECIAL.items() if len(v) == 1}
    return "".join(one), "".join(one.values()), tuple((k, v) for k, v in SPECIAL.items() if len(v) > 1)


def ascii_fold(text: Column) -> Column:
    """Latin letters with marks to ASCII; what has no fold (marks, other scripts) is removed. ASCII text is left alone."""
    source, target, longer = fold_table()
    out = F.translate(text, source, target)
    for k, v in longer:
        out = F.replace(out, F.lit(k), F.lit(v))
    out = F.regexp_replace(out, r"[^\x00-\x7F]+", "")
    return F.when(F.octet_length(text) > F.length(text), out).otherwise(text)


def collapse(text: Column) -> Column:
    """One space for each run of white space, none at the ends. Single spaces are left alone."""
    return F.trim(F.regexp_replace(text, f"{SPACE}{{2,}}|[\\x09-\\x0D\\x1C-\\x1F]", " "))


#: ASCII characters that are no capital, small letter, digit, underscore or white space.
PUNCTUATION = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c.isspace() or c == "_"))


def depunctuate(text: Column) -> Column:
    """Lower-cased, with a space for every character that is no letter, digit, underscore or white space.

    A pattern of all that is blanked, a negated class of several ranges, takes about a microsecond a character; a table of
    ASCII characters and a pattern of all others do not.
    """
    plain = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return F.regexp_replace(plain, r"[^\x00-\x7F]", " ")


#: What every match of a pattern in SUFFIXES holds.
TRIGGER = "private limited|pvt|corporation|incorporated|street|road|avenue|boulevard"


def standardize_suffixes(text: Column) -> Column:
    """Long forms of company and street suffixes to short ones, in order, on lower-cased text. Text without any of
    TRIGGER is left alone after one look at it."""
    short = text
    for pattern, suffix in SUFFIXES:
        short = F.regexp_replace(short, pattern, suffix)
    return F.when(text.rlike(TRIGGER), short).otherwise(text)


def clean_address(address: Column) -> Column:
    """Folded, lower-cased, without punctuation; empty for null."""
    return F.coalesce(collapse(depunctuate(ascii_fold(address))), F.lit(""))


def clean_name(name: Column) -> Column:
    """clean_address with suffixes standardized, before white space is collapsed."""
    return F.coalesce(collapse(standardize_suffixes(depunctuate(ascii_fold(name)))), F.lit(""))


#: Characters of a name that first_letter cleans, and cleaned characters from which on they tell how the name begins.
HEAD, HEAD_CLEANED = 128, 40


def first_letter(name: Column) -> Column:
    """The first character of clean_name(name), from the head of a long name alone.

    Folding and punctuation go character by character. Suffixes change a name's first letter only in its first two words (private limited,
    pvt ltd), and where they stand first, HEAD_CLEANED characters of what the head becomes reach past them.
    """
    head = clean_name(F.substring(name, 1, HEAD))
    far = F.get(F.regexp_extract_all(head, F.lit(f"^(.).{{{HEAD_CLEANED - 1}}}"), F.lit(1)), F.lit(0))  # names head once
    return F.coalesce(far, F.substring(clean_name(name), 1, 1))


def search_document(name: Column, address: Column) -> Column:
    return F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(address, F.lit("")))


#: Metaphone (L. Philips, Computer Language 7(12), 1990) as ordered rewriting rules on lower-cased words with single
#: spaces between them. Codes are capitals, which later rules leave alone. Each rule: ("re", pattern, replacement) or
#: ("tr", from, to).
METAPHONE = (
    ("re", r"[^a-z ]", ""),
    ("re", r"(^| )(?:[kgp](?=n)|w(?=r)|a(?=e))", "$1"),  # silent at the start of a word
    ("re", r"(^| )x", "$1s"),
    ("re", r"(^| )wh", "$1w"),
    ("re", r"([abd-z])\1+", "$1"),
    ("re", r"mb( |$)", "m$1"),
    ("re", r"sch", "sk"),
    ("re", r"tch", "ch"),
    ("re", r"ci(a)|ch", "X$1"),
    ("re", r"ck", "K"),
    ("re", r"sc([iey])", "S$1"),
    ("re", r"c([iey])", "S$1"),
    ("re", r"dg([iey])", "J$1"),
    ("re", r"gh([^aeiou])", "$1"),
    ("re", r"gn(ed)?( |$)", "n$1$2"),
    ("re", r"g([iey])", "J$1"),
    ("re", r"ph", "F"),
    ("re", r"sh", "X"),
    ("re", r"th", "0"),
    ("re", r"([aeiou])h([^aeiou]|$)", "$1$2"),
    ("re", r"[st]i([oa])", "X$1"),
    ("re", r"x", "KS"),
    ("re", r"w([aeiou])", "W$1"),
    ("re", r"y([aeiou])", "Y$1"),
    ("re", r"[wy]", ""),
    ("tr", "bcdfghjklmnpqrstvzaeiou", "BKTFKHJKLMNPKRSTFSAEIOU"),
    ("re", r"(?<=[^ ])[AEIOU]", ""),  # vowels count at the start of a word
    ("re", r"  +", " "),
)


def metaphone(clean: Column) -> Column:
    """Phonetic codes of a cleaned name, word by word, with the spaces between words; empty for empty."""
    for kind, a, b in METAPHONE:
        clean = F.translate(clean, a, b) if kind == "tr" else F.regexp_replace(clean, a, b)
    return F.trim(clean)


#: The same rules for re, without the last one, which joins words.
_RULES = tuple((re.compile(a), re.sub(r"\$(\d)", r"\\g<\1>", b)) if kind == "re" else (None, str.maketrans(a, b)) for kind, a, b in METAPHONE[:-1])
#: Words and their codes that a worker keeps, so many at most (some 30 MB).
_CODES, KNOWN_WORDS = {}, 200_000


def _rewritten(text: str) -> str:
    for pattern, to in _RULES:
        text = text.translate(to) if pattern is None else pattern.sub(to, text)
    return text


def word_codes(words: list[str]) -> list[str]:
    """Metaphone's codes of distinct words, each as it is before another word."""
    new = [w for w in words if w not in _CODES]
    fresh = dict(zip(new, _rewritten(" ".join(new) + " ").split(" "))) if new else {}
    out = [_CODES[w] if w in _CODES else fresh[w] for w in words]
    _CODES.update(list(fresh.items())[: max(0, KNOWN_WORDS - len(_CODES))])
    return out


def name_codes(names: pa.Array) -> pa.Array:
    """metaphone of cleaned names, in the words that a batch holds and not in every place of them: no rule looks past the
    space behind a word, and only gh is left alone at the end of a name and not before a space."""
    lists = pc.split_pattern(names, " ")
    words, sizes = lists.flatten().dictionary_encode(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    known, number, ends = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64), np.cumsum(sizes)
    codes = word_codes(known)
    last, which = np.unique(number[ends - 1], return_inverse=True)
    number[ends - 1] = len(codes) + which
    codes += [_rewritten(known[i]) if "g" in known[i] and "h" in known[i] else codes[i] for i in last.tolist()]
    held = np.array([c != "" for c in codes], dtype=bool)[number]
    rows = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[held], minlength=len(sizes))
    offsets = pa.array(np.concatenate([[0], np.cumsum(rows)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array(codes, pa.string()).take(pa.array(number[held]))), " ")


def with_codes(batches):
    """clean_name, the last column, becomes phonetic_hash."""
    for batch in batches:
        if batch.num_rows:
            columns = [*batch.columns[:-1], name_codes(batch["clean_name"].cast(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "phonetic_hash"])


#: depunctuate for ASCII bytes, and white space of any kind as spaces.
_PLAIN = bytes(32 if chr(b) in PUNCTUATION or b > 127 else ord(chr(b).lower()) for b in range(256))
_BLANK = bytes(32 if b in (*range(9, 14), *range(28, 33)) else b for b in range(256))
_FOLDS = dict(zip(*fold_table()[:2])) | dict(fold_table()[2])
_ODD = re.compile(r"[^\x00-\x7F]")
#: SUFFIXES for bytes, each behind a part that its matches hold.
_SHORT = tuple((re.search(r"[a-z]{3,}( [a-z]+)?", re.sub(r"\\[a-z]", "", a))[0].encode(), re.compile(a.encode()), b.encode()) for a, b in SUFFIXES)


def cleaned(text: bytes | None, suffixes: bool) -> bytes:
    """clean_name (with suffixes) or clean_address of a text in UTF-8, without a pattern for every character."""
    if not text:
        return b""
    if not text.isascii():
        text = _ODD.sub(lambda m: _FOLDS.get(m[0], ""), text.decode("utf-8", "replace")).encode()
    text = text.translate(_PLAIN)
    for held, pattern, short in _SHORT if suffixes else ():
        if held in text:
            text = pattern.sub(short, text)
    return b" ".join(text.translate(_BLANK).split())


#: Records whose texts are cleaned at once.
CLEANED_ROWS = 2_000


def with_texts(columns: tuple[str, ...], suffix_address: bool):
    """business_name and business_address, the last columns, become phonetic_hash and search_document, as far as asked for."""

    def run(batches):
        for batch in (whole.slice(at, CLEANED_ROWS) for whole in batches for at in range(0, max(whole.num_rows, 1), CLEANED_ROWS)):
            names = [cleaned(v, True) for v in batch["business_name"].cast(pa.binary()).to_pylist()]
            made = {}
            if "phonetic_hash" in columns:
                made["phonetic_hash"] = name_codes(pa.array(names, pa.binary()).cast(pa.string())) if names else pa.array([], pa.string())
            if "search_document" in columns:
                addresses = batch["business_address"].cast(pa.binary()).to_pylist()
                made["search_document"] = pa.array([n + b" " + cleaned(a, suffix_address) for n, a in zip(names, addresses)], pa.binary()).cast(pa.string())
            own = batch.select([c for c in batch.schema.names if c not in ("business_name", "business_address")])
            yield pa.RecordBatch.from_arrays([*own.columns, *made.values()], names=[*own.schema.names, *made])

    return run


#: What tokens makes of ASCII bytes, spaces between words.
_WORD = bytes(ord(chr(b).lower()) if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


def batch_tokens(texts: pa.Array, stopwords: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """tokens of a batch of texts, in order: of each its row and its number in an array of distinct words."""
    values = [b"" if v is None else v if v.isascii() else v.decode("utf-8", "replace").lower().encode() for v in texts.cast(pa.binary()).to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.string(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(values).translate(_WORD))])
    lists = pc.split_pattern(plain, " ")
    words = lists.flatten().dictionary_encode()
    known, number = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(values)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    kept = pc.and_(pc.greater_equal(pc.binary_length(known), 2), pc.invert(pc.is_in(known, pa.array(stopwords, pa.string())))).to_numpy(zero_copy_only=False)
    held = kept[number] if len(known) else np.empty(0, dtype=bool)
    return row[held], number[held], known


def tokens(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Words of two or more characters, lower-cased, in order with repetitions, without stopwords. For folded text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{2,})"), F.lit(1))
    stop = F.array(*[F.lit(s) for s in stopwords])
    return F.filter(words, lambda w: ~F.array_contains(stop, w)) if stopwords else words


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words, each word padded with one space on both sides; low must be 2 or 3."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != "")

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        sizes = F.filter(F.array(*[F.lit(n) for n in range(low, high + 1)]), lambda n: n <= F.length(padded))
        return F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, n))))

    return F.flatten(F.transform(words, grams))
