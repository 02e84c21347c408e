import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [a + b + c for a in ("th", "er", "on", "an", "re") for b in ("ea", "ou", "in", "at") for c in ("", "st", "nd", "ly")]


def prose(rng, n):
    """n words in sentences of seven."""
    words = [rng.choice(VOCABULARY) for _ in range(n)]
    return " ".join(w.capitalize() if i % 7 == 0 else w + "." * (i % 7 == 6) for i, w in enumerate(words))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1):
    """Awkward documents: copies, near copies, nulls, empty and long texts, odd white space, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((1, 2, 3, 5, 8, 30, 60, 120))) for _ in range(40)]
    for base in texts[:12]:
        texts += [base, edited(rng, base, 0.03), edited(rng, base, 0.06), edited(rng, base, 0.15)]
    texts += [None, "", " \t\n", None, "a\x0bb\x0cc", "É " * 40, prose(rng, 6000), "MIT License applies", "x" * 3000, "<|endoftext|> the end"]
    rng.shuffle(texts)
    rows = [(i * 3, t, ("en", "fr", None)[i % 3], f"src{0 if i % 3 else i % 7}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], rows[9]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with those that operators make."""
    extra = "kept boolean, n int, node string, digest string, keys string, shard string, items string, word string, row int, part string, block string"
    return spark.createDataFrame([(*r, True, 1, "x", "x", "x", "x", "x", "x", 1, "x", "x") for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nullish(spark):
    """Null ids, null texts, nothing else."""
    return spark.createDataFrame([(None, None, None, None, None), (None, "a b", None, None, None), (1, None, None, None, None)], SCHEMA)
