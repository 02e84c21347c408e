"""Hand cases of text and geographic functions."""

import pytest
from pyspark.sql import functions as F

from entwine.functions import geo, text


def apply(spark, function, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return row.select(function(*[F.col(n) for n in names]).alias("out")).first()["out"]


@pytest.mark.parametrize(
    "name, clean",
    [
        ("Acme Pvt. Ltd.", "acme ltd"),
        ("Acme Private Limited", "acme ltd"),
        ("Private  Limited Co", "private limited co"),
        ("Foo Corporation", "foo corp"),
        ("Foo Incorporated", "foo inc"),
        ("Café  Straße\t& Söhne", "cafe strasse sohne"),
        ("12 Main Street", "12 main st"),
        ("", ""),
        (None, ""),
        ("日本", ""),
        ("Łódź Ærø þing", "lodz aero thing"),
    ],
)
def test_clean_name(spark, name, clean):
    assert apply(spark, text.clean_name, name) == clean


def test_punctuation_is_what_the_pattern_takes(spark):
    """All of ASCII by the table, and other characters, which folding does not leave, by the pattern."""
    kept = set("abcdefghijklmnopqrstuvwxyz0123456789_") | {chr(i) for i in (*range(9, 14), *range(0x1C, 0x21))}
    for value in ("".join(map(chr, range(128))), "A\u00e9\u4e2d\u2028b\x00\t-_"):
        assert apply(spark, text.depunctuate, value) == "".join(c if c in kept else " " for c in value.lower())
    assert set(text.PUNCTUATION) == set(map(chr, range(128))) - kept - set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    assert apply(spark, text.depunctuate, None) is None


def test_collapse_takes_every_white_space(spark):
    assert apply(spark, text.collapse, " a\tb  c \x1c d\re \n") == "a b c d e"


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


@pytest.mark.parametrize("start", ["Private Limited ", "Pvt. Ltd. ", "pvt" + " " * 200 + "ltd ", "pvt" + " " * 100 + "ltd", "Private Limitedx ", "." * 130 + "Pvt ltd ", "\u00c9 ", "\u4e2d", "", "street ", "x" * 200])
def test_first_letter_is_that_of_the_clean_name(spark, start):
    """Of long names, the head alone is cleaned."""
    for name in (start, start + LONG, start + LONG + " street " + LONG * 9):
        assert apply(spark, text.first_letter, name) == apply(spark, text.clean_name, name)[:1]
    assert apply(spark, text.first_letter, None) == ""


def test_address_keeps_suffixes(spark):
    assert apply(spark, text.clean_address, "12 Main Street") == "12 main street"
    assert apply(spark, text.clean_address, None) == ""


@pytest.mark.parametrize(
    "address, code",
    [
        ("5 rue x, 75001 Paris", "75001"),
        ("5 rue x, 75001 Saint Denis", None),
        ("x 560001, India", None),
        ("560001 mg road 560002", "560002"),
        ("x 560001 .", "560001"),
        ("1234567", None),
        (None, None),
    ],
)
def test_pin(spark, address, code):
    assert apply(spark, geo.pin, address) == code


@pytest.mark.parametrize(
    "address, country, expected",
    [
        ("12/3, MG Road, Pune, India", "India", ("india", None, "pune", "mg_road")),
        ("Nagar, Pune", "India", ("india", None, "pune", None)),
        (None, "India", ("india", None, None, None)),
        ("Lyon", None, ("", None, "lyon", None)),
        ("a, b, , 75001", " France ", ("france", "75001", None, None)),
        ("Saint-Étienne‚ Loire,Ærø\t Vest, 日本 ,", "France", ("france", None, "aero_vest", "saint_etienne_loire")),
        ("no 5\u20ac, a-411001-b ,, New  Town", "new town", ("new town", None, "a_b", "no_5eur")),
    ],
)
def test_layers(spark, address, country, expected):
    assert tuple(apply(spark, geo.layers, address, country)) == expected


def test_base_key(spark):
    key = lambda a, c: geo.base_key(geo.layers(a, c))
    assert apply(spark, key, "x, Pune 411001", "India") == "india_411001"
    assert apply(spark, key, "x, Pune", "India") == "india_pune"
    assert apply(spark, key, None, "India") == "india_unknown"
    assert apply(spark, key, "", None) == "_unknown"


@pytest.mark.parametrize(
    "word, code",
    [
        ("thompson", "0MPSN"), ("knight", "NT"), ("physics", "FSKS"), ("school", "SKL"), ("church", "XRX"), ("bridge", "BRJ"), ("wrack", "RK"),
        ("apple pie", "APL P"), ("action", "AKXN"), ("comb", "KM"), ("exit", "EKST"), ("42", ""), ("", ""), ("yes why", "YS"),
        ("science", "SNS"), ("scene scythe", "SN S0"), ("conscious", "KNSS"), ("school scan", "SKL SKN"), ("aeon aisle", "EN ASL"), ("sign signed gnome", "SN SNT NM"), ("aa bookkeeper", "A BKPR"),
    ],
)
def test_metaphone(spark, word, code):
    assert apply(spark, text.metaphone, word) == code


def test_codes_by_words_are_those_of_names(spark, monkeypatch):
    """Codes by distinct words, from what a worker keeps too, equal the rules on whole names."""
    import random

    import pyarrow as pa

    draw = random.Random(7)
    words = ["gh", "high", "ghost", "sigh", "laughed", "42", "a_b", "x", "xgh1", "ghh", "sign", "signed", "comb", "wh", "why", "mbmb", "ahah", "aah", "science", "cia", "edge"]
    words += ["".join(draw.choice("aeghbmnckstwxy01_") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    names = ["", "42", *words, *(" ".join(draw.choice(words) for _ in range(draw.randint(1, 9))) for _ in range(500))]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(names)), "i int, n string").repartition(1).sortWithinPartitions("i").select(text.metaphone(F.col("n"))).collect()]
    monkeypatch.setattr(text, "KNOWN_WORDS", 50)
    assert text.name_codes(pa.array(names)).to_pylist() == want
    assert text.name_codes(pa.array(names[::-1])).to_pylist() == want[::-1]


def test_tokens_keep_repetitions(spark):
    assert apply(spark, lambda c: text.tokens(c, ("the",)), "The cat a the cat_1 b2 é") == ["cat", "cat_1", "b2"]
    assert apply(spark, lambda c: text.tokens(c, ()), None) == []


def test_char_ngrams(spark):
    grams = apply(spark, text.char_ngrams, "ab c")
    assert sorted(grams) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert apply(spark, text.char_ngrams, "") == []


def keys(spark, rows, upper, lower, scope=()):
    df = spark.createDataFrame(rows, "id int, source int, base_key string, country string, chunk_1 string, chunk_2 string, clean_name string")
    df = df.withColumn("geo", F.struct("country", "chunk_1", "chunk_2"))
    out = geo.assign_block_keys(df, upper, lower, list(scope))
    return {r["id"]: r["geo_block_key"] for r in out.collect()}


def test_block_keys_three_passes(spark):
    rows = [(i, 0, "in_pune", "in", "pune", "camp" if i < 3 else None, "abc") for i in range(6)]
    rows += [(10, 0, "in_goa", "in", "goa", None, "x"), (11, 0, "in_400001", "in", None, None, "y"), (12, 0, "in_400001", "in", None, None, "y")]
    out = keys(spark, rows, upper=5, lower=2)
    assert {out[i] for i in range(3)} == {"in_camp_pune"}
    assert {out[i] for i in range(3, 6)} == {"in_pune"}
    assert out[10] == "in_unknown" and out[11] == "in_400001"


def test_block_key_limits_are_strict(spark):
    rows = [(i, 0, "in_pune", "in", "pune", "camp", "abc") for i in range(5)]
    assert set(keys(spark, rows, upper=5, lower=5).values()) == {"in_pune"}
    assert set(keys(spark, rows, upper=4, lower=6).values()) == {"in_unknown"}


def test_large_unknown_block_is_split_by_letter(spark):
    rows = [(i, 0, "in_unknown", "in", None, None, "abc" if i % 2 else "") for i in range(6)]
    assert set(keys(spark, rows, upper=5, lower=1).values()) == {"in_unknown_a", "in_unknown_z"}


def test_joint_and_per_source_keys(spark):
    rows = [(i, i % 2, "in_pune", "in", "pune", "camp", "abc") for i in range(6)]
    assert set(keys(spark, rows, upper=5, lower=1).values()) == {"in_camp_pune_a"}  # six rows stay above five after the first pass
    assert set(keys(spark, rows, upper=5, lower=1, scope=["source"]).values()) == {"in_pune"}


#: Texts whose folding, punctuation, white space or suffixes are out of the ordinary.
ODD = [
    None, "", " ", "Straße der Ägäis…", "pvt  ltd", "PVT. LTD. x", "Acme Private Limited", "acme private\x1climited", "pvt\x1cltd", "broad roads Road", "a\x00b\x7fc\x1dd\u00a0e", "日本語 Cafe\u0301 ½ €5",
    "İstanbul K ſtreet", "under_score-street  CORPORATION\tincorporated", "x" * 200 + " boulevard", "‚a‘b’ «c» pvt private limited", "night high ghost sigh", "don't — stop\r\nthe 12a",
]


def test_texts_cleaned_in_batches_equal_expressions(spark):
    from entwine.config import BlockingConfig
    from entwine.plans import normalize

    rows = [(f"S{1 + i % 3}-{i}", i % 3, name, address, ["en", "fr", None][i % 3]) for i, (name, address) in enumerate((n, a) for n in ODD for a in (None, "12 Old Road, Area 51, Köln 50667", ODD[-2]))]
    records = spark.createDataFrame(rows, "entity_id string, source byte, business_name string, business_address string, country string")
    for config in (BlockingConfig(upper_threshold=15, lower_threshold=3), BlockingConfig(upper_threshold=5, lower_threshold=2, suffix_address=True, joint_thresholds=False)):
        columns = ["entity_id", "source", "country", "geo_block_key", "phonetic_hash", "search_document"]
        want = normalize.normalize(records, config).select(*columns)
        assert sorted(map(repr, normalize.matched(records, config, *columns[3:]).collect())) == sorted(map(repr, want.collect()))
    assert normalize.matched(records.limit(0), config, "phonetic_hash", "search_document").count() == 0


def test_tokens_of_batches_equal_expressions(spark):
    import pyarrow as pa

    for stopwords in ((), ("the", "der", "cafe")):
        want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(ODD)], "i int, t string").coalesce(1).select(text.tokens(F.col("t"), stopwords)).collect()]
        row, number, words = text.batch_tokens(pa.array(ODD, pa.string()), stopwords)
        known = words.to_pylist()
        assert [[known[n] for n in number[row == i]] for i in range(len(ODD))] == want
