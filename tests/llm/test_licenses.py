import re
from re import _parser as parser

import pytest

from entwine.llm import licenses

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [p[0] for p in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


TEXTS = [
    "MIT License", "mit  license MIT-License; apache/license mit\nlicense", "permit license", "the GNU General Public License and MIT license é license", "general public licenses", None, "", "\x00 mit\x7flicense 1",
    "MIT LICENSE " * 50, "naïve mit licenseé", "a" * 5000 + " apache license",
]


def test_base_columns_against_brute_force(spark, docs, rows):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.digest(licenses.scan(frame)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    more = sorted(tuple(r)[:6] for r in licenses.digest(licenses.scan(docs)).collect())
    assert more == sorted((r[0], *brute(r[1])) for r in rows)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX-License-Identifier: GPL-2.0-only", ["gpl"]),
        ("SPDX-License-Identifier: (MIT", ["mit"]),
        ("Licensed under the Apache License, Version 2.0", ["apache"]),
        ("GNU Lesser General Public License", ["lgpl"]),
        ("under the GNU Affero General Public License v3", ["agpl"]),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]),
        ("released under the Mozilla Public License 2.0 and the ISC license", ["mpl", "isc"]),
        ("this is free and unencumbered software released into the public domain", ["unlicense"]),
        ("No license is granted; the mitten is red", []),
        ("All rights reserved.", ["proprietary"]),
        ("openldap public license, see https://www.openldap.org/software/release/license.html", ["openldap", "openldap"]),
    ],
)
def test_signatures(text, labels):
    assert [d[2].label for d in licenses.detect(text.lower().encode())[0]] == labels


def test_detections_are_disjoint_and_priority_wins():
    text = b"licensed under the mit license. mit license. spdx-license-identifier: mit"
    found, lost = licenses.detect(text)
    assert [d[2].kind for d in found] == ["grant", "name", "tag"] and lost >= 1
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_hundreds_of_rules_each_behind_its_keyword():
    rules = licenses.rules()
    assert len(rules) > 200
    assert [r.priority for r in rules] == sorted((r.priority for r in rules), reverse=True)
    assert all(r.keyword and r.keyword == r.keyword.lower() for r in rules)


def test_scores_and_labels(spark):
    frame = spark.createDataFrame([(1, "MIT license; under the terms of the BSD license"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(frame)).collect()}
    assert got[1]["labels"] == "bsd,mit" and 0.7 <= got[1]["score"] <= 1
    assert (got[2]["labels"], got[2]["score"], got[3]["labels"], got[3]["n_words"]) == ("", 0, "", 0)


def test_empty_and_null(empty, nullish):
    assert licenses.scan(empty).count() == 0 and licenses.scan(nullish).count() == 3


def examples(part):
    """A text for every branch, with and without what is optional (one at a time), of a parsed pattern."""
    base, out = b"", []
    for op, arg in part:
        many = [b""]
        if op is parser.LITERAL:
            many = [bytes([arg])]
        elif op is parser.ANY:
            many = [b"x"]
        elif op is parser.IN:
            first = arg[0]
            many = [b"\n" if first[0] is parser.CATEGORY else bytes([first[1][0] if first[0] is parser.RANGE else first[1]])]
        elif op is parser.SUBPATTERN:
            many = examples(arg[3])
        elif op is parser.BRANCH:
            many = [x for branch in arg[1] for x in examples(branch)]
        elif op is parser.MAX_REPEAT or op is parser.MIN_REPEAT:
            inner = examples(arg[2])
            spaced = inner == [b"\n"] and arg[1] > 1
            many = ([b" \t\n"] if spaced else [x * max(1, arg[0]) for x in inner]) + ([b""] if not arg[0] else [])
        out = [o + many[0] for o in out] + [base + m for m in many[1:]]
        base += many[0]
    return [base, *out]


def ungated(text):
    all_rules = licenses.rules()
    return sum(1 for r in all_rules for m in r.pattern.finditer(text) if m.end() > m.start())


def test_gated_equals_ungated_on_every_rule_and_branch():
    seen = 0
    for r in licenses.rules():
        plain = {x for x in examples(parser.parse(r.pattern.pattern, re.S)) if r.pattern.search(x)}
        assert plain, r.pattern.pattern
        for text in plain:
            collapsed = b" %b " % b" ".join(text.split())
            assert all(any(k in collapsed for k in any_of) for any_of in r.needs), (r.label, r.kind, text)
            seen += 1
    assert seen > 1000


@pytest.mark.parametrize(
    "text, label",
    [
        ("released under the Mulan PSL v2", "mulan"), ("distributed under CeCILL", "cecill"), ("https://www.mozilla.org/MPL/2.0/", "mpl"), ("https://www.gnu.org/copyleft/gpl.html", "gpl"),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"), ("Commons Clause condition", "commons-clause"), ("https://mariadb.com/bsl11/", "busl"),
        ("https://scripts.sil.org/OFL", "ofl"), ("neither the name of X nor the names of its contributors may be used to endorse", "bsd"), ("GNU General\n   Public License", "gpl"),
        ("this work is in the public\ndomain and is  released to the public \t domain", "public-domain"), ("all\nrights reserved", "proprietary"),
    ],
)
def test_no_gate_hides_what_a_rule_matches(text, label):
    text = text.lower().encode()
    found, lost = licenses.detect(text)
    assert label in [d[2].label for d in found] and len(found) + lost == ungated(text)
