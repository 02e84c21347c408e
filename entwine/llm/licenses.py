"""License scans: ordered signature rules behind literals that their patterns need, with priority and containment suppression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, utf8

#: Base phrases: their words must stand one after another.
PHRASES = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}


#: One line per license: label | name | SPDX identifiers | address. Each is a pattern over lower-cased
#: text in which a space stands for any white space. An empty field gives no rule.
SIGNATURES = r"""
mit | (?:mit|expat|x11|mit/x11)(?: open source)? licen[sc]e | mit(?:-0|-cmu|-feh|-modern-variant)?|x11 | opensource\.org/licenses?/mit
mit | permission is hereby granted, free of charge, to any person obtaining a copy | |
mit | the software is provided ["'“]?as is["'”]?, without warranty of any kind | |
apache | apache(?: software)? licen[sc]e,?(?: version| v)?\.? ?(?:1\.[01]|2(?:\.0)?)? | apache-(?:1\.[01]|2\.0) | apache\.org/licenses(?:/license-[12]\.[01])?
apache | unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e | |
gpl | gnu general public licen[sc]e(?:,? version [123](?:\.0)?)? | gpl-[123]\.[01](?:-only|-or-later|\+)? | gnu\.org/(?:licenses|copyleft)/gpl
gpl | this program is free software[:;] you can redistribute it and/or modify it under the terms of | |
gpl | this program is distributed in the hope that it will be useful, but without any warranty | |
lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e | lgpl-[23]\.[01](?:-only|-or-later|\+)? | gnu\.org/(?:licenses|copyleft)/lgpl
agpl | (?:gnu )?affero general public licen[sc]e | agpl-[13]\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl
fdl | gnu free documentation licen[sc]e | gfdl-1\.[123](?:-only|-or-later)? | gnu\.org/(?:licenses|copyleft)/fdl
bsd | (?:(?:new|simplified|modified|original|revised) bsd|bsd(?:[ -][0234][ -]clause)?|[0234][ -]clause bsd)(?:[ -]style)? licen[sc]e | bsd-[1234]-clause(?:-[a-z-]+)?|0bsd | opensource\.org/licenses?/bsd-[123]-clause
bsd | redistribution and use in source and binary forms,? with or without modification,? are permitted | |
bsd | neither the name of .{1,120}? nor the names of its contributors may be used to endorse | |
isc | isc licen[sc]e | isc | opensource\.org/licenses?/isc
isc | permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose with or without fee is hereby granted | |
mpl | mozilla public licen[sc]e,?(?: version| v)?\.? ?(?:1\.[01]|2\.0)? | mpl-(?:1\.[01]|2\.0)(?:-no-copyleft-exception)? | mozilla\.org/(?:en-us/)?mpl
epl | eclipse public licen[sc]e(?:,? version| v\.?)? ?(?:[12]\.0)? | epl-[12]\.0 | eclipse\.org/(?:legal/)?epl
edl | eclipse distribution licen[sc]e | | eclipse\.org/org/documents/edl
cddl | common development and distribution licen[sc]e | cddl-1\.[01] | opensource\.org/licenses?/cddl
cpl | common public licen[sc]e | cpl-1\.0 | opensource\.org/licenses?/cpl
ipl | ibm public licen[sc]e | ipl-1\.0 | opensource\.org/licenses?/ipl
cc0 | cc0(?: 1\.0)?(?: universal)? | cc0-1\.0 | creativecommons\.org/publicdomain/zero
cc-by | creative commons attribution(?: [1-4]\.[05])?(?: international| unported| generic)? licen[sc]e | cc-by-[1-4]\.[05] | creativecommons\.org/licenses/by/
cc-by-sa | creative commons attribution[ -]share ?-?alike(?: [1-4]\.[05])?(?: international| unported| generic)? licen[sc]e | cc-by-sa-[1-4]\.[05] | creativecommons\.org/licenses/by-sa/
cc-by-nd | creative commons attribution[ -]no ?-?derivatives?(?: works)?(?: [1-4]\.[05])? | cc-by-nd-[1-4]\.[05] | creativecommons\.org/licenses/by-nd/
cc-by-nc | creative commons attribution[ -]non ?-?commercial(?: [1-4]\.[05])?(?: international| unported| generic)? licen[sc]e | cc-by-nc-[1-4]\.[05] | creativecommons\.org/licenses/by-nc/
cc-by-nc-sa | creative commons attribution[ -]non ?-?commercial[ -]share ?-?alike | cc-by-nc-sa-[1-4]\.[05] | creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd | creative commons attribution[ -]non ?-?commercial[ -]no ?-?deriv(?:ative)?s? | cc-by-nc-nd-[1-4]\.[05] | creativecommons\.org/licenses/by-nc-nd/
public-domain | (?:released|placed|dedicated|dedicates?|is) (?:in ?to|in|to) the public domain | cc-pddc | creativecommons\.org/licenses/publicdomain
unlicense | (?:the )?unlicense | unlicense | unlicense\.org
unlicense | this is free and unencumbered software released into the public domain | |
wtfpl | do what the f[u*]ck you want to public licen[sc]e | wtfpl | wtfpl\.net
zlib | zlib(?:/libpng)? licen[sc]e | zlib(?:-acknowledgement)? | opensource\.org/licenses?/zlib
zlib | the origin of this software must not be misrepresented | |
libpng | (?:png reference library|libpng) licen[sc]e | libpng(?:-2\.0)? | libpng\.org/pub/png/src/libpng-license
boost | boost software licen[sc]e(?:,? version| -)? ?(?:1\.0)? | bsl-1\.0 | boost\.org/license_1_0
artistic | (?:perl )?artistic licen[sc]e(?: [12]\.0)? | artistic-[12]\.0(?:-perl|-cl8)? | opensource\.org/licenses?/artistic
perl | (?:same terms as perl itself|under the terms of perl) | | dev\.perl\.org/licenses
python | (?:python software foundation|psf|python) licen[sc]e(?: agreement)? | psf-2\.0|python-2\.0 | python\.org/(?:psf/license|license)
php | php licen[sc]e(?:,? version)? ?(?:3\.0[01]?)? | php-3\.0[1]? | php\.net/license
ruby | (?:the )?ruby licen[sc]e | ruby | ruby-lang\.org/en/about/license
eupl | european union public licen[sc]e | eupl-1\.[012] | joinup\.ec\.europa\.eu/.{0,40}eupl
osl | open software licen[sc]e(?: v\.?)? ?(?:[123]\.0)? | osl-[123]\.[01] | opensource\.org/licenses?/osl
afl | academic free licen[sc]e | afl-[123]\.[01] | opensource\.org/licenses?/afl
ms-pl | microsoft public licen[sc]e | ms-pl | opensource\.org/licenses?/ms-pl
ms-rl | microsoft reciprocal licen[sc]e | ms-rl | opensource\.org/licenses?/ms-rl
ncsa | (?:university of illinois/)?ncsa open source licen[sc]e | ncsa | opensource\.org/licenses?/ncsa
upl | universal permissive licen[sc]e | upl-1\.0 | oss\.oracle\.com/licenses/upl
postgresql | postgresql licen[sc]e | postgresql | postgresql\.org/about/licen[sc]e
openssl | openssl(?: and ssleay)? licen[sc]e | openssl | openssl\.org/source/license
openldap | openldap public licen[sc]e | oldap-[12]\.[0-8](?:\.[12])? | openldap\.org/.{0,40}license
ofl | (?:sil )?open font licen[sc]e | ofl-1\.[01](?:-rfn|-no-rfn)? | scripts\.sil\.org/ofl
curl | curl licen[sc]e | curl | curl\.(?:se|haxx\.se)/docs/copyright
beerware | beer-?ware licen[sc]e | beerware |
vim | vim licen[sc]e | vim | vimdoc\.sourceforge\.net/.{0,30}uganda
tcl | tcl/tk licen[sc]e | tcl | tcl\.tk/software/tcltk/license
w3c | w3c software (?:notice and )?licen[sc]e | w3c(?:-[0-9]{8})? | w3\.org/consortium/legal
ijg | independent jpeg group(?:'s)? (?:licen[sc]e|software) | ijg |
unicode | unicode(?:, inc\.)? licen[sc]e agreement | unicode-(?:dfs-201[56]|3\.0|tou) | unicode\.org/(?:copyright|license)
icu | icu licen[sc]e | icu |
cecill | cecill(?:-[bc])?(?: free software)?(?: licen[sc]e)? | cecill-(?:[12]\.[01]|b|c) | cecill\.info
odbl | open (?:data commons open )?database licen[sc]e | odbl-1\.0 | opendatacommons\.org/licenses/odbl
odc-by | open data commons attribution licen[sc]e | odc-by-1\.0 | opendatacommons\.org/licenses/by
pddl | public domain dedication and licen[sc]e | pddl-1\.0 | opendatacommons\.org/licenses/pddl
cdla | community data licen[sc]e agreement | cdla-(?:permissive-[12]\.0|sharing-1\.0) | cdla\.(?:io|dev)
openrail | (?:open |creativeml )*responsible ai licen[sc]e | (?:bigscience-|creativeml-)?openrail(?:-m|\+\+)? | licenses\.ai
sspl | server side public licen[sc]e | sspl-1\.0 | mongodb\.com/licensing/server-side-public-license
busl | business source licen[sc]e | busl-1\.1 | mariadb\.com/bsl
elastic | elastic licen[sc]e(?: 2\.0)? | elastic-2\.0 | elastic\.co/licensing/elastic-license
commons-clause | commons clause(?: licen[sc]e)? condition | | commonsclause\.com
polyform | polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) licen[sc]e | polyform-(?:noncommercial|small-business)-1\.0\.0 | polyformproject\.org/licenses
hippocratic | hippocratic licen[sc]e | hippocratic-2\.1 | firstdonoharm\.dev
blueoak | blue oak model licen[sc]e | blueoak-1\.0\.0 | blueoakcouncil\.org/license
qpl | q public licen[sc]e | qpl-1\.0 | opensource\.org/licenses?/qtpl
sleepycat | sleepycat(?: software)? licen[sc]e | sleepycat |
watcom | sybase open watcom public licen[sc]e | watcom-1\.0 |
zpl | zope public licen[sc]e | zpl-[12]\.[01] | zope\.org/resources/zpl
apsl | apple public source licen[sc]e | apsl-[12]\.[0-2] | opensource\.apple\.com/apsl
nasa | nasa open source agreement | nasa-1\.3 | opensource\.org/licenses?/nasa
rpl | reciprocal public licen[sc]e | rpl-1\.[15] |
mulan | mulan p(?:ermissive )?s(?:oftware )?l(?:icense)? | mulanpsl-[12]\.0 | license\.coscl\.org\.cn/mulanpsl
proprietary | all rights reserved | |
proprietary | (?:proprietary and confidential|confidential and proprietary|strictly prohibited without prior written) | |
proprietary | unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this (?:file|software|document))?.{0,40}(?:is )?strictly prohibited | |
"""
#: Rules in the order of their priority: where detections meet, the earlier kind stays.
KINDS = (
    ("tag", 4, 0.99, r"spdx-license-identifier:\s*\(?(?:{spdx})(?![\w.+-])"),
    ("grant", 3, 0.95, r"(?:licen[sc]ed|released|distributed|available|covered|governed|published|relicensed|redistributed?)\s+(?:is\s+|are\s+)?(?:under|by|pursuant\s+to)\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+(?:the\s+)?)?{name}"),
    ("address", 2, 0.85, r"https?://(?:www\.)?{address}"),
    ("name", 1, 0.7, r"(?<![\w-]){name}(?![\w-])"),
)


def needs(parsed) -> list[frozenset[bytes]]:
    r"""What every match of a parsed pattern holds once runs of white space are single spaces: one literal of each set.

    Literals that stand one after another are one, `\s+` is a space, and anything else
    ends a literal; a group of alternatives needs a literal of each of them, or it gives no set.
    """
    out, run = [], bytearray()

    def end() -> None:
        if len(run) > 1:
            out.append(frozenset({bytes(run)}))
        run.clear()

    def walk(part) -> None:
        for op, arg in part:
            if op is parser.LITERAL and arg in b" \t\n\r\f\v" or op is parser.MAX_REPEAT and arg[0] and list(arg[2]) == SPACE:
                if run.endswith(b" "):  # one space in the text may be both
                    end()
                run.extend(b" ")
            elif op is parser.LITERAL:
                run.append(arg)
            elif op is parser.SUBPATTERN:
                walk(arg[3])
            elif op is parser.BRANCH:
                end()
                best = [max(needs(x), key=selectivity, default=None) for x in arg[1]]
                if None not in best:
                    out.append(frozenset().union(*best))
            else:
                end()
                if op is parser.MAX_REPEAT and arg[0]:
                    walk(arg[2])
                    end()

    walk(parsed)
    end()
    return out


def selectivity(literals: frozenset[bytes]) -> tuple[int, int]:
    return min(map(len, literals)), -len(literals)


SPACE = list(parser.parse(rb"\s"))


class Rule:
    def __init__(self, label: str, kind: str, priority: int, confidence: float, pattern: str):
        self.label, self.kind, self.priority, self.confidence = label, kind, priority, confidence
        self.pattern = re.compile(pattern.encode(), re.S)
        self.needs = sorted(needs(parser.parse(pattern.encode(), re.S)), key=selectivity, reverse=True)
        #: The most telling of the needs, alternatives parted by |.
        self.keyword = b"|".join(sorted(self.needs[0]))


def rules() -> list[Rule]:
    """All signature rules by priority, then in the order of the table."""
    out = []
    for kind, priority, confidence, form in KINDS:
        for line in SIGNATURES.strip().splitlines():
            # a | parts fields where it has a space before it and a space or nothing after it
            label, name, spdx, address = (x.strip() for x in (*re.split(r" \|(?= |$)", line), "", "")[:4])
            if not {"tag": spdx, "grant": name, "address": address, "name": name}[kind]:
                continue
            loose = lambda p: re.sub(r" (\??)", lambda m: r"\s*" if m[1] else r"\s+", p)
            out.append(Rule(label, kind, priority, confidence, form.format(spdx=spdx, name=f"(?:{loose(name)})", address=address)))
    return out


_RULES: list[Rule] = []
_LITERALS: list[bytes] = []


def detect(text: bytes) -> tuple[list[tuple[int, int, Rule]], int]:
    """Detections (start, end, rule) in lower-cased text, without those that others suppress; and how many were.

    Higher priority goes first, then longer, then earlier, then the rule's order. A detection that lies inside one
    that stays, or overlaps it, is suppressed, so that those that stay are disjoint.
    """
    if not _RULES:
        _RULES.extend(rules())
        _LITERALS.extend(sorted({k for r in _RULES for any_of in r.needs for k in any_of}))
    plain = b" %b " % b" ".join(text.split())
    present = {k for k in _LITERALS if k in plain}
    found = [(m.start(), m.end(), n) for n, r in enumerate(_RULES) if all(map(present.intersection, r.needs)) for m in r.pattern.finditer(text) if m.end() > m.start()]
    found.sort(key=lambda d: (-_RULES[d[2]].priority, d[0] - d[1], d[0], d[2]))
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for s, e, n in found:
        i = bisect_right(starts, s)
        if (i and ends[i - 1] > s) or (i < len(starts) and starts[i] < e):
            continue
        starts.insert(i, s)
        ends.insert(i, e)
        kept.append((s, e, _RULES[n]))
    return sorted(kept, key=lambda d: d[0]), len(found) - len(kept)


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand one after another."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        wanted, at, word, done = b" " + b" ".join(phrase) + b" ", -1, 0, 0
        while (at := joined.find(wanted, at + 1)) >= 0:
            word += joined.count(b" ", done, at)
            done = at
            out.append((word, label))
    return sorted(out)


DETECTIONS = "array<struct<start: long, end: long, label: string, kind: string, confidence: double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]))
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, lower = text.translate(LETTERS).split(), text.lower()
            places = phrase_places(words) if b"license" in lower else []
            found, lost = detect(lower)
            out.append((
                doc, len(words), len(places), min(p[0] for p in places) if places else None, max(p[0] for p in places) if places else None, sorted({p[1] for p in places}),
                [{"start": s, "end": e, "label": r.label, "kind": r.kind, "confidence": r.confidence} for s, e, r in found], lost,
            ))
        cols = list(zip(*out)) or [()] * 8
        kinds = [pa.int64()] * 5 + [pa.list_(pa.string()), spans, pa.int64()]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "detections", "n_suppressed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base (labels of the base phrases),
    detections (byte spans in the UTF-8 text with label, rule kind and confidence) and n_suppressed.

    Whole texts are searched in one pass without a shuffle. Null or empty text: no words and no detections. Repeated
    rows give repeated rows; an empty table gives none. Only doc_id and text are read.
    """
    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, detections {DETECTIONS}, n_suppressed long"
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(_scan, schema)


def digest(scanned: DataFrame) -> DataFrame:
    """scan() in flat columns: base_labels and labels as sorted comma lists (empty without any), and a score: the
    highest confidence among the detections that stay, 0.7 at least where a base phrase stands, else 0."""
    labels = F.array_sort(F.array_union("base", F.array_distinct(F.transform("detections", lambda d: d["label"]))))
    least = F.when(F.col("n_base") > 0, 0.7).otherwise(0.0)
    best = F.aggregate("detections", F.lit(0.0), lambda a, d: F.greatest(a, d["confidence"]))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(least, best).alias("score"), F.size("detections").cast("long").alias("n_detections"), "n_suppressed",
    )
