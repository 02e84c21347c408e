import re

import pytest

from entwine.llm import urls


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])


def fit(host, path):
    fits = [(len(h + p), h + p, k) for k, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    "http://Example.ORG/es/x", "https://a.example.org/en/12?q#f", "http://x.org", "http://x.org/", "ftp://y.com/fr/", "http://y.com/de/1", "http://com/de/",
    "nourl", "", None, "://", "http://?q", "http://h.net#f", "http://xorg/", "http://example.org/en/2", "x://y://z", "HTTP://ÉCOLE.com/fr/a b", "http://a.com\n/de/",
]


@pytest.fixture(scope="module")
def judged(spark):
    pages = [(i, u, None) for i, u in enumerate(URLS)]
    return {r["page_id"]: r.asDict() for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("i", range(len(URLS)))
def test_rules_against_brute_force(judged, i):
    host, path = parse(URLS[i])
    rule, verdict = fit(host, path)
    got = judged[i]
    assert (got["host"], got["path"], got["rule"]) == (host, path, rule)
    assert got["verdict"] == verdict if verdict else got["verdict"] in ("allow", "block")


def brute_mass(edges, seeds):
    """Wave by wave until no host has LEAST to hand on."""
    total, held, new = {}, dict(seeds), dict(seeds)
    for (s, _), n in edges.items():
        total[s] = total.get(s, 0) + n
    while any(m >= urls.LEAST for m in new.values()):
        wave = {}
        for (s, d), n in edges.items():
            m = new.get(s, 0)
            if m >= urls.LEAST:
                wave[d] = wave.get(d, 0) + (m // 1000 * urls.DAMPING + m % 1000 * urls.DAMPING // 1000) * n // total[s]
        for h, m in wave.items():
            held[h] = held.get(h, 0) + m
        new = wave
    return {h: m for h, m in held.items() if m}


def test_spread_against_brute_force(spark):
    edges = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 5, ("c", "a"): 1, ("d", "d2"): 3, **{(f"e{i}", f"e{i + 1}"): 1 for i in range(20)}}
    seeds = {"trust": {"a": 7 * urls.SCALE + 1, "d": urls.SCALE, "e0": urls.SCALE}, "distrust": {"d": 10**6 * urls.SCALE}}
    frame = spark.createDataFrame([(k, *e, n) for k in seeds for e, n in edges.items()], "kind string, src string, dst string, n long")
    got = urls.spread(frame, spark.createDataFrame([(k, *x) for k, own in seeds.items() for x in own.items()], "kind string, host string, mass long"))
    found = {k: {r["host"]: r["mass"] for r in got.collect() if r["kind"] == k and r["mass"]} for k in seeds}
    assert found == {k: brute_mass(edges, own) for k, own in seeds.items()} and found["trust"]["e20"] > 0


PAGES = "page_id long, url string, html string"


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    """A blocked page's sibling host stays blocked whatever else the table holds."""
    own = [(0, "http://a.blogs.com/de/", None), (1, "http://b.blogs.com/", None), (2, "http://blogs.com/", None)]
    for other in (0, 400):
        pages = own + [(10 + i, f"http://h{i % 50}.net.org/", None) for i in range(other)] + [(1000 + i, f"http://z{i % 3}.far.com/de/", None) for i in range(other)]
        got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, PAGES)).collect()}
        assert got[1]["verdict"] == "block" and got[1]["distrust"] > 0 and got[1]["trust"] == 0


def test_awkward_pages(spark):
    """Repeated pages, links without a scheme, very long pages, clashing columns."""
    link = "<a href='//BAD.com/de/'>x</a>"
    pages = [(1, "http://shady.net/", link * 3000), (1, "http://shady.net/", link), (2, "http://bad.com/de/", None), (None, None, link), (4, "http://shady.net/fr", "x" * 300_000)]
    extra = "host string, path string, trust long, rule string, verdict string, kind string, mass long, src string, n long, pages long, _salt int"
    got = urls.judge(spark.createDataFrame([(*p, "q", "q", 9, "q", "q", "q", 9, "q", 9, 9, 9) for p in pages], f"{PAGES}, {extra}")).collect()
    assert sorted((str(r["page_id"]), r["host"], r["verdict"]) for r in got) == [("1", "shady.net", "block")] * 2 + [("2", "bad.com", "block"), ("4", "shady.net", "block"), ("None", "", "allow")]


def test_links_carry_trust_and_distrust(spark):
    link = lambda h: f'<a href="http://{h}/x">x</a>'
    pages = [
        (1, "http://good.org/", link("friend.net")), (2, "http://friend.net/", ""), (3, "http://shady.net/", link("bad.com")), (4, "http://bad.com/de/", None),
        (5, "http://alone.net/", '<a href="/local">x</a>'),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_host_edges(spark):
    pages = spark.createDataFrame([("www.a.example.com", '<A HREF=http://B.net/x> <img src="https://b.net/i"> <a href="/y">'), ("com", None), ("", "x")], "host string, html string")
    got = {(r["src"], r["dst"]): r["n"] for r in urls.host_edges(pages).collect()}
    up = [("www.a.example.com", "a.example.com"), ("a.example.com", "example.com")]
    assert got == {("www.a.example.com", "b.net"): 2} | {e: 1 for e in up} | {e[::-1]: 1 for e in up}


def test_empty_table(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
