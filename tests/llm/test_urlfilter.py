import time

import pytest

from marlstone.llm import urlfilter
from marlstone.llm.urlfilter import Rule

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def run(spark, rows, **how):
    out = urlfilter.judge(spark.createDataFrame([(*r, "h", "v") for r in rows], SCHEMA), **how)
    return {r.page_id: r for r in out.collect()}


def test_parts_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1?q", "https://example.com/en/", "https://a.example.com/EN/x", "http://x.net/fr/?a", "http://x.net/fr", "http://com", "http://notcom/", "no scheme", None, "://ÄB.net/es/#f", "http://a.com?x=http://b.net/es/"]
    out = run(spark, [(i, u, None) for i, u in enumerate(urls)])
    got = [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(len(urls))]
    assert got == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/EN/x", "com/", "allow"),
        ("x.net", "/fr/", "net/fr/", "block"), ("x.net", "/fr", None, "allow"), ("com", "", None, "allow"), ("notcom", "/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("Äb.net", "/es/", "net/es/", "block"), ("a.com", "", None, "allow"),
    ]


def slow_rank(edges, seeds, damping=0.85, rounds=10):
    total = sum(seeds.values())
    seeds = {h: w / total for h, w in seeds.items()}
    out = {}
    for (s, _), n in edges.items():
        out[s] = out.get(s, 0) + n
    mass = dict(seeds)
    for _ in range(rounds):
        came = {}
        for (s, d), n in edges.items():
            came[d] = came.get(d, 0) + mass.get(s, 0) * n / out[s]
        lost = 1 - sum(came.values())
        mass = {h: (1 - damping + damping * lost) * seeds.get(h, 0) + damping * came.get(h, 0) for h in {*seeds, *came}}
    return mass


PAGES = [
    (1, "http://good.com/", '<a href="http://friend.org/x">f</a> <a class=b href=//friend.org/y>g</a> <A HREF=\'https://Other.org\'>'),
    (2, "http://bad.net/es/1", '<a href="http://bait.org/">'),
    (3, "http://farm.org/", '<a href="http://bad.net/es/1"><a href="http://bad.net/es/2"><a href="/self">'),
    (4, "http://friend.org/", '<a href="http://farm.org/">'),
    (5, "http://bait.org/", None), (6, "http://other.org/", ""), (7, None, '<a href="http://bad.net/">'), (3, "http://farm.org/", '<a href="http://bad.net/es/1"><a href="http://bad.net/es/2"><a href="/self">'),
]


def test_propagation_matches_brute_force(spark):
    out = run(spark, PAGES)
    edges = {("good.com", "friend.org"): 2, ("good.com", "other.org"): 1, ("bad.net", "bait.org"): 1, ("farm.org", "bad.net"): 4, ("friend.org", "farm.org"): 1}
    trust = slow_rank(edges, {"good.com": 1})
    distrust = slow_rank({(d, s): n for (s, d), n in edges.items()}, {"bad.net": 1})
    for i, host in ((1, "good.com"), (2, "bad.net"), (3, "farm.org"), (4, "friend.org"), (5, "bait.org"), (6, "other.org")):
        assert out[i].trust == pytest.approx(trust.get(host, 0)) and out[i].distrust == pytest.approx(distrust.get(host, 0))
        if i not in (1, 2):
            assert out[i].verdict == ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow")
    assert {i: out[i].verdict for i in (1, 2, 3, 5, 6, 7)} == {1: "allow", 2: "block", 3: "block", 5: "allow", 6: "allow", 7: "allow"}


def test_other_rules_and_empty_table(spark):
    assert run(spark, [(1, "http://a.b/c", None)], rules=[Rule("block", "b", "/c"), Rule("allow", "b", "")])[1].verdict == "block"
    assert run(spark, []) == {}


def test_work_grows_with_the_page_only(spark):
    """Open anchors without an end, as in a cut page: ten times the page costs about ten times."""

    def took(html):
        df = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
        began = time.perf_counter()
        rows = urlfilter.host_edges(df).collect()
        return time.perf_counter() - began, rows

    for piece in ("<a ", "<a href", "<a href=", "<a x='", "<a href=a:"):
        took(piece * 100)
        small, large = took(piece * 40_000), took(piece * 400_000 + '<a href="http://b.org/">')
        assert large[0] < 25 * small[0] + 3, piece
        assert [tuple(r) for r in large[1]] == [("a.org", "b.org", 1)]


def test_very_long_urls(spark):
    host = "a." * 100_000 + "net"
    out = run(spark, [(1, f"http://{host}/fr/{'x' * 200_000}", None), (2, "://" * 100_000, None)])
    assert (out[1].host, out[1].rule, out[1].verdict) == (host, "net/fr/", "block") and out[2].verdict == "allow"
