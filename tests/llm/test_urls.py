"""URL rules: the trie and the join against plain Python."""

from __future__ import annotations

import random

from quarry.llm import urls


def slow(host, path, rules):
    best = (None, None)
    for text, verdict in rules:
        rule_host, slash, rest = text.partition("/")
        fits = (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest)
        if fits and (best[0] is None or (len(text), verdict == "block") > (len(best[0]), best[1] == "block")):
            best = (text, verdict)
    return best


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut : max(cut, end)]


def test_trie_and_join_equal_brute_force(spark):
    rng = random.Random(1)
    labels, parts = ["a", "b", "org", "x"], ["", "/", "/e", "/en", "/en/", "/en/1", "/en/12/", "//", "/1"]
    rules = [(".".join(rng.choices(labels, k=rng.randrange(1, 4))) + rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(40)]
    seen = [None, "", "no scheme", "http://", "://a.org", "http://A.b.ORG/en/12/x?y#z", "http://x?q", "ftp://x#/en", "http://a.org?u=http://b/en"]
    seen += [f"http://{'.'.join(rng.choices(labels, k=rng.randrange(1, 5)))}{rng.choice(parts)}{rng.choice(['', '3', '/z', '?a'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(seen)], "page_id int, url string, rule string")
    table = spark.createDataFrame([*rules, (None, "block"), ("a", None)], "text string, verdict string")
    for bound in (200_000, 3):
        got = {r.page_id: r for r in urls.filter_urls(pages, table, max_rules=bound, default="unknown").collect()}
        assert len(got) == len(seen)
        for i, url in enumerate(seen):
            host, path = split(url)
            rule, verdict = slow(host, path, rules)
            assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "unknown"), url
    assert urls.filter_urls(pages.limit(0), table).count() == 0
    assert {r.verdict for r in urls.filter_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_long_urls_repeats_and_any_columns(spark):
    long = "http://a.org/" + "x/" * 200_000 + "?q"
    rows = [(1, long, "h", "p", "r"), (2, "http://a.org/", "h", "p", "r"), (2, "http://a.org/", "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id int, url string, _host string, _path string, host string")
    table = spark.createDataFrame([("a.org/", "block"), ("a.org/x/x", "allow")], "text string, verdict string")
    for bound in (10, 1):
        got = sorted(urls.filter_urls(pages, table, max_rules=bound).collect(), key=lambda r: r.page_id)
        assert [(r.page_id, r.rule, r.verdict, r._host, r._path, r.host) for r in got] == [(1, "a.org/x/x", "allow", "h", "p", "a.org")] + [(2, "a.org/", "block", "h", "p", "a.org")] * 2
        assert len(got[0].path) == 400_001
