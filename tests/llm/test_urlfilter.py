"""URL filters: the digest arrays against a plain search, odd urls, collisions,
and the join that takes lists beyond the size bound."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parityframe.llm import urlfilter as uf

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", "a.b": "block",
         "b/xé": "allow", "b/x": "block", "": "allow", "x.y/a": "allow", "y/aaa": "block"}
URLS = [None, "", "no scheme", "http://", "https://Example.NET/en/1?x#y", "http://example.net", "http://net/", "http://xnet/a",
        "http://a.b.example.com/de/", "http://example.com/deutsch", "ftp://sub.example.org/fr/?q", "http://a.b?c", "http://c.a.b#f",
        "http://z.b/xéz", "http://z.b/xe", "http://..net/", "http://x.y/aaaa", "x://q://net/", "http://net.",
        "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://example.net/en/1?x#y", "http://Ä.net/\nline"]


def plain(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule, verdict in rules.items():
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), len(h), rule, verdict))
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def judged(spark, urls, rules, **kw):
    table = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "i long, url string, host string")
    listed = spark.createDataFrame([*rules.items(), (None, "block")], "rule string, verdict string")
    got = uf.judge_urls(table, listed, **kw).select("i", "host", "path", "rule", "verdict").collect()
    return [tuple(r)[1:] for r in sorted(got)]


@pytest.mark.parametrize("kw", [{}, {"bits": 2}, {"most_bytes": 0}, {"default": "block"}])
def test_as_a_plain_search(spark, kw):
    assert judged(spark, URLS, RULES, **kw) == [plain(u, RULES, kw.get("default", "allow")) for u in URLS]


def test_empty_lists_and_both_verdicts(spark):
    assert judged(spark, URLS[:8], {}) == [plain(u, {}, "allow") for u in URLS[:8]]
    assert judged(spark, URLS[:8], {}, most_bytes=-1) == [plain(u, {}, "allow") for u in URLS[:8]]
    listed = spark.createDataFrame([("NET/", "allow"), ("net/", "block"), ("net/A", "allow")], "rule string, verdict string")
    assert {tuple(r) for r in uf.rule_table(listed).collect()} == {("net/", "block"), ("net/A", "allow")}


part = st.text(alphabet="ab.", max_size=6)
path = st.text(alphabet="/ab", max_size=5).map(lambda p: "/" + p)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.builds(str.__add__, part, st.one_of(path, st.just(""))), st.sampled_from(["block", "allow"]), max_size=12),
       st.lists(st.tuples(part, st.one_of(path, st.just(""))), max_size=12), st.sampled_from([1, 3, 64]))
def test_index_by_random_rules(rules, urls, bits):
    index = uf.UrlIndex(np.frombuffer(uf.UrlIndex.file(rules, bits), np.uint8))
    hosts = sorted({h for h, _ in urls})
    got = index.judge(hosts, np.array([hosts.index(h) for h, _ in urls], int), [p for _, p in urls])
    assert list(zip(*got)) == [tuple(v) for v in (plain(f"x://{h}{p}", rules, None)[2:] for h, p in urls)]
