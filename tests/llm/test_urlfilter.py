"""URL filter against plain versions; canonical URLs; long URLs; the Bloom filter itself."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import urlfilter

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("b.org/x", "block"), ("b.org/x", "allow"), (None, "block")]
LISTED = [("http://Spam.example.com:80", "block"), ("ok.spam.example.com/fine/", "allow"), ("https://u:p@page.org./a/../one%2Ehtml?q#f", "block"), ("page.org/dir/", "block"), (None, "block"), ("page.org/%c3%a9", "block")]
HOSTS = ["example.net", "WWW.Example.NET", "net", "a.example.com", "example.com", "xexample.com", "b.org", "c.b.org", "", "x.net:80", "example.net.", "spam.example.com", "me@a.SPAM.example.com:8080", "ok.spam.example.com", "page.org", "www.page.org", "page.org.", ".page.org", "..", "pa%67e.org"]
PATHS = ["", "/", "/en/", "/en/x?y=/fr/", "/de/1#a", "/fr/", "/xyz", "?q", "/a//b/", "/one.html", "/%6fne.html", "/x/../one.html", "/./one.html", "/dir", "/dir/..", "/dir/x", "/a/../dir/y", "/%C3%a9", "/fine/x", "//one.html", "/one.html/"]


def plain(url):
    """host, path, rule, listed, verdict."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for e, _ in RULES:
        if e:
            h, p = e.split("/", 1)
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(e), e.index("/"), e, max(v for x, v in RULES if x == e)))
    if fits:
        return host, path, max(fits)[2], None, max(fits)[3]
    fits = []
    own, below = urlfilter.canonical(host, path)
    for e, v in LISTED:
        if e and host:
            key = urlfilter.listed_key(e)[2:]
            h, p = key.split("/", 1)
            if key.endswith("/") and (own == h or own.endswith("." + h)) and below.startswith("/" + p) or key == own + below:
                fits.append((v == "block", key, v))
    return host, path, None, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


@pytest.mark.parametrize("few", [200_000, 0])
def test_urls(spark, monkeypatch, few):
    monkeypatch.setattr(urlfilter, "BROADCAST_FOUND", few)
    urls = [f"{s}://{h}{p}" for s in ("http", "a") for h in HOSTS for p in PATHS] + ["x://b://net/", "none", "", None, "http://net/"]
    pages = spark.createDataFrame([(k, u, "h", "r", "k", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, key string, row int")
    lists = [spark.createDataFrame(x, "entry string, verdict string") for x in (RULES, LISTED)]
    got = {r["page_id"]: r for r in urlfilter.judge(pages, *lists).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert tuple(got[k][c] for c in ("host", "path", "rule", "verdict")) == tuple(plain(u)[i] for i in (0, 1, 2, 4)), u
        assert (got[k]["listed"] is None) == (plain(u)[3] is None), u
    if few:
        empty = urlfilter.judge(pages, *(x.limit(0) for x in lists))
        assert empty.where("rule is not null or listed is not null or verdict <> 'allow'").isEmpty()
        assert urlfilter.judge(pages.limit(0), *lists).count() == 0
        again = urlfilter.judge(pages.unionByName(pages), *lists)
        assert again.count() == 2 * len(urls)


@pytest.mark.parametrize("written,want", [
    (("user@Host.org:80", ""), ("Host.org", "/")), (("host.org..", "/a/./b/../c"), ("host.org", "/a/c")), (("h", "/%7Ea%2f%c3%A9"), ("h", "/~a%2F%C3%A9")),
    (("h", "/../.."), ("h", "/")), (("h", "/a/.."), ("h", "/")), (("h", "/a/b/.."), ("h", "/a/")), (("h", "//a///b//"), ("h", "/a/b/")), (("h", "/a/..b/..."), ("h", "/a/..b/...")), (("h", "/%"), ("h", "/%")), (("h", "/%2e%2e/a"), ("h", "/a")),
])
def test_canonical(written, want):
    assert urlfilter.canonical(*written) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["/", ".", "..", "a", "%2e", "%41", "b", "//"]), max_size=12).map("".join))
def test_canonical_is_settled(path):
    once = urlfilter.canonical("h", "/" + path)
    assert urlfilter.canonical(*once) == once


def test_long_urls_take_linear_time():
    shape = {"rules": 1, "listed": 1, "rule_labels": 3, "rule_folders": 4, "rule_lengths": [2, 7], "labels": 4, "folders": 9}
    for url in ("http://" + "a." * 500_000 + "net/en/" + "x/" * 500_000, "http://h.net/" + "../" * 330_000, "http://h.net/" + "%2E/" * 250_000, "http://h.net" + "/" * 10**6, "h" * 10**6 + "://", "http://" + "@" * 10**6, "http://h" + "." * 10**6):
        began = time.perf_counter()
        _, _, keys = urlfilter.keys_of(url, shape)
        assert time.perf_counter() - began < 1 and len(keys) < 100 and sum(map(len, keys)) < 100 * 2 * urlfilter.ENTRY


def test_long_rows_and_entries(spark):
    pages = spark.createDataFrame([(1, "http://spam.org/" + "x/" * 500_000), (2, "http://" + "a." * 300_000 + "spam.org/"), (3, None)], "page_id long, url string")
    none = spark.createDataFrame([], "entry string, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, none, spark.createDataFrame([("spam.org", "block")], none.schema)).select("page_id", "verdict").collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
    with pytest.raises(Exception, match="longer than"):
        urlfilter.judge(pages, none, spark.createDataFrame([("h.org/" + "x" * 3000, "block")], none.schema)).count()


def test_bloom_filter_misses_nothing(spark):
    entries = spark.createDataFrame([(f"host{k}.net/", "block") for k in range(3000)], "entry string, verdict string")
    own = urlfilter.entries(entries, False)
    words = urlfilter.build(own)
    hashes = np.array([r["h"] for r in own.collect()])
    other = urlfilter._hashes([f"s other{k}.net/" for k in range(20000)])
    assert urlfilter.contains(words, hashes).all() and urlfilter.contains(words, other).mean() < 0.02
    tight = urlfilter.build(own, max_bytes=64)
    assert len(tight) == 2 and urlfilter.contains(tight, hashes).all()
