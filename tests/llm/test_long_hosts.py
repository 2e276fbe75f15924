"""URL filter: very long hosts in linear time, and the same answers as trying every suffix."""

import random
import time

from tiercraft.llm import url_filter


def plain(url, rules):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    if not host:
        return None
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3] if fits else None


def test_suffixes_by_brute_force(spark):
    rng = random.Random(1)
    label = lambda: rng.choice(["a", "b", "example", "org", ""])
    rules = {(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.choice([1, 2, 4]))),
              rng.choice(["", "/", "/x", "/x/y"])) for _ in range(25)}
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 6))) + rng.choice(["", "/", "/x/y?q", "#/x", "/xx"])
            for _ in range(800)] + [None, "no host", "http:///x", "://a/x"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    table = spark.createDataFrame(sorted(rules), "verdict string, host string, path string")
    got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, table).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_a_host_of_many_labels(spark):
    host = "a." * 100_000 + "example.org"
    pages = spark.createDataFrame([(1, f"http://{host}/es/x"), (2, "http://" + "b." * 100_000 + "net/")], "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.rule for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {1: "example.org/es/", 2: None}
    assert time.time() - began < 60
