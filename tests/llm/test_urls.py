from __future__ import annotations

import random

from tracewright.llm import url_filter as u

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/en/x", "block"), ("org", "", "block"), ("a.org", "/p", "allow"), ("net", "/", "allow")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:k], rest[k:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), a, h + p) for h, p, a in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    urls = [f"{rng.choice(['http', 'x'])}://{rng.choice(['', 'a.', 'B.', 'b.a.'])}{rng.choice(['example.net', 'ORG', 'a.org', 'net', 'notnet', 'é.net', ''])}{rng.choice(['', '/', '/en/', '/en/xy', '/EN/', '/p?q', '?x', '#y/en/'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "a://b://c.net/", "http://net:80/", "x" * 5000, "http://" + "a." * 3000 + "net/", "http://\nnet/"]
    pages = spark.createDataFrame([(i % 250, x, "h", "v") for i, x in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block")], "host string, path string, action string")
    want = sorted(((i % 250, *brute(x)) for i, x in enumerate(urls)), key=str)
    assert sorted((tuple(r) for r in u.filter_urls(pages, rules).collect()), key=str) == want
    monkeypatch.setattr(u, "MOST_BROADCAST_RULES", 1)  # the way of rule sets that can't be broadcast
    assert sorted((tuple(r) for r in u.filter_urls(pages, rules).collect()), key=str) == want
    assert u.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in u.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
