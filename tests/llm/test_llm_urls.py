"""URL rules against a plain loop over all rules, and odd rows."""

import random

from corpusaudit.llm import urls


def _plain(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
    fits = [
        (len(h) + len(p or ""), len(h), v == "block", h + (p or ""), v)
        for h, p, v in rules
        if h is not None and v is not None and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


def _check(spark, rows, rules):
    made = spark.createDataFrame(rows, "page_id long, url string, host int, verdict int")
    got = urls.judge_urls(made, spark.createDataFrame(rules, urls.RULES)).collect()
    expected = [(r[0], *_plain(r[1], rules)) for r in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_equals_plain_loop(spark):
    r = random.Random(3)
    hosts = ["org", "a.org", "b.a.org", "A.Org", "xa.org", "a-b.org", "a.org:80", "com", "c.com", "", "é.com", "a..org", "."]
    paths = ["", "/", "/e", "/en", "/en/1", "/en/12?q=/x", "/es/#a://b", "?x", "/En", "/ü/" + "z" * 50_000]
    rules = [(r.choice(hosts).lower(), r.choice(["", "/", "/e", "/en/", "/en/1", "/ü", None]), r.choice(["allow", "block"])) for _ in range(25)]
    rules += [(None, "/", "block"), ("org", "/", None)]
    rows = [(i % 170, f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}", 1, 2) for i in range(400)]
    rows += [(1, None, 1, 2), (2, "", 1, 2), (3, "a.org/en", 1, 2), (None, "http://a.org/en/1", 1, 2), (None, None, None, None)]
    rows += [(9, "http://b.a.org/en/1", 1, 2)] * 300
    _check(spark, rows, rules)


def test_no_rules_and_no_pages(spark):
    _check(spark, [(1, "http://a.org/", 1, 2)], [])
    _check(spark, [], [("org", "/", "block")])
