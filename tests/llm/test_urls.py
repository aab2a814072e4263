import random

from sparkwell.llm import urls

SCHEMA = "page_id long, url string, html string"


def brute(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[: min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[3:]) if fit else (host, path, None, "allow")


def cases():
    rng = random.Random(3)
    hosts = ["example.net", "a.example.net", "EXAMPLE.com", "b.c.example.com", "x.org", "org", "net", "badnet", "net.", "a..net", "h:80", "", "Ünï.net", "a\nb.net"]
    tails = ["", "/", "/en/", "/en/x?y#z", "/de/1", "/de", "/fr/a.html", "?q=://x", "#f", "/fr/" + "p" * 5000, "/\n/en/"]
    out = [f"{s}://{h}{t}" for s in ("http", "") for h in hosts for t in tails] + [None, "", "no scheme", "://", "mailto:x"]
    return out + [rng.choice(out) for _ in range(30)]


def check(spark, rules, **kw):
    rows = [(i if i % 7 else None, u, "h") for i, u in enumerate(cases())]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), urls.rules_frame(spark, rules), **kw)
    want = sorted(((i, *brute(u, rules)) for i, u, _ in rows), key=str)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == want


def test_matches_brute_force(spark):
    check(spark, urls.RULES)


def test_shuffled_rules_and_odd_prefixes(spark):
    check(spark, [("block", "net", "/e"), ("allow", "example.net", ""), ("block", "c.example.com", "/de/1"), ("allow", "c.example.com", "/de/1"), ("block", "org", "/fr/" + "p" * 99)], broadcast_rules=-1)


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "action string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.net/", "h")], SCHEMA)
    assert [r.verdict for r in urls.judge(pages, none).collect()] == ["allow"]
    assert urls.judge(pages.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0
