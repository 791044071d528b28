from __future__ import annotations

import random

from weft.llm import urls as U
from weft.llm.queries import URL_RULES

ALL = URL_RULES + U.DEFAULT_PATTERNS


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fitting = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fitting:
        best = max(fitting, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")

    def fits(pattern):
        at = 0
        for part in pattern.split("*"):
            at = low.find(part, at)
            if at < 0:
                return False
            at += len(part)
        return True

    hits = {r.action for r in U.DEFAULT_PATTERNS if fits(r.pattern)}
    return host, path, None, "block" if hits == {"block"} else "allow"


CASES = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://a.net", "http://a.net/", "http://a.net?x", "http://a.net/#f", "http://planet/", "http://x.example.net/en/5",
    "http://example.net/en", "http://example.net/EN/", "https://b.example.com/de/1?q=/", "http://org/fr/", "http://x.org/fr", "http://good.com/a.net /b", "http://h?://x.net/",
    "http://a.b.c.net:80/", "ftp://ads.x.com/", "http://x.com/ads/1", "http://x.com/myads/1", "http://x.com/robots.txt/ads/1", "HTTP://X.COM/WARez/a", "a://b://c.net/", "http://ÄÖ.net/",
]


def test_judgement_equals_brute_force():
    rng = random.Random(2)
    pieces = ["http://", "://", "net", "example", ".", "/", "en", "de", "org", "fr", "com", "?", "#", "ads", "casino", "A", " ", "xxx", "é", ":"]
    index = U.RuleIndex(ALL)
    for url in CASES + ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]:
        assert index.judge(url) == brute(url), url


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(k, f"http://x{k}.example.com/en/{k}") for k in range(9)] + [(9, "http://example.com/de/1"), (10, None)], "page_id long, url string")
    counts = U.token_counts(pages, "url", ALL)
    assert counts["com"] == 10 and counts["de"] == 1
    index = U.RuleIndex(ALL, counts)
    names = {token: [index.rules[k][0].name for k in ks] for token, ks in index.filed.items()}
    assert "example.com/de/" in names["de"]
    assert sorted(names["net"]) == ["example.net/en/", "net/"]
    assert not index.untokened


def test_rule_without_sure_token_is_always_tried():
    index = U.RuleIndex((U.Rule("block", pattern="bad*stuff"),))
    assert index.untokened == [0]
    assert index.judge("http://x.com/notbadstuffs")[3] == "block"


def test_query(spark):
    df = spark.createDataFrame([(k, url, "x", 1) for k, url in enumerate(CASES)] + [(0, None, "y", 2)], "page_id long, url string, host string, rule int")
    rows = [tuple(r) for r in U.filter_urls(df, ALL).collect()]
    assert sorted(rows, key=str) == sorted([(k, *brute(url)) for k, url in enumerate(CASES)] + [(0, *brute(None))], key=str)
    assert U.filter_urls(df.limit(0), ALL).count() == 0
