import random

import pytest
from pyspark.sql import functions as F

from quillgrain.llm import catalog, url_filter as u


def plain(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].partition("?")[0].partition("#")[0]
    fit = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.host), len(r.path)), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://", "https://COM/", "http://example.com", "http://example.com/en/", "http://www.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://notexample.com/en/", "ftp://x.net/es/1", "http://net/fr/", "http://x.net/fr", "http://x.net?/es/", "http://é.com/ü", "http://a..com/", "http://.com/", "x://y://z.com/q", "http://ex\nample.com/en/", "http://com:80/"]


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "a.b.example.com", "net", "x.net", "y.x.net", "xnet", "org"]
    urls = URLS + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/a', '/es/', '/fr/x?q=/en/', '#/en/'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://example.com/en/"), (0, None)], "page_id long, url string").withColumn("host", F.lit("clash"))
    for rules in (catalog.URL_RULES, [u.Rule("block" if i % 2 else "allow", h, p) for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/", "/en/a"))]):
        for block in (50_000, 3):
            got = sorted(map(repr, map(tuple, u.judge_urls(pages, rules, block_rules=block).collect())))
            assert got == sorted(repr((r.page_id, *plain(r.url, rules))) for r in pages.collect())


def test_clash_and_empty(spark):
    with pytest.raises(ValueError):
        u.judge_urls(spark.createDataFrame([], "page_id long, url string"), [u.Rule("allow", "a", "/"), u.Rule("block", "a", "/")])
    assert u.judge_urls(spark.createDataFrame([], "page_id long, url string"), catalog.URL_RULES).count() == 0
