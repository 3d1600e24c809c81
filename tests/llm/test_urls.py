import re

import pytest

from wardlake.llm import urls
from wardlake.llm.queries import URL_RULES


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [
        (len(h) + len(p), len(h), h + p, v) for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("frequent", [1e-3, 0.04, 1.0])
def test_judged_urls(spark, monkeypatch, frequent):
    monkeypatch.setattr(urls, "FREQUENT", frequent)
    given = [
        "http://a.example.com/en/1?x=/de/", "https://WWW.Example.COM/en/", "http://example.com/EN/", "ftp://x.net/es/a#b", "x.net/es/",
        "http://net/fr/", "http://notnet/fr/", "http://com", "http://com/", "a://b://c.com/d", None, "", "://", "http://x.com:80/",
        "http://u@com/", "http://ex ample.com/en/\n", "http://.com/", "http://com./", "http://a.b.c.d.example.com/en/x/y/z",
        "http://" + "a." * 20_000 + "d.example.com/en/x/y" + "/z" * 20_000,
    ] * 2
    pages = spark.createDataFrame([(i % 25, u, "h", "r", "k") for i, u in enumerate(given)], "page_id bigint, url string, html string, rule string, key string")
    rules = [*URL_RULES, ("d.example.com", "/en/x/y", "block"), ("d.example.com", "/en/x/y", "allow"), ("x.net", "", "block")]
    strict = {(h, p): v for h, p, v in sorted(rules, key=lambda r: r[2])}
    rows = urls.judged_urls(pages, urls.rules_table(spark, rules)).collect()
    want = [(i % 25, *plain_verdict(u, [(*k, v) for k, v in strict.items()])) for i, u in enumerate(given)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    none = urls.rules_table(spark, [])
    assert [r["verdict"] for r in urls.judged_urls(pages, none).collect()] == ["allow"]
    assert urls.judged_urls(pages.limit(0), urls.rules_table(spark, URL_RULES)).count() == 0
