from __future__ import annotations

import re

from clusterloom.llm import url_vocabulary as u
from clusterloom.llm.queries import QUERIES, URL_RULES


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rule = None
    for name in URL_RULES:
        h, p = name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(name) > len(rule or ""):
            rule = name
    tokens = re.findall(r"[^\W_]+", (url or "").lower())
    strict = sum(t in u.STRICT for t in tokens)
    soft = {t for t in tokens if t in u.SOFT}
    method = "block" if strict or len(soft) >= 2 else "allow"
    return host, path, rule, URL_RULES.get(rule, method)


URLS = [
    None, "", "no scheme/xxx", "http://", "HTTP://A.NET", "http://a.net/", "http://x.Example.net/en/1", "http://example.net/en",
    "https://b.example.com/de/", "https://a.org/fr/x?y#z", "http://q.example.com#/de/", "http://cheap-pills.example.com/a",
    "http://cheapest.example.com/pills", "https://c.io/xxx.html", "https://c.io/xxxl", "a://b://c/d", "http://c.io/?free=1&win=2",
    "http://notexample.net/en/", "http://x.io/" + "a" * 50000 + "/casino", "http://é.io/cheap_cheap",
]


def test_against_plain_rules(spark):
    docs = spark.createDataFrame([(i, x, "z", 1) for i, x in enumerate(URLS)] + [(None, URLS[5], "z", 1)] * 2,
                                 "page_id long, url string, host string, n_soft int")
    got = sorted((repr(r.page_id), (r.host, r.path, r.rule, r.verdict)) for r in u.judge(docs, URL_RULES).collect())
    assert got == sorted([(repr(i), expected(x)) for i, x in enumerate(URLS)] + [("None", expected(URLS[5]))] * 2)


def test_empty_table_and_no_terms(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(empty, URL_RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.io/xxx")], "page_id long, url string")
    assert u.judge(one, {}, strict=(), soft={}).first().verdict == "allow"


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op5_url_vocabulary"](spark, sf_dir).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: expected(x) for i, x in urls.items()}
