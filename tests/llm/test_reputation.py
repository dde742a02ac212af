"""Url rules and reputation against plain code and SQL."""

import re

import duckdb
import pytest

from netloom.llm.reputation import RULES, filter_sql, filter_urls

URLS = [
    "http://www.Example.com/en/x?q", "https://example.com/en/", "http://a.b.example.com/en/1#t", "http://example.com", "http://example.com/de", "http://notexample.com/en/", "ftp://x.net/es/1", "x.net/fr/1", "http://X.NET/fr/1?a=/es/", "http://net/es/", "HTTP://ÀB.net?/es/", None, "", "://", "http:///path", "a://b://c/d", "http://com/", "http://example.org/en/1", "http://m.net:80/es/", "http://www.example.com.net/fr/", "http://h\n.com/\nx",
]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)] + [(None, URLS[0], "old")], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    rows = filter_urls(pages, labels).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule = plain(r.url)
        assert (r.host, r.path) == (host, path)
        assert (r.verdict, r.rule) == (rule or ("allow", None))


def data():
    pages, labels = [], []
    for i in range(600):
        host = ["good.site.org", "bad.evil.org", "worse.evil.org", "x.mixed.net", "new.evil.org"][i % 5]
        pages.append((i, f"https://{host}/en/{i}"))
        if i % 5 != 4 and i % 3:
            labels.append((i, int(not (i % 5 in (1, 2) or i % 10 == 3)), 0))
    return [*pages, (None, "http://bad.evil.org/q"), (5, "http://good.site.org/"), (700, None)], [*labels, (1, 0, 0), (2, None, None), (None, 1, 1), (9999, 0, 1)]


@pytest.mark.parametrize("empty", [False, True])
def test_reputation_matches_sql(spark, empty):
    from netloom.llm.queries import page_outcomes

    pages, labels = data()
    pages = [] if empty else pages
    p = spark.createDataFrame(pages, "page_id long, url string")
    label = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_urls(p, page_outcomes(label))
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    if pages:
        db.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert got == sorted(db.sql(filter_sql()).fetchall(), key=str)
    if not empty:
        verdict = {r.host: r.verdict for r in out.collect() if r.rule is None}
        assert verdict["bad.evil.org"] == "block" and verdict["good.site.org"] == "allow"


def test_suffixes_below_a_second_label(spark):
    from netloom.llm.reputation import domain_of, suffix_of

    hosts = {"a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "www.c.de": ("c.de", "de"), "co.com": ("co.com", "com"), "d.taco.uk": ("taco.uk", "uk"), "": ("", ""), "localhost": ("localhost", "localhost")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: (r.d, r.s) for r in df.select("h", domain_of(df["h"]).alias("d"), suffix_of(df["h"]).alias("s")).collect()} == hosts


def hosts_with(spark, shares, pages=30):
    """Verdict of each host when so many of its pages are bad."""
    urls, labels = [], []
    for h, bad in enumerate(shares):
        for i in range(pages):
            urls.append((len(urls), f"https://www{h}.site{h % 17}.org/{i}"))
            labels.append((len(labels), int(i < bad)))
    out = filter_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    return {int(r.host.split(".")[0][3:]): r.verdict for r in out.select("host", "verdict").distinct().collect()}


def test_planted_bad_hosts_are_blocked_and_no_others(spark):
    got = hosts_with(spark, [27 if h in (5, 19, 33) else 2 + h % 3 for h in range(40)])
    assert {h for h, v in got.items() if v == "block"} == {5, 19, 33}


def test_hosts_that_do_not_differ_are_left_alone(spark):
    assert set(hosts_with(spark, [6] * 40).values()) == {"allow"}
    assert set(hosts_with(spark, [5 + h % 3 for h in range(40)]).values()) == {"allow"}  # less spread than chance gives
