import random
from urllib.parse import parse_qs, quote, urlencode, urldefrag, urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from webfurrow.functions import urls


def table(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_canonize(spark):
    pairs = [
        ("http://shop.example.org", "shop.example.org"),
        ("https://shop.example.org/tea/", "shop.example.org/tea"),
        ("http://shop.example.org/tea?sort=up&page=2", "shop.example.org/tea%3Fsort%3Dup%26page%3D2"),
        ("HTTP://a///", "HTTP%3A//a"),
        ("http://a/è b", "a/è b"),
        ("http://a/~x*y z", "a/%7Ex%2Ay%20z"),
        ("", ""),
    ]
    df = table(spark, pairs, "url string, want string").withColumn("got", urls.canonize(F.col("url")))
    assert df.filter("got <> want").collect() == []


def test_domain(spark):
    pairs = [("http://shop.example.org/1", "shop.example.org"), ("https://u:p@H.com:8080?x", "u:p@H.com:8080"), ("//h/p", "h"),
             ("/p", ""), ("mailto:a@b", ""), ("http://h|x y/p", "h|x y"), ("", "")]
    df = table(spark, pairs, "url string, want string").withColumn("got", urls.domain(F.col("url")))
    assert df.filter("got <> want").collect() == []


def model_normalize(url, params):
    u = urlsplit(url)
    query = parse_qs(u.query.replace(";", "&"))
    for p in params:
        query.pop(p, None)
    text = urlencode(sorted(query.items()), True).replace("~", "%7E")
    return urldefrag(urlunsplit((u.scheme, u.netloc, u.path, text, u.fragment)))[0]


def test_normalize_against_standard_library(spark):
    rng = random.Random(1)
    keys = ["a", "b", "utm", "q r", "è", "x*", "~t"]
    rows = []
    for _ in range(300):
        pieces = []
        for _ in range(rng.randint(0, 5)):
            k, v = quote(rng.choice(keys)), rng.choice(["1", "2", "", "a+b", "%C3%A9", "x=y", "%7E", "p%26q", "a/b"])
            pieces.append(rng.choice([f"{k}={v}", k, f"{k}="]))
        url = rng.choice(["http", "HTTPS"]) + "://H.com" + rng.choice(["", "/", "/p/", "/p;x"])
        if pieces or rng.random() < .3:
            url += "?" + rng.choice(["&", ";"]).join(pieces)
        rows.append((url + rng.choice(["", "#", "#f?g"]),))
    df = table(spark, rows, "url string").select("url", urls.normalize(F.col("url"), ["utm"]).alias("n"))
    for r in df.collect():
        assert r.n == model_normalize(r.url, ["utm"]), r.url


@pytest.mark.parametrize("url,want", [
    ("http://h/p?a=%zz", "http://h/p?a=%25zz"),
    ("http://h/p?b=2&a=1&a=0", "http://h/p?a=1&a=0&b=2"),
    ("http://h/p?vclk=x%7Cy", "http://h/p"),
    ("http://h/p/", "http://h/p/"),
    ("www.H.com:80", "www.H.com:80"),
    ("http://h/p?a=1?b=2", "http://h/p?a=1%3Fb%3D2"),
    ("http://h/cups?vclk=1&size=s&vclk=2", "http://h/cups?size=s"),
])
def test_normalize_cases(value, url, want):
    assert value(urls.normalize(F.lit(url), ["vclk"])) == want


def test_resolve(spark):
    base = "http://a/b/c/d;p?q"
    hrefs = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", "", ".", "./", "..", "../", "../g", "../..",
             "../../", "../../g", "./g/.", "g/./h", "g/../h", "http:g", "mailto:a@b", "https://z", "HTTP://Q/w"]
    rows = [(base, h, urljoin(base, h)) for h in hrefs]
    # More '..' than folders are kept, as the older rule has it.
    rows += [(base, "../../../g", "http://a/../g"), ("http://a", "x", "http://a/x"), ("http://a/", "../x", "http://a/../x"),
             ("http://a/b", "..", "http://a/"), ("http://a/b/", "..", "http://a/"), ("", "x", "x"), ("http://a/b?q#f", "", "http://a/b?q#f")]
    df = table(spark, rows, "base string, href string, want string").withColumn("got", urls.resolve(F.col("base"), F.col("href")))
    assert [(r.base, r.href, r.got) for r in df.filter("got <> want").collect()] == []


def test_check_and_admit(spark):
    rows = [("http://shop.example.org/private/7", "http://shop.example.org/private/7", True, "excluded"),
            ("http://shop.example.org/tea", "http://shop.example.org/tea", False, "ok"),
            ("http://shop.example.org/tea?ref=9&sort=up", "http://shop.example.org/tea?sort=up", True, "normalized"),
            ("http://other.example.org/tea", "http://other.example.org/tea", True, "domain"),
            ("http://other.example.org/private", "http://other.example.org/private", True, "excluded")]
    df = table(spark, rows, "url string, nurl string, rm boolean, why string").withColumn(
        "c", urls.check(F.col("url"), ["shop.example.org"], urls.anchored([".*/private"]), ["ref"]))
    assert df.filter("c.nurl <> nurl or c.to_remove <> rm or c.reason <> why").collect() == []
    admitted = {r.url for r in df.filter(urls.is_admitted(F.col("c"), F.col("url"))).collect()}
    assert admitted == {rows[1][0], rows[2][0]}


def test_exclude_is_anchored_at_the_start_only(value):
    pattern = urls.anchored(["abc", ".*/foto/.*"])
    assert value(urls.is_excluded(F.lit("abcd"), pattern))
    assert not value(urls.is_excluded(F.lit("xabc"), pattern))
    assert value(urls.is_excluded(F.lit("http://h/foto/1"), pattern))
    assert not value(urls.is_excluded(F.lit("abc"), urls.anchored([])))


def test_no_allowed_domains_allows_all(value):
    assert value(urls.is_allowed(F.lit("h"), []))
    assert not value(urls.is_allowed(F.lit("h:80"), ["h"]))
