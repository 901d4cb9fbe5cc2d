import html as stdlib_html

import pytest
from pyspark.sql import functions as F

from webfurrow.functions import html, links, urls
from webfurrow.functions.encoding import decode_bodies
from webfurrow.operators.robots import permitted_links


def content(value, page, name):
    return value(html.meta_content(html.head_and_link_tags(F.lit(page)), name))


@pytest.mark.parametrize("page,name,want", [
    ('<head><meta property="og:title" content="Tea"></head>', "og:title", "Tea"),
    ("<meta http-equiv=refresh content='5; url=/next'>", "refresh", "5; url=/next"),
    ("<p>no tag</p>", "author", None),
    ('<meta property="a" content="1"><meta name="a" content="2">', "a", "2"),
    ('<meta name="a"><meta property="a" content="2">', "a", None),
    ('<!-- <meta name="a" content="1"> --><META NAME=a CONTENT=2>', "a", "2"),
])
def test_meta(value, page, name, want):
    assert content(value, page, name) == want


@pytest.mark.parametrize("page,want", [
    ("<p>a<b>B</b></p>c", "aBc"),
    ("a<!-- x > y -->b", "ab"),
    ("<script>if (a<b && c) { '</p>' }</script>z", "if (a<b && c) { '</p>' }z"),
    ("<style>p&amp;</style>&amp;", "p&amp;&"),
    ('<a title="x>y" href="z">t</a>', "t"),
    ("<a title=it's>t</a> don't", "t don't"),
    ("1 < 2 and <3", "1 < 2 and <3"),
    ("&am<b>p;</b>&amp;lt;", "&amp;&lt;"),
    ("T&eacute;&#233;&#xE9;&euro;&#128512;&nosuch;&#0;", "Tééé€😀&nosuch;�"),
    ("&nbsp;&copy;&middot;&quot;&apos;", " ©·\"'"),
    ("<!DOCTYPE html><title>T</title>", "T"),
    ("&#00000000065;&#x00000041;&#999999999;&#xFFFFFFFFFF;&#0000;", "AA���"),
    ("a<!-- never closed <b>c</b>", "a"),
    ("a<style>never closed <b>", "anever closed <b>"),
    ("", ""),
])
def test_text(value, page, want):
    assert value(html.text_content(F.lit(page))) == want


def test_entities_like_the_standard_library(value):
    text = "&alpha;&Omega;&hellip;&#8217;&lt;&gt;&amp;amp;&mdash; & x &y"
    assert value(html.decode_entities(F.lit(text))) == stdlib_html.unescape(text)


def test_canonical_and_base(value):
    page = ('<link rel="stylesheet" href="s"><link rel="canonical"><link rel="x canonical" href="/c?b=1&amp;a=2">'
            '<base target="t"><base href="/b/">')
    tags = html.head_and_link_tags(F.lit(page))
    assert value(html.canonical_href(tags)) == "/c?b=1&a=2"
    assert value(html.base_href(tags)) == "/b/"
    assert value(links.base_url(F.lit("http://h/p"), tags)) == "http://h/b/"
    assert value(html.canonical_href(html.head_and_link_tags(F.lit("<link rel='Canonical' href='x'>")))) is None


def found(spark, page, url="http://h/d/p"):
    df = spark.createDataFrame([(url, page)], "url string, page string")
    df = df.withColumn("tags", html.head_and_link_tags(F.col("page"))).withColumn("parts", urls.split_uri(F.col("url")))
    return df.withColumn("found", links.resolved_anchors(F.col("url"), F.col("parts"), F.col("tags")))


def test_links(spark):
    page = ('<a title="q href=no" href=" x ">1</a><a href="/y" rel="nofollow ugc">2</a><a href="/y">3</a><a name=n>4</a>'
            "<a href>5</a><a href='//o/z?utm=1&amp;k=v'>6</a><a href=mailto:a@b>7</a><script><a href=no></script>")
    df = found(spark, page)
    out = df.select(
        links.extracted(F.col("found")).alias("all"), links.followed(F.col("found"), F.lit(True)).alias("kept"),
        links.followed(F.col("found"), F.lit(False)).alias("every"),
        links.allowed(links.followed(F.col("found"), F.lit(True)), ["h", "o"], urls.anchored([".*/x$"]), ["utm"]).alias("ok")).first()
    assert out["all"] == ["http://h/d/x", "http://h/y", "http://h/y", "http://h/d/p", "http://o/z?utm=1&k=v", "mailto:a@b"]
    assert "http://h/y" not in out.kept and "http://h/y" in out.every
    assert sorted(out.ok) == ["http://h/d/p", "http://o/z?k=v"]


def test_a_script_without_end_holds_no_links(spark):
    page = "<a href=/y>1</a><script>a<a href=x>b"
    assert found(spark, page).select(links.extracted(F.col("found")).alias("l")).first().l == ["http://h/y"]


def test_links_of_a_page_without_host_are_dropped(spark):
    assert found(spark, '<a href="/y">', url="p").select(links.extracted(F.col("found")).alias("l")).first().l == []


def test_robots_first_rule_wins(spark):
    rules = spark.createDataFrame(
        [("h", "*", 1, True, "/fr/1"), ("h", "*", 2, False, "/fr"), ("g", "*", 1, False, "/fr"), ("g", "*", 2, True, "/fr/1"),
         ("e", "*", 1, False, ""), ("s", "*", 1, False, "*"), ("q", "*", 1, False, "/a%20b"), ("h", "bot", 0, False, "/")],
        "domain string, agent string, rule_no int, allow boolean, path string")
    urls_ = ["http://h/fr/1", "http://h/fr/2", "http://h/", "http://g/fr/1", "http://g", "http://e/x", "http://s/x", "http://q/a b/c",
             "http://none/x"]
    df = spark.createDataFrame([(u, True) for u in urls_] + [("http://s/y", False)], "url string, on boolean")
    got = {r.url for r in permitted_links(df, rules, F.col("on")).collect()}
    assert got == {"http://h/fr/1", "http://h/", "http://g", "http://e/x", "http://none/x", "http://s/y"}


def test_bodies(spark):
    rows = [(1, "é".encode(), None, "é"), (2, b"\xffa\xc3(b", "utf-8", "a(b"), (3, "é".encode("latin-1"), "ISO-8859-1", "é"),
            (4, "€".encode("cp1252"), "windows-1252", "€"), (5, "ж".encode("koi8-r"), "koi8-r", "ж"),
            (6, "�x".encode() + b"\xff", "UTF-8", "�x"), (7, b"abc", "nosuch", "abc"), (8, None, "koi8-r", None), (9, b"x", "", "x"),
            (10, "жŁ".encode("utf-16"), "UTF-16", "жŁ"), (11, "Łódź".encode("cp1250"), "Windows-1250", "Łódź"),
            (12, b"a\x81b\x80", "cp1252", "ab€"), (13, "日本".encode("shift_jis"), "shift_jis", "日本"),
            *[(20 + n, b"caf\xc3\xa9\xff", name, "café") for n, name in enumerate(
                ["hex", "base64", "rot13", "undefined", "idna", "punycode", "koi8\0-r", "zlib", "quopri"])],
            (40, b"a\\ud800b", "unicode_escape", "ab")]
    df = spark.createDataFrame(rows, "id int, content binary, encoding string, want string")
    assert decode_bodies(df).filter("not (raw_html <=> want)").collect() == []
    # Without a declared charset and without a default, no row is lost.
    assert decode_bodies(df, F.lit(None).cast("string")).count() == len(rows)
