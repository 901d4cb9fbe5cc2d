"""Page extraction and fingerprint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from webfurrow.functions import fingerprint, html, links, urls
from webfurrow.functions.encoding import decode_bodies
from webfurrow.operators.documents import time_text
from webfurrow.operators.lookup import with_config
from webfurrow.operators.robots import permitted_links
from webfurrow.plans.page_parse import PARSE_OPTIONS, parse_pages

_pg, _hp, _cfg = i.pages_sql, i.head_pages_sql, i.config_sql


def page_text(spark, sf):
    text = i.pages(spark, sf).select("page_id", html.page_text(F.col("html")).alias("text"))
    return text.select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _tagged(spark, sf):
    return i.head_pages(spark, sf).withColumn("tags", html.head_and_link_tags(F.col("html")))


def page_meta(spark, sf):
    return _tagged(spark, sf).select(
        "page_id", F.coalesce(html.meta_content(F.col("tags"), "lang"), F.lit("none")).alias("lang"))


def page_canonical(spark, sf):
    return _tagged(spark, sf).select("page_id", F.coalesce(
        urls.normalize(html.canonical_href(F.col("tags")), i.PARAMS), F.lit("")).alias("canonical"))


def page_base(spark, sf):
    return _tagged(spark, sf).select("page_id", links.base_url(F.col("url"), F.col("tags")).alias("base"))


def _with_links(spark, sf):
    """Pages with ``base`` and the array ``found`` of resolved anchors."""
    based = _tagged(spark, sf).withColumn("base", links.base_url(F.col("url"), F.col("tags")))
    based = based.withColumn("parts", urls.split_uri(F.col("base")))
    return based.withColumn("found", links.resolved_anchors(F.col("base"), F.col("parts"), F.col("tags")))


def link_extract(spark, sf):
    return _with_links(spark, sf).select(
        "page_id", F.posexplode(links.extracted(F.col("found"))).alias("pos", "link"))


def link_nofollow(spark, sf):
    kept = links.followed(F.col("found"), F.lit(True))
    return _with_links(spark, sf).select("page_id", F.explode(kept).alias("link"))


_OPTIONS = ["allowed_domains", "exclude_re", "normalize_params", "nofollow_compliant", "robots_compliant", "max_depth"]


def _allowed(spark, sf):
    known = with_config(_with_links(spark, sf), i.config(spark), _OPTIONS)
    followed = links.followed(F.col("found"), F.col("nofollow_compliant"))
    return known.withColumn("followed", followed).withColumn("allowed", links.allowed(
        F.col("followed"), F.col("allowed_domains"), F.col("exclude_re"), F.col("normalize_params")))


def link_allowed(spark, sf):
    return _allowed(spark, sf).select("page_id", F.explode("allowed").alias("link"))


def link_robots(spark, sf):
    found = _allowed(spark, sf).select("page_id", "robots_compliant", F.explode("allowed").alias("url"))
    kept = permitted_links(found, i.robots_rules(spark, sf), F.col("robots_compliant"))
    return kept.select("page_id", F.col("url").alias("link"))


def link_depth(spark, sf):
    """Links of the pages above the depth limit; the page depth is ``page_id % 4``."""
    near = _allowed(spark, sf).filter(F.col("page_id") % 4 < F.col("max_depth"))
    return near.select("page_id", F.explode("allowed").alias("link"))


def parse_input(spark, sf):
    """Responses of the pages: http pages answer from their https address."""
    pid = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1704067200) + pid * 61)
    rows = i.head_pages(spark, sf).select(
        "page_id", "spider", F.col("html").alias("raw_html"),
        F.regexp_replace("url", "^http:", "https:").alias("response_url"), F.array("url").alias("alternatives"),
        F.when(pid % 11 == 0, 304).otherwise(200).alias("status_code"), at.alias("fetched_at"),
        (pid % 4).cast("int").alias("depth"))
    return with_config(rows, i.config(spark), PARSE_OPTIONS)


def page_parse(spark, sf):
    parsed = parse_pages(parse_input(spark, sf))
    return parsed.select(
        "page_id", F.col("page_url").alias("url"), "domain", F.col("status_code").alias("status"), "fetched_time",
        "hash", "comments", "blocked", F.array_join(F.array_sort("alternatives"), " ").alias("alternatives"),
        F.array_join(F.array_sort("links"), " ").alias("links"))


def body_decode(spark, sf):
    """Page bodies in three charsets and under names that are none; a byte no UTF-8 text has is put before the UTF-8 ones."""
    kind = F.col("page_id") % 7
    raw = (F.when(kind.isin(1, 2), F.encode("html", "ISO-8859-1"))
           .otherwise(F.concat(F.lit(b"\xff"), F.encode("html", "UTF-8"))))
    names = ["ISO-8859-1", "windows-1252", "hex", "idna", "utf\0-8", "no-such-charset"]
    rows = i.pages(spark, sf).select("page_id", raw.alias("content"), F.get(F.array(*map(F.lit, names)), (kind - 1).cast("int")).alias("encoding"))
    return decode_bodies(rows).select("page_id", F.length("raw_html").alias("n_chars"), F.md5("raw_html").alias("digest"))


def page_tokens(spark, sf):
    d = i.texts(spark, sf, "documents").select("doc_id", fingerprint.tokens(F.lower("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("digest"))


def doc_simhash(spark, sf):
    return i.texts(spark, sf, "documents").select("doc_id", fingerprint.simhash(F.lower("text")).alias("hash"))


def hash_distance(spark, sf):
    """Distance between the hash of a text and that of its lower-case form."""
    a, b = fingerprint.token_hash(F.col("text")), fingerprint.token_hash(F.lower("text"))
    return i.texts(spark, sf, "documents").select("doc_id", fingerprint.distance(a, b).alias("distance"))


def change_detect(spark, sf):
    """Half of the pages were stored; every page is fetched again with its URL added."""
    stored = i.page_seen(spark, sf, fingerprint.simhash(html.page_text(F.col("html"))))
    fetched = i.pages(spark, sf).select(
        "page_id", "spider", urls.canonize(F.col("url")).alias("key"),
        fingerprint.simhash(html.page_text(F.concat("html", F.col("url")))).alias("hash"))
    joined = fetched.join(stored.select("spider", "key", "page_hash"), ["spider", "key"], "left")
    return joined.select("page_id", fingerprint.is_changed(F.col("hash"), F.col("page_hash")).alias("is_changed"))


# SQL of the link queries: what a page holds, step by step.
_hrefs = """anchors AS (SELECT page_id, spider, url, list_transform(list_filter(tags, lambda t: regexp_matches(t, '^<a ')),
  lambda t: {'h': trim(regexp_extract(t, 'href="([^"]*)"', 1)), 'n': regexp_matches(t, 'rel="nofollow')}) AS a,
  regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) AS dir,
  len(list_filter(tags, lambda t: t LIKE '<base %')) > 0 AS based FROM tags)"""
_found = f"""{_pg}, {_hp}, {i.tags_sql('hp')}, {_hrefs},
found AS (SELECT page_id, spider, unnest(list_transform(a, lambda x: {{'link': CASE WHEN x.h[1] = '/' THEN site || x.h
  WHEN x.h = 'rel/./x?ref=1' THEN site || CASE WHEN based THEN '/b/' ELSE dir END || 'rel/x?ref=1' ELSE 'unexpected' END, 'n': x.n}})) AS l,
  generate_subscripts(a, 1) - 1 AS pos FROM anchors)"""


def _links_sql(nofollow="true", extra=""):
    return f"""{_found}, {_cfg},
kept AS (SELECT DISTINCT f.page_id, f.spider, f.l.link AS link FROM found f JOIN config c USING (spider)
  WHERE NOT ({nofollow} AND EXISTS (SELECT 1 FROM found g WHERE g.page_id = f.page_id AND g.l.n AND g.l.link = f.l.link))),
ok AS (SELECT DISTINCT k.page_id, k.spider, c.robots, c.max_depth, {i.normalize_sql('k.link')} AS link FROM kept k JOIN config c USING (spider)
  WHERE (len(allowed) = 0 OR list_contains(allowed, {i.domain_sql('k.link')}))),
allowed AS (SELECT o.* FROM ok o JOIN config c USING (spider) WHERE NOT coalesce(regexp_matches(o.link, c.exclude_re), false)){extra}"""


_robots = f""", {i.robots_sql},
hits AS (SELECT a.*, r.allow, r.rule_no FROM allowed a LEFT JOIN rules r ON r.domain = {i.domain_sql('a.link')}
  AND starts_with(regexp_replace(a.link, '^[a-z]+://[^/?#]*', ''), r.path)),
permitted AS (SELECT page_id, spider, link, max_depth FROM hits GROUP BY ALL HAVING NOT bool_or(robots) OR coalesce(arg_min(allow, rule_no), true)),
"""
_canonical = f"""CASE WHEN page_id % 5 < 2 THEN {i.normalize_sql('url')} END"""
_page_text = i.text_sql("hp", "txt", "page_id, spider, url")
links_sql = _links_sql

parse_sql = f"""{_links_sql('c.nofollow')}, {_page_text}, {i.simhash_sql('txt', 'page_id')},
pl AS (SELECT a.page_id, array_to_string(list_sort(list(a.link)), ' ') AS links FROM allowed a
  WHERE a.page_id % 4 < a.max_depth GROUP BY 1),
pr AS (SELECT page_id, spider, url AS requested, {i.normalize_sql("regexp_replace(url, '^http:', 'https:')")} AS url,
  CASE WHEN use_canonical AND page_id % 5 < 2 THEN {i.normalize_sql('url')} END AS canonical FROM hp JOIN config USING (spider)),
parsed AS (SELECT p.page_id, p.url, {i.domain_sql('p.url')} AS domain, CASE WHEN p.page_id % 11 = 0 THEN 304 ELSE 200 END AS status,
  strftime(make_timestamp((1704067200 + p.page_id * 61) * 1000000), '%Y-%m-%dT%H:%M') AS fetched_time, s.hash,
  0 AS comments, false AS blocked, array_to_string(list_sort(list_distinct(list_filter([requested, p.url, canonical], lambda x: x IS NOT NULL))), ' ') AS alternatives,
  coalesce(pl.links, '') AS links FROM pr p JOIN sim s USING (page_id) LEFT JOIN pl USING (page_id))"""
# A page is parsed under its https address, so relative links carry that scheme.
parse_sql = parse_sql.replace("regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site", "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*', 0), '^http:', 'https:') AS site")

QUERIES = {
    "page_text": (page_text, f"WITH {_pg}, {i.text_sql('pg')} SELECT page_id, length(text) AS n_chars, md5(text) AS digest FROM txt"),
    "page_meta": (page_meta, f"WITH {_pg}, {_hp}, {i.tags_sql('hp')} SELECT page_id, coalesce(regexp_extract(list_filter(tags, "
                  "lambda t: regexp_matches(t, '(name|property)=\"lang\"'))[1], 'content=\"([^\"]*)\"', 1), 'none') AS lang FROM tags"),
    "page_canonical": (page_canonical, f"WITH {_pg} SELECT page_id, coalesce({_canonical}, '') AS canonical FROM pg"),
    "page_base": (page_base, f"WITH {_pg} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*', 0) "
                             "|| '/b/' ELSE url END AS base FROM pg"),
    "link_extract": (link_extract, f"WITH {_found} SELECT page_id, pos, l.link AS link FROM found"),
    "link_nofollow": (link_nofollow, f"WITH {_links_sql()} SELECT page_id, link FROM kept"),
    "link_allowed": (link_allowed, f"WITH {_links_sql('c.nofollow')} SELECT page_id, link FROM allowed"),
    "link_robots": (link_robots, f"WITH {_links_sql('c.nofollow', _robots.rstrip().rstrip(','))} SELECT page_id, link FROM permitted"),
    "link_depth": (link_depth, f"WITH {_links_sql('c.nofollow')} SELECT page_id, link FROM allowed WHERE page_id % 4 < max_depth"),
    "page_parse": (page_parse, f"WITH {parse_sql} SELECT * FROM parsed"),
    "body_decode": (body_decode, "SELECT page_id, length(html) AS n_chars, md5(html) AS digest FROM pages"),
    "page_tokens": (page_tokens, "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS digest FROM "
                    "(SELECT doc_id, string_split_regex(lower(text), '[^A-Za-z0-9_]+') AS t FROM documents)"),
    "doc_simhash": (doc_simhash, "WITH lowered AS (SELECT doc_id, lower(text) AS text FROM documents), "
                    f"{i.simhash_sql('lowered', 'doc_id')} SELECT doc_id, hash FROM sim"),
    "hash_distance": (hash_distance, f"SELECT doc_id, bit_count(xor({i.md5_number_sql('text')}, "
                      f"{i.md5_number_sql('lower(text)')})) AS distance FROM documents"),
    "change_detect": (change_detect, f"WITH {_pg}, pb AS (SELECT page_id, spider, url, html || url AS html FROM pg), "
                      f"{i.text_sql('pg', 'ta')}, {i.text_sql('pb', 'tb')}, {i.simhash_sql('ta', 'page_id', 'sa')}, "
                      f"{i.simhash_sql('tb', 'page_id', 'sb')}, st AS (SELECT spider, {i.canonize_sql('url')} AS key, max(hash) AS stored "
                      f"FROM pg JOIN sa USING (page_id) WHERE md5({i.canonize_sql('url')}) < '8' GROUP BY ALL) "
                      "SELECT page_id, coalesce(bit_count(xor(sb.hash, st.stored)) >= 3, true) AS is_changed FROM pg JOIN sb USING (page_id) "
                      f"LEFT JOIN st ON st.spider = pg.spider AND st.key = {i.canonize_sql('pg.url')}"),
}
