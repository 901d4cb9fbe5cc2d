"""URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from webfurrow.functions import html, urls
from webfurrow.operators.lookup import with_config


def _checked(spark, sf):
    known = with_config(i.pages(spark, sf), i.config(spark),
                        ["allowed_domains", "exclude_re", "normalize_params"])
    return known.withColumn("c", urls.check(F.col("url"), F.col("allowed_domains"), F.col("exclude_re"), F.col("normalize_params")))


_excluded = "coalesce(regexp_matches(url, exclude_re), false)"
_allowed = f"(len(allowed) = 0 OR list_contains(allowed, {i.domain_sql('url')}))"
checked_sql = f"""ck AS (SELECT page_id, spider, url, CASE WHEN {_excluded} THEN 'excluded' WHEN NOT {_allowed} THEN 'domain'
  WHEN {i.normalize_sql('url')} <> url THEN 'normalized' ELSE 'ok' END AS reason, {i.normalize_sql('url')} AS normal
  FROM pg JOIN config USING (spider))"""


def url_domain(spark, sf):
    return i.pages(spark, sf).select("page_id", urls.domain(F.col("url")).alias("domain"))


def url_normalize(spark, sf):
    return i.pages(spark, sf).select("page_id", urls.normalize(i.messy_url(F.col("url")), i.PARAMS).alias("nurl"))


def url_canonize(spark, sf):
    return i.pages(spark, sf).select("page_id", urls.canonize(i.messy_url(F.col("url"))).alias("key"))


def url_quote(spark, sf):
    return i.pages(spark, sf).select("page_id", urls.quote(i.messy_url(F.col("url"))).alias("quoted"))


_FORMS = ["{}", "..{}", "../..{}", ".{}", "?q={}", "#{}", "//other.example.org{}", "https://o.example.org{}"]


def url_resolve(spark, sf):
    """Every anchor of every page in eight written forms, against the page URL."""
    tags = i.pages(spark, sf).select("page_id", "url", html.head_and_link_tags(F.col("html")).alias("tags"))
    hrefs = tags.select("page_id", "url", F.posexplode(html.anchors(F.col("tags"))).alias("pos", "a"))
    forms = F.array(*[F.concat(F.lit(f.split("{}")[0]), F.col("a.href")) for f in _FORMS])
    rows = hrefs.select("page_id", "url", "pos", F.posexplode(forms).alias("form", "href"))
    return rows.select("page_id", "pos", "form", urls.resolve(F.col("url"), F.col("href")).alias("resolved"))


url_resolve_sql = f"""WITH {i.pages_sql}, {i.tags_sql('pg')},
hrefs AS (SELECT page_id, url, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, url,
  list_transform(list_filter(tags, lambda t: regexp_matches(t, '^<a ')), lambda t: regexp_extract(t, 'href="([^"]*)"', 1)) AS hs FROM tags)),
b AS (SELECT *, regexp_extract(url, '^[a-z]+', 0) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS site,
  split_part(url, '#', 1) AS nofrag, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM hrefs),
d AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM b),
e AS (SELECT *, regexp_replace(dir, '[^/]+/$', '') AS parent FROM d),
f AS (SELECT *, CASE WHEN parent = '/' THEN '/..' ELSE regexp_replace(parent, '[^/]+/$', '') END AS grand FROM e)
SELECT page_id, pos, unnest([0,1,2,3,4,5,6,7]) AS form, unnest([site || h, site || parent || substr(h, 2),
  site || CASE WHEN grand = '/..' THEN '/..' || h ELSE grand || substr(h, 2) END, site || dir || substr(h, 2),
  site || path || '?q=' || h, nofrag || '#' || h, scheme || '://other.example.org' || h, 'https://o.example.org' || h]) AS resolved FROM f"""


def url_exclude(spark, sf):
    known = with_config(i.pages(spark, sf), i.config(spark), ["exclude_re"])
    return known.select("page_id", urls.is_excluded(F.col("url"), F.col("exclude_re")).alias("excluded"))


def url_allowed(spark, sf):
    known = with_config(i.pages(spark, sf), i.config(spark), ["allowed_domains"])
    return known.filter(urls.is_allowed(urls.domain(F.col("url")), F.col("allowed_domains"))).select("page_id", "url")


def url_check(spark, sf):
    return _checked(spark, sf).select("page_id", "c.nurl", "c.to_remove", "c.reason")


def admit_urls(spark, sf):
    return _checked(spark, sf).filter(urls.is_admitted(F.col("c"), F.col("url"))).select("page_id", "c.nurl", "c.to_remove")


_pg, _cfg = i.pages_sql, i.config_sql
_messy = i.messy_url_sql("url")
QUERIES = {
    "url_domain": (url_domain, f"WITH {_pg} SELECT page_id, {i.domain_sql('url')} AS domain FROM pg"),
    "url_normalize": (url_normalize, f"WITH {_pg}, m AS (SELECT page_id, {_messy} AS url FROM pg) "
                                     f"SELECT page_id, {i.normalize_sql('url')} AS nurl FROM m"),
    "url_canonize": (url_canonize, f"WITH {_pg}, m AS (SELECT page_id, {_messy} AS url FROM pg) "
                                   f"SELECT page_id, {i.canonize_sql('url')} AS key FROM m"),
    "url_quote": (url_quote, f"WITH {_pg}, m AS (SELECT page_id, {_messy} AS url FROM pg) "
                             "SELECT page_id, replace(replace(url_encode(url), '~', '%7E'), '%2F', '/') AS quoted FROM m"),
    "url_resolve": (url_resolve, url_resolve_sql),
    "url_exclude": (url_exclude, f"WITH {_pg}, {_cfg} SELECT page_id, {_excluded} AS excluded FROM pg JOIN config USING (spider)"),
    "url_allowed": (url_allowed, f"WITH {_pg}, {_cfg} SELECT page_id, url FROM pg JOIN config USING (spider) WHERE {_allowed}"),
    "url_check": (url_check, f"WITH {_pg}, {_cfg}, {checked_sql} SELECT page_id, CASE WHEN reason = 'normalized' THEN normal "
                             "ELSE url END AS nurl, reason <> 'ok' AS to_remove, reason FROM ck"),
    "admit_urls": (admit_urls, f"WITH {_pg}, {_cfg}, {checked_sql} SELECT page_id, CASE WHEN reason = 'normalized' THEN normal "
                               "ELSE url END AS nurl, reason <> 'ok' AS to_remove FROM ck WHERE reason IN ('ok', 'normalized')"),
}
