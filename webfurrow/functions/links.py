"""Outgoing links of a page as arrays of its row, so no shuffle by page is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.functions import html, urls


def base_url(page_url: Column, tags: Column) -> Column:
    """Base of relative links: the page's base tag against its own URL."""
    href = html.base_href(tags)
    return F.when(href.isNull(), page_url).otherwise(urls.resolve(page_url, href))


def resolved_anchors(base: Column, base_parts: Column, tags: Column) -> Column:
    """All anchors as ``(url, nofollow)``, resolved against the base. ``base`` and
    ``base_parts`` should be columns, so that they are computed once per page."""
    return F.transform(html.anchors(tags), lambda a: F.struct(
        urls.resolve_against(base, base_parts, a["href"]).alias("url"), a["nofollow"].alias("nofollow")))


def extracted(links: Column) -> Column:
    """Link URLs of a page in order; those still without a host are left out."""
    return F.filter(F.transform(links, lambda a: a["url"]), lambda u: ~u.startswith("/"))


def followed(links: Column, compliant: Column) -> Column:
    """Distinct link URLs without those any nofollow anchor points to."""
    barred = F.transform(F.filter(links, lambda a: a["nofollow"] & compliant), lambda a: a["url"])
    return F.array_except(extracted(links), barred)


def allowed(link_urls: Column, allowed_domains, exclude_re: Column, drop_params) -> Column:
    """Distinct normal forms of the links on allowed domains that are not excluded."""
    inside = F.filter(link_urls, lambda u: urls.is_allowed(urls.domain(u), allowed_domains))
    normal = F.array_distinct(F.transform(inside, lambda u: urls.normalize(u, drop_params)))
    return F.filter(normal, lambda u: ~urls.is_excluded(u, exclude_re))
