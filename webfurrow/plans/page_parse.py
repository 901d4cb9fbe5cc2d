"""Page parse: from a response to document, fingerprint, aliases and links."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import fingerprint, html, links, urls
from webfurrow.functions.encoding import decode_bodies
from webfurrow.operators.documents import time_text
from webfurrow.plans.extensions import extra_fields, extracted, hooks_version

PARSE_OPTIONS = ["normalize_params", "use_canonical", "nofollow_compliant", "robots_compliant",
                 "allowed_domains", "exclude_re", "default_encoding", "max_depth"]


@lru_cache(maxsize=8)
def _expressions(application: str, hooks: int) -> tuple[dict, dict, dict, dict, dict]:
    """The columns of each parse stage. They name their inputs only, so a running
    crawl builds them once and not for every batch."""
    page, params, spider = F.col("raw_html"), F.col("normalize_params"), F.col("spider")
    tags, base, parts = F.col("_tags"), F.col("_base"), F.col("_parts")
    read = {"page_url": urls.normalize(F.col("response_url"), params), "_tags": html.head_and_link_tags(page)}
    located = {"_base": links.base_url(F.col("page_url"), tags)}
    split = {"_parts": urls.split_uri(base)}
    follow = (F.col("depth") < F.col("max_depth")) & page.isNotNull()
    found = {
        "_found": F.when(follow, links.resolved_anchors(base, parts, tags)),
        "canonical": F.when(F.col("use_canonical"), urls.normalize(html.canonical_href(tags), params))}
    outgoing = links.allowed(
        links.followed(F.col("_found"), F.col("nofollow_compliant")),
        F.col("allowed_domains"), F.col("exclude_re"), params)
    text = extracted("text", page, spider, html.page_text(page))
    aliases = F.concat("alternatives", F.array("page_url"), F.array("canonical"))
    fields = {
        "hash": fingerprint.simhash(text),
        "domain": urls.domain(F.col("page_url")),
        "blocked": extracted("blocked", page, spider, F.lit(False)),
        "comments": extracted("comments", page, spider, F.lit(0)).cast("int"),
        "social": extracted("social", page, spider, F.from_json(F.lit("{}"), "map<string,string>")),
        "fetched_time": time_text(F.col("fetched_at")),
        "alternatives": F.array_distinct(F.array_compact(aliases)),
        "links": F.coalesce(outgoing, F.array().cast("array<string>")),
        **{n: extracted(n, page, spider, F.lit(None)) for n in extra_fields()}}
    return read, located, split, found, fields


def parse_pages(pages: DataFrame) -> DataFrame:
    """Parsed pages, row by row and without a shuffle.

    ``pages``: spider, response_url, status_code, fetched_at, depth, the columns of
    ``PARSE_OPTIONS``, ``alternatives`` so far, and the body as ``raw_html`` or as
    ``content`` with ``encoding``. A NULL body gives NULL fields.
    """
    if "raw_html" not in pages.columns:
        pages = decode_bodies(pages, F.col("default_encoding")).drop("content", "encoding")
    *stages, fields = _expressions(pages.sparkSession.sparkContext.applicationId, hooks_version())
    for columns in stages:
        pages = pages.withColumns(columns)
    kept = [c for c in pages.columns if not c.startswith("_") and c not in fields]
    return pages.select(*kept, *[value.alias(name) for name, value in fields.items()])
