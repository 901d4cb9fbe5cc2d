"""The seen table: one row per canonical URL and its aliases.

Every operator returns a new table. Rows to look up are reduced to one per key
before they meet the table, so a URL linked from everywhere is no hot key. What changes the
table works on its groups of aliases: ``alias_groups`` and ``plans.replay``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import urls

KEY = ["spider", "key"]


def with_key(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("key", urls.canonize(F.col(url)))


def _keys(df: DataFrame) -> DataFrame:
    return (df if "key" in df.columns else with_key(df)).select(*KEY).distinct()


def new_urls(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidate rows whose canonical URL is not stored."""
    keyed = candidates if "key" in candidates.columns else with_key(candidates)
    return keyed.join(seen.select(*KEY), KEY, "left_anti")


def lookup(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored rows of the wanted URLs, each once."""
    return seen.join(_keys(wanted), KEY, "left_semi")


def contains(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """Wanted keys with a flag ``known``."""
    found = lookup(wanted, seen).select(*KEY, F.lit(True).alias("known"))
    return _keys(wanted).join(found, KEY, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def size(seen: DataFrame) -> DataFrame:
    return seen.groupBy("spider").agg(F.count("*").alias("n"))


def link_counts(links: DataFrame) -> DataFrame:
    """Links per canonical URL, counted before any shuffle."""
    keyed = links if "key" in links.columns else with_key(links)
    return keyed.groupBy(*KEY).agg(F.count("*").alias("n"))
