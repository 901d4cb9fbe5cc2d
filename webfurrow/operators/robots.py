"""Robots rules as a table, applied to links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import urls
from webfurrow.operators.lookup import lookup_join


def _unquoted(text: Column) -> Column:
    held = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(held)


def rules_by_domain(rules: DataFrame, agent: str = "*") -> DataFrame:
    """One row per domain with its rules in order. The list is one robots file."""
    path = F.when((F.col("path") == "*"), F.col("path")).otherwise(_unquoted(F.col("path")))
    # A deny rule without path denies nothing.
    allow = F.col("allow") | (F.coalesce("path", F.lit("")) == "")
    return (rules.filter(F.col("agent") == agent).groupBy("domain")
            .agg(F.array_sort(F.collect_list(F.struct("rule_no", path.alias("path"), allow.alias("allow")))).alias("rules")))


def may_fetch(url: Column, rules: Column) -> Column:
    """The first rule whose path starts the URL's path decides; no rule allows."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?", "")
    path = _unquoted(F.when(rest == "", F.lit("/")).otherwise(rest))
    hits = F.filter(rules, lambda r: (r["path"] == "*") | path.startswith(r["path"]))
    return F.coalesce(F.get(hits, F.lit(0))["allow"], F.lit(True))


def permitted_links(links: DataFrame, rules: DataFrame, compliant: Column | None = None) -> DataFrame:
    """Links the robots rules of their domain permit; ``compliant`` may switch the
    test off per row. ``links`` has the URL in ``url``."""
    compliant = F.lit(True) if compliant is None else compliant
    keyed = links.withColumn("domain", urls.domain(F.col("url")))
    joined = lookup_join(keyed, rules_by_domain(rules), ["domain"])
    return joined.filter(~compliant | may_fetch(F.col("url"), F.col("rules"))).drop("domain", "rules")
