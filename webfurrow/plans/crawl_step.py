"""One crawl step: a batch of fetch results against the stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import urls
from webfurrow.operators import documents as docs
from webfurrow.operators import frontier as fr
from webfurrow.operators import seen as sn
from webfurrow.operators.alias_groups import ORDER, SeenGroups, SeenStep
from webfurrow.operators.components import Stage
from webfurrow.operators.fetches import ITEM, resolve_attempts, route
from webfurrow.operators.lookup import with_config
from webfurrow.operators.robots import permitted_links
from webfurrow.plans.page_parse import PARSE_OPTIONS, parse_pages
from webfurrow.plans.replay import events_of, replay_batch, with_order
from webfurrow.plans.reschedule import announcements, refetch_items, timed
from webfurrow.session import default_stage

@dataclass(frozen=True)
class StepResult:
    """What a step does to the tables, and what happened in it."""

    seen: SeenStep
    fetched: DataFrame  # items that leave the frontier
    pushed: DataFrame  # items that come into it, after that
    document_changes: DataFrame
    change_feed: DataFrame
    outcomes: DataFrame
    links: DataFrame

    def frontier(self, before: DataFrame) -> DataFrame:
        """The whole frontier after the step."""
        return fr.push(fr.remove_items(before, self.fetched), self.pushed)


def visit_batch(log: DataFrame, config: DataFrame) -> DataFrame:
    """Fetch results per item: admission, outcome and the parsed page.

    A connection error has hash 0 and no page; dropped rows have neither.
    """
    resolved = route(resolve_attempts(log))
    options = [*PARSE_OPTIONS, "restart_delay", "refetching_delay", "refetching_strategy"]
    known = with_config(resolved, config, options)
    checked = known.withColumn("checked", urls.check(
        F.col("url"), F.col("allowed_domains"), F.col("exclude_re"), F.col("normalize_params")))
    admitted = checked.withColumn("admitted", urls.is_admitted(F.col("checked"), F.col("url")))
    parse = F.col("admitted") & (F.col("route") == "parse")
    body = "raw_html" if "raw_html" in log.columns else "content"
    ready = (admitted.withColumn("nurl", F.col("checked.nurl")).withColumn("to_remove", F.col("checked.to_remove"))
             .withColumn("alternatives", F.array("nurl"))
             .withColumn(body, F.when(parse, F.col(body)))
             .withColumn("response_url", F.when(parse, F.col("response_url"))).drop("checked"))
    parsed = parse_pages(ready)
    return (parsed.withColumn("parsed", parse)
            .withColumn("visited", F.col("admitted") & F.col("route").isin("parse", "reschedule"))
            .withColumn("visit_url", F.when(parse, F.col("page_url")).otherwise(F.col("nurl")))
            .withColumn("dhash", F.when(parse, F.col("hash")).otherwise(F.lit(0).cast("bigint"))))


def counted_links(visits: DataFrame, robots_rules: DataFrame) -> DataFrame:
    """Links of the parsed pages, equal ones counted: spider, url, depth, key, n."""
    found = visits.filter("parsed").select("spider", "depth", "robots_compliant", F.explode("links").alias("url"))
    counted = found.groupBy("spider", "url", "depth", "robots_compliant").agg(F.count("*").alias("n"))
    allowed = permitted_links(counted, robots_rules, F.col("robots_compliant"))
    return sn.with_key(allowed.select("spider", "url", "depth", "n"))


def document_batch(visits: DataFrame) -> DataFrame:
    """Rows for the document merge."""
    return sn.with_key(visits.filter("parsed").select(
        "spider", F.col("page_url").alias("url"), "raw_html", "blocked", "hash", "domain", "comments", "social",
        "fetched_at", F.col("status_code").alias("status")))


def _in_order(pushes: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items pushed in the batch, equal ones once, without those that were fetched after their last push."""
    last = pushes.groupBy(*fr.COLUMNS).agg(F.max(F.struct(*ORDER)).alias("_pushed"))
    taken = fetched.groupBy(*fr.COLUMNS).agg(F.max(F.struct(*ORDER)).alias("_fetched"))
    right = taken.select(*[F.col(c).alias(f"_{c}") for c in fr.COLUMNS], "_fetched")
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fr.COLUMNS]
    return (last.join(right, equal, "left").filter(F.col("_fetched").isNull() | (F.col("_pushed") >= F.col("_fetched")))
            .select(*fr.COLUMNS))


def crawl_step(log: DataFrame, seen: SeenGroups, document_state: DataFrame, config: DataFrame, robots_rules: DataFrame,
               now: Column, stage: Stage | None = None, max_doc_bytes: int | None = None) -> StepResult:
    """Changes of the tables by a batch of fetch results, the same as if they had come one by one.

    ``seen`` and ``document_state`` (spider, key, history of the stored documents) are tables, or stored
    ones that are read only around the keys of the batch. ``now`` may use columns of the log, such as the fetch
    time. Results come in the order of fetch time and URL, whatever the batches: aliases, counters, links,
    timing and frontier items of a batch are those of the sequential crawl. Results several branches need
    are staged, by default in the shared folder.
    """
    stage = stage or default_stage(log.sparkSession, "crawl-step")
    visits = stage(with_order(visit_batch(log, config)), "visits")
    links = stage(counted_links(visits, robots_rules), "links")
    events = stage(events_of(visits.filter("visited OR to_remove").select(
        "spider", *ORDER, F.when(F.col("to_remove"), F.col("url")).alias("gone_url"),
        F.when(F.col("visited"), F.col("visit_url")).alias("url"), "alternatives", "dhash")), "events")
    page_links = visits.filter("parsed").select("spider", "depth", *ORDER, F.explode("links").alias("url"))
    step = replay_batch(seen, events, stage, links, page_links, sn.with_key(visits.select("spider", "url")))

    judged = stage(visits.filter("visited").join(step.judged, "row").withColumn("url", F.col("visit_url"))
                   .withColumn("status", F.when(F.col("parsed"), F.col("status_code")))
                   .drop("links", "raw_html", "content", "text"), "judged")
    fetched = visits.select("spider", "source", "score", "url", F.col("delay").alias("next_delay"), "depth", *ORDER)
    pushes = fr.normal_items(step.unknown, ORDER).unionByName(refetch_items(timed(judged, now), ORDER))
    documents = document_batch(visits)
    known = document_state if isinstance(document_state, DataFrame) else document_state.around(documents.select(*sn.KEY))

    return StepResult(
        seen=step,
        fetched=fetched.select(*fr.COLUMNS).distinct(),
        pushed=_in_order(pushes, fetched),
        document_changes=docs.document_changes(known, documents, max_doc_bytes),
        change_feed=announcements(judged, now),
        outcomes=visits.select(*ITEM, "outcome", "route", "admitted", "to_remove", "nurl"),
        links=links)
