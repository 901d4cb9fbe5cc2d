"""After a visit: is the page new or changed, when to fetch it again, what to announce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import refetch
from webfurrow.operators.alias_groups import ORDER, grouped
from webfurrow.operators.components import Stage
from webfurrow.operators.seen import with_key
from webfurrow.plans.replay import events_of, replay_batch, with_order
from webfurrow.schemas import PRIORITY, REFETCH
from webfurrow.session import default_stage


def judge(visits: DataFrame, seen: DataFrame, stage: Stage | None = None) -> DataFrame:
    """Adds ``key``, ``is_new`` and ``is_changed`` of each visit, as if the visits came one by one.

    Each visit is held against what the visits before it in order of ``(fetched_at, url)`` left of the
    table, under any of its names. ``visits``: spider, url, dhash, fetched_at and alternatives.
    ``seen``: the flat table.
    """
    stage = stage or default_stage(visits.sparkSession, "judge")
    rows = stage(with_order(with_key(visits)), "visits")
    events = stage(events_of(rows.withColumn("gone_url", F.lit(None).cast("string"))), "events")
    return rows.join(replay_batch(grouped(seen, stage), events, stage).judged, "row").drop(*ORDER)


def timed(judged: DataFrame, now: Column) -> DataFrame:
    """Adds ``next_delay`` and ``expire``; both NULL for a page that is given up.
    Needs restart_delay, refetching_delay and refetching_strategy of the spider."""
    visit = refetch.Visit(
        source=F.col("source"), delay=F.col("delay"), status=F.col("status"),
        is_new=F.col("is_new"), is_changed=F.col("is_changed"),
        restart_delay=F.col("restart_delay"), refetching_delay=F.col("refetching_delay"))
    return (judged.withColumn("next_delay", refetch.next_delay(F.col("refetching_strategy"), visit))
            .withColumn("expire", now.cast("bigint") + F.col("next_delay")))


def refetch_items(timed_visits: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Frontier items of the visits, with the columns to ``keep``: priority stays priority, the rest is refetched."""
    source = F.when(F.col("source") == PRIORITY, F.lit(PRIORITY)).otherwise(F.lit(REFETCH))
    return timed_visits.filter(F.col("next_delay").isNotNull()).select(
        "spider", source.cast("tinyint").alias("source"), F.col("expire").alias("score"), "url",
        "next_delay", "depth", *keep)


def announcements(judged: DataFrame, now: Column) -> DataFrame:
    """Change feed of the visits: new or changed URLs, each with its latest time."""
    return (judged.filter(F.col("is_new") | F.col("is_changed"))
            .groupBy("spider", "url").agg(F.max(now.cast("bigint")).alias("detected_at")))
