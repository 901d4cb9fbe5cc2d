"""The crawl frontier: priority, normal and refetch items of every spider."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import urls
from webfurrow.operators.lookup import first_n, with_config
from webfurrow.operators.seen import KEY, new_urls, with_key
from webfurrow.schemas import FRONTIER, NORMAL, PRIORITY, REFETCH

COLUMNS = FRONTIER.fieldNames()
# Fixed value: seeds from a list rank behind pages found near the start URLs.
SEED_DEPTH_OFFSET = 2


def _item(source: int, score: Column, url: Column, next_delay: Column, depth: Column) -> list[Column]:
    return [F.col("spider"), F.lit(source).cast("tinyint").alias("source"),
            score.cast("bigint").alias("score"), url.alias("url"),
            next_delay.cast("bigint").alias("next_delay"), depth.cast("int").alias("depth")]


def _normal(depth: Column) -> list[Column]:
    return _item(NORMAL, depth, F.col("url"), F.lit(0), depth)


def _same(items: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Items with (``left_semi``) or without (``left_anti``) an equal item in ``others``; NULL equals NULL."""
    right = others.select(*[F.col(c).alias(f"_{c}") for c in COLUMNS])
    equal = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in COLUMNS]
    return items.join(right, equal, how)


def push(frontier: DataFrame, items: DataFrame) -> DataFrame:
    """Frontier with the items added; an equal item is kept once. Only the new items
    are made distinct, the stored ones are looked up and passed on."""
    fresh = items.select(*COLUMNS).distinct()
    present = _same(frontier.select(*COLUMNS), fresh, "left_semi")
    return frontier.select(*COLUMNS).unionByName(_same(fresh, present, "left_anti"))


def link_items(links: DataFrame, seen: DataFrame) -> DataFrame:
    """Items for the links not seen yet. ``links``: spider, url, depth of the page."""
    unique = with_key(links.select("spider", "url", "depth").distinct())  # equal links once
    return new_urls(unique, seen).select(*_normal(F.col("depth") + 1))


def normal_items(links: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Items for links that are known to be unseen, with the columns to ``keep``."""
    return links.select(*_normal(F.col("depth") + 1), *keep)


def enqueue_links(frontier: DataFrame, links: DataFrame, seen: DataFrame) -> DataFrame:
    return push(frontier, link_items(links, seen))


def seed_items(seeds: DataFrame, seen: DataFrame) -> DataFrame:
    """Items for the seeds not seen yet; the depth may be text."""
    depth = F.col("depth").cast("int") + SEED_DEPTH_OFFSET
    return new_urls(seeds.select("spider", "url", "depth").distinct(), seen).select(*_normal(depth))


def enqueue_seeds(frontier: DataFrame, seeds: DataFrame, seen: DataFrame) -> DataFrame:
    return push(frontier, seed_items(seeds, seen))


def reset_start_urls(frontier: DataFrame, config: DataFrame) -> DataFrame:
    """Frontier with the priority class replaced by the start URLs, due at once."""
    starts = config.select("spider", F.explode("start_urls").alias("url"), "restart_delay")
    items = starts.select(*_item(
        PRIORITY, F.lit(1), F.col("url"), F.coalesce("restart_delay", F.lit(0)), F.lit(0)))
    return push(frontier.filter(F.col("source") != PRIORITY), items)


def due_items(frontier: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Items that may be fetched now: due priority and refetch items, and unseen
    normal ones, each canonical URL once with its smallest depth."""
    timed = frontier.filter(F.col("source").isin(PRIORITY, REFETCH) & (F.col("score") <= now)).select(*COLUMNS)
    best = F.struct("score", "url", "depth", "next_delay")
    normal = (with_key(frontier.filter(F.col("source") == NORMAL))
              .groupBy(*KEY).agg(F.min(best).alias("best"))
              .join(seen.select(*KEY), KEY, "left_anti"))
    normal = normal.select("spider", F.lit(NORMAL).cast("tinyint").alias("source"), F.col("best.score"),
                           F.col("best.url"), F.col("best.next_delay"), F.col("best.depth"))
    return timed.unionByName(normal)


def next_items(frontier: DataFrame, seen: DataFrame, now: Column, n: int) -> DataFrame:
    """The next ``n`` items of each spider in fetch order, with their ``rank``."""
    order = [F.col(c) for c in ("source", "score", "url", "next_delay", "depth")]
    return first_n(due_items(frontier, seen, now), ["spider"], order, n)


def fetch_plan(items: DataFrame, config: DataFrame, now: Column, free: DataFrame | None = None) -> DataFrame:
    """Ranked items with the second each may be fetched at: the pause of the spider
    between two fetches. ``free`` (spider, free_at), from ``next_free`` of the call before, keeps the pause to its fetches too."""
    planned = with_config(items, config, ["spider_delay"])
    start = now.cast("bigint")
    if free is not None:
        planned = planned.join(free.select("spider", "free_at"), ["spider"], "left")
        start = F.greatest(start, F.coalesce("free_at", start))
    return planned.select(
        *items.columns, (start + (F.col("rank") - 1) * F.col("spider_delay")).cast("bigint").alias("planned_at"))


def next_free(planned: DataFrame, config: DataFrame, free: DataFrame | None = None) -> DataFrame:
    """``spider, free_at``: the first second at which a spider may fetch again after the planned items, to be carried to the
    next call. Spiders without items keep theirs, and no second is taken back."""
    after = with_config(planned, config, ["spider_delay"]).groupBy("spider").agg(
        F.max(F.col("planned_at") + F.col("spider_delay")).cast("bigint").alias("free_at"))
    if free is None:
        return after
    return after.unionByName(free.select("spider", "free_at")).groupBy("spider").agg(F.max("free_at").alias("free_at"))


def remove_items(frontier: DataFrame, items: DataFrame) -> DataFrame:
    """Frontier without the given items, compared by their whole value, NULL equal to NULL."""
    return _same(frontier, items.select(*COLUMNS).distinct(), "left_anti")


def drop_seen(frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Frontier without the normal items that ``next_items`` would pass over for good
    because their page is seen by now. Run it now and then to keep the table small."""
    normal = with_key(frontier.filter(F.col("source") == NORMAL))
    open_items = normal.join(seen.select(*KEY), KEY, "left_anti")
    return frontier.filter(F.col("source") != NORMAL).select(*COLUMNS).unionByName(open_items.select(*COLUMNS))


def clear(frontier: DataFrame, source: int) -> DataFrame:
    """Frontier without one class."""
    return frontier.filter(F.col("source") != source)


def listing(frontier: DataFrame) -> DataFrame:
    """All items in score order."""
    return frontier.orderBy("spider", "source", "score", "url", "depth")


def push_scores(pushes: DataFrame, member: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """Scored set after a series of pushes: a member keeps its last score."""
    return pushes.groupBy(*member).agg(F.max_by(score, seq).alias(score))


def fifo_next(rows: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The oldest ``n`` rows of a list in insertion order, duplicates kept."""
    return rows.orderBy(seq).limit(n)
