"""The seen table after a batch of visits and links, as if they had come one by one.

Visits that share a name, a stored list or a page to delete are replayed in their order, component by
component. Links meet their component at the time of the page they stand on. Links to any other
stored page only raise its counter, by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import urls
from webfurrow.operators.alias_groups import ALIASES, GROUPS, KEY, ORDER, SeenGroups, SeenStep, hit, node, replay
from webfurrow.operators.components import Stage, components
from webfurrow.operators.lookup import as_of


def with_order(df: DataFrame, at: str = "fetched_at", url: str = "url") -> DataFrame:
    """Adds the ORDER columns. Stage the result before it is used twice: rows equal in everything are told apart by number."""
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "byte", "timestamp", "boolean")
             and f.name not in ("raw_html", "text")]
    return df.withColumns({"at": F.col(at), "visit": F.col(url), "tie": F.xxhash64(*plain, *[c for c in ("alternatives",) if c in df.columns]), "row": F.monotonically_increasing_id()})


def events_of(visits: DataFrame) -> DataFrame:
    """Events from visits: ORDER, ``names`` and keys. ``gone_url`` is a URL to delete first, ``url`` the page to store; either may be NULL."""
    names = F.array_distinct(F.transform(F.filter("alternatives", lambda a: F.coalesce(a, F.lit("")) != ""), urls.canonize))
    main = urls.canonize(F.col("url"))
    return visits.select(
        "spider", *ORDER, F.when(F.col("gone_url").isNotNull(), urls.canonize(F.col("gone_url"))).alias("gone"), main.alias("main"),
        F.when(F.col("url").isNotNull(), F.array_union(F.array(main), F.coalesce(names, F.array().cast("array<string>")))).alias("names"), "dhash")


def replay_batch(stored: SeenGroups, events: DataFrame, stage: Stage, links: DataFrame | None = None,
                 page_links: DataFrame | None = None, also: DataFrame | None = None) -> SeenStep:
    """``stored``: the table, or anything else with its ``around``. ``events``: staged, see ``events_of``. ``links``: spider,
    url, depth, key, n, equal ones counted. ``page_links``: the same links one by one with the ORDER of their
    page. ``also``: keys (spider, key) whose links need an order too.

    Pages of no event are not replayed, so what meets in a task is one component of the batch, and a hot
    link target is counted before any shuffle or split by the hour. Of the table only what the batch touches is used.
    """
    touched = events.select("spider", F.explode(F.array_distinct(F.concat(
        F.coalesce("names", F.array().cast("array<string>")), F.array_compact(F.array("gone"))))).alias("key"), "row")
    anchor = events.select("row", node(F.col("spider"), F.coalesce("main", "gone")).alias("a"))
    keys = touched.select(*KEY).distinct() if also is None else touched.select(*KEY).unionByName(also.select(*KEY)).distinct()
    keys = stage(keys.withColumn("node", node(F.col("spider"), F.col("key"))), "event-keys")
    wanted = keys.select(*KEY) if links is None else stage(keys.select(*KEY).unionByName(links.select(*KEY)).distinct(), "wanted-keys")
    known, lists = stored.around(wanted, stage)
    known = known.join(keys, KEY).select("node", "comp").distinct()
    edges = (touched.join(anchor, "row").select("a", node(F.col("spider"), F.col("key")).alias("b"))
             .unionByName(known.select(F.col("node").alias("a"), F.col("comp").alias("b")))
             .unionByName(keys.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    labels = components(edges, stage)
    comps = stage(known.select("comp").distinct().join(labels, F.col("comp") == F.col("node")).select("comp", "label"), "touched")
    own = SeenGroups(lists.aliases.join(comps, "comp").drop("comp"), lists.groups.join(comps, "comp").drop("comp"))
    placed_events = events.join(labels, node(F.col("spider"), F.coalesce("main", "gone")) == F.col("node")).drop("node")
    if links is None:
        done = replay(own, placed_events, None, stage)
        return SeenStep(done.visits, events.select("spider", *ORDER).limit(0), lists, done.state)

    place = stage(keys.join(labels, "node").select(*KEY, "label").unionByName(own.aliases.select(*KEY, "label")).distinct(), "places")
    timed = page_links.join(links.join(place, KEY).select("spider", "url", "depth", "key", "label"), ["spider", "url", "depth"])
    slots = stage(as_of(timed, placed_events.select("label", *ORDER), ["label"], ORDER, F.date_trunc("hour", F.col("at")), "slot")
                  .withColumn("same", F.coalesce(F.col("slot.row") == F.col("row"), F.lit(False))), "link-slots")
    slot = [F.col(f"slot.{c}").alias(c) for c in ORDER]
    hits = slots.select("label", *KEY, *slot, "same").groupBy("label", *KEY, *ORDER, "same").agg(F.count("*").alias("n"))
    done = replay(own, placed_events, hits, stage)
    missed = done.hits.filter("NOT known").select(*KEY, F.coalesce("row", F.lit(-1)).alias("_slot"), "same")
    late = (slots.withColumn("_slot", F.coalesce("slot.row", F.lit(-1))).join(missed, [*KEY, "_slot", "same"], "left_semi")
            .select("spider", "url", "depth", *ORDER))
    rest = SeenGroups(lists.aliases.join(comps, "comp", "left_anti").select(*ALIASES.fieldNames()),
                      lists.groups.join(comps, "comp", "left_anti").select(*GROUPS.fieldNames()))

    plain = links.join(place, KEY, "left_anti")
    rest, found = hit(rest, plain.groupBy(*KEY).agg(F.sum("n").alias("n")), stage)
    early = plain.join(found, KEY, "left_anti").select("spider", "url", "depth", *[
        F.lit(None).cast(t).alias(c) for c, t in zip(ORDER, ("timestamp", "string", "bigint", "bigint"), strict=True)])
    return SeenStep(done.visits, late.unionByName(early), lists, SeenGroups(
        rest.aliases.unionByName(done.state.aliases), rest.groups.unionByName(done.state.groups)))


def known_at(links: DataFrame, visits: DataFrame, stored: DataFrame, order: Sequence[str]) -> DataFrame:
    """``links`` with ``known``: whether their page was stored when they were found.

    It was if its key is in ``stored`` (spider, key) or if one of ``visits`` of the key comes before the link in
    ``order``, whose first column is a time; a page's own visit comes after its links. For logs in which no
    page is deleted; ``replay_batch`` is for all others.
    """
    steps = [*order, "_phase"]
    found = as_of(links.withColumn("_phase", F.lit(0)), visits.select(*KEY, *order, F.lit(1).alias("_phase")), KEY, steps,
                  F.date_trunc("hour", F.col(order[0])), "_last")
    kept = stored.select(*KEY, F.lit(True).alias("_stored")).distinct()
    return found.join(kept, KEY, "left").withColumn(
        "known", F.col("_last").isNotNull() | F.col("_stored").isNotNull()).select(*links.columns, "known")


def store(stored: SeenGroups, pages: DataFrame, stage: Stage) -> SeenGroups:
    """The lists after fetched pages were stored one by one in the order of ``(fetched_at, url)``.

    ``pages``: spider, url, dhash, alternatives (raw URLs), fetched_at.
    """
    rows = stage(with_order(pages.select("spider", "url", "dhash", "alternatives", "fetched_at")), "pages")
    events = stage(events_of(rows.withColumn("gone_url", F.lit(None).cast("string"))), "events")
    return stored.after(replay_batch(stored, events, stage))
