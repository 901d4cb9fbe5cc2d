"""Taking items out of the frontier, and the change feed of batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from webfurrow import schemas
from webfurrow.plans.change_log import changes_in_log
from webfurrow.plans.take import IN_FLIGHT, return_expired, settle, take_items
from webfurrow.sources.snapshots import Snapshots
from webfurrow.streaming import change_feed

ITEMS = [("a", 2, 0, "http://n.test/1", None, 0), ("a", 2, 1, "https://n.test/1/", 0, 1), ("a", 2, 2, "http://n.test/bad", 0, 2),
         ("a", 3, 50, "http://n.test/2?x=1#f", None, 1), ("a", 3, 500, "http://n.test/later", 9, 1), ("a", 1, 1, "http://n.test/", 120, 0)]


def rows(df):
    return {tuple(r) for r in df.collect()}


def taken(spark, frontier, out, n, seen=()):
    config = schemas.spider_config(spark, [{"spider": "a", "exclude_pages": [".*bad"], "start_urls": []}])
    known = spark.createDataFrame([("a", k, 1, 1, [k]) for k in seen], schemas.SEEN)
    return take_items(frontier, out, known, config, F.lit(100), n)


def test_items_are_checked_taken_once_and_returned_after_the_lease(spark):
    frontier = spark.createDataFrame(ITEMS, schemas.FRONTIER)
    none = spark.createDataFrame([], IN_FLIGHT)
    one = taken(spark, frontier, none, 3)
    assert [(r.url, r.nurl) for r in one.items.orderBy("rank").collect()] == [
        ("http://n.test/", "http://n.test/"), ("http://n.test/1", "http://n.test/1")]
    assert rows(one.removed) == {("a", "http://n.test/bad")}
    assert rows(one.in_flight) == {(*ITEMS[5], 100), (*ITEMS[0], 100)}
    assert rows(one.frontier) == {ITEMS[1], ITEMS[3], ITEMS[4]}
    # The other address of a page in flight waits; the refetch item loses its fragment.
    two = taken(spark, one.frontier, one.in_flight, 3)
    assert [(r.url, r.nurl) for r in two.items.collect()] == [("http://n.test/2?x=1#f", "http://n.test/2?x=1")]
    assert rows(two.removed) == {("a", "http://n.test/2?x=1#f")} and rows(two.frontier) == {ITEMS[1], ITEMS[4]}
    # A result settles its item, NULL delay and all; what is out too long comes back.
    left = settle(two.in_flight, frontier.filter("url = 'http://n.test/1'"))
    assert rows(left) == {(*ITEMS[5], 100), (*ITEMS[3], 100)}
    again, out = return_expired(two.frontier, left, F.lit(160), 60)
    assert rows(again) == {ITEMS[1], ITEMS[4], ITEMS[5], ITEMS[3]} and rows(out) == set()
    assert {r.url for r in taken(spark, again, out, 9, seen=["n.test/1"]).items.collect()} == {"http://n.test/", "http://n.test/2?x=1#f"}


def test_empty_frontier_gives_nothing(spark):
    got = taken(spark, spark.createDataFrame([], schemas.FRONTIER), spark.createDataFrame([], IN_FLIGHT), 5)
    assert got.items.count() == got.removed.count() == got.frontier.count() == got.in_flight.count() == 0


def test_batches_give_the_feed_of_the_whole_log(spark, tmp_path):
    rnd, start = random.Random(3), dt.datetime(2024, 5, 1)
    log = [("a", f"p{rnd.randrange(6)}", f"u{n}", rnd.choice([None, 0, 1, 7, 255]), start + dt.timedelta(minutes=7 * n)) for n in range(120)]
    df = spark.createDataFrame(log, "spider string, key string, url string, dhash long, fetched_at timestamp")
    store = Snapshots(spark, str(tmp_path), segments=2)
    for version in range(5):
        part = df.filter(F.substring("url", 2, 9).cast("int").between(24 * version, 24 * version + 23))
        for _ in range(2):  # a batch that is repeated changes nothing
            change_feed.apply_fetches(store, version, part)
    assert rows(store.read_all("fetch_feed", 4).select(*df.columns)) == rows(changes_in_log(df))
    full = store.read("last_hash", 4)
    last = df.groupBy("spider", "key").agg(F.max_by("dhash", "fetched_at").alias("dhash"))
    assert full.count() == 6 and rows(full) == rows(last.select(*full.columns))
