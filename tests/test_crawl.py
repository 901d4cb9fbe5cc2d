"""Crawl steps of one fetch each against a plain sequential model."""

import datetime as dt
import re
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from tests.test_fingerprint import model as simhash
from webfurrow import schemas
from webfurrow.plans.change_log import changes_in_log
from webfurrow.sources.snapshots import Snapshots
from webfurrow.streaming.crawl import apply_batch, start_tables

T0 = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)
D = 14400
PARAM = re.compile(r"\?utm=[^&]*$")


def canon(u):
    return quote(re.sub("^https?://", "", u.rstrip("/")))


def norm(u):
    return PARAM.sub("", u)


class Model:
    def __init__(self):
        self.seen, self.frontier, self.docs, self.feed = {}, {(1, 1, "http://h/", 120, 0)}, {}, []

    def store_seen(self, url, alternatives, page_hash):
        names = {canon(a) for a in alternatives} | set(self.seen.get(canon(url), (0, 0, []))[2])
        for n in names:
            self.seen[n] = (page_hash, 1, sorted(names))

    def fetch(self, url, response, error, status, page, depth, delay, source, score, now):
        self.frontier.discard((source, score, url, delay, depth))
        excluded, target = re.match(".*private", url), norm(url)
        if excluded or target != url:
            for n in self.seen.get(canon(url), (0, 0, []))[2]:
                self.seen.pop(n, None)
            if excluded:
                return
        alternatives, page_hash = [target], 0
        if error == "ConnectionError":
            status = None
        elif error is None and status < 400:
            target = norm(response)
            alternatives.append(target)
            page_hash = simhash(re.sub("<[^>]*>", "", page).lower())
            canonical = re.search('rel="canonical" href="([^"]*)"', page)
            alternatives += [canonical.group(1)] if canonical else []
            links = {norm(urljoin(target, h)) for h in re.findall('<a href="([^"]*)"', page)} if depth < 2 else set()
            for link in {x for x in links if not re.match(".*private", x) and not re.match("http://h/no", x)}:
                if canon(link) in self.seen:
                    for n in self.seen[canon(link)][2]:
                        h, count, names = self.seen[n]
                        self.seen[n] = (h, count + 1, names)
                else:
                    self.frontier.add((2, depth + 1, link, 0, depth + 1))
            old = self.docs.get(canon(target))
            body = page if status == 200 or old is None else old[0]
            self.docs[canon(target)] = (body, ([status] + (old[1] if old else []))[:10])
        else:
            return
        stored = self.seen.get(canon(target))
        new = stored is None
        changed = new or bin((stored[0] ^ page_hash) & (2**64 - 1)).count("1") >= 3
        if changed:
            self.feed.append((target, now))
        self.store_seen(target, alternatives, page_hash)
        steps = {7200: D, D: 2 * D, 2 * D: 4 * D, 4 * D: None}
        if source == 1:
            following = 120
        elif new or not delay:
            following = 7200
        elif not changed or status not in (None, 200):
            following = steps.get(delay, D)
        else:
            following = {D: D, 2 * D: D, 4 * D: 2 * D}.get(delay, 2 * D)
        if following:
            self.frontier.add((1 if source == 1 else 3, now + following, target, following, depth))


HOME = '<a href="/a">x</a><a href="/b?utm=1">y</a><a href="/no/1">n</a><a href="/private">p</a> home words one two three'
FETCHES = [
    ("http://h/", "http://h/", None, 200, HOME, 0, 120, 1, 1),
    ("http://h/a", "http://h/a?utm=9", None, 200, '<link rel="canonical" href="http://h/a2"><a href="/">h</a><a href="/a2/">s</a> a page', 1, 0, 2, 1),
    ("http://h/b", None, "ConnectionError", None, None, 1, 0, 2, 1),
    ("http://h/a", "http://h/a", None, 200, '<a href="http://h/a2">s</a> a page', 1, 14400, 3, 5),
    ("http://h/a2?utm=1", "http://h/a2", None, 304, "quite other text", 2, 28800, 3, 6),
    ("http://h/gone", "http://h/gone", None, 404, "gone", 1, 0, 2, 1),
    ("http://h/private", "http://h/private", None, 200, "secret", 1, 0, 2, 1),
    ("http://h/b", "http://h/", None, 200, HOME + " changed", 1, 57600, 3, 7),
]
RULES = [("h", "*", 1, False, "/no")]


def log_rows(spark, fetches, start=0):
    rows = []
    for n, (url, response, error, status, page, depth, delay, source, score) in enumerate(fetches, start):
        for attempt in range(1, 6 if error else 2):
            rows.append(("s", url, response, attempt, error, status, page.encode() if page else None, None,
                         T0 + dt.timedelta(minutes=n), depth, delay, source, score))
    return spark.createDataFrame(rows, schemas.FETCH_LOG)


def config_of(spark):
    return schemas.spider_config(spark, [{
        "spider": "s", "exclude_pages": [".*private"], "normalize_params": ["utm"], "start_urls": ["http://h/"]}])


@pytest.fixture(scope="module")
def crawled(spark, tmp_path_factory):
    store = Snapshots(spark, str(tmp_path_factory.mktemp("crawl")), buckets=2)
    config = config_of(spark)
    start_tables(store, config, spark.createDataFrame([], "spider string, url string, depth string"))
    rules = spark.createDataFrame(RULES, schemas.ROBOTS_RULES)
    model = Model()
    for version, fetch in enumerate(FETCHES):
        apply_batch(store, version, log_rows(spark, [fetch], version), config, rules)
        model.fetch(*fetch, int((T0 + dt.timedelta(minutes=version)).timestamp()))
    return store, model, config, rules


def tables(store, version):
    seen = {r.key: (r.page_hash, r["count"], sorted(r.alternatives)) for r in store.read_seen(version).flat().collect()}
    frontier = {(r.source, r.score, r.url, r.next_delay, r.depth) for r in store.read("frontier", version).collect()}
    documents = {r.key: (r.raw_html, [h.status for h in r.history]) for r in store.documents(version).collect()}
    return seen, frontier, documents


def test_steps_of_one_fetch_are_the_sequential_crawl(crawled):
    store, model, _, _ = crawled
    seen, frontier, documents = tables(store, len(FETCHES) - 1)
    assert seen == model.seen
    assert frontier == model.frontier
    assert documents == model.docs
    feed = sorted((r.url, r.detected_at) for r in store.read_all("change_feed", len(FETCHES) - 1).filter("version >= 0").collect())
    assert feed == sorted(model.feed)


@pytest.mark.parametrize("cuts", [[8], [3, 8]])
def test_any_batches_are_the_sequential_crawl(spark, crawled, tmp_path, cuts):
    _, model, config, rules = crawled
    store = Snapshots(spark, str(tmp_path), buckets=2)
    start_tables(store, config, spark.createDataFrame([], "spider string, url string, depth string"))
    for version, (start, stop) in enumerate(zip([0, *cuts], cuts)):
        apply_batch(store, version, log_rows(spark, FETCHES[start:stop], start), config, rules)
    assert tables(store, len(cuts) - 1) == (model.seen, model.frontier, model.docs)
    feed = {}
    for r in store.read_all("change_feed", len(cuts)).filter("version >= 0").collect():
        feed[r.url] = max(r.detected_at, feed.get(r.url, 0))
    assert feed == dict(sorted(model.feed, key=lambda f: f[1]))


def test_a_repeated_batch_changes_nothing(spark, crawled):
    store, _, config, rules = crawled
    last = len(FETCHES) - 1
    before = tables(store, last)
    apply_batch(store, last, log_rows(spark, [FETCHES[last]], last), config, rules)
    assert tables(store, last) == before


def test_change_log_over_buckets_is_the_plain_lag(spark):
    import random
    rng = random.Random(3)
    rows = [("s", f"k{rng.randint(0, 3)}", f"u{n}", rng.choice([0, 1, 7, 15, -1]), T0 + dt.timedelta(hours=rng.randint(0, 200), seconds=n))
            for n in range(300)]
    df = spark.createDataFrame(rows, "spider string, key string, url string, dhash bigint, fetched_at timestamp")
    want, last = set(), {}
    for s, k, u, h, at in sorted(rows, key=lambda r: (r[4], r[2])):
        if k not in last or bin((last[k] ^ h) & (2**64 - 1)).count("1") >= 3:
            want.add(u)
        last[k] = h
    assert {r.url for r in changes_in_log(df).collect()} == want
    assert {r.url for r in changes_in_log(df, bucket=F.hour("fetched_at") * 0).collect()} == want


def test_extractors(spark):
    from webfurrow.plans import extensions
    from webfurrow.plans.crawl_step import visit_batch
    log, config = log_rows(spark, FETCHES[:1]), config_of(spark)
    extensions.register_extractor("comments", lambda page: F.regexp_count(page, F.lit("<a ")))
    extensions.register_extractor("title", lambda page: F.lit("t"), spider="other")
    extensions.register_extractor("text", lambda page: F.lit("fixed"), spider="s")
    try:
        row = visit_batch(log, config).first()
        assert (row.comments, row.title, row.hash) == (4, None, simhash("fixed"))
    finally:
        extensions.clear_extractors()
    assert visit_batch(log, config).first().comments == 0
