"""Seen table, frontier, refetch timing, outcomes and documents on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from webfurrow import schemas
from webfurrow.functions import outcomes, refetch
from webfurrow.operators import documents as docs
from webfurrow.operators import frontier as fr
from webfurrow.operators import seen as sn
from webfurrow.operators.alias_groups import grouped, hit, remove
from webfurrow.operators.fetches import resolve_attempts, route
from webfurrow.operators.lookup import first_n, lookup_join, of_spiders, with_config
from webfurrow.plans.replay import store
from webfurrow.plans.reschedule import announcements, judge, refetch_items, timed
from webfurrow.session import default_stage
from webfurrow.sources.tables import read_seed_file, usable_seeds, write_documents

T0 = dt.datetime(2018, 5, 31)


def seen_table(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], schemas.SEEN)


def urls_df(spark, names, spider="s"):
    return spark.createDataFrame([(spider, u) for u in names], "spider string, url string")


def visits(spark, rows):
    """(url, alternatives, dhash, minute)"""
    data = [("s", u, a, h, T0 + dt.timedelta(minutes=m)) for u, a, h, m in rows]
    return spark.createDataFrame(data, "spider string, url string, alternatives array<string>, dhash bigint, fetched_at timestamp")


def as_dict(seen):
    return {r.key: (r.page_hash, r["count"], r.alternatives) for r in seen.collect()}


EMPTY_SEEN = []


def changed(spark, seen, change):
    """Flat table after a change of its groups."""
    stage = default_stage(spark, "seen")
    return change(grouped(seen, stage), stage).flat()


def added(spark, pages, seen):
    return changed(spark, seen, lambda state, stage: store(state, pages, stage))


def deleted(spark, unwanted, seen):
    return changed(spark, seen, lambda state, stage: remove(state, sn.with_key(unwanted), stage))


def test_add_then_delete(spark):
    names = ["http://shop.example.org/", "https://m.shop.example.org", "http://old-shop.example.net"]
    keys = ["m.shop.example.org", "old-shop.example.net", "shop.example.org"]
    seen = added(spark, visits(spark, [(names[0], [*names, None, ""], 77, 0)]), seen_table(spark, EMPTY_SEEN))
    assert as_dict(seen) == {k: (77, 1, keys) for k in keys}
    assert as_dict(deleted(spark, urls_df(spark, ["blog.example.org"]), seen)) == as_dict(seen)
    assert as_dict(deleted(spark, urls_df(spark, [names[2]]), seen)) == {}
    assert sn.size(seen).first().n == 3


def test_add_merges_the_stored_aliases(spark):
    first = added(spark, visits(spark, [("http://a?q=test", ["http://a?q=test", "http://b/", "https://c"], 1, 0)]), seen_table(spark, EMPTY_SEEN))
    second = as_dict(added(spark, visits(spark, [("http://b", ["http://b", "http://d"], 2, 1)]), first))
    names = ["a%3Fq%3Dtest", "b", "c", "d"]
    assert second == {k: (2, 1, names) for k in names}


def test_visits_of_a_batch_are_stored_one_after_another(spark):
    stored = seen_table(spark, [("a", 1, 5, ["a", "x"]), ("x", 1, 5, ["a", "x"]), ("z", 9, 3, ["z"])])
    out = as_dict(added(spark, visits(spark, [("http://a", ["http://a", "http://p"], 7, 1), ("http://a", ["http://a", "http://q"], 8, 2)]), stored))
    names = ["a", "p", "q", "x"]  # the second visit takes over the names of the first
    assert out == {k: (8, 1, names) for k in names} | {"z": (9, 3, ["z"])}


def test_increment_counts_each_link_of_a_group(spark):
    stored = seen_table(spark, [("r1", 1, 1, ["r1", "r3"]), ("r3", 1, 1, ["r1", "r3"]), ("r4", 2, 1, ["r4"])])
    counts = sn.link_counts(urls_df(spark, ["http://r1", "https://r3/", "http://r2"]))
    out = as_dict(changed(spark, stored, lambda state, stage: hit(state, counts, stage)[0]))
    assert out["r1"][1] == 3 and out["r3"][1] == 3 and out["r4"][1] == 1
    assert {r.url for r in sn.new_urls(urls_df(spark, ["http://r1", "http://r2"]), stored).collect()} == {"http://r2"}
    assert {(r.key, r.known) for r in sn.contains(urls_df(spark, ["http://r1", "http://r2"]), stored).collect()} == {("r1", True), ("r2", False)}
    # Another spider shares nothing.
    assert sn.lookup(urls_df(spark, ["http://r1"], "t"), stored).count() == 0


def links_df(spark, rows):
    return spark.createDataFrame([("s", u, d) for u, d in rows], "spider string, url string, depth int")


def empty_frontier(spark):
    return spark.createDataFrame([], schemas.FRONTIER)


def test_enqueue_links(spark):
    found = [("http://shop.example.org/tea", 0), ("http://shop.example.org/cups", 0), ("http://blog.example.org/", 3)]
    none = seen_table(spark, EMPTY_SEEN)
    first = fr.enqueue_links(empty_frontier(spark), links_df(spark, found), none)
    assert {(r.url, r.source, r.score, r.depth) for r in first.collect()} == {(u, 2, d + 1, d + 1) for u, d in found}
    again, deeper = links_df(spark, found[:1]), links_df(spark, [(found[0][0], 6)])
    assert fr.enqueue_links(first, again, none).count() == 3  # the same item
    assert fr.enqueue_links(first, deeper, none).count() == 4  # another depth is another item
    known = seen_table(spark, [("shop.example.org/tea", 5, 1, ["shop.example.org/tea"])])
    assert fr.enqueue_links(first, deeper, known).count() == 3


def test_seeds_rank_by_depth(spark):
    rows = [("s", "far.example.org", "8"), ("s", "near.example.org", "0"), ("s", "mid.example.org", "4")]
    seeds = spark.createDataFrame(rows, "spider string, url string, depth string")
    queued = fr.enqueue_seeds(empty_frontier(spark), seeds, seen_table(spark, EMPTY_SEEN))
    out = fr.next_items(queued, seen_table(spark, EMPTY_SEEN), F.lit(10), 99).orderBy("rank").collect()
    assert [(r.url.split(".")[0], r.depth) for r in out] == [("near", 2), ("mid", 6), ("far", 10)]


def test_items_with_null_are_equal_to_themselves(spark):
    item = ("s", 2, 1, "http://a.example.org", None, None)
    frontier = spark.createDataFrame([item, ("s", 2, 1, "http://a.example.org", 0, None)], schemas.FRONTIER)
    fetched = spark.createDataFrame([item], schemas.FRONTIER)
    assert [r.next_delay for r in fr.remove_items(frontier, fetched).collect()] == [0]
    assert fr.push(frontier, fetched).count() == 2


def test_next_items_order_and_limits(spark):
    items = [("s", 1, 5, "p-late", 9, 0), ("s", 1, 1, "p2", 9, 0), ("s", 1, 1, "p1", 9, 0), ("s", 2, 4, "http://n", 0, 4), ("s", 2, 2, "https://n/", 0, 2),
             ("s", 2, 1, "http://old", 0, 1), ("s", 3, 3, "r", 9, 1), ("s", 3, 9, "r-late", 9, 1), ("t", 3, 3, "r", 9, 1)]
    frontier = spark.createDataFrame(items, schemas.FRONTIER)
    seen = seen_table(spark, [("old", 1, 1, ["old"])])
    out = fr.next_items(frontier, seen, F.lit(4), 10)
    assert [(r.url, r.source) for r in out.filter("spider = 's'").orderBy("rank").collect()] == [("p1", 1), ("p2", 1), ("https://n/", 2), ("r", 3)]
    assert fr.next_items(frontier, seen, F.lit(4), 1).count() == 2
    assert fr.next_items(frontier, seen, F.lit(0), 10).filter("source <> 2").count() == 0
    config = schemas.spider_config(spark, [{"spider": "s", "delay": 20}, {"spider": "t"}])
    plan = fr.fetch_plan(out, config, F.lit(100)).filter("spider = 's'").orderBy("rank")
    assert [r.planned_at for r in plan.collect()] == [100, 120, 140, 160]
    # The next call, a little later, starts after the last second the one before has planned.
    free = fr.next_free(plan, config)
    again = fr.fetch_plan(out, config, F.lit(130), free).filter("spider = 's'").orderBy("rank")
    assert [r.planned_at for r in again.collect()] == [180, 200, 220, 240]
    late = fr.fetch_plan(out, config, F.lit(500), fr.next_free(again, config, free)).filter("spider = 's'").orderBy("rank")
    assert [r.planned_at for r in late.collect()] == [500, 520, 540, 560]
    assert [tuple(r) for r in fr.next_free(again.limit(0), config, free).collect()] == [("s", 180)]
    rest = fr.remove_items(frontier, out)
    assert rest.count() == 4 and fr.clear(rest, 2).count() == 2
    assert {r.url for r in frontier.join(fr.drop_seen(frontier, seen), fr.COLUMNS, "left_anti").collect()} == {"http://old"}
    assert of_spiders(frontier, config.filter("spider = 't'")).count() == 1


def test_start_urls_replace_the_priority_class(spark):
    frontier = spark.createDataFrame([("s", 1, 77, "old", 9, 0), ("s", 2, 1, "n", 0, 1)], schemas.FRONTIER)
    config = schemas.spider_config(spark, [{"spider": "s", "start_urls": ["a", "b"], "restart_delay": 2}])
    out = {(r.source, r.score, r.url, r.next_delay, r.depth) for r in fr.reset_start_urls(frontier, config).collect()}
    assert out == {(1, 1, "a", 2, 0), (1, 1, "b", 2, 0), (2, 1, "n", 0, 1)}


def test_scored_set_and_list(spark):
    pushes = spark.createDataFrame([("a", 5, 1), ("b", 3, 2), ("a", 1, 3)], "member string, score long, seq long")
    assert {(r.member, r.score) for r in fr.push_scores(pushes, ["member"]).collect()} == {("a", 1), ("b", 3)}
    rows = spark.createDataFrame([(3, "y"), (1, "x"), (2, "y")], "seq long, item string")
    assert [r.item for r in fr.fifo_next(rows, 2).collect()] == ["x", "y"]


STORED = 1 << 40
CHANGED = STORED ^ 0b10101  # three bits away
PAGE = "http://news.example.net/story"


def reschedule(spark, strategy, refetching, source, delay, dhash, url=PAGE):
    seen = seen_table(spark, [(k, STORED, 2, ["news.example.net/story", "m.example.net/7"]) for k in ("news.example.net/story", "m.example.net/7")])
    config = schemas.spider_config(spark, [{"spider": "s", "restart_delay": 45, "refetching_delay": refetching, "refetching_strategy": strategy}])
    v = visits(spark, [(url, [url], dhash, 0)]).withColumns({
        "source": F.lit(source).cast("tinyint"), "delay": F.lit(delay).cast("bigint"), "depth": F.lit(1), "status": F.lit(200)})
    judged = judge(v, seen).join(config.select("spider", "restart_delay", "refetching_delay", "refetching_strategy"), "spider")
    items = refetch_items(timed(judged, F.lit(1000))).collect()
    assert all(i.score == 1000 + i.next_delay for i in items)
    return [(i.source, i.next_delay) for i in items]


NEW = "http://news.example.net/first"


@pytest.mark.parametrize("strategy,refetching,source,delay,dhash,url,want", [
    # base: double while unchanged, halve over an hour when changed, else stay
    ("base", 60, 3, 6400, STORED, PAGE, [(3, 12800)]),
    ("base", 60, 3, 6400, CHANGED, PAGE, [(3, 3200)]),
    ("base", 60, 3, 6401, CHANGED, PAGE, [(3, 3200)]),
    ("base", 60, 3, 3600, CHANGED, PAGE, [(3, 3600)]),
    ("base", 60, 2, 900, CHANGED, NEW, [(3, 60)]),
    ("base", 60, 1, 900, CHANGED, NEW, [(1, 45)]),
    ("", 60, 2, 6400, STORED, PAGE, [(3, 12800)]),
    # news: d, 2 d, 4 d while unchanged, then given up; back one step when changed
    ("news", 50, 3, 50, STORED, PAGE, [(3, 100)]),
    ("news", 50, 3, 100, STORED, PAGE, [(3, 200)]),
    ("news", 50, 3, 200, STORED, PAGE, []),
    ("news", 50, 3, 200, CHANGED, PAGE, [(3, 100)]),
    ("news", 50, 3, 100, CHANGED, PAGE, [(3, 50)]),
    ("news", 50, 2, 0, CHANGED, NEW, [(3, 7200)]),
    ("news", 50, 1, 900, CHANGED, NEW, [(1, 45)]),
    ("news", 900, 3, 7200, STORED, PAGE, [(3, 900)]),
])
def test_reschedule(spark, strategy, refetching, source, delay, dhash, url, want):
    assert reschedule(spark, strategy, refetching, source, delay, dhash, url) == want


def test_visits_of_a_batch_are_judged_one_after_another(spark):
    a, b = "http://a.example.org", "http://b.example.org"
    rows = [(a, [a], 0b111, 0), (a, [a], 0b111, 1), (a, [a], 0, 61), (a, [a], 0, 62), (b, [b], 9, 0), (b, [b], 9, 500)]
    judged = judge(visits(spark, rows), seen_table(spark, [("b.example.org", 9, 1, ["b.example.org"])])).orderBy("url", "fetched_at").collect()
    assert [(r.is_new, r.is_changed) for r in judged] == [(True, True), (False, False), (False, True), (False, False), (False, False), (False, False)]


def test_unknown_policy_fails_and_own_policy_works(spark):
    with pytest.raises(Exception, match="unknown refetching strategy"):
        reschedule(spark, "weekly", 60, 2, 500, STORED)
    refetch.register_policy("weekly", lambda v: F.lit(604800))
    try:
        assert reschedule(spark, "weekly", 60, 2, 500, STORED) == [(3, 604800)]
    finally:
        refetch._POLICIES.pop("weekly")
    with pytest.raises(Exception, match="must be positive"):
        reschedule(spark, "base", 0, 2, 0, STORED, NEW)


def test_announcements_keep_the_latest_time(spark):
    v = visits(spark, [("http://a", ["http://a"], 5, 0), ("http://a", ["http://a"], 5 ^ 0b11100, 1), ("http://b", ["http://b"], 0, 2)])
    judged = judge(v, seen_table(spark, [("b", 1, 1, ["b"])]))
    out = announcements(judged, F.unix_timestamp("fetched_at")).collect()
    assert [(r.url, r.detected_at) for r in out] == [("http://a", int((T0 + dt.timedelta(minutes=1)).replace(tzinfo=dt.timezone.utc).timestamp()))]


def test_outcomes(spark):
    rows = [("TooManyRedirects", 300), ("HTTPError", 300), ("Timeout", 300), ("InvalidSchema", 300), ("ConnectionError", 200), (None, 0), ("Boom", 100)]
    df = spark.createDataFrame(rows, "error string, want int")
    assert df.filter(outcomes.outcome(F.col("error")) != F.col("want")).count() == 0
    waits = spark.range(1, 6).select(outcomes.wait_after(F.col("id")).alias("w"), outcomes.waited_before(F.col("id")).alias("b")).collect()
    assert [(r.w, r.b) for r in waits] == [(0, 0), (600, 0), (1200, 600), (1800, 1800), (2400, 3600)]


def test_resolve_attempts(spark):
    c, t = "ConnectionError", "Timeout"
    log = [("a", 1, c, None), ("a", 2, c, None), ("a", 3, None, 200), ("a", 4, t, None), ("b", 1, c, None), ("b", 2, t, None),
           *[("c", n, c, None) for n in range(1, 8)], ("c", 8, None, 200), ("d", 1, None, 404)]
    df = spark.createDataFrame(log, "url string, attempt int, error string, status_code int")
    out = {r.url: (r.attempt, r.outcome, r.route) for r in route(resolve_attempts(df, ["url"])).collect()}
    assert out == {"a": (3, 0, "parse"), "b": (2, 300, "drop"), "c": (5, 200, "reschedule"), "d": (1, 0, "drop")}


def doc_batch(spark, rows):
    """(key, status, minute, body)"""
    data = [("s", k, k, b, False, h, "", 0, {}, T0 + dt.timedelta(minutes=m), st) for h, (k, st, m, b) in enumerate(rows)]
    return spark.createDataFrame(data, "spider string, key string, url string, raw_html string, blocked boolean, hash long, domain string, "
                                       "comments int, social map<string,string>, fetched_at timestamp, status int")


def no_documents(spark):
    return spark.createDataFrame([], schemas.DOCUMENTS)


def docs_dict(df):
    return {r.key: (r.raw_html, [h.status for h in r.history]) for r in df.collect()}


def model_store(stored, rows, limit=None):
    """One document after another."""
    for key, status, _, body in sorted(rows, key=lambda r: r[2]):
        old = stored.get(key)
        new = (body if status == 200 or old is None else old[0], ([status] + (old[1] if old else []))[:10])
        if limit is None or len(new[0]) <= limit:
            stored[key] = new
    return stored


def test_bad_status_keeps_the_body(spark):
    table = no_documents(spark)
    for status, body, kept, history in ((200, "morning", "morning", [200]), (503, "error page", "morning", [503, 200]),
                                        (200, "evening", "evening", [200, 503, 200])):
        table = docs.merge_documents(table, doc_batch(spark, [("k", status, len(history), body)]))
        assert docs_dict(table) == {"k": (kept, history)}
    assert docs_dict(docs.delete_documents(table, table)) == {}


@pytest.mark.parametrize("limit", [None, 3])
def test_any_batching_gives_the_sequential_result(spark, limit):
    import random
    rng = random.Random(7)
    rows = [(rng.choice("abcde"), rng.choice([200, 200, 304, 500]), m, "x" * rng.randint(1, 5)) for m in range(60)]
    want = model_store({}, rows, limit)
    for cuts in ([60], [5, 20, 35]):
        table = no_documents(spark)
        for batch in [rows[:cuts[0]]] + [rows[c:15 + c] for c in cuts[1:]]:
            if batch:
                table = docs.merge_documents(table, doc_batch(spark, batch), limit)
        rows_used = rows[:cuts[0]] + [r for c in cuts[1:] for r in rows[c:15 + c]]
        assert docs_dict(table) == (want if len(rows_used) == 60 else model_store({}, rows_used, limit))


def test_document_defaults(spark):
    df = spark.createDataFrame([("u", None, "2018", 301), ("v", [("2019", 200)], "2018", 301)],
                               "url string, history array<struct<fetched_time:string,status:int>>, fetched_time string, status int")
    rows = {r.url: r for r in docs.with_document_defaults(df).collect()}
    assert (rows["u"].fetched_time, rows["u"].status, rows["v"].fetched_time, rows["v"].status) == ("2018", 301, "2019", 200)
    assert (rows["u"].raw_html, rows["u"].blocked, rows["u"].hash, rows["u"].social, rows["u"].history) == ("", False, 0, {}, [])
    assert docs.short_info(df).columns == ["url", "fetched_time", "status", "domain", "comments", "social"]


def test_seed_file(spark, tmp_path):
    path = tmp_path / "seeds"
    path.write_text('{"url":"http://in.example.org/x", "depth": "3"}\nno json {\n{"url":"http://out.example.com/", "depth": "0"}\n'
                    '{"url":"http://in.example.org/", "depth": "0"}\n')
    config = schemas.spider_config(spark, [{"spider": "s", "allowed_domains": ["in.example.org"], "start_urls": ["http://in.example.org/"]}])
    seeds = read_seed_file(spark, str(path), "s")
    assert seeds.cache().filter("_bad_line is not null").count() == 1
    assert [(r.url, r.depth) for r in usable_seeds(seeds, config).collect()] == [("http://in.example.org/x", "3")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", None)], "url string, hash long")
    write_documents(df, "json", str(tmp_path / "j"))
    write_documents(df, "json", str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).collect()[0].value == '{"url":"u","hash":null}'
    write_documents(df, "parquet", str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    with pytest.raises(ValueError):
        write_documents(df, "redis", "x")


def test_config_defaults(spark):
    row = schemas.with_defaults(spark.createDataFrame([("s",)], "spider string")).first()
    assert (row.depth, row.delay, row.refetching_strategy, row.allowed_domains, row.exclude_re) == (2, 20, "news", [], None)
    with pytest.raises(ValueError):
        schemas.spider_config(spark, [{"spider": "s", "colour": 1}])


def test_hot_keys_are_spread(spark):
    facts = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    lookup = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = lookup_join(facts, lookup, ["k"])
    assert joined.count() == 1000 and joined.filter("v <> 2 * k or v is null").count() == 0
    for n in (20, 600, 2000):  # one plan below and above Spark's own limit for cutting early
        top = first_n(facts, ["k"], [F.col("id")], n)
        assert [r.id for r in top.filter("k = 0").orderBy("rank").collect()] == list(range(min(n, 900)))
        assert top.count() == 100 + min(n, 900)


def test_a_spider_without_config_is_not_lost_unseen(spark):
    config = schemas.spider_config(spark, [{"spider": "s"}])
    assert with_config(urls_df(spark, ["a"]), config, ["spider_delay"]).count() == 1
    with pytest.raises(Exception, match="no config for spider t"):
        with_config(urls_df(spark, ["a"], "t"), config, ["spider_delay"]).collect()
