"""Change feed, crawl step and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.document_queries import batch, flat, merge_sql
from catalog.page_queries import links_sql
from catalog.frontier_queries import policy_sql
from webfurrow.functions import fingerprint, html, urls
from webfurrow.plans.change_log import changes_in_log
from webfurrow.operators.alias_groups import grouped
from webfurrow.plans.crawl_step import crawl_step as run_step
from webfurrow.schemas import FETCH_LOG
from webfurrow.session import default_stage, staging_path
from webfurrow.sources.snapshots import Snapshots
from webfurrow.sources.tables import stream_fetch_log
from webfurrow.streaming.change_feed import start_change_feed
from webfurrow.streaming.crawl import start_crawl, start_tables

_fe, _pg, _hp, _cfg = i.fetches_sql, i.pages_sql, i.head_pages_sql, i.config_sql
_feed = ["spider", "key", "dhash", "at"]


def _feed_rows(df):
    return df.select("spider", "key", "dhash", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


_feed_sql = f"""WITH {_fe}, p AS (SELECT *, lag(dhash) OVER (PARTITION BY spider, key ORDER BY fetched_at, url) AS prev FROM fe)
SELECT spider, key, dhash, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS at FROM p WHERE prev IS NULL OR bit_count(xor(dhash, prev)) >= 3"""


def change_feed(spark, sf):
    return _feed_rows(changes_in_log(i.fetches(spark, sf)))


def _written(spark, df, name):
    """The rows as files, week after week, the way a log arrives, and how many files two weeks have at least.

    A week has as many files as ``df`` has parts, so that no task writes, or later reads, a whole week.
    """
    path = staging_path(spark, name)
    week = F.least(F.floor((F.dayofmonth("fetched_at") - 1) / 8), F.lit(3))
    for number in range(4):
        df.filter(week == number).write.mode("append").parquet(path)
    return path, -(-len(spark.read.schema(df.schema).parquet(path).inputFiles()) // 2)


def change_feed_stream(spark, sf):
    """The fetches as a stream against the last hash of each page, its output read back."""
    rows = i.fetches(spark, sf).select("spider", "key", "url", "dhash", "fetched_at")
    path, files = _written(spark, rows, "fetches")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)
    store = Snapshots(spark, staging_path(spark, "feed"))
    query = start_change_feed(stream, store)
    query.awaitTermination()
    return _feed_rows(store.read_all("fetch_feed", query.lastProgress["batchId"]))


def page_log(spark, sf):
    """Fetch log of the pages. The German ones were unreachable twice before they
    answered, the Spanish ones timed out, pages with a fragment are gone, and the
    https pages answer from their address without a query."""
    pid = F.col("page_id")
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    p = i.head_pages(spark, sf).withColumn("lang", lang)
    delay = F.element_at(F.array(*[F.lit(d).cast("bigint") for d in i.DELAYS]), (pid % 7 + 1).cast("int"))
    attempts = F.when(lang == "de", F.array(F.lit(1), F.lit(2), F.lit(3))).otherwise(F.array(F.lit(1)))
    rows = p.withColumn("attempt", F.explode(attempts))
    failed = (lang == "de") & ((F.col("attempt") < 3) | (pid % 2 == 0))
    error = F.when(failed, "ConnectionError").when(lang == "es", "Timeout")
    ok = error.isNull()
    status = F.when(F.contains("url", F.lit("#")), 410).when(pid % 11 == 0, 304).otherwise(200)
    return rows.select(
        "spider", "url",
        F.when(ok, F.when(F.col("url").startswith("https:"), F.substring_index("url", "?", 1)).otherwise(F.col("url"))).alias("response_url"),
        F.col("attempt").cast("int").alias("attempt"), error.alias("error"), F.when(ok, status).alias("status_code"),
        F.when(ok, F.encode("html", "UTF-8")).alias("content"), F.lit(None).cast("string").alias("encoding"),
        F.timestamp_seconds(F.lit(1704067200) + pid * 61 + F.col("attempt")).alias("fetched_at"),
        (pid % 4).cast("int").alias("depth"), delay.alias("delay"), (pid % 3 + 1).cast("tinyint").alias("source"),
        (pid % 1000).cast("bigint").alias("score"))


page_log_sql = f"""lg AS (SELECT *, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, page_id % 4 AS depth, {i.DELAYS}[page_id % 7 + 1]::BIGINT AS delay,
  page_id % 3 + 1 AS source, page_id % 1000 AS score FROM hp),
ot AS (SELECT *, CASE WHEN lang = 'de' AND page_id % 2 = 0 THEN 200 WHEN lang = 'es' THEN 300 ELSE 0 END AS outcome,
  CASE WHEN instr(url, '#') > 0 THEN 410 WHEN page_id % 11 = 0 THEN 304 ELSE 200 END AS answer,
  1704067200 + page_id * 61 + CASE WHEN lang = 'de' THEN 3 ELSE 1 END AS tm,
  CASE WHEN url LIKE 'https:%' THEN split_part(url, '?', 1) ELSE url END AS response_url FROM lg),
rt AS (SELECT *, CASE WHEN outcome = 200 THEN 'reschedule' WHEN outcome = 0 AND answer < 400 THEN 'parse' ELSE 'drop' END AS route FROM ot),
ad AS (SELECT rt.*, c.* EXCLUDE (spider), CASE WHEN coalesce(regexp_matches(url, exclude_re), false) THEN 'excluded'
  WHEN NOT (len(allowed) = 0 OR list_contains(allowed, {i.domain_sql('url')})) THEN 'domain' WHEN {i.normalize_sql('url')} <> url THEN 'normalized' ELSE 'ok' END AS reason,
  {i.normalize_sql('url')} AS normal FROM rt JOIN config c USING (spider)),
vi AS (SELECT *, CASE WHEN reason = 'normalized' THEN normal ELSE url END AS nurl, reason <> 'ok' AS to_remove, reason IN ('ok', 'normalized') AS admitted,
  reason IN ('ok', 'normalized') AND route = 'parse' AS parsed, reason IN ('ok', 'normalized') AND route IN ('parse', 'reschedule') AS visited FROM ad),
vr AS (SELECT *, CASE WHEN parsed THEN {i.normalize_sql('response_url')} ELSE nurl END AS visit_url FROM vi)"""


def step_seen(spark, sf):
    """Seen table before the step: half of the pages with the hash of their text now."""
    return i.page_seen(spark, sf, fingerprint.simhash(html.page_text(F.col("html"))))


def step_frontier(spark, sf):
    """Frontier before the step: the items fetched now, and one of later."""
    items = page_log(spark, sf).select("spider", "source", "score", "url", F.col("delay").alias("next_delay"), "depth").distinct()
    return items.unionByName(items.withColumn("score", F.col("score") + i.NOW))


def crawl_step(spark, sf):
    """One crawl step over all pages. The tables after it are shown in one shape."""
    no_documents = spark.createDataFrame([], "spider string, key string, history array<struct<fetched_time:string,status:int>>")
    stored = grouped(step_seen(spark, sf), default_stage(spark, "step-seen"))
    result = run_step(page_log(spark, sf), stored, no_documents, i.config(spark), i.robots_rules(spark, sf), F.lit(i.NOW))

    def rows(df, name, item, a, b, c):
        return df.select(F.lit(name).alias("tbl"), "spider", item.alias("item"), a.cast("string").alias("a"),
                         b.cast("string").alias("b"), c.cast("string").alias("c"))

    none = F.lit("")
    history = F.array_join(F.transform("new_history", lambda h: F.concat(h["fetched_time"], F.lit("="), h["status"])), " ")
    names = F.array_join(F.array_sort("alternatives"), " ")
    return (rows(stored.after(result.seen).flat(), "seen", F.col("key"), F.col("page_hash"), F.col("count"), names)
            .unionByName(rows(result.frontier(step_frontier(spark, sf)), "frontier", F.col("url"), F.concat_ws(" ", "source", "score"), F.col("next_delay"), F.col("depth")))
            .unionByName(rows(result.document_changes, "documents", F.col("key"), F.concat_ws(" ", "body.url", "body.hash"), F.md5("body.raw_html"), history))
            .unionByName(rows(result.change_feed, "feed", F.col("url"), F.col("detected_at"), none, none))
            .unionByName(rows(result.outcomes, "outcome", F.col("url"), F.col("outcome"), F.col("route"), F.col("to_remove"))))


def step_sql() -> str:
    """The step one fetch after another: ``st`` holds the whole seen table of a spider after each of its fetches."""
    # Links resolve against the response address, for parsed pages only.
    links = links_sql("c.nofollow").split(f"{_hp}, ", 1)[1]
    key = i.canonize_sql
    text = i.text_sql("hp", "txt", "page_id, spider, url")
    quiet = "(NOT is_changed OR (parsed AND answer <> 200))"
    row = "{'key': %s, 'page_hash': %s, 'count': %s, 'names': %s}"
    entry = "list_filter(%s, lambda e: e.key = %s)[1]"
    return f"""WITH RECURSIVE {_pg}, {_hp}, {links}, {page_log_sql}, {text}, {i.simhash_sql('txt', 'page_id', 'simhead')},
{i.text_sql('pg', 'ptxt')}, {i.simhash_sql('ptxt', 'page_id', 'simpg')}, {i.robots_sql},
sm AS (SELECT spider, {key('url')} AS main, max(hash) AS page_hash FROM pg JOIN simpg USING (page_id) WHERE md5({key('url')}) < '8' GROUP BY ALL),
seen AS (SELECT spider, unnest([main, 'm.' || main]) AS key, page_hash, 1::BIGINT AS count, [main, 'm.' || main] AS names FROM sm),
pl AS (SELECT DISTINCT a.page_id, a.spider, a.link, v.depth FROM allowed a JOIN vr v USING (page_id) WHERE v.parsed AND v.depth < v.max_depth),
plh AS (SELECT pl.*, c.robots, r.allow, r.rule_no FROM pl JOIN config c USING (spider) LEFT JOIN rules r ON r.domain = {i.domain_sql('pl.link')}
  AND starts_with(regexp_replace(pl.link, '^[a-z]+://[^/?#]*', ''), r.path)),
lk AS (SELECT page_id, spider, link, depth, {key('link')} AS key FROM plh GROUP BY page_id, spider, link, depth HAVING NOT bool_or(robots) OR coalesce(arg_min(allow, rule_no), true)),
lks AS (SELECT page_id, list({{'url': link, 'key': key}}) AS links FROM lk GROUP BY page_id),
ev AS (SELECT vr.* EXCLUDE (html), row_number() OVER (PARTITION BY vr.spider ORDER BY tm, vr.url) AS n, {key('vr.url')} AS gone, {key('visit_url')} AS main,
  CASE WHEN parsed THEN simhead.hash ELSE 0 END AS dhash, coalesce(links, []) AS links,
  list_distinct(list_transform(list_filter([nurl, CASE WHEN parsed THEN visit_url END, CASE WHEN parsed AND use_canonical AND page_id % 5 < 2 THEN normal END],
    lambda x: x IS NOT NULL), lambda n: {key('n')})) AS alts FROM vr JOIN simhead USING (page_id) LEFT JOIN lks USING (page_id)),
st AS (SELECT spider, 0::BIGINT AS n, list({row % ('key', 'page_hash', 'count', 'names')}) AS seen, NULL::BOOLEAN AS is_new, NULL::BOOLEAN AS is_changed,
    []::VARCHAR[] AS fresh FROM seen GROUP BY spider
  UNION ALL SELECT spider, n, CASE WHEN visited THEN list_filter(s2, lambda e: NOT list_contains(names, e.key)) || list_transform(names, lambda k: {row % ('k', 'dhash', '1::BIGINT', 'names')})
      ELSE s2 END, old IS NULL, old IS NULL OR bit_count(xor(dhash, old.page_hash)) >= 3, fresh
  FROM (SELECT *, list_distinct(alts || coalesce(old.names, [])) AS names FROM (SELECT *, {entry % ('s2', 'main')} AS old FROM (
    SELECT *, list_transform(s1, lambda e: {row % ('e.key', 'e.page_hash', 'e.count + len(list_filter(hits, lambda h: h = e.key))', 'e.names')}) AS s2 FROM (
      SELECT *, flatten(list_transform(links, lambda l: coalesce({entry % ('s1', 'l.key')}.names, []))) AS hits,
        list_transform(list_filter(links, lambda l: len(list_filter(s1, lambda e: e.key = l.key)) = 0), lambda l: l.url) AS fresh FROM (
        SELECT *, list_filter(seen, lambda e: NOT list_contains(gone_names, e.key)) AS s1 FROM (
          SELECT ev.spider, ev.n, ev.visited, ev.links, ev.main, ev.dhash, ev.alts, st.seen,
            CASE WHEN to_remove THEN coalesce({entry % ('st.seen', 'ev.gone')}.names, []) ELSE [] END AS gone_names
          FROM st JOIN ev ON ev.spider = st.spider AND ev.n = st.n + 1))))))),
ns AS (SELECT spider, unnest(seen) AS e FROM st QUALIFY row_number() OVER (PARTITION BY spider ORDER BY n DESC) = 1),
vk AS (SELECT ev.*, st.is_new, st.is_changed, refetching_delay AS d, restart_delay AS restart FROM ev JOIN st USING (spider, n) WHERE visited),
tv AS (SELECT *, CASE WHEN strategy = 'base' THEN {policy_sql('base', 'd', 'restart', quiet, 'is_new')} ELSE {policy_sql('news', 'd', 'restart', quiet, 'is_new')} END AS nd FROM vk),
fr0 AS (SELECT DISTINCT spider, source, score + {i.NOW} AS score, url, delay AS next_delay, depth FROM lg),
push AS (SELECT spider, source, score, url, next_delay, depth, max(n) AS n FROM (
  SELECT spider, 2 AS source, ev.depth + 1 AS score, unnest(fresh) AS url, 0 AS next_delay, ev.depth + 1 AS depth, n FROM st JOIN ev USING (spider, n) UNION ALL
  SELECT spider, CASE WHEN source = 1 THEN 1 ELSE 3 END, {i.NOW} + nd, visit_url, nd, depth, n FROM tv WHERE nd IS NOT NULL) GROUP BY ALL),
nf AS (SELECT * FROM fr0 UNION SELECT spider, source, score, url, next_delay, depth FROM push p WHERE NOT EXISTS (SELECT 1 FROM ev
  WHERE ev.spider = p.spider AND ev.source = p.source AND ev.score = p.score AND ev.url = p.url AND ev.delay = p.next_delay AND ev.depth = p.depth AND ev.n > p.n)),
db AS (SELECT vk.*, html, epoch_us(make_timestamp(tm * 1000000)) AS us, strftime(make_timestamp(tm * 1000000), '%Y-%m-%dT%H:%M') || '=' || answer AS entry
  FROM vk JOIN hp USING (page_id) WHERE parsed),
body AS (SELECT spider, main, visit_url, dhash, md5(html) AS digest FROM db
  QUALIFY row_number() OVER (PARTITION BY spider, main ORDER BY answer = 200 DESC, CASE WHEN answer = 200 THEN -us ELSE us END, visit_url DESC) = 1),
hs AS (SELECT spider, main, string_agg(entry, ' ' ORDER BY tm DESC, visit_url DESC) AS history FROM (SELECT * FROM db
  QUALIFY row_number() OVER (PARTITION BY spider, main ORDER BY tm DESC, visit_url DESC) <= 10) GROUP BY 1, 2)
SELECT 'seen' AS tbl, spider, e.key AS item, e.page_hash::VARCHAR AS a, e.count::VARCHAR AS b, array_to_string(list_sort(e.names), ' ') AS c FROM ns
UNION ALL SELECT 'frontier', spider, url, source || ' ' || score, next_delay::VARCHAR, depth::VARCHAR FROM nf
UNION ALL SELECT 'documents', spider, main, visit_url || ' ' || dhash, digest, history FROM body JOIN hs USING (spider, main)
UNION ALL SELECT 'feed', spider, visit_url, max({i.NOW})::VARCHAR, '', '' FROM vk WHERE is_new OR is_changed GROUP BY spider, visit_url
UNION ALL SELECT 'outcome', spider, url, outcome::VARCHAR, route, to_remove::VARCHAR FROM vr"""


def _event_crawl(spark, sf, name, **options):
    """Every event is the fetch of a small page; four batches of files go through the continuous crawl."""
    b = batch(spark, sf)
    log = b.select(
        "spider", "url", F.col("url").alias("response_url"), F.lit(1).alias("attempt"), F.lit(None).cast("string").alias("error"),
        F.when(F.col("status") == 503, 301).otherwise(F.col("status")).alias("status_code"), F.encode("raw_html", "UTF-8").alias("content"),
        F.lit("utf-8").alias("encoding"), "fetched_at", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("delay"),
        F.lit(3).cast("tinyint").alias("source"), F.unix_micros("fetched_at").alias("score"))
    log = log.select(*[F.col(f.name).cast(f.dataType) for f in FETCH_LOG.fields])
    path, files = _written(spark, log, "fetch-log")
    config = i.config(spark).withColumn("allowed_domains", F.array().cast("array<string>"))
    store = Snapshots(spark, staging_path(spark, name))
    start_tables(store, config, spark.createDataFrame([], "spider string, url string, depth string"))
    query = start_crawl(stream_fetch_log(spark, path, files), store, config, i.robots_rules(spark, sf), **options)
    query.awaitTermination()
    return store, query.lastProgress["batchId"]


def crawl_stream(spark, sf):
    """The document table after the last batch."""
    store, last = _event_crawl(spark, sf, "crawl")
    return flat(store.documents(last)).select("spider", "key", "url", "raw_html", "history")


def crawl_stream_tables(spark, sf):
    """Seen table, frontier and feed after the last batch, in one shape."""
    store, last = _event_crawl(spark, sf, "crawl")
    none = F.lit("")
    feed = store.read_all("change_feed", last).groupBy("spider", "url").agg(F.max("detected_at").alias("at"))
    return (store.read_seen(last).flat().select(
        F.lit("seen").alias("tbl"), "spider", F.col("key").alias("item"), F.col("page_hash").cast("string").alias("a"),
        F.concat_ws(" ", "count", "alternatives").alias("b"))
        .unionByName(store.read("frontier", last).select(
            F.lit("frontier").alias("tbl"), "spider", F.col("url").alias("item"), F.concat_ws(" ", "source", "score").alias("a"),
            F.concat_ws(" ", "next_delay", "depth").alias("b")))
        .unionByName(feed.select(F.lit("feed").alias("tbl"), "spider", F.col("url").alias("item"), F.col("at").cast("string").alias("a"), none.alias("b"))))


def crawl_sink(spark, sf):
    """Documents as the crawl wrote them to JSON files, batch by batch: the last body of each."""
    target = staging_path(spark, "documents")
    _event_crawl(spark, sf, "crawl", sink=("json", target))
    rows = spark.read.schema("spider string, key string, url string, raw_html string, version int").json(target)
    return rows.groupBy("spider", "key").agg(F.max_by(F.struct("url", "raw_html"), "version").alias("d")).select("spider", "key", "d.*")


# No page of an event has links or other names, so each is a sequence of its own.
_tables_sql = f"""WITH {_fe}, {_cfg}, txt AS (SELECT event_id, lower(event_id || ':' || event_type) AS text FROM fe), {i.simhash_sql('txt', 'event_id', 'sim')},
v AS (SELECT fe.spider, fe.key, fe.url, s.hash, epoch_us(fetched_at) // 1000000 AS tm, lag(s.hash) OVER w AS prev, row_number() OVER w AS n,
  count(*) OVER (PARTITION BY fe.spider, fe.key) AS visits, c.strategy, c.refetching_delay AS d
  FROM fe JOIN sim s USING (event_id) JOIN config c USING (spider) WINDOW w AS (PARTITION BY fe.spider, fe.key ORDER BY fetched_at, fe.url)),
j AS (SELECT *, tm + CASE WHEN strategy = 'base' THEN d ELSE 7200 END AS due, CASE WHEN strategy = 'base' THEN d ELSE 7200 END AS nd,
  prev IS NULL OR bit_count(xor(hash, prev)) >= 3 AS changed FROM v)
SELECT 'seen' AS tbl, spider, key AS item, hash::VARCHAR AS a, '1 ' || key AS b FROM j WHERE n = visits
UNION ALL SELECT DISTINCT 'frontier', spider, url, '3 ' || due, nd || ' 0' FROM j
UNION ALL SELECT 'frontier', spider, unnest(start_urls), '1 1', coalesce(restart_delay, 0) || ' 0' FROM config
UNION ALL SELECT 'feed', spider, url, max(tm)::VARCHAR, '' FROM j WHERE changed GROUP BY spider, url"""

_stream_sql = (merge_sql("true").replace("WHEN 'error' THEN 503", "WHEN 'error' THEN 301").replace("WHERE c_acctbal > 0", "WHERE false")
               .replace("coalesce(body.hash, old.hash) AS hash, history", "history"))

QUERIES = {
    "change_feed": (change_feed, _feed_sql),
    "change_feed_stream": (change_feed_stream, _feed_sql),
    "crawl_step": (crawl_step, step_sql()),
    "crawl_stream": (crawl_stream, _stream_sql),
    "crawl_stream_tables": (crawl_stream_tables, _tables_sql),
    "crawl_sink": (crawl_sink, f"SELECT spider, key, url, raw_html FROM ({_stream_sql})"),
}
