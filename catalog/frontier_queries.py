"""Frontier, refetch-timing and fetch-outcome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from webfurrow.functions import outcomes, refetch, urls
from webfurrow.operators import frontier as fr
from webfurrow.operators.fetches import resolve_attempts, route
from webfurrow.operators.lookup import of_spiders, with_config
from webfurrow.plans.replay import known_at
from webfurrow.plans.take import IN_FLIGHT, take_items
from webfurrow.plans.reschedule import judge, refetch_items, timed
from webfurrow.sources.tables import read_seed_file, usable_seeds
from webfurrow.session import default_stage, staging_path

_fe, _fr, _ss, _cfg, _pg = i.fetches_sql, i.frontier_sql, i.site_seen_sql, i.config_sql, i.pages_sql
_cols = "spider, source, score, url, next_delay, depth"
# Items per spider that one call takes from the frontier.
TAKE = 50
TAKE_MANY = 5000
# Items per spider that one of several calls plans.
CARRIED = 7


def seed_load(spark, sf):
    """Page addresses written as a JSON seed file, read back and filtered."""
    path = staging_path(spark, "seeds")
    i.pages(spark, sf).select("url", (F.col("page_id") % 6).cast("string").alias("depth")).write.json(path)
    return usable_seeds(read_seed_file(spark, path, "s1"), i.config(spark))


def frontier_list(spark, sf):
    return fr.listing(i.frontier(spark, sf).select(*fr.COLUMNS).distinct())


def _links(spark, sf):
    return i.fetches(spark, sf).filter(F.col("event_type") == "click").select("spider", "url", "depth")


def frontier_enqueue(spark, sf):
    stored = i.frontier(spark, sf).filter(F.col("event_type") == "view")
    return fr.enqueue_links(stored.select(*fr.COLUMNS).distinct(), _links(spark, sf), i.site_seen(spark, sf))


def link_asof(spark, sf):
    """Every event is a fetch, and its page links to another page of the site: how many links of each page
    found it stored, by the table or by a fetch before them, and how many did not."""
    f = i.fetches(spark, sf).select("spider", "key", F.col("fetched_at").alias("at"), F.col("url").alias("visit"), "event_id", "user_number")
    target = i.site_url(F.col("user_number") + 3 * (F.col("event_id") % 50))
    links = f.withColumn("key", urls.canonize(target)).drop("user_number")
    judged = known_at(links, f, i.site_seen(spark, sf), ["at", "visit", "event_id"])
    return judged.groupBy("spider", "key").agg(F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_new"))


def frontier_bootstrap(spark, sf):
    seeds = i.pages(spark, sf).select("spider", "url", (F.col("page_id") % 6).cast("string").alias("depth"))
    return fr.enqueue_seeds(i.frontier(spark, sf).select(*fr.COLUMNS).distinct(), seeds, i.page_seen(spark, sf))


def frontier_seed(spark, sf):
    return fr.reset_start_urls(i.frontier(spark, sf).select(*fr.COLUMNS).distinct(), i.config(spark))


def _next(spark, sf):
    return fr.next_items(i.frontier(spark, sf), i.site_seen(spark, sf), F.lit(i.NOW), TAKE)


def frontier_next(spark, sf):
    return _next(spark, sf)


def frontier_next_many(spark, sf):
    """More items than Spark's own limit for cutting each task early."""
    return fr.next_items(i.frontier(spark, sf), i.site_seen(spark, sf), F.lit(i.NOW), TAKE_MANY)


def frontier_take(spark, sf):
    """Two calls in a row on a frontier in which every second depth has another form of its URLs."""
    url = F.when(F.col("depth") % 2 == 1, F.concat("url", F.lit("?ref=1#x"))).otherwise(F.col("url"))
    frontier = i.frontier(spark, sf).withColumn("url", url).select(*fr.COLUMNS).distinct()
    seen, config, now = i.site_seen(spark, sf), i.config(spark), F.lit(i.NOW)
    one = take_items(frontier, spark.createDataFrame([], IN_FLIGHT), seen, config, now, TAKE)
    two = take_items(one.frontier, one.in_flight, seen, config, now, TAKE)

    def rows(df, call, kind, nurl=F.lit(""), number=F.lit(0)):
        return df.select(F.lit(call).alias("call"), F.lit(kind).alias("kind"), "spider", "url", nurl.alias("nurl"),
                         number.cast("bigint").alias("number"))

    return (rows(one.items, 1, "item", F.col("nurl"), F.col("rank")).unionByName(rows(one.removed, 1, "removed"))
            .unionByName(rows(two.items, 2, "item", F.col("nurl"), F.col("rank"))).unionByName(rows(two.removed, 2, "removed"))
            .unionByName(rows(two.frontier, 2, "left", number=F.col("score"))).unionByName(rows(two.in_flight, 2, "out", number=F.col("score"))))


def fetch_plan(spark, sf):
    return fr.fetch_plan(_next(spark, sf), i.config(spark), F.lit(i.NOW)).select("spider", "rank", "url", "planned_at")


def fetch_plan_carry(spark, sf):
    """Three calls within a minute, each on what the ones before left: no second is planned twice."""
    left, seen, config = i.frontier(spark, sf).select(*fr.COLUMNS).distinct(), i.site_seen(spark, sf), i.config(spark)
    free, out = None, None
    for call in range(3):
        stage = default_stage(spark, "plan")
        now = F.lit(i.NOW + 30 * call)
        items = stage(fr.next_items(left, seen, now, CARRIED), "items")
        planned = stage(fr.fetch_plan(items, config, now, free), "planned")
        free = stage(fr.next_free(planned, config, free), "free")
        left = stage(fr.remove_items(left, items), "left")
        rows = planned.select(F.lit(call).alias("call"), "spider", "rank", "url", "planned_at")
        out = rows if out is None else out.unionByName(rows)
    return out


def multi_site(spark, sf):
    """Next items of two chosen spiders."""
    chosen = i.config(spark).filter(F.col("spider") != "s1")
    part = of_spiders(i.frontier(spark, sf), chosen)
    return fr.next_items(part, i.site_seen(spark, sf), F.lit(i.NOW), TAKE)


def frontier_push(spark, sf):
    pushes = i.fetches(spark, sf).select(
        "spider", "url", F.floor(F.col("value") * 100).cast("bigint").alias("score"), F.col("event_id").alias("seq"))
    return fr.push_scores(pushes, ["spider", "url"])


def frontier_remove(spark, sf):
    items = i.frontier(spark, sf)
    return fr.remove_items(items.select(*fr.COLUMNS).distinct(), items.filter(F.col("event_type") == "purchase"))


def frontier_clear(spark, sf):
    return fr.clear(i.frontier(spark, sf).select(*fr.COLUMNS).distinct(), 3)


def fifo_next(spark, sf):
    rows = i.fetches(spark, sf).select(F.col("event_id").alias("seq"), "url")
    return fr.fifo_next(rows, 100)


def _visit(d, strategy, spark, sf):
    eid = F.col("event_id")
    f = i.fetches(spark, sf).withColumn("is_new", eid % 11 == 0).withColumn("is_changed", F.col("value") > 10)
    visit = refetch.Visit(
        source=F.col("source"), delay=F.col("delay"), status=F.when(F.col("status") != 503, F.col("status")),
        is_new=F.col("is_new"), is_changed=F.col("is_changed"),
        restart_delay=F.when(eid % 2 == 0, F.lit(120).cast("bigint")), refetching_delay=d)
    timed_rows = f.withColumn("next_delay", refetch.next_delay(F.lit(strategy), visit))
    return timed_rows.select("event_id", F.coalesce("next_delay", F.lit(-1)).alias("next_delay"),
                             F.coalesce(F.lit(i.NOW) + F.col("next_delay"), F.lit(-1)).alias("expire"))


def refetch_base(spark, sf):
    return _visit(F.lit(14400).cast("bigint"), "base", spark, sf)


def refetch_news(spark, sf):
    """Three refetching delays, two of which share a step with the first two hours."""
    steps = F.element_at(F.array(*[F.lit(d).cast("bigint") for d in (14400, 7200, 1800)]), (F.col("event_id") % 3 + 1).cast("int"))
    return _visit(steps, "news", spark, sf)


def visits(spark, sf):
    """Fetches with the options of their spider; errors have hash 0 and no status."""
    f = i.fetches(spark, sf).withColumn("alternatives", F.array("url"))
    failed = F.col("status") == 503
    f = f.withColumn("dhash", F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("dhash")))
    f = f.withColumn("status", F.when(~failed, F.col("status")))
    return with_config(f, i.config(spark), ["restart_delay", "refetching_delay", "refetching_strategy"])


def reschedule(spark, sf):
    return refetch_items(timed(judge(visits(spark, sf), i.site_seen(spark, sf)), F.lit(i.NOW))).distinct()


def fetch_outcome(spark, sf):
    return _attempts(spark, sf).select("event_id", outcomes.outcome(F.col("error")).alias("outcome"))


def _attempts(spark, sf):
    """Seven events in a row are the attempts of one fetch."""
    e, kind = i.table(spark, sf, "events"), F.col("event_type")
    error = (F.when(kind == "purchase", F.when(F.col("value") > 10, "Timeout").otherwise("SSLError"))
             .when(kind != "view", "ConnectionError"))
    return e.select(
        "event_id", F.expr("event_id div 7").alias("fetch_id"), (F.col("event_id") % 7 + 1).cast("int").alias("attempt"),
        error.alias("error"), F.when(kind == "view", F.when(F.col("value") > 5, 200).otherwise(404)).alias("status_code"))


_attempts_sql = """att AS (SELECT event_id, event_id // 7 AS fetch_id, (event_id % 7 + 1)::INT AS attempt,
  CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 10 THEN 300 ELSE 100 END WHEN event_type = 'view' THEN 0 ELSE 200 END AS outcome,
  CASE WHEN event_type = 'view' THEN CASE WHEN value > 5 THEN 200 ELSE 404 END END AS status_code FROM events)"""
_resolved_sql = """res AS (SELECT fetch_id, event_id, attempt, outcome, status_code FROM att WHERE attempt <= 5
  QUALIFY row_number() OVER (PARTITION BY fetch_id ORDER BY outcome = 200, CASE WHEN outcome = 200 THEN -attempt ELSE attempt END) = 1)"""


def fetch_resolve(spark, sf):
    return resolve_attempts(_attempts(spark, sf), ["fetch_id"]).select("fetch_id", "event_id", "attempt", "outcome")


def outcome_route(spark, sf):
    routed = route(resolve_attempts(_attempts(spark, sf), ["fetch_id"]))
    return routed.select("fetch_id", "outcome", "route")


def retry_wait(spark, sf):
    a = F.col("attempt")
    return _attempts(spark, sf).filter(a <= outcomes.MAX_ATTEMPTS).select(
        "event_id", outcomes.wait_after(a).cast("bigint").alias("wait_after"), outcomes.waited_before(a).alias("waited_before"))


_due_sql = f"""due AS (SELECT spider, source, score, url, next_delay, depth FROM fr WHERE source <> 2 AND score <= {i.NOW}
  UNION ALL (SELECT spider, source, score, url, 0, depth FROM fr WHERE source = 2
    AND NOT EXISTS (SELECT 1 FROM site_seen s WHERE s.spider = fr.spider AND s.key = replace(fr.url, 'http://', ''))
    QUALIFY row_number() OVER (PARTITION BY spider, url ORDER BY score, depth) = 1)),
nx AS (SELECT *, row_number() OVER (PARTITION BY spider ORDER BY source, score, url, next_delay, depth) AS rank FROM due
  QUALIFY rank <= {TAKE})"""
# The frontier of the events may hold an item once per event type; the due list does too.
_next_sql = f"WITH {_fe}, {_fr}, {_ss}, {_due_sql} SELECT spider, source, score, url, next_delay, depth, rank FROM nx"


def _taken_sql(call: int, source: str, waiting: str) -> str:
    """CTE ``t<call>``: the items one call takes, with the result of the check."""
    return f"""t{call} AS (SELECT n.*, CASE WHEN reason = 'normalized' THEN normal ELSE url END AS nurl, reason IN ('ok', 'normalized') AS admitted FROM (
  SELECT d.*, {i.normalize_sql('url')} AS normal, CASE WHEN coalesce(regexp_matches(url, exclude_re), false) THEN 'excluded'
    WHEN NOT (len(allowed) = 0 OR list_contains(allowed, {i.domain_sql('url')})) THEN 'domain' WHEN {i.normalize_sql('url')} <> url THEN 'normalized' ELSE 'ok' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY spider ORDER BY source, score, url, next_delay, depth) AS rank FROM (
    SELECT * FROM {source} WHERE source <> 2 AND score <= {i.NOW} UNION ALL
    (SELECT * FROM {source} f WHERE source = 2 AND NOT EXISTS (SELECT 1 FROM site_seen s WHERE s.spider = f.spider AND s.key = replace(f.url, 'http://', ''))
     {waiting} QUALIFY row_number() OVER (PARTITION BY spider, url ORDER BY score, depth) = 1)) QUALIFY rank <= {TAKE}) d JOIN config c USING (spider)) n)"""


_take_sql = f"""WITH {_fe}, {_fr}, {_ss}, {_cfg}, f1 AS (SELECT DISTINCT spider, source, score::BIGINT AS score,
  CASE WHEN depth % 2 = 1 THEN url || '?ref=1#x' ELSE url END AS url, next_delay, depth FROM fr), {_taken_sql(1, 'f1', '')},
f2 AS (SELECT * FROM f1 EXCEPT SELECT {_cols} FROM t1),
{_taken_sql(2, 'f2', 'AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.source = 2 AND t1.admitted AND t1.spider = f.spider AND t1.url = f.url)')}
SELECT 1 AS call, 'item' AS kind, spider, url, nurl, rank AS number FROM t1 WHERE admitted UNION ALL
SELECT DISTINCT 1, 'removed', spider, url, '', 0 FROM t1 WHERE reason <> 'ok' UNION ALL
SELECT 2, 'item', spider, url, nurl, rank FROM t2 WHERE admitted UNION ALL
SELECT DISTINCT 2, 'removed', spider, url, '', 0 FROM t2 WHERE reason <> 'ok' UNION ALL
SELECT 2, 'left', spider, url, '', score FROM (SELECT * FROM f2 EXCEPT SELECT {_cols} FROM t2) UNION ALL
SELECT 2, 'out', spider, url, '', score FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) WHERE admitted"""


def _carry_sql() -> str:
    parts, source = [], "f0"
    for call in range(3):
        start = f"greatest({i.NOW + 30 * call}, {f'coalesce(free_at, 0)' if call else '0'})"
        parts.append(f"""t{call} AS (SELECT *, row_number() OVER (PARTITION BY spider ORDER BY source, score, url, next_delay, depth) AS rank FROM (
  SELECT * FROM {source} WHERE source <> 2 AND score <= {i.NOW + 30 * call} UNION ALL
  (SELECT * FROM {source} f WHERE source = 2 AND NOT EXISTS (SELECT 1 FROM site_seen s WHERE s.spider = f.spider AND s.key = replace(f.url, 'http://', ''))
   QUALIFY row_number() OVER (PARTITION BY spider, url ORDER BY score, depth) = 1)) QUALIFY rank <= {CARRIED}),
p{call} AS (SELECT {call} AS call, t.*, ({start} + (rank - 1) * spider_delay)::BIGINT AS planned_at, spider_delay
  FROM t{call} t JOIN config USING (spider) {f'LEFT JOIN e{call - 1} USING (spider)' if call else ''}),
e{call} AS (SELECT spider, max(planned_at + spider_delay) AS free_at FROM ({' UNION ALL '.join(f'SELECT spider, planned_at, spider_delay FROM p{c}' for c in range(call + 1))}) GROUP BY spider),
f{call + 1} AS (SELECT * FROM {source} EXCEPT SELECT {_cols} FROM t{call})""")
        source = f"f{call + 1}"
    first = f"f0 AS (SELECT DISTINCT spider, source, score::BIGINT AS score, url, next_delay, depth FROM fr)"
    return (f"WITH {_fe}, {_fr}, {_ss}, {_cfg}, {first}, {', '.join(parts)} "
            + " UNION ALL ".join(f"SELECT call, spider, rank, url, planned_at FROM p{c}" for c in range(3)))


def policy_sql(strategy: str, d: str, restart: str, unchanged: str, is_new: str) -> str:
    first = f"WHEN {is_new} OR delay = 0 THEN {d if strategy == 'base' else 7200}"
    if strategy == "base":
        rest = f"WHEN {unchanged} THEN delay * 2 WHEN delay > 3600 THEN delay // 2 ELSE delay"
    else:
        rest = (f"WHEN {unchanged} THEN CASE WHEN delay = {d} * 2 THEN {d} * 4 WHEN delay = {d} THEN {d} * 2 WHEN delay = 7200 THEN {d} "
                f"WHEN delay = {d} * 4 THEN NULL ELSE {d} END WHEN delay = {d} * 4 THEN {d} * 2 WHEN delay IN ({d}, {d} * 2) THEN {d} ELSE {d} * 2")
    return f"CASE WHEN source = 1 THEN coalesce({restart}, {d}) {first} {rest} END"


_unchanged = "(NOT (value > 10) OR (status <> 503 AND status <> 200))"
_timing = {s: policy_sql(s, d, "CASE WHEN event_id % 2 = 0 THEN 120 END", _unchanged, "event_id % 11 = 0")
           for s, d in (("base", "14400"), ("news", "[14400, 7200, 1800][event_id % 3 + 1]"))}


def _timing_sql(s):
    return (f"WITH {_fe}, t AS (SELECT event_id, {_timing[s]} AS nd FROM fe) SELECT event_id, coalesce(nd, -1)::BIGINT AS next_delay, "
            f"coalesce({i.NOW} + nd, -1)::BIGINT AS expire FROM t")


judged_sql = """vs AS (SELECT fe.* REPLACE (CASE WHEN status = 503 THEN 0 ELSE dhash END AS dhash), c.strategy, c.refetching_delay AS d,
  c.restart_delay AS restart, s.key IS NULL AND row_number() OVER visits = 1 AS is_new,
  coalesce(bit_count(xor(CASE WHEN status = 503 THEN 0 ELSE dhash END,
    coalesce(lag(CASE WHEN status = 503 THEN 0 ELSE dhash END) OVER visits, s.page_hash))) >= 3, true) AS is_changed
  FROM fe JOIN config c USING (spider) LEFT JOIN site_seen s ON s.spider = fe.spider AND s.key = fe.key
  WINDOW visits AS (PARTITION BY fe.spider, fe.key ORDER BY fetched_at, fe.url))"""
_quiet = "(NOT is_changed OR (status <> 503 AND status <> 200))"
timed_sql = f"""tv AS (SELECT *, CASE WHEN strategy = 'base' THEN {policy_sql('base', 'd', 'restart', _quiet, 'is_new')}
  ELSE {policy_sql('news', 'd', 'restart', _quiet, 'is_new')} END AS nd FROM vs)"""

QUERIES = {
    "seed_load": (seed_load, f"WITH {_pg}, {_cfg} SELECT c.spider, url, (page_id % 6)::VARCHAR AS depth FROM pg, config c WHERE c.spider = 's1' "
                  f"AND list_contains(c.allowed, {i.domain_sql('url')}) AND NOT list_contains(c.start_urls, url)"),
    "frontier_list": (frontier_list, f"WITH {_fe}, {_fr} SELECT DISTINCT {_cols} FROM fr"),
    "frontier_enqueue": (frontier_enqueue, f"WITH {_fe}, {_fr}, {_ss} SELECT DISTINCT {_cols} FROM fr WHERE event_type = 'view' UNION "
                         "SELECT spider, 2, depth + 1, url, 0, depth + 1 FROM fe ANTI JOIN site_seen USING (spider, key) WHERE event_type = 'click'"),
    "link_asof": (link_asof, f"WITH {_fe}, {_ss}, fv AS (SELECT spider, key, min(row(fetched_at, url, event_id)) AS seen_at FROM fe GROUP BY 1, 2), "
                  "lk AS (SELECT spider, 'site' || ((user_id + 3 * (event_id % 50)) % 7) || '.example.com/p/' || (user_id + 3 * (event_id % 50)) AS key, "
                  "row(fetched_at, url, event_id) AS found_at FROM fe JOIN events USING (event_id)), "
                  "j AS (SELECT lk.*, s.key IS NOT NULL OR coalesce(seen_at < found_at, false) AS known FROM lk LEFT JOIN fv USING (spider, key) "
                  "LEFT JOIN site_seen s ON s.spider = lk.spider AND s.key = lk.key) "
                  "SELECT spider, key, count_if(known)::BIGINT AS n_known, count_if(NOT known)::BIGINT AS n_new FROM j GROUP BY 1, 2"),
    "frontier_bootstrap": (frontier_bootstrap, f"WITH {_fe}, {_fr}, {_pg}, {i.page_seen_sql}, k AS (SELECT spider, page_id, url, {i.canonize_sql('url')} AS key FROM pg) "
                           f"SELECT DISTINCT {_cols} FROM fr UNION SELECT spider, 2, page_id % 6 + 2, url, 0, page_id % 6 + 2 FROM k ANTI JOIN seen USING (spider, key)"),
    "frontier_seed": (frontier_seed, f"WITH {_fe}, {_fr}, {_cfg} SELECT DISTINCT {_cols} FROM fr WHERE source <> 1 UNION "
                      "SELECT spider, 1, 1, unnest(start_urls), coalesce(restart_delay, 0), 0 FROM config"),
    "frontier_next": (frontier_next, _next_sql),
    "frontier_next_many": (frontier_next_many, _next_sql.replace(f"rank <= {TAKE}", f"rank <= {TAKE_MANY}")),
    "frontier_take": (frontier_take, _take_sql),
    "fetch_plan": (fetch_plan, f"WITH {_fe}, {_fr}, {_ss}, {_cfg}, {_due_sql} SELECT spider, rank, url, ({i.NOW} + (rank - 1) * spider_delay)::BIGINT AS planned_at "
                   "FROM nx JOIN config USING (spider)"),
    "fetch_plan_carry": (fetch_plan_carry, _carry_sql()),
    "multi_site": (multi_site, _next_sql + " WHERE spider IN ('s0', 's2')"),
    "frontier_push": (frontier_push, f"WITH {_fe} SELECT spider, url, arg_max(floor(value * 100)::BIGINT, event_id) AS score FROM fe GROUP BY 1, 2"),
    "frontier_remove": (frontier_remove, f"WITH {_fe}, {_fr} SELECT DISTINCT {_cols} FROM fr EXCEPT SELECT {_cols} FROM fr WHERE event_type = 'purchase'"),
    "frontier_clear": (frontier_clear, f"WITH {_fe}, {_fr} SELECT DISTINCT {_cols} FROM fr WHERE source <> 3"),
    "fifo_next": (fifo_next, f"WITH {_fe} SELECT event_id AS seq, url FROM fe ORDER BY event_id LIMIT 100"),
    "refetch_base": (refetch_base, _timing_sql("base")),
    "refetch_news": (refetch_news, _timing_sql("news")),
    "reschedule": (reschedule, f"WITH {_fe}, {_ss}, {_cfg}, {judged_sql}, {timed_sql} SELECT DISTINCT spider, CASE WHEN source = 1 THEN 1 ELSE 3 END AS source, "
                   f"({i.NOW} + nd)::BIGINT AS score, url, nd::BIGINT AS next_delay, depth FROM tv WHERE nd IS NOT NULL"),
    "fetch_outcome": (fetch_outcome, f"WITH {_attempts_sql} SELECT event_id, outcome FROM att"),
    "fetch_resolve": (fetch_resolve, f"WITH {_attempts_sql}, {_resolved_sql} SELECT fetch_id, event_id, attempt, outcome FROM res"),
    "outcome_route": (outcome_route, f"WITH {_attempts_sql}, {_resolved_sql} SELECT fetch_id, outcome, CASE WHEN outcome = 200 THEN 'reschedule' "
                      "WHEN outcome = 0 AND status_code < 400 THEN 'parse' ELSE 'drop' END AS route FROM res"),
    "retry_wait": (retry_wait, f"WITH {_attempts_sql}, a AS (SELECT *, 600 * (attempt - 1) AS w FROM att WHERE attempt <= 5) SELECT event_id, w::BIGINT AS wait_after, "
                   "coalesce(sum(w) OVER (PARTITION BY fetch_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS waited_before FROM a"),
}
