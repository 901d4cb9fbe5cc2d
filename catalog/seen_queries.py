"""Seen-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from webfurrow.functions import fingerprint, urls
from webfurrow.operators import seen as sn
from webfurrow.operators.alias_groups import hit, remove
from webfurrow.plans.replay import store
from webfurrow.session import default_stage

_pg, _seen = i.pages_sql, i.page_seen_sql


def _flat(seen):
    return seen.select("spider", "key", "page_hash", "count", F.array_join(F.array_sort("alternatives"), " ").alias("alternatives"))


_flat_sql = "spider, key, page_hash, count, array_to_string(list_sort(alternatives), ' ') AS alternatives"


def seen_new(spark, sf):
    fresh = sn.new_urls(i.pages(spark, sf).select("page_id", "spider", "url"), i.page_seen(spark, sf))
    return fresh.select("page_id", "url")


def seen_lookup(spark, sf):
    return _flat(sn.lookup(i.pages(spark, sf).select("spider", "url"), i.page_seen(spark, sf)))


def seen_contains(spark, sf):
    return sn.contains(i.pages(spark, sf).select("spider", "url"), i.page_seen(spark, sf))


def seen_size(spark, sf):
    return sn.size(i.page_seen(spark, sf))


def page_visits(spark, sf):
    """Each page fetched with a second address, and the home page of its host as a third."""
    host = urls.domain(F.col("url"))
    names = F.array("url", F.concat(F.lit("https://www."), host, F.lit("/"), F.col("page_id") % 5),
                    F.concat(F.lit("http://"), host, F.lit("/")), F.lit(None).cast("string"))
    return i.pages(spark, sf).select(
        "page_id", "spider", "url", fingerprint.token_hash(F.concat("html", "url")).alias("dhash"),
        names.alias("alternatives"), F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 61).alias("fetched_at"))


visits_sql = f"""vi AS (SELECT page_id, spider, url, {i.md5_number_sql('html || url')} AS dhash,
  [url, 'https://www.' || {i.domain_sql('url')} || '/' || (page_id % 5), 'http://' || {i.domain_sql('url')} || '/'] AS names,
  1704067200 + page_id * 61 AS tm FROM pg)"""

# One page after another: the whole table of a spider after each of its visits.
upserts_sql = f"""ev AS (SELECT spider, row_number() OVER (PARTITION BY spider ORDER BY tm, url) AS n, {i.canonize_sql('url')} AS main, dhash,
  list_distinct(list_transform(names, lambda n: {i.canonize_sql('n')})) AS alts FROM vi),
st AS (SELECT spider, 0::BIGINT AS n, list({{'key': key, 'page_hash': page_hash, 'count': count, 'names': alternatives}}) AS seen FROM seen GROUP BY spider
  UNION ALL SELECT spider, n, list_filter(seen, lambda e: NOT list_contains(names, e.key)) || list_transform(names,
    lambda k: {{'key': k, 'page_hash': dhash, 'count': 1::BIGINT, 'names': names}}) FROM (
    SELECT ev.spider, ev.n, dhash, seen, list_distinct(alts || coalesce(list_filter(seen, lambda e: e.key = main)[1].names, [])) AS names
    FROM st JOIN ev ON ev.spider = st.spider AND ev.n = st.n + 1)),
ns AS (SELECT spider, unnest(seen) AS e FROM st QUALIFY row_number() OVER (PARTITION BY spider ORDER BY n DESC) = 1)"""


def seen_upsert(spark, sf):
    """The pages stored one by one; those of a host share the address of its home page."""
    pages = page_visits(spark, sf).drop("page_id")
    return _flat(store(i.page_groups(spark, sf), pages, default_stage(spark, "upsert")).flat())


def seen_delete(spark, sf):
    """Pages that carry a campaign parameter go, by either scheme."""
    unwanted = i.pages(spark, sf).filter(F.contains("url", F.lit("utm_source"))).select("spider", "url")
    return _flat(remove(i.page_groups(spark, sf), sn.with_key(unwanted), default_stage(spark, "delete")).flat())


def event_links(spark, sf):
    """Each event is a link to the page with the number of its user."""
    e = i.table(spark, sf, "events").select(F.col("user_id").alias("page_id"))
    return e.join(i.pages(spark, sf).select("page_id", "spider", "url"), "page_id").select("spider", "url")


def seen_increment(spark, sf):
    state, _ = hit(i.page_groups(spark, sf), sn.link_counts(event_links(spark, sf)), default_stage(spark, "increment"))
    return _flat(state.flat())


QUERIES = {
    "seen_new": (seen_new, f"WITH {_pg}, {_seen}, k AS (SELECT page_id, spider, url, {i.canonize_sql('url')} AS key FROM pg) "
                 "SELECT page_id, url FROM k ANTI JOIN seen USING (spider, key)"),
    "seen_lookup": (seen_lookup, f"WITH {_pg}, {_seen}, k AS (SELECT DISTINCT spider, {i.canonize_sql('url')} AS key FROM pg) "
                    f"SELECT {_flat_sql} FROM seen SEMI JOIN k USING (spider, key)"),
    "seen_contains": (seen_contains, f"WITH {_pg}, {_seen}, k AS (SELECT DISTINCT spider, {i.canonize_sql('url')} AS key FROM pg) "
                      "SELECT spider, key, EXISTS (SELECT 1 FROM seen s WHERE s.spider = k.spider AND s.key = k.key) AS known FROM k"),
    "seen_size": (seen_size, f"WITH {_pg}, {_seen} SELECT spider, count(*) AS n FROM seen GROUP BY 1"),
    "seen_upsert": (seen_upsert, f"WITH RECURSIVE {_pg}, {_seen}, {visits_sql}, {upserts_sql} SELECT spider, e.key AS key, e.page_hash AS page_hash, "
                    "e.count AS count, array_to_string(list_sort(e.names), ' ') AS alternatives FROM ns"),
    "seen_delete": (seen_delete, f"WITH {_pg}, {_seen}, k AS (SELECT DISTINCT spider, {i.canonize_sql('url')} AS key FROM pg WHERE url LIKE '%utm_source%'), "
                    "gone AS (SELECT DISTINCT spider, unnest(alternatives) AS key FROM seen SEMI JOIN k USING (spider, key)) "
                    f"SELECT {_flat_sql} FROM seen ANTI JOIN gone USING (spider, key)"),
    "seen_increment": (seen_increment, f"WITH {_pg}, {_seen}, k AS (SELECT spider, {i.canonize_sql('url')} AS key FROM events e JOIN pg ON e.user_id = pg.page_id), "
                       "inc AS (SELECT spider, a AS key, count(*) AS n FROM (SELECT spider, unnest(alternatives) AS a FROM k JOIN seen USING (spider, key)) GROUP BY 1, 2) "
                       "SELECT spider, key, page_hash, (count + coalesce(n, 0))::BIGINT AS count, array_to_string(list_sort(alternatives), ' ') AS alternatives "
                       "FROM seen LEFT JOIN inc USING (spider, key)"),
}
