"""Document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from webfurrow.operators import documents as docs
from webfurrow.schemas import DOCUMENTS
from webfurrow.session import staging_path
from webfurrow.sources.tables import write_documents

# Bytes a page may have in the size-guard query; the bodies have between 6 and 14.
MAX_BYTES = 11


def batch(spark, sf):
    """Each event is a fetched document; its body is its number and kind."""
    f = i.fetches(spark, sf)
    return f.select(
        "spider", "key", "url", F.concat_ws(":", "event_id", "event_type").alias("raw_html"), F.lit(False).alias("blocked"),
        F.col("dhash").alias("hash"), F.lit("").alias("domain"), F.lit(0).alias("comments"),
        F.from_json(F.lit("{}"), "map<string,string>").alias("social"), "fetched_at", "status")


def stored(spark, sf):
    """Documents stored before: the sites of customers in credit."""
    entry = F.struct(F.lit("2023-12-31T00:00").alias("fetched_time"), F.lit(200).alias("status"))
    rows = i.site_seen(spark, sf).select(
        "spider", "key", F.concat(F.lit("http://"), "key").alias("url"), F.lit("old").alias("raw_html"), F.lit(False).alias("blocked"),
        F.col("page_hash").alias("hash"), F.lit("").alias("domain"), F.lit(0).alias("comments"),
        F.from_json(F.lit("{}"), "map<string,string>").alias("social"), F.array(entry).alias("history"))
    return rows.select(*DOCUMENTS.fieldNames())


def flat(documents):
    history = F.array_join(F.transform("history", lambda h: F.concat(h["fetched_time"], F.lit("="), h["status"])), " ")
    return documents.select("spider", "key", "url", "raw_html", "hash", history.alias("history"))


def document_history(spark, sf):
    return flat(docs.merge_documents(stored(spark, sf), batch(spark, sf)))


def document_size_guard(spark, sf):
    return flat(docs.merge_documents(stored(spark, sf), batch(spark, sf), MAX_BYTES))


def merge_sql(kept: str) -> str:
    """Log form of the merge over the fetches that pass ``kept``."""
    return f"""WITH {i.fetches_sql}, {i.site_seen_sql},
old AS (SELECT spider, key, 'http://' || key AS url, 'old' AS raw_html, page_hash AS hash, '2023-12-31T00:00=200' AS entry FROM site_seen),
raw AS (SELECT *, event_id || ':' || event_type AS raw_html, strftime(fetched_at, '%Y-%m-%dT%H:%M') || '=' || status AS entry FROM fe),
fits AS (SELECT spider, key, min(fetched_at) AS first_at FROM raw WHERE {kept} GROUP BY 1, 2),
b AS (SELECT raw.*, o.key IS NOT NULL AS existed, {kept} AS fit FROM raw LEFT JOIN old o USING (spider, key) LEFT JOIN fits USING (spider, key)
  WHERE {kept} OR (status <> 200 AND (o.key IS NOT NULL OR fetched_at > fits.first_at))),
body AS (SELECT spider, key, url, raw_html, dhash AS hash FROM b WHERE fit AND (status = 200 OR NOT existed)
  QUALIFY row_number() OVER (PARTITION BY spider, key ORDER BY status = 200 DESC,
    CASE WHEN status = 200 THEN -epoch_us(fetched_at) ELSE epoch_us(fetched_at) END) = 1),
entries AS (SELECT spider, key, entry, epoch_us(fetched_at) AS tm FROM b UNION ALL SELECT spider, key, entry, 0 FROM old),
h AS (SELECT spider, key, string_agg(entry, ' ' ORDER BY tm DESC) AS history FROM (SELECT * FROM entries
  QUALIFY row_number() OVER (PARTITION BY spider, key ORDER BY tm DESC) <= 10) GROUP BY 1, 2)
SELECT h.spider, h.key, coalesce(body.url, old.url) AS url, coalesce(body.raw_html, old.raw_html) AS raw_html,
  coalesce(body.hash, old.hash) AS hash, history FROM h LEFT JOIN body USING (spider, key) LEFT JOIN old USING (spider, key)"""


def _loose(spark, sf):
    """Records as older stores left them: history missing, empty or filled, fields NULL."""
    f = i.fetches(spark, sf)
    entry = F.struct(docs.time_text(F.col("fetched_at")).alias("fetched_time"), F.col("status").alias("status"))
    kind = F.col("event_type")
    return f.select(
        F.col("event_id").alias("key"), F.when(kind != "view", F.col("url")).alias("url"),
        F.when(kind == "click", F.array(entry)).when(kind == "view", F.array_remove(F.array(entry), entry)).alias("history"),
        F.when(kind != "signup", F.lit("2020-01-01T00:00")).alias("fetched_time"),
        F.when(kind != "signup", F.lit(301)).alias("status"), F.when(kind == "purchase", F.col("dhash")).alias("hash"),
        F.when(kind == "purchase", F.lit(7)).alias("comments"), F.when(kind == "error", F.lit(True)).alias("blocked"))


def document_read(spark, sf):
    full = docs.with_document_defaults(_loose(spark, sf))
    return full.select("key", "url", "raw_html", "blocked", "fetched_time", "status", F.size("history").alias("n_history"),
                       "hash", "domain", "comments", F.size(F.map_keys("social")).alias("n_social"))


def document_short(spark, sf):
    return docs.short_info(_loose(spark, sf)).select("key", "url", "fetched_time", "status", "domain", "comments")


_read_sql = f"""WITH {i.fetches_sql}, r AS (SELECT event_id AS key, CASE WHEN event_type <> 'view' THEN url ELSE '' END AS url, '' AS raw_html,
  event_type = 'error' AS blocked, CASE event_type WHEN 'click' THEN strftime(fetched_at, '%Y-%m-%dT%H:%M') WHEN 'signup' THEN '' ELSE '2020-01-01T00:00' END AS fetched_time,
  CASE event_type WHEN 'click' THEN status WHEN 'signup' THEN 0 ELSE 301 END AS status, (event_type = 'click')::INT AS n_history,
  CASE WHEN event_type = 'purchase' THEN dhash ELSE 0 END AS hash, '' AS domain, CASE WHEN event_type = 'purchase' THEN 7 ELSE 0 END AS comments, 0 AS n_social FROM fe)"""


def document_delete(spark, sf):
    """Sites with an error event lose their document."""
    bad = i.fetches(spark, sf).filter(F.col("event_type") == "error").filter(F.col("value") > 100)
    return flat(docs.delete_documents(stored(spark, sf), bad))


def json_roundtrip(spark, sf):
    """Documents of the pages written as JSON lines and read back."""
    rows = i.pages(spark, sf).select(
        F.col("page_id").alias("comments"), "url", F.col("html").alias("raw_html"),
        F.array(F.struct(F.lit("2024-01-01T00:00").alias("fetched_time"), F.lit(200).alias("status"))).alias("history"))
    path = staging_path(spark, "documents-json")
    write_documents(docs.with_document_defaults(rows), "json", path)
    schema = "url string, raw_html string, blocked boolean, fetched_time string, status int, hash bigint, comments int"
    back = spark.read.schema(schema).json(path)
    return back.select("comments", "url", F.md5("raw_html").alias("digest"), "blocked", "fetched_time", "status", "hash")


QUERIES = {
    "document_history": (document_history, merge_sql("true")),
    "document_size_guard": (document_size_guard, merge_sql(f"octet_length(encode(raw.raw_html)) <= {MAX_BYTES}")),
    "document_read": (document_read, _read_sql + " SELECT * FROM r"),
    "document_short": (document_short, _read_sql + " SELECT key, url, fetched_time, status, domain, comments FROM r"),
    "document_delete": (document_delete, f"WITH {i.fetches_sql}, {i.site_seen_sql}, bad AS (SELECT DISTINCT spider, key FROM fe WHERE event_type = 'error' AND value > 100) "
                        "SELECT spider, key, 'http://' || key AS url, 'old' AS raw_html, page_hash AS hash, '2023-12-31T00:00=200' AS history "
                        "FROM site_seen ANTI JOIN bad USING (spider, key)"),
    "json_roundtrip": (json_roundtrip, "SELECT page_id AS comments, url, md5(html) AS digest, false AS blocked, '2024-01-01T00:00' AS fetched_time, "
                       "200 AS status, 0::BIGINT AS hash FROM pages"),
}
