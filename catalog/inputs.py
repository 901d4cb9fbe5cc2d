"""Crawl tables derived from the given tables, once for Spark and once for SQL.

Each ``*_sql`` text states the same recipe as the function above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfurrow.functions import fingerprint, urls
from webfurrow.operators.alias_groups import SeenGroups, node
from webfurrow.schemas import spider_config

PARAMS = ["utm_source", "ref"]
NOW = 1706745600
DELAYS = [0, 500, 5000, 7200, 14400, 28800, 57600]
HOSTS = ["thther.example.org", "www.therti.example.org", "blog.ththan.example.net", "ththed.example.org",
         "therin.example.net", "ththre.example.com", "blog.theres.example.com", "www.cheap-pills.example.com"]
SPIDERS = [
    {"spider": "s0", "exclude_pages": ["https?://[^/]*(casino|pills|bets|track)", "https?://[^/]*/de/"],
     "start_urls": ["http://site0.example.com/", "http://site1.example.com/"], "normalize_params": PARAMS},
    {"spider": "s1", "allowed_domains": HOSTS, "depth": 3, "delay": 5, "use_canonical": False,
     "nofollow_compliant": False, "refetching_strategy": "base", "refetching_delay": 7200,
     "start_urls": ["http://site2.example.com/"], "normalize_params": PARAMS},
    {"spider": "s2", "exclude_pages": [".*page=2"], "depth": 1, "restart_delay": None, "robots_compliant": False,
     "refetching_delay": 1800, "start_urls": ["http://site3.example.com/"], "normalize_params": PARAMS},
]
_HOST_LIST = ", ".join(f"'{h}'" for h in HOSTS)

config_sql = f"""config AS (SELECT * FROM (VALUES
  ('s0', []::VARCHAR[], '^(?:(?:https?://[^/]*(casino|pills|bets|track))|(?:https?://[^/]*/de/))', 2, 120, true, true, true, 20, 14400, 'news', ['http://site0.example.com/', 'http://site1.example.com/']),
  ('s1', [{_HOST_LIST}], NULL, 3, 120, false, false, true, 5, 7200, 'base', ['http://site2.example.com/']),
  ('s2', []::VARCHAR[], '^(?:.*page=2)', 1, NULL, true, true, false, 20, 1800, 'news', ['http://site3.example.com/'])
) c(spider, allowed, exclude_re, max_depth, restart_delay, use_canonical, nofollow, robots, spider_delay, refetching_delay, strategy, start_urls))"""


def config(spark: SparkSession) -> DataFrame:
    return spider_config(spark, SPIDERS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with long texts. Each given file is one row group, which one task would read, so its rows are
    dealt over all cores before they are worked on, at every size."""
    return table(spark, sf, name).repartition(spark.sparkContext.defaultParallelism)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "pages").withColumn("spider", F.concat(F.lit("s"), F.col("page_id") % 3))


pages_sql = "pg AS (SELECT page_id, url, html, 's' || (page_id % 3) AS spider FROM pages)"


def messy_url(url: Column) -> Column:
    """Adds query pairs to sort, drop and re-encode."""
    return (F.when(F.instr(url, "#") > 0, url)
            .when(F.instr(url, "?") > 0, F.concat(url, F.lit("&b=2&a=x%20y;b=1&e=&q")))
            .otherwise(F.concat(url, F.lit("?b=1&a=~*"))))


def messy_url_sql(url: str) -> str:
    return (f"CASE WHEN instr({url}, '#') > 0 THEN {url} WHEN instr({url}, '?') > 0 "
            f"THEN {url} || '&b=2&a=x%20y;b=1&e=&q' ELSE {url} || '?b=1&a=~*' END")


def domain_sql(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def canonize_sql(url: str) -> str:
    bare = f"regexp_replace(rtrim({url}, '/'), '^https?://', '')"
    quoted = f"replace(replace(url_encode({bare}), '~', '%7E'), '%2F', '/')"
    return f"(CASE WHEN regexp_matches({bare}, '[^\\x00-\\x7F]') THEN {bare} ELSE {quoted} END)"


def normalize_sql(url: str) -> str:
    whole = f"split_part({url}, '#', 1)"
    drop = ", ".join(f"'{p}'" for p in PARAMS)

    def decode(x):
        return f"url_decode(replace({x}, '+', ' '))"

    def encode(x):
        return f"replace(replace(url_encode({x}), '%20', '+'), '~', '%7E')"

    pairs = (f"list_filter(list_transform(string_split_regex(substr({whole}, instr({whole}, '?') + 1), '[&;]'), "
             f"lambda x, i: {{'k': {decode(chr(39).join(['split_part(x, ', '=', ', 1)']))}, 'i': i, "
             f"'v': CASE WHEN instr(x, '=') > 0 THEN substr(x, instr(x, '=') + 1) ELSE '' END}}), "
             f"lambda p: p.v <> '' AND p.k NOT IN ({drop}))")
    query = (f"array_to_string(list_transform(list_sort({pairs}), "
             f"lambda p: {encode('p.k')} || '=' || {encode(decode('p.v'))}), '&')")
    return (f"(CASE WHEN instr({whole}, '?') = 0 THEN {whole} ELSE split_part({whole}, '?', 1) || "
            f"coalesce('?' || nullif({query}, ''), '') END)")


# A page with the head tags and the nofollow link the given pages lack.
def head_pages(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.regexp_extract("url", "/(en|fr|de|es)/", 1)
    pid = F.col("page_id")
    head = F.concat(
        F.lit('<!-- <a href="/no">no</a> -->'),
        F.when(pid % 2 == 0, F.lit('<base href="/b/">')).otherwise(""),
        F.when(pid % 5 < 2, F.concat(F.lit('<link rel="x canonical" href="'), F.col("url"), F.lit('">')))
        .otherwise('<link rel="stylesheet" href="/s.css">'),
        F.when(pid % 5 == 0, F.lit('<meta property="lang" content="other">'))
        .otherwise(F.concat(F.lit('<meta name="lang" content="'), lang, F.lit('">'))),
        F.when(pid % 4 == 0, F.lit('<a rel="nofollow ugc" href="/The">x</a>')).otherwise(""),
        F.lit('<a href=" rel/./x?ref=1 ">r</a>'))
    return pages(spark, sf).withColumn("html", F.concat(head, "html"))


head_pages_sql = """hp AS (SELECT page_id, spider, url,
  '<!-- <a href="/no">no</a> -->'
  || CASE WHEN page_id % 2 = 0 THEN '<base href="/b/">' ELSE '' END
  || CASE WHEN page_id % 5 < 2 THEN '<link rel="x canonical" href="' || url || '">' ELSE '<link rel="stylesheet" href="/s.css">' END
  || CASE WHEN page_id % 5 = 0 THEN '<meta property="lang" content="other">'
     ELSE '<meta name="lang" content="' || regexp_extract(url, '/(en|fr|de|es)/', 1) || '">' END
  || CASE WHEN page_id % 4 = 0 THEN '<a rel="nofollow ugc" href="/The">x</a>' ELSE '' END
  || '<a href=" rel/./x?ref=1 ">r</a>' || html AS html FROM pg)"""

_LEXER = (r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[^>]*>|[^<]+|<")


def text_sql(source: str, name: str = "txt", columns: str = "page_id") -> str:
    """CTE with the lower-case text of each page of ``source``."""
    piece = (r"CASE WHEN regexp_matches(p, '(?is)^<(script|style)\b') THEN regexp_extract(p, '(?is)^<[^>]*>(.*)</[^>]*>$', 1) "
             r"WHEN p[1] = '<' THEN '' ELSE replace(regexp_replace(replace(replace(replace(replace(p, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), "
             r"'&quot;', chr(34)), '&amp($|[^A-Za-z0-9;])', '&\1', 'g'), '&amp;', '&') END")
    return (f"{name} AS (SELECT {columns}, lower(array_to_string(list_transform("
            f"regexp_extract_all(html, '{_LEXER}', 0), lambda p: {piece}), '')) AS text FROM {source})")


def tags_sql(source: str, name: str = "tags", columns: str = "page_id, spider, url") -> str:
    """CTE with the list of start tags of each page of ``source``."""
    return (f"{name} AS (SELECT {columns}, list_filter(regexp_extract_all(html, '{_LEXER}', 0), "
            r"lambda p: regexp_matches(p, '(?i)^<(a|base|link|meta)[\s/>]')) AS tags FROM " f"{source})")


def simhash_sql(source: str, key: str, name: str = "sim", text: str = "text") -> str:
    """CTEs ``name`` with ``key`` and the fingerprint ``hash`` of a text column."""
    sums = ", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))
    bits = " + ".join(f"CASE WHEN 2 * b{i} > n THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64))
    return (
        f"{name}_t AS (SELECT {key}, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM "
        f"(SELECT {key}, unnest(string_split_regex({text}, '[^A-Za-z0-9_]+')) AS t FROM {source})), "
        f"{name}_c AS (SELECT {key}, count(*) AS n, {sums} FROM {name}_t GROUP BY {key}), "
        f"{name}_u AS (SELECT {key}, {bits} AS u FROM {name}_c), "
        f"{name} AS (SELECT {key}, (CASE WHEN u >= 9223372036854775808::HUGEINT "
        f"THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS hash FROM {name}_u)")


def md5_number_sql(text: str) -> str:
    """First 64 bits of the md5 as a signed number."""
    u = f"('0x' || substr(md5({text}), 1, 16))::UBIGINT::HUGEINT"
    return f"((CASE WHEN {u} >= 9223372036854775808::HUGEINT THEN {u} - 18446744073709551616::HUGEINT ELSE {u} END)::BIGINT)"


# Seen table: about half of the pages of every spider, by a hash of their key, and their m. alias.
def page_seen(spark: SparkSession, sf: str, page_hash: Column | None = None) -> DataFrame:
    value = fingerprint.token_hash(F.col("html")) if page_hash is None else page_hash
    rows = (pages(spark, sf).withColumn("main", urls.canonize(F.col("url"))).filter(F.md5("main") < "8")
            .groupBy("spider", "main").agg(F.max(value).alias("page_hash")))
    names = F.array("main", F.concat(F.lit("m."), "main"))
    return rows.select("spider", F.explode(names).alias("key"), "page_hash",
                       F.lit(1).cast("bigint").alias("count"), names.alias("alternatives"))


def page_groups(spark: SparkSession, sf: str) -> SeenGroups:
    """The same table as groups: each page with its m. alias."""
    seen = page_seen(spark, sf)
    main = F.element_at("alternatives", 1)
    comp = node(F.col("spider"), main).alias("comp")
    return SeenGroups(
        seen.select("spider", "key", comp, main.alias("grp"), F.lit(True).alias("live"), F.lit(0).cast("bigint").alias("extra")),
        seen.filter(F.col("key") == main).select("spider", comp, F.col("key").alias("grp"), "page_hash", "count"))


page_seen_sql = f"""sm AS (SELECT spider, {canonize_sql('url')} AS main, max({md5_number_sql('html')}) AS page_hash
  FROM pg WHERE md5({canonize_sql('url')}) < '8' GROUP BY ALL),
seen AS (SELECT spider, unnest([main, 'm.' || main]) AS key, page_hash, 1::BIGINT AS count,
  [main, 'm.' || main] AS alternatives FROM sm)"""


# Fetches: one row per event.
def site_url(number: Column) -> Column:
    return F.concat(F.lit("http://site"), number % 7, F.lit(".example.com/p/"), number)


def fetches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event. The given file is one row group, which one task would read, and sort before it
    aggregates, so its rows are dealt by their number; Spark sets how many parts by their size."""
    e = table(spark, sf, "events").repartition("event_id")
    eid, kind = F.col("event_id"), F.col("event_type")
    delay = F.element_at(F.array(*[F.lit(d).cast("bigint") for d in DELAYS]), (eid % 7 + 1).cast("int"))
    url = site_url(F.col("user_id"))
    return e.select(
        "event_id", "event_type", "value", F.col("user_id").alias("user_number"), F.concat(F.lit("s"), F.col("user_id") % 3).alias("spider"),
        url.alias("url"), urls.canonize(url).alias("key"), F.col("ts").cast("timestamp").alias("fetched_at"),
        F.floor(F.col("value")).cast("bigint").alias("dhash"),
        F.when(kind == "signup", 304).when(kind == "error", 503).otherwise(200).alias("status"),
        (eid % 6).cast("int").alias("depth"), delay.alias("delay"), (eid % 3 + 1).cast("tinyint").alias("source"))


fetches_sql = f"""fe AS (SELECT event_id, event_type, value, 's' || (user_id % 3) AS spider,
  'http://site' || (user_id % 7) || '.example.com/p/' || user_id AS url,
  'site' || (user_id % 7) || '.example.com/p/' || user_id AS key, ts AS fetched_at,
  floor(value)::BIGINT AS dhash,
  CASE event_type WHEN 'signup' THEN 304 WHEN 'error' THEN 503 ELSE 200 END AS status,
  (event_id % 6)::INT AS depth, {DELAYS}[event_id % 7 + 1]::BIGINT AS delay, (event_id % 3 + 1) AS source FROM events)"""


# Seen table of the fetched sites: customers in credit.
def site_seen(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter(F.col("c_acctbal") > 0)
    key = urls.canonize(site_url(F.col("c_custkey")))
    return c.select(F.concat(F.lit("s"), F.col("c_custkey") % 3).alias("spider"), key.alias("key"),
                    (F.col("c_custkey") % 512).cast("bigint").alias("page_hash"),
                    F.lit(1).cast("bigint").alias("count"), F.array(key).alias("alternatives"))


site_seen_sql = """site_seen AS (SELECT 's' || (c_custkey % 3) AS spider,
  'site' || (c_custkey % 7) || '.example.com/p/' || c_custkey AS key, (c_custkey % 512)::BIGINT AS page_hash,
  1::BIGINT AS count FROM customer WHERE c_acctbal > 0)"""


# Frontier: one item per event, equal items once.
def frontier(spark: SparkSession, sf: str) -> DataFrame:
    f = fetches(spark, sf)
    normal = F.col("source") == 2
    return f.select(
        "spider", "source", F.when(normal, F.col("depth").cast("bigint")).otherwise(
            F.lit(1704067200) + F.floor(F.col("value") * 10000).cast("bigint")).alias("score"),
        "url", F.when(normal, F.lit(0).cast("bigint")).otherwise(F.col("delay")).alias("next_delay"), "depth",
        "event_type").distinct()


frontier_sql = """fr AS (SELECT DISTINCT spider, source, CASE WHEN source = 2 THEN depth
    ELSE 1704067200 + floor(value * 10000)::BIGINT END AS score, url,
  CASE WHEN source = 2 THEN 0 ELSE delay END AS next_delay, depth, event_type FROM fe)"""


# Robots rules: the same three lines for every host, their order by the host's length.
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "pages").select(urls.domain(F.col("url")).alias("domain")).distinct()
    rules = F.array(*[F.struct(F.lit(n).alias("rule_no"), F.lit(a).alias("allow"), F.lit(p).alias("path"))
                      for n, a, p in [(2, False, "/a"), (1, True, "/and"), (3, False, "/b/rel")]])
    rows = hosts.select("domain", F.lit("*").alias("agent"), F.explode(rules).alias("r")).select(
        "domain", "agent", "r.*")
    flipped = F.when(F.length("domain") % 2 == 0, -F.col("rule_no")).otherwise(F.col("rule_no"))
    return rows.withColumn("rule_no", flipped)


robots_sql = """rules AS (SELECT domain, CASE WHEN length(domain) % 2 = 0 THEN -rule_no ELSE rule_no END AS rule_no, allow, path
  FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain FROM pages),
  (VALUES (2, false, '/a'), (1, true, '/and'), (3, false, '/b/rel')) r(rule_no, allow, path))"""
