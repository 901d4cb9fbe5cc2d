"""Table schemas, codes and option defaults."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Where a frontier item comes from.
UNKNOWN, PRIORITY, NORMAL, REFETCH = 0, 1, 2, 3

# Outcome codes of a fetch.
SUCCESS, GENERIC_ERROR, CONNECTION_ERROR, SKIP_URL = 0, 100, 200, 300

_strings = T.ArrayType(T.StringType())

SPIDER_CONFIG = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("allowed_domains", _strings),
    T.StructField("exclude_pages", _strings),
    T.StructField("start_urls", _strings),
    T.StructField("depth", T.IntegerType()),
    T.StructField("restart_delay", T.LongType()),
    T.StructField("use_canonical", T.BooleanType()),
    T.StructField("nofollow_compliant", T.BooleanType()),
    T.StructField("robots_compliant", T.BooleanType()),
    T.StructField("delay", T.IntegerType()),
    T.StructField("normalize_params", _strings),
    T.StructField("default_encoding", T.StringType()),
    T.StructField("refetching_delay", T.LongType()),
    T.StructField("refetching_strategy", T.StringType()),
])

FETCH_LOG = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("response_url", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("encoding", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("delay", T.LongType()),
    T.StructField("source", T.ByteType()),
    T.StructField("score", T.LongType()),
])

HISTORY = T.ArrayType(T.StructType([
    T.StructField("fetched_time", T.StringType()),
    T.StructField("status", T.IntegerType()),
]))

DOCUMENTS = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("raw_html", T.StringType()),
    T.StructField("blocked", T.BooleanType()),
    T.StructField("hash", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("comments", T.IntegerType()),
    T.StructField("social", T.MapType(T.StringType(), T.StringType())),
    T.StructField("history", HISTORY),
])

SEEN = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("page_hash", T.LongType()),
    T.StructField("count", T.LongType()),
    T.StructField("alternatives", _strings),
])

FRONTIER = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("source", T.ByteType()),
    T.StructField("score", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("next_delay", T.LongType()),
    T.StructField("depth", T.IntegerType()),
])

CHANGE_FEED = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("detected_at", T.LongType()),
])

ROBOTS_RULES = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("rule_no", T.IntegerType()),
    T.StructField("allow", T.BooleanType()),
    T.StructField("path", T.StringType()),
])

# Option defaults of a spider, refetch settings included.
SPIDER_DEFAULTS = {
    "depth": 2,
    "restart_delay": 120,
    "use_canonical": True,
    "nofollow_compliant": True,
    "robots_compliant": True,
    "delay": 20,
    "default_encoding": "utf-8",
    "refetching_delay": 14400,
    "refetching_strategy": "news",
}


def empty_strings() -> Column:
    return F.array().cast(_strings)


def with_defaults(config: DataFrame) -> DataFrame:
    """Spider options with every missing column or NULL value filled in, and the
    exclude patterns joined into one start-anchored pattern (NULL if none)."""
    columns = []
    for field in SPIDER_CONFIG.fields:
        present = field.name in config.columns
        value = F.col(field.name).cast(field.dataType) if present else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            value = F.coalesce(value, empty_strings())
        elif field.name == "restart_delay" and present:
            pass  # NULL is a real value: no periodic refetch of start URLs
        elif field.name in SPIDER_DEFAULTS:
            value = F.coalesce(value, F.lit(SPIDER_DEFAULTS[field.name]).cast(field.dataType))
        columns.append(value.alias(field.name))
    filled = config.select(*columns)
    joined = F.array_join(F.transform("exclude_pages", lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))), "|")
    return filled.withColumn(
        "exclude_re", F.when(F.size("exclude_pages") > 0, F.concat(F.lit("^(?:"), joined, F.lit(")"))))


def spider_config(spark, rows: list[dict]) -> DataFrame:
    """A ``spider_config`` table from option dictionaries, one per spider."""
    names = SPIDER_CONFIG.fieldNames()
    full = []
    for row in rows:
        unknown = set(row) - set(names)
        if unknown:
            raise ValueError(f"unknown spider options: {sorted(unknown)}")
        values = {**SPIDER_DEFAULTS, **row}
        full.append({n: values.get(n) for n in names})
    # An Arrow table becomes a local relation, whose size the planner knows.
    arrow = pa.Table.from_pylist(full, schema=to_arrow_schema(SPIDER_CONFIG))
    return with_defaults(spark.createDataFrame(arrow, SPIDER_CONFIG))
