"""Joins and limits that stay balanced when one key holds many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to a lookup with one row per key.

    A lookup below the broadcast threshold is broadcast by Spark, which checks its size. A
    larger one shuffles, and adaptive execution splits the partition of a hot key by its
    measured size, repeating the key's one lookup row for each part.
    """
    return facts.join(lookup, list(keys), how)


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key in ``order``, numbered from 1.

    One plan for every ``n``: each key is cut to ``n`` in parts first, as many as a shuffle
    has, so that what meets in one task is ``n`` rows of each part.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    cut = (df.withColumn("_part", F.pmod(F.xxhash64(*order_columns(df)), F.lit(parts)))
           .withColumn("_r", F.row_number().over(within)).filter(F.col("_r") <= n).drop("_part", "_r"))
    over = Window.partitionBy(*keys).orderBy(*order)
    return cut.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) <= n)


def as_of(rows: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the order values of the last of ``events`` of the same keys at or before each row, NULL without one.

    Rows and events are put together and read off in two levels: inside a ``bucket`` of the order it is a
    running maximum, and a row without an event in its bucket takes the last one of the buckets before. So
    no task sorts all rows of a key, and per key only one row a bucket is sorted.
    """
    at = F.struct(*order)
    both = (rows.withColumns({"_event": F.lit(None).cast(events.select(at.alias("at")).schema["at"].dataType), "_row": F.lit(True)})
            .unionByName(events.select(*keys, *order, at.alias("_event"), F.lit(False).alias("_row")), allowMissingColumns=True)
            .withColumn("_bucket", bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.filter("NOT _row").groupBy(*keys, "_bucket").agg(F.max("_event").alias("_end"))
    every = both.select(*keys, "_bucket").distinct().join(ends, [*keys, "_bucket"], "left")
    across = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = every.select(*keys, "_bucket", F.max("_end").over(across).alias("_before"))
    found = both.withColumn("_within", F.max("_event").over(inside)).filter("_row")
    return (found.join(before, [*keys, "_bucket"], "left").withColumn(out, F.coalesce("_within", "_before"))
            .select(*rows.columns, out))


def order_columns(df: DataFrame) -> list[str]:
    """Columns a hash can be taken of."""
    return [f.name for f in df.schema.fields if "map" not in f.dataType.simpleString()]


CONFIG_COLUMNS = ["allowed_domains", "exclude_re", "normalize_params", "use_canonical", "nofollow_compliant",
                  "robots_compliant", "default_encoding", "max_depth", "spider_delay", "restart_delay",
                  "refetching_delay", "refetching_strategy"]


def with_config(df: DataFrame, config: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds options of the row's spider. ``depth`` and ``delay`` of the config are
    called ``max_depth`` and ``spider_delay``, as rows have their own. A row whose
    spider has no config fails the query, so that no row is lost unseen."""
    renamed = config.withColumnsRenamed({"depth": "max_depth", "delay": "spider_delay"})
    joined = lookup_join(df, renamed.select("spider", *columns, F.lit(True).alias("_known")), ["spider"])
    missing = F.raise_error(F.concat(F.lit("no config for spider "), F.coalesce("spider", F.lit("NULL"))))
    return joined.filter(F.when(F.col("_known"), True).otherwise(missing.cast("boolean"))).drop("_known")


def of_spiders(df: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the chosen spiders only; ``names`` has a ``spider`` column."""
    return lookup_join(df, names.select("spider").distinct(), ["spider"], how="left_semi")
