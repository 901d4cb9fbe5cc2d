"""Change feed of a whole fetch log: each fetch against the one before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.functions import fingerprint
from webfurrow.operators.seen import KEY


def changes_in_log(fetches: DataFrame, at: str = "fetched_at", dhash: str = "dhash",
                   tie: Sequence[str] = ("url",), bucket: Column | None = None) -> DataFrame:
    """Fetches whose page was new or differed from the fetch before it."""
    stepped = with_previous(fetches, at, dhash, tie, bucket)
    return stepped.filter(fingerprint.is_changed(F.col(dhash), F.col("_previous.dhash"))).select(*fetches.columns)


def with_previous(fetches: DataFrame, at: str = "fetched_at", dhash: str = "dhash",
                  tie: Sequence[str] = ("url",), bucket: Column | None = None) -> DataFrame:
    """Adds ``_previous``: ``(dhash)`` of the fetch of the same page before, NULL for the first.

    It is found in two levels. Inside a time bucket (an hour by default) it is the row
    before; the first row of a bucket takes the last hash of the bucket before. So no task
    sorts all fetches of a URL, and what is sorted per URL is one row per bucket.
    """
    bucket = F.date_trunc("hour", F.col(at)) if bucket is None else bucket
    rows = fetches.withColumn("_bucket", bucket)
    order = [at, *tie]
    inside = Window.partitionBy(*KEY, "_bucket").orderBy(*order)
    stepped = rows.withColumn("_within", F.lag(F.struct(F.col(dhash).alias("dhash"))).over(inside))
    ends = rows.groupBy(*KEY, "_bucket").agg(F.max_by(dhash, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*KEY).orderBy("_bucket")
    starts = ends.select(*KEY, "_bucket", F.lag(F.struct(F.col("_end").alias("dhash"))).over(across).alias("_before"))
    joined = stepped.join(starts, [*KEY, "_bucket"], "left")
    return joined.withColumn("_previous", F.coalesce("_within", "_before")).drop("_bucket", "_within", "_before")
