"""Change feed of a fetch stream, against a table with the last hash of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webfurrow.functions import fingerprint
from webfurrow.operators.seen import KEY
from webfurrow.plans.change_log import with_previous
from webfurrow.session import staged_under
from webfurrow.sources.snapshots import Snapshots


def apply_fetches(store: Snapshots, version: int, fetches: DataFrame) -> None:
    """Write the feed of a batch and its last hashes. ``fetches``: spider, key, url, dhash, fetched_at.

    Fetches of a page in the batch are compared in the order of time, the first with the stored
    hash; a missing hash counts as changed. Only the buckets of the batch's pages are read, only its pages
    are written, and a repeated batch writes the same files.
    """
    hashes = store.states["last_hash"]
    if version == 0:
        hashes.start(-1)
    rows = staged_under(store.path("_staging", version))(
        fetches.select("spider", "key", "url", "dhash", F.col("fetched_at").cast("timestamp").alias("fetched_at")), "fetches")
    stored = hashes.around(version - 1, rows.select(*KEY))
    stepped = with_previous(rows).join(stored.withColumnRenamed("dhash", "_stored"), KEY, "left")
    previous = F.when(F.col("_previous").isNotNull(), F.col("_previous.dhash")).otherwise(F.col("_stored"))
    store.write("fetch_feed", version, stepped.filter(fingerprint.is_changed(F.col("dhash"), previous)).select(*rows.columns))
    hashes.write(version, rows.groupBy(*KEY).agg(F.max_by("dhash", F.struct("fetched_at", "url")).alias("dhash")))
    hashes.retain(version)
    store.discard("_staging", version)


def start_change_feed(fetches: DataFrame, store: Snapshots, available_now: bool = True) -> StreamingQuery:
    """Publish the fetches of a stream whose page was new or changed as table ``fetch_feed`` of ``store``."""
    writer = (fetches.writeStream.foreachBatch(lambda batch, version: apply_fetches(store, version, batch))
              .option("checkpointLocation", f"{store.root}/_checkpoint"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
