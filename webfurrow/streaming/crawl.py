"""Continuous crawl: each micro-batch of fetch results is one crawl step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webfurrow.operators.frontier import enqueue_seeds, remove_items, reset_start_urls
from webfurrow.operators.seen import KEY
from webfurrow.plans.crawl_step import crawl_step
from webfurrow.schemas import FRONTIER, PRIORITY, SEEN
from webfurrow.session import staged_under
from webfurrow.sources.snapshots import Snapshots, StoredDocuments
from webfurrow.sources.tables import write_documents


def start_tables(store: Snapshots, config: DataFrame, seeds: DataFrame, seen: DataFrame | None = None,
                 documents: DataFrame | None = None) -> None:
    """First version of the tables: start URLs in the priority class, then the seeds."""
    spark = store.spark
    known = spark.createDataFrame([], SEEN) if seen is None else seen
    empty = spark.createDataFrame([], FRONTIER)
    store.start(seen, enqueue_seeds(reset_start_urls(empty, config), seeds, known), documents)


def apply_batch(store: Snapshots, version: int, log: DataFrame, config: DataFrame, robots_rules: DataFrame,
                max_doc_bytes: int | None = None, sink: tuple[str, str] | None = None, restarted: bool = False) -> None:
    """Write version ``version`` of all tables from the version before and a batch.

    Time is the fetch time of each row, so a repeated batch gives the same rows. Only buckets with keys of the
    batch are read, and only changes are written. ``sink``: kind and folder documents are written to as
    well, see ``write_documents``. ``restarted``: the priority class is replaced by the start URLs first.
    """
    before = version - 1
    stage = staged_under(store.path("_staging", version))
    result = crawl_step(log, store.seen_at(before), StoredDocuments(store, before), config, robots_rules,
                        F.unix_timestamp("fetched_at"), stage, max_doc_bytes)
    changes = stage(result.document_changes, "document-changes")
    if sink:
        kind, target = sink
        bodies = changes.filter("body IS NOT NULL").select(*KEY, "body.*", F.col("new_history").alias("history"))
        write_documents(bodies, kind, f"{target}_{version}" if kind == "table" else f"{target}/version={version}")
    store.write_documents(version, changes)
    store.write_seen(version, result.seen)
    puts, gone = result.pushed, result.fetched
    if restarted:
        old = store.read("frontier", before).filter(F.col("source") == PRIORITY)
        starts = remove_items(reset_start_urls(store.spark.createDataFrame([], FRONTIER), config), gone)
        puts, gone = puts.unionByName(starts).distinct(), gone.unionByName(old.select(*gone.columns)).distinct()
    store.states["frontier"].write(version, puts, gone)
    store.write("change_feed", version, result.change_feed)
    store.retain(version)
    store.discard("_staging", version)


def start_crawl(log: DataFrame, store: Snapshots, config: DataFrame, robots_rules: DataFrame,
                max_doc_bytes: int | None = None, available_now: bool = True, sink: tuple[str, str] | None = None,
                restarted: bool = False) -> StreamingQuery:
    """Run crawl steps over a fetch-log stream until it is stopped, or until all
    present input is used. The batch number is the version, so a batch that is
    repeated after a failure replaces its own output. With ``restarted`` the first batch of this run
    starts from the start URLs of ``config``, whatever was left of the old ones."""
    first = [restarted]

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_batch(store, batch_id, batch, config, robots_rules, max_doc_bytes=max_doc_bytes, sink=sink, restarted=first[0])
        first[0] = False

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", f"{store.root}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
