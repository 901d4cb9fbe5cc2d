"""Every registered query against its SQL at the smallest scale."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from catalog import inputs
from webfurrow.operators.seen import new_urls

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_all_queries_match_their_sql():
    run = subprocess.run([sys.executable, "check.py", SF], cwd=ROOT, capture_output=True, text=True, timeout=1500)
    assert run.returncode == 0, run.stdout[-3000:]


def test_every_query_has_sql():
    from catalog import ALL_QUERIES

    assert all(sql for _, sql in ALL_QUERIES.values())


def test_the_size_guard_changes_the_result(spark):
    from catalog.document_queries import QUERIES

    guarded, plain = (QUERIES[name][0](spark, SF) for name in ("document_size_guard", "document_history"))
    assert guarded.exceptAll(plain).count() and plain.exceptAll(guarded).count()


def test_derived_tables_exercise_every_spider(spark):
    heads = inputs.head_pages(spark, SF).filter(F.contains("html", F.lit('rel="x canonical"')))
    assert {r["spider"] for r in heads.select("spider").distinct().collect()} == {"s0", "s1", "s2"}
    stored = inputs.page_seen(spark, SF)
    assert {r["spider"] for r in stored.select("spider").distinct().collect()} == {"s0", "s1", "s2"}
    fresh = new_urls(inputs.pages(spark, SF).select("spider", "url"), stored)
    assert {r["spider"] for r in fresh.select("spider").distinct().collect()} == {"s0", "s1", "s2"}


@pytest.fixture
def uncoalesced(spark):
    """Small tables would share one task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_events_of_one_row_group_are_dealt_over_tasks(uncoalesced):
    rows = inputs.fetches(uncoalesced, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).count().collect()
    counts = [r["count"] for r in rows]
    assert sum(counts) == 100_000 and max(counts) < 80_000


def test_a_week_of_a_log_has_many_files(uncoalesced):
    from catalog.crawl_queries import _written

    rows = inputs.fetches(uncoalesced, "/root/testdata/sf0.1").select("event_id", "fetched_at")
    path, files = _written(uncoalesced, rows, "fetches")
    back = uncoalesced.read.parquet(path)
    of_file = back.groupBy(F.input_file_name()).count().collect()
    assert len(of_file) > 4 and files == (len(of_file) + 1) // 2 and max(r["count"] for r in of_file) < 20_000
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
