"""Shapes of physical plans that matter at scale."""

from pyspark.sql import functions as F

from catalog import inputs
from webfurrow.functions import fingerprint
from webfurrow.operators import frontier as fr
from webfurrow.operators.documents import document_changes
from webfurrow.plans.page_parse import PARSE_OPTIONS, parse_pages
from webfurrow.schemas import DOCUMENTS, FRONTIER, SEEN

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def empty(spark, tmp_path, schema, name):
    """A table on disk whose size the planner does not take as small."""
    path = str(tmp_path / name)
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def test_parse_has_no_shuffle(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(
        F.lit("s0").alias("spider"), F.col("html").alias("raw_html"), F.col("url").alias("response_url"),
        F.array("url").alias("alternatives"), F.lit(200).alias("status_code"), F.current_timestamp().alias("fetched_at"), F.lit(0).alias("depth"))
    options = inputs.config(spark).withColumnRenamed("depth", "max_depth").select("spider", *PARSE_OPTIONS)
    text = plan(parse_pages(pages.join(F.broadcast(options), "spider")))
    assert "Exchange hashpartitioning" not in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_simhash_reads_two_columns_and_has_no_shuffle(spark):
    text = plan(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", fingerprint.simhash(F.col("text"))))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text


def test_next_items_are_cut_before_the_shuffle(spark, tmp_path):
    frontier = empty(spark, tmp_path, FRONTIER, "f")
    text = plan(fr.next_items(frontier, empty(spark, tmp_path, SEEN, "s"), F.lit(1), 100))
    assert text.count("WindowGroupLimit") >= 2 and "PushedFilters: [IsNotNull(source)" in text


def test_document_changes_do_not_read_stored_bodies(spark, tmp_path):
    known = empty(spark, tmp_path, DOCUMENTS, "d")
    batch = known.withColumn("fetched_at", F.current_timestamp()).withColumn("status", F.lit(200))
    text = plan(document_changes(known, batch))
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert any("history" in s and "raw_html" not in s for s in schemas)
    assert "WindowGroupLimit" in text
