"""Seed lists, fetch logs and the output of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfurrow.functions import urls
from webfurrow.operators.lookup import with_config
from webfurrow.schemas import FETCH_LOG

SEED_FILE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("depth", T.StringType()),
    T.StructField("_bad_line", T.StringType()),
])


def read_seed_file(spark: SparkSession, path: str, spider: str) -> DataFrame:
    """Seeds of a JSON-lines file with ``url`` and ``depth``. Lines that are no JSON
    keep their text in ``_bad_line`` and have no URL."""
    lines = spark.read.schema(SEED_FILE).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad_line").json(path)
    return lines.withColumn("spider", F.lit(spider))


def usable_seeds(seeds: DataFrame, config: DataFrame) -> DataFrame:
    """Seeds on an allowed domain that are no start URL of their spider."""
    known = with_config(seeds.filter(F.col("url").isNotNull()),
                        config.withColumnRenamed("start_urls", "starts"), ["allowed_domains", "starts"])
    kept = known.filter(urls.is_allowed(urls.domain(F.col("url")), F.col("allowed_domains"))
                        & ~F.array_contains("starts", F.col("url")))
    return kept.select("spider", "url", "depth")


def read_fetch_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_LOG).parquet(path)


def stream_fetch_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Fetch log as a stream; ``files_per_batch`` bounds what one batch holds."""
    return (spark.readStream.schema(FETCH_LOG).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def write_documents(df: DataFrame, sink: str, target: str, **options) -> None:
    """Write documents whole: ``json`` lines, ``parquet`` files or a ``table``."""
    writer = df.write.mode("overwrite").options(**options)
    if sink == "json":
        writer.option("ignoreNullFields", "false").json(target)
    elif sink == "parquet":
        writer.parquet(target)
    elif sink == "table":
        writer.saveAsTable(target)
    else:
        raise ValueError(f"unknown sink {sink!r}, choose json, parquet or table")
