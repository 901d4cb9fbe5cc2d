"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "webfurrow", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings this library is tuned for.

    On a cluster leave ``master`` unset and give ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder shared by all executors for checkpoints and staged tables.

    Read from ``spark.checkpoint.dir``. Only a local master may fall back to a
    fresh temporary folder, since there every executor is in this process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_roots:
        _local_roots[application] = tempfile.mkdtemp(prefix="webfurrow-")
    return _local_roots[application]


def staging_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged_under(folder: str) -> Callable[[DataFrame, str], DataFrame]:
    """A stage that writes a result under ``folder`` and reads it back. Each reader
    then scans only its columns, the plans stay short, and nothing is computed again
    if an executor is lost. The folder must be one all executors share; a stage of the same
    name is another folder each time."""
    used: dict[str, int] = {}

    def stage(df: DataFrame, name: str) -> DataFrame:
        number = used[name] = used.get(name, -1) + 1
        path = f"{folder}/{name}-{number}" if number else f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return stage


def default_stage(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    return staged_under(staging_path(spark, name))
