"""What the operators of this package share: typed per-text helpers, staging, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfurrow.session import staging_path

#: Rows of one Arrow batch. Texts may be long, so a batch is a few hundred of them, not Spark's 10,000.
BATCH_ROWS = 400
#: Entries of a per-task memo of words; a full memo is emptied, so memory stays bounded.
MEMO_SIZE = 400_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Python's table for lower-casing A-Z only.
LOWER_TABLE = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. A text of one byte per character takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER))


def stage(df: DataFrame, name: str, compression: str = "snappy", **options) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it back: lineage is cut, and a lost
    executor costs nothing, since the files are shared. ``options`` are the writer's."""
    path = staging_path(df.sparkSession, name)
    df.write.options(compression=compression, **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def per_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str, column: str = "text") -> DataFrame:
    """Adds the columns of ``schema`` computed from each value of ``column``.

    ``make`` runs once in every task and returns the function of a batch: a list of texts
    (None for null) in, a dict of equally long lists out. Existing columns of the same
    names are replaced. No row is moved between tasks.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    small_batches(df.sparkSession)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for texts in batches:
            got = work([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({n: pd.Series(got[n], dtype=object if None in got[n] else None) for n in names}, columns=names)

    kept = without(df, names)
    added = kept.withColumn("_made", run(F.col(f"`{column}`").cast("string")))
    return added.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.col(f"_made.{n}").alias(n) for n in names])


def small_batches(spark: SparkSession) -> None:
    """Caps the rows of an Arrow batch, which has no cap in bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch while a result is written; the session's own setting is put back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Memo(dict):
    """Values of a pure function by key, emptied when full."""

    def __init__(self, function, size: int = MEMO_SIZE):
        super().__init__()
        self.function, self.size = function, size

    def __missing__(self, key):
        if len(self) >= self.size:
            self.clear()
        value = self[key] = self.function(key)
        return value


def connected(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of each node: ``id`` -> ``component``.

    ``edges`` has ``a`` and ``b``. Each round every node takes the smallest label among
    itself and its neighbours, then the label of that label, so the number of rounds grows
    with the logarithm of the longest path in practice. Only nodes with edges take part;
    each round is written to the shared folder. Nothing passes through the driver but a count.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                 .filter("a <> b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    for _ in range(rounds):
        near = (both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near")))
        took = (labels.join(near, labels.id == near.a, "left")
                .select("id", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old")))
        # A node lowers its label and, through it, the label of the node it used to point to.
        hooked = (took.select(F.col("old").alias("node"), F.col("new").alias("goal"))
                  .unionByName(took.select(F.col("id").alias("node"), F.col("new").alias("goal")))
                  .groupBy("node").agg(F.min("goal").alias("goal")))
        jump = hooked.select(F.col("node").alias("via"), F.col("goal").alias("far"))
        after = stage(hooked.join(jump, hooked.goal == jump.via, "left")
                      .select(F.col("node").alias("id"), F.least("goal", F.coalesce("far", "goal")).alias("label")), "labels")
        changed = after.join(labels, ["id"], "left").filter(~after.label.eqNullSafe(labels.label)).limit(1).count()
        labels = after
        if not changed:
            return (nodes.select("id").join(labels, ["id"], "left")
                    .select("id", F.coalesce("label", "id").alias("component")))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
