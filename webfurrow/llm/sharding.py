"""Sharding of equal texts together: longest processing time first."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.llm.common import without

#: Items the schedule holds for each shard: so many large groups and so many bundles of small groups at most.
ITEMS_PER_SHARD = 256
#: Bytes a row costs besides its text.
ROW_COST = 16
#: Rows numbered by one task, about.
ROWS_PER_PART = 100_000
OUTPUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def longest_first(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Item -> shard: items from the largest to the smallest, each to the least loaded shard.

    Ties in size go by name, ties in load by shard number.
    """
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for size, name in sorted(items, key=lambda item: (-item[0], item[1])):
        load, shard = heap[0]
        placed[name] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, shards: int = 40, column: str = "text", order: str = "doc_id",
                    items_per_shard: int = ITEMS_PER_SHARD, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``law`` (``bytes``), ``shard``, ``slot`` and ``grown_shard`` (null).

    Rows of equal text share a shard. A group larger than ``1 / (shards * items_per_shard)`` of all
    bytes is an item of the schedule, so there are fewer than ``shards * items_per_shard`` of them;
    smaller groups are bundled by hash into as many items. The schedule therefore has a fixed bound
    at any input size, and it is all that meets the driver. The rows stay where they are until they
    are numbered: slots are counted per part of a shard and offset by the parts before it.

    A null text has no bytes, checksum 0, and is a group of its own by ``order``; an empty text is
    a text. Rows equal in all that is looked at are numbered in any order. An empty table gives no
    rows. Existing columns of the added names are replaced.
    """
    text = F.col(f"`{column}`").cast("string")
    rows = without(docs, OUTPUT).withColumns({
        "size": (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_COST).cast("bigint"),
        "text_crc32": F.coalesce(F.crc32(text), F.lit(0)).cast("bigint"),
        "_group": F.coalesce(F.md5(text), F.concat(F.lit("null "), F.coalesce(F.col(f"`{order}`").cast("string"), F.lit("")))),
    })
    groups = rows.select("_group", "size").groupBy("_group").agg(F.sum("size").alias("bytes"))
    totals = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    spark = docs.sparkSession
    bundles = shards * items_per_shard
    least = (totals["bytes"] or 0) / bundles
    bundle = F.concat(F.lit("bundle "), F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("string"))
    items = (groups.select(F.when(F.col("bytes") > least, F.col("_group")).otherwise(bundle).alias("item"), "bytes")
             .groupBy("item").agg(F.sum("bytes").alias("bytes")))
    placed = longest_first([(r["bytes"], r["item"]) for r in items.collect()], shards)  # under 2 * bundles rows
    plan = spark.createDataFrame(list(placed.items()) or [("", 0)], "item string, shard int")
    # Both lookups hold under 2 * bundles rows: a proven bound.
    large = F.broadcast(plan.select(F.col("item").alias("_group"), F.col("shard").alias("_own")))
    small = F.broadcast(plan.select(F.col("item").alias("_bundle"), F.col("shard").alias("_shared")))
    parts = max(1, -(-totals["rows"] // (shards * rows_per_part)))
    put = (rows.join(large, ["_group"], "left").withColumn("_bundle", bundle).join(small, ["_bundle"], "left")
           .withColumn("shard", F.coalesce("_own", "_shared"))
           .withColumn("_part", F.pmod(F.xxhash64("_group", F.col(f"`{order}`")), F.lit(parts)).cast("int")))
    counts = put.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_part", (F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_part")) - F.col("_n")).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy(F.col(f"`{order}`"), "_group")
    numbered = (put.withColumn("_in", F.row_number().over(within)).join(before, ["shard", "_part"])
                .withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("bigint"))
                .withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")))
    kept = [c for c in rows.columns if c not in ("_group", "size", "text_crc32")]
    return numbered.select(*[F.col(f"`{c}`") for c in kept], *OUTPUT)
