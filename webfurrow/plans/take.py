"""Taking items out of the frontier: admission before the fetch, and leases for what is out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfurrow.functions import urls
from webfurrow.operators import frontier as fr
from webfurrow.operators.components import Stage
from webfurrow.operators.lookup import with_config
from webfurrow.operators.seen import KEY, with_key
from webfurrow.schemas import FRONTIER, NORMAL
from webfurrow.session import default_stage

IN_FLIGHT = T.StructType([*FRONTIER.fields, T.StructField("taken_at", T.LongType())])


@dataclass(frozen=True)
class Taken:
    """Items to fetch, pages to delete from the seen table, and the tables after the call."""

    items: DataFrame
    removed: DataFrame
    frontier: DataFrame
    in_flight: DataFrame


def take_items(frontier: DataFrame, in_flight: DataFrame, seen: DataFrame, config: DataFrame, now: Column, n: int,
               stage: Stage | None = None) -> Taken:
    """Takes up to ``n`` items of each spider out of the frontier, in fetch order.

    URLs are checked before they are fetched: ``nurl`` is the form to fetch, and an excluded URL
    is spent without being handed out. ``removed`` has the URLs whose pages leave the seen table,
    those that were refused or got another form. A normal item waits while another of its
    canonical URL is in flight. Only the taken items are staged; the stored tables are streamed.
    """
    stage = stage or default_stage(frontier.sparkSession, "take")
    out = with_key(in_flight.filter(F.col("source") == NORMAL)).select(*KEY).distinct()
    due = fr.next_items(frontier, seen.select(*KEY).unionByName(out), now, n)
    options = ["allowed_domains", "exclude_re", "normalize_params"]
    checked = with_config(due, config, options).withColumn("checked", urls.check(F.col("url"), *map(F.col, options)))
    taken = stage(checked.select(
        *fr.COLUMNS, "rank", "checked.nurl", "checked.to_remove",
        urls.is_admitted(F.col("checked"), F.col("url")).alias("admitted")), "taken")
    admitted = taken.filter("admitted")
    return Taken(
        items=admitted.select(*fr.COLUMNS, "rank", "nurl"),
        removed=taken.filter("to_remove").select("spider", "url").distinct(),
        frontier=fr.remove_items(frontier.select(*fr.COLUMNS), taken),
        in_flight=in_flight.unionByName(admitted.select(*fr.COLUMNS, now.cast("bigint").alias("taken_at"))))


def settle(in_flight: DataFrame, fetched: DataFrame) -> DataFrame:
    """Items still out after the results of ``fetched`` came in, compared by their whole value."""
    return fr.remove_items(in_flight, fetched)


def return_expired(frontier: DataFrame, in_flight: DataFrame, now: Column, lease: int) -> tuple[DataFrame, DataFrame]:
    """Frontier with the items whose lease of ``lease`` seconds is over, and the items still out."""
    expired = F.col("taken_at") + lease <= now
    return fr.push(frontier, in_flight.filter(expired)), in_flight.filter(~expired)
