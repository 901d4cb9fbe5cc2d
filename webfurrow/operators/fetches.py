"""Fetch attempts: final result per item, and where each result goes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.functions import outcomes
from webfurrow.schemas import CONNECTION_ERROR

ITEM = ["spider", "source", "score", "url", "depth", "delay"]


def resolve_attempts(log: DataFrame, item: Sequence[str] = ITEM) -> DataFrame:
    """One row per item: the first attempt that was no connection error, else the
    last attempt made. Attempts beyond the limit do not count."""
    made = log.filter(F.col("attempt") <= outcomes.MAX_ATTEMPTS).withColumn(
        "outcome", outcomes.outcome(F.col("error")))
    rest = [c for c in made.columns if c not in item]
    # Any other outcome beats a connection error; of these the earliest wins.
    rank = F.when(F.col("outcome") != CONNECTION_ERROR, 1000 - F.col("attempt")).otherwise(F.col("attempt") - 1000)
    return (made.groupBy(*item).agg(F.max_by(F.struct(*rest), rank).alias("final"))
            .select(*item, "final.*"))


def route(resolved: DataFrame) -> DataFrame:
    """Adds ``route``: ``parse`` a good response, ``reschedule`` an unreachable URL,
    ``drop`` the rest."""
    good = outcomes.has_good_response(F.col("outcome"), F.col("status_code"))
    return resolved.withColumn("route", F.when(F.col("outcome") == CONNECTION_ERROR, "reschedule")
                               .when(good, "parse").otherwise("drop"))
