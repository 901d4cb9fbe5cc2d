"""Refetch timing as Column expressions, and the registry of policies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.functions.binding import bind
from webfurrow.schemas import PRIORITY

# First refetch of fresh news, and the delay below which a changed
# page is not fetched more often.
TWO_HOURS = 7200
HOUR = 3600


@dataclass(frozen=True)
class Visit:
    """Columns a policy may use. ``delay`` is the delay the URL was fetched with."""

    source: Column
    delay: Column
    status: Column
    is_new: Column
    is_changed: Column
    restart_delay: Column
    refetching_delay: Column

    @property
    def is_priority(self) -> Column:
        return self.source == PRIORITY

    @property
    def priority_delay(self) -> Column:
        """Start delay; without one the ordinary delay."""
        unset = F.coalesce(self.restart_delay, F.lit(0)) == 0
        return F.when(unset, self.refetching_delay).otherwise(self.restart_delay)

    @property
    def is_first(self) -> Column:
        return self.is_new | (F.coalesce(self.delay, F.lit(0)) == 0)

    @property
    def is_quiet(self) -> Column:
        """Unchanged, or answered with another status than 200."""
        return ~self.is_changed | F.coalesce(self.status != 200, F.lit(False))


def base_policy(v: Visit) -> Column:
    """Double the delay of a quiet page, halve that of a changed one."""
    halved = F.when(v.delay > HOUR, F.shiftright(v.delay, 1)).otherwise(v.delay)
    return (F.when(v.is_priority, v.priority_delay)
            .when(v.is_first, v.refetching_delay)
            .when(v.is_quiet, v.delay * 2)
            .otherwise(halved))


def news_policy(v: Visit) -> Column:
    """Steps of two hours, d, 2d and 4d; NULL after 4d, which ends refetching.

    Steps may be equal numbers; then the larger step decides, so the conditions
    run from the last step back.
    """
    d = v.refetching_delay
    later = (F.when(v.delay == d * 2, d * 4)
             .when(v.delay == d, d * 2)
             .when(v.delay == TWO_HOURS, d)
             .when(v.delay == d * 4, F.lit(None).cast("bigint"))
             .otherwise(d))
    sooner = (F.when(v.delay == d * 4, d * 2)
              .when((v.delay == d * 2) | (v.delay == d), d)
              .otherwise(d * 2))
    return (F.when(v.is_priority, v.priority_delay)
            .when(v.is_first, F.lit(TWO_HOURS).cast("bigint"))
            .when(v.is_quiet, later)
            .otherwise(sooner))


_POLICIES: dict[str, Callable[[Visit], Column]] = {}


def register_policy(name: str, policy: Callable[[Visit], Column]) -> None:
    """Make a policy known by the name used in ``refetching_strategy``."""
    _POLICIES[name] = policy


register_policy("base", base_policy)
register_policy("news", news_policy)


def next_delay(strategy: Column, visit: Visit) -> Column:
    """Delay chosen by the named policy; no name means base, an unknown one fails.
    A delay must be positive, or NULL to leave the refetch list."""
    name = F.coalesce(F.when(strategy != "", strategy), F.lit("base"))
    chosen = None
    for key, policy in _POLICIES.items():
        value = policy(visit).cast("bigint")
        chosen = F.when(name == key, value) if chosen is None else chosen.when(name == key, value)
    chosen = chosen.otherwise(F.raise_error(F.concat(F.lit("unknown refetching strategy "), name)).cast("bigint"))
    refused = F.raise_error(F.lit("refetch delay must be positive")).cast("bigint")
    return bind(chosen, lambda delay: F.when(delay <= 0, refused).otherwise(delay))
