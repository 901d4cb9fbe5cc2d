"""Outcome of a fetch attempt and the waits between attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.schemas import CONNECTION_ERROR, GENERIC_ERROR, SKIP_URL, SUCCESS

# Errors after which a URL is skipped, attempts made, seconds waited.
SKIP_ERRORS = ["TooManyRedirects", "HTTPError", "Timeout", "InvalidSchema"]
RETRY_ERROR = "ConnectionError"
MAX_ATTEMPTS = 5
WAIT_ON_FAIL = 600


def outcome(error: Column) -> Column:
    """Outcome code of one attempt; a NULL error is a success."""
    return (F.when(error.isNull(), F.lit(SUCCESS))
            .when(error.isin(SKIP_ERRORS), F.lit(SKIP_URL))
            .when(error == RETRY_ERROR, F.lit(CONNECTION_ERROR))
            .otherwise(F.lit(GENERIC_ERROR)))


def wait_after(attempt: Column, wait_on_fail: int = WAIT_ON_FAIL) -> Column:
    """Seconds waited after a failed attempt; attempts count from 1."""
    return (attempt - 1) * F.lit(wait_on_fail)


def waited_before(attempt: Column, wait_on_fail: int = WAIT_ON_FAIL) -> Column:
    """Seconds waited in total before an attempt: the sum of the waits so far,
    in closed form, so no window over the attempts is needed."""
    failures = attempt.cast("bigint") - 1
    return F.shiftright(failures * (failures - 1), 1) * F.lit(wait_on_fail)


def has_good_response(code: Column, status: Column) -> Column:
    """A response is processed only with a status below 400."""
    return (code == SUCCESS) & (F.coalesce(status, F.lit(0)) < 400)
