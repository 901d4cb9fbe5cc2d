"""User hooks: replace or add page fields by Column functions of the page text."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTRACTORS: dict[str, list[tuple[str | None, Callable[[Column], Column]]]] = {}
_changes = count(1)
_version = 0


def register_extractor(name: str, extract: Callable[[Column], Column], spider: str | None = None) -> None:
    """Field ``name`` of the parsed page is ``extract(html)``, for one spider or all.

    ``text`` replaces the text the fingerprint is made of; ``comments``, ``social``
    and ``blocked`` fill the document; any other name is added as a column.
    """
    global _version
    _EXTRACTORS.setdefault(name, []).append((spider, extract))
    _version = next(_changes)


def clear_extractors() -> None:
    global _version
    _EXTRACTORS.clear()
    _version = next(_changes)


def hooks_version() -> int:
    """Changes whenever a hook is added or all are removed."""
    return _version


def extracted(name: str, html: Column, spider: Column, default: Column) -> Column:
    """Value of a field: the hook registered last for this spider, else the default."""
    value = default
    for only, extract in _EXTRACTORS.get(name, []):
        value = extract(html) if only is None else F.when(spider == only, extract(html)).otherwise(value)
    return value


def extra_fields() -> list[str]:
    return [n for n in _EXTRACTORS if n not in ("text", "comments", "social", "blocked")]
