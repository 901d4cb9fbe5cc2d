"""Crawl-data processing on Spark: URL identity, page extraction, change
detection, seen table, frontier, refetch timing and document history, all as
DataFrame operations over tables that carry a ``spider`` column."""

__version__ = "0.1.0"
