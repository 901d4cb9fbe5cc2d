"""Readers and writers of the crawl tables."""
