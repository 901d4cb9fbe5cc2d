"""The queries of this repository: name -> (Spark query, SQL with the same result)."""

from catalog import crawl_queries, document_queries, frontier_queries, page_queries, seen_queries, url_queries

# Columns whose number type in SQL is wider or narrower than in the query.
_ITEM = {"source": "TINYINT", "depth": "INTEGER"}
_TYPES = {
    "url_resolve": {"pos": "INTEGER"}, "link_extract": {"pos": "INTEGER"}, "page_text": {"n_chars": "INTEGER"},
    "body_decode": {"n_chars": "INTEGER"}, "page_tokens": {"n_tokens": "INTEGER"}, "hash_distance": {"distance": "INTEGER"},
    "frontier_list": _ITEM, "frontier_enqueue": _ITEM, "frontier_bootstrap": _ITEM, "frontier_seed": _ITEM,
    "frontier_remove": _ITEM, "frontier_clear": _ITEM, "reschedule": _ITEM, "fetch_plan": {"rank": "INTEGER"},
    "frontier_next": {**_ITEM, "rank": "INTEGER"}, "frontier_next_many": {**_ITEM, "rank": "INTEGER"}, "multi_site": {**_ITEM, "rank": "INTEGER"},
    "json_roundtrip": {"comments": "INTEGER"},
}


def _typed(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({column} AS {kind}) AS {column}" for column, kind in _TYPES.get(name, {}).items())
    return f"SELECT * REPLACE ({casts}) FROM ({sql}) AS typed" if casts else sql


ALL_QUERIES = {
    name: (query, _typed(name, sql))
    for module in (url_queries, page_queries, seen_queries, frontier_queries, document_queries, crawl_queries)
    for name, (query, sql) in module.QUERIES.items()}
