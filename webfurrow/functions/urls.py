"""URL identity as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.functions.binding import bind

# Generic URI syntax, groups scheme, authority, path, query, fragment.
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
# A name before ':' is a scheme unless only digits follow (host:port).
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(?!\d+$)"


def _strings(value: Column | Iterable[str]) -> Column:
    if isinstance(value, Column):
        return value
    items = [F.lit(v) for v in value]
    return F.array(*items) if items else F.array().cast("array<string>")


def domain(url: Column) -> Column:
    """Authority part of a URL, port and user info included; '' if there is none."""
    return F.regexp_extract(url, NETLOC, 1)


def _decode(text: Column) -> Column:
    # A '%' without two hex digits stands for itself.
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))


def _lower_scheme(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, SCHEME, 0)), F.regexp_replace(url, SCHEME, ""))


def _clean_query(query: Column, drop: Column) -> Column:
    def pair(piece, position):
        parts = F.split(piece, "=", 2)
        return F.struct(
            _decode(parts[0]).alias("k"), position.alias("pos"), F.get(parts, F.lit(1)).alias("raw"))

    pairs = F.transform(F.split(query, "[&;]"), pair)
    pairs = F.filter(pairs, lambda p: (F.coalesce(p["raw"], F.lit("")) != "")
                     & ~F.array_contains(drop, p["k"]))
    # Keys sorted; values of one key keep their order.
    encoded = F.transform(F.array_sort(pairs),
                          lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(_decode(p["raw"]))))
    return F.array_join(encoded, "&")


def normalize(url: Column, drop_params: Column | Iterable[str] = ()) -> Column:
    """Fetchable normal form: no fragment, query pairs without value and listed
    parameters dropped, keys sorted and re-encoded, scheme in lower case. A
    trailing slash is kept."""
    drop = _strings(drop_params)
    whole = F.regexp_replace(url, "(?s)#.*$", "")

    def body(u):
        cleaned = bind(_clean_query(F.regexp_replace(u, r"(?s)^[^?]*\?", ""), drop), lambda q: F.when(
            q == "", q).otherwise(F.concat(F.lit("?"), q)))
        return (F.when(F.instr(u, "?") == 0, _lower_scheme(u))
                .otherwise(F.concat(_lower_scheme(F.substring_index(u, "?", 1)), cleaned)))

    return bind(whole, body)


def quote(text: Column) -> Column:
    """Percent-quote all but letters, digits and ``_.-/``."""
    out = F.url_encode(text)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%2F", "/")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def canonize(url: Column) -> Column:
    """Identity key of a URL: no trailing slashes, no http(s) prefix, quoted.
    A URL with non-ASCII characters stays unquoted. Not fetchable."""
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), "^https?://", "")
    return bind(bare, lambda u: F.when(u.rlike(r"[^\x00-\x7F]"), u).otherwise(quote(u)))


def split_uri(url: Column) -> Column:
    """Struct of scheme (lower case), netloc, path, query and fragment."""
    part = [F.regexp_extract(url, URI, i) for i in range(1, 6)]
    return F.struct(
        F.lower(part[0]).alias("scheme"), part[1].alias("netloc"), part[2].alias("path"),
        part[3].alias("query"), part[4].alias("fragment"))


def _join_uri(scheme, netloc, path, query, fragment) -> Column:
    def if_set(value, *pieces):
        return F.when(value != "", F.concat(*pieces)).otherwise("")

    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(
        if_set(scheme, scheme, F.lit(":")), if_set(netloc, F.lit("//"), netloc), rooted,
        if_set(query, F.lit("?"), query), if_set(fragment, F.lit("#"), fragment))


def _but_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.size(items) - 1)


def _last(items: Column) -> Column:
    return F.element_at(items, -1)


def _merge_path(base_path: Column, path: Column) -> Column:
    """Relative path against the folder of ``base_path``, dot segments applied.
    A '..' with nothing to climb out of is kept."""
    segments = F.concat(_but_last(F.split(base_path, "/")), F.split(path, "/"))

    def step(stack, segment):
        climbs = (segment == "..") & (F.size(stack) > 0) & ~F.coalesce(
            F.try_element_at(stack, F.lit(-1)), F.lit("")).isin("", "..")
        return (F.when(segment == ".", stack)
                .when(climbs, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
                .otherwise(F.concat(stack, F.array(segment))))

    def joined(parts):
        folders, final = parts["folders"], parts["final"]
        depth = F.size(folders)
        parent = F.array_join(F.slice(folders, F.lit(1), F.greatest(depth - 1, F.lit(0))), "/")
        return (F.when((final == "..") & (depth == 1) & (folders[0] == ""), F.lit("/"))
                .when((final == "..") & (depth == 1), F.lit(""))
                .when((final == "..") & (depth > 1), F.concat(parent, F.lit("/")))
                .otherwise(F.array_join(F.concat(
                    folders, F.array(F.when(final == ".", F.lit("")).otherwise(final))), "/")))

    parts = bind(segments, lambda s: F.struct(
        F.aggregate(_but_last(s), F.array().cast("array<string>"), step).alias("folders"),
        _last(s).alias("final")))
    return bind(parts, joined)


def resolve_against(base: Column, base_parts: Column, href: Column) -> Column:
    """As :func:`resolve`, with the base already split by :func:`split_uri`, so
    that many links of one page share that work."""
    scheme, netloc, base_path = base_parts["scheme"], base_parts["netloc"], base_parts["path"]

    def body(ref):
        path, query, fragment = ref["path"], ref["query"], ref["fragment"]
        same_site = ref["netloc"] == ""
        final_path = (F.when(~same_site | path.startswith("/"), path)
                      .when(path == "", base_path)
                      .otherwise(_merge_path(base_path, path)))
        final_query = F.when(same_site & (path == "") & (query == ""), base_parts["query"]).otherwise(query)
        target = F.struct(
            F.when(same_site, netloc).otherwise(ref["netloc"]).alias("netloc"),
            final_path.alias("path"), final_query.alias("query"))
        return (F.when((ref["scheme"] != "") & (ref["scheme"] != scheme), href)
                .otherwise(bind(target, lambda t: _join_uri(
                    scheme, t["netloc"], t["path"], t["query"], fragment))))

    return (F.when(href == "", base).when(base == "", href)
            .otherwise(bind(split_uri(href), body)))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` found on the page ``base``."""
    return bind(split_uri(base), lambda parts: resolve_against(base, parts, href))


def is_excluded(url: Column, exclude_re: Column) -> Column:
    """The joined exclude pattern matches at the start of the URL."""
    return F.coalesce(F.regexp_like(url, exclude_re), F.lit(False))


def anchored(patterns: Iterable[str]) -> Column:
    """One start-anchored pattern from a fixed list; NULL for an empty list."""
    patterns = list(patterns)
    if not patterns:
        return F.lit(None).cast("string")
    return F.lit("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def is_allowed(url_domain: Column, allowed_domains: Column | Iterable[str]) -> Column:
    """Exact authority match; an empty list allows every domain."""
    allowed = _strings(allowed_domains)
    return (F.size(allowed) == 0) | F.array_contains(allowed, url_domain)


def check(url: Column, allowed_domains, exclude_re: Column, drop_params) -> Column:
    """Struct ``(nurl, to_remove, reason)`` of the admission check."""
    def body(normal):
        reason = (F.when(is_excluded(url, exclude_re), F.lit("excluded"))
                  .when(~is_allowed(domain(url), allowed_domains), F.lit("domain"))
                  .when(normal != url, F.lit("normalized"))
                  .otherwise(F.lit("ok")))
        return bind(reason, lambda r: F.struct(
            F.when(r == "normalized", normal).otherwise(url).alias("nurl"),
            (r != "ok").alias("to_remove"), r.alias("reason")))

    return bind(normalize(url, drop_params), body)


def is_admitted(checked: Column, url: Column) -> Column:
    """A checked URL goes on unless it was refused without a changed form."""
    return ~(checked["to_remove"] & (checked["nurl"] == url))
