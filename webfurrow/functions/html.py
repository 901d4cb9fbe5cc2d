"""Page extraction as Column expressions: regular expressions over whole pages."""

from __future__ import annotations

from html.entities import name2codepoint
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.functions.binding import bind

# Inside a tag a quote opens a value only right after '=', so '>' may stand in it.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
# A comment, script or style without its end reaches to the end of the page.
_COMMENT = r"<!--.*?(?:-->|\z)"
_RAW = rf"<(script|style)\b{_INSIDE}>(.*?)(?:</\1\s*>|\z)"
_TAG = rf"<[/!?a-z]{_INSIDE}>"
MARKUP = rf"(?is){_COMMENT}|{_RAW}|{_TAG}"
PIECES = rf"{MARKUP}|[^<]+|<"
_ATTRIBUTE = r"""(?s)[^\s=>"'/<]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
# An attribute as written, with its value in one of three groups.
_UNQUOTE = r"""(?s)^[^\s=]+(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(.*)))?$"""
_KEPT_TAGS = r"(?i)^<(?:a|base|link|meta)[\s/>]"

# Entities common enough for plain replacement; '&amp;' goes last.
COMMON_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0",
    "copy": "©", "middot": "·", "amp": "&",
}
_OTHER_ENTITY = rf"&(?!(?:{'|'.join(COMMON_ENTITIES)});)[#A-Za-z]"


def _character(code: Column) -> Column:
    """Character of a code point, U+FFFD if there is none."""
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def _any_entity(text: Column) -> Column:
    names = {name: chr(code) for name, code in name2codepoint.items()}
    names["apos"] = "'"
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")

    def decode(piece):
        # Leading zeros do not count; a number too long for a code point is none.
        decimal = F.nullif(F.regexp_extract(piece, r"^&#0*(\d+);?$", 1), F.lit(""))
        hexadecimal = F.nullif(F.regexp_extract(piece, r"^&#[xX]0*([0-9A-Fa-f]+);?$", 1), F.lit(""))
        none = F.lit(str(0x110000))
        code = F.coalesce(F.when(F.length(decimal) > 7, none).otherwise(decimal),
                          F.when(F.length(hexadecimal) > 6, none).otherwise(F.conv(hexadecimal, 16, 10)))
        named = F.try_element_at(table, F.regexp_extract(piece, "^&([A-Za-z0-9]+);?$", 1))
        numbered = bind(code.cast("int"), lambda c: F.when(c.isNotNull(), _character(c)))
        return (F.when(~piece.startswith("&"), piece)
                .when(piece.startswith("&#"), F.coalesce(numbered, piece))
                .otherwise(F.coalesce(named, piece)))

    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#?[A-Za-z0-9]+;?|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(pieces, decode), "")


def decode_entities(text: Column) -> Column:
    """Text with character references replaced, in one pass."""
    def body(t):
        common = t
        for name, char in COMMON_ENTITIES.items():
            common = F.replace(common, F.lit(f"&{name};"), F.lit(char))
        return (F.when(F.instr(t, "&") == 0, t)
                .when(t.rlike(_OTHER_ENTITY), _any_entity(t))
                .otherwise(common))

    return bind(text, body)


def _text_by_pieces(html: Column) -> Column:
    def text(piece):
        raw = F.regexp_extract(piece, rf"(?is)^{_RAW}$", 2)
        return (F.when(~piece.startswith("<"), decode_entities(piece))
                .when(piece.rlike(rf"(?is)^{_RAW}$"), raw)
                .when(F.length(piece) == 1, piece)
                .otherwise(""))

    return F.array_join(F.transform(F.regexp_extract_all(html, F.lit(PIECES), F.lit(0)), text), "")


def text_content(html: Column) -> Column:
    """Text nodes of a page joined without separator. Comments and doctype are
    left out, script and style text is included undecoded."""
    stripped = F.regexp_replace(html, MARKUP, "$2")
    # Decoding after stripping is the same unless an entity meets a tag or a
    # script holds '&'; then every piece is decoded on its own.
    mixed = html.rlike(r"(?i)&[#a-z0-9]*+<|<(?:script|style)\b(?:[^<&]++|<(?!/(?:script|style)))*+&")
    return (F.when(F.instr(html, "&") == 0, stripped)
            .when(mixed, _text_by_pieces(html))
            .otherwise(decode_entities(stripped)))


def page_text(html: Column) -> Column:
    """Lower-case text of a page, the input of the fingerprint."""
    return F.lower(text_content(html))


def head_and_link_tags(html: Column) -> Column:
    """The ``a``, ``base``, ``link`` and ``meta`` start tags of a page, in order, as
    ``(tag, attributes)`` with attributes ``(name, value)``. Tags inside comments,
    scripts and styles do not count. Keep the result in a column of its own, so
    that a page is read once for all its tags."""
    def attributes(tag):
        written = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(0))
        return F.transform(
            F.slice(written, F.lit(2), F.greatest(F.size(written) - 1, F.lit(0))),
            lambda a: F.struct(
                F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"),
                decode_entities(F.regexp_replace(a, _UNQUOTE, "$1$2$3")).alias("value")))

    found = F.filter(F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0)), lambda t: t.rlike(_KEPT_TAGS))
    return F.transform(found, lambda t: F.struct(
        F.lower(F.regexp_extract(t, "^<([A-Za-z]+)", 1)).alias("tag"), attributes(t).alias("attributes")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag: '' without value, NULL if absent."""
    found = F.filter(tag["attributes"], lambda a: a["name"] == name)
    return F.get(found, F.lit(0))["value"]


def _has_rel(tag: Column, token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(tag, "rel"), r"\s+"), token), F.lit(False))


def meta_content(tags: Column, name: Column | str) -> Column:
    """``content`` of the first meta tag with this ``name``, else ``property``,
    else ``http-equiv``; the first attribute with a tag decides."""
    name = name if isinstance(name, Column) else F.lit(name)

    def first(attr):
        return F.get(F.filter(tags, lambda t: (t["tag"] == "meta") & (attribute(t, attr) == name)), F.lit(0))

    return attribute(F.coalesce(first("name"), first("property"), first("http-equiv")), "content")


def canonical_href(tags: Column) -> Column:
    """``href`` of the first canonical link, as written; NULL if there is none."""
    hits = F.filter(tags, lambda t: (t["tag"] == "link") & _has_rel(t, "canonical") & attribute(t, "href").isNotNull())
    return attribute(F.get(hits, F.lit(0)), "href")


def base_href(tags: Column) -> Column:
    """``href`` of the first base tag; NULL if there is none."""
    hits = F.filter(tags, lambda t: (t["tag"] == "base") & attribute(t, "href").isNotNull())
    return attribute(F.get(hits, F.lit(0)), "href")


def anchors(tags: Column) -> Column:
    """Array of ``(href, nofollow)`` of all anchors with a target, href stripped."""
    found = F.transform(
        F.filter(tags, lambda t: t["tag"] == "a"),
        lambda t: F.struct(
            F.regexp_replace(attribute(t, "href"), r"^\s+|\s+$", "").alias("href"),
            _has_rel(t, "nofollow").alias("nofollow")))
    return F.filter(found, lambda a: a["href"].isNotNull())
