"""Body bytes to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two noncharacters around NUL: holds a real U+FFFD while bad bytes are dropped.
_HELD = "﷐\u0000﷑"
_REPLACEMENT = "�"

# Codecs for host names, which change a text.
_HOST_NAMES = ["idna", "punycode"]

_UTF8 = ["utf-8", "utf8", "utf_8", "us-ascii", "ascii"]
_LATIN1 = ["iso-8859-1", "iso8859-1", "latin-1", "latin1", "iso_8859-1"]

# Charsets of one byte per character, with the names they go by.
ONE_BYTE = {
    **{f"cp125{n}": [f"windows-125{n}", f"cp125{n}", f"cp-125{n}"] for n in range(9)},
    **{f"iso8859-{n}": [f"iso-8859-{n}", f"iso8859-{n}", f"iso_8859-{n}"] for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 13, 14, 15, 16)},
    "koi8-r": ["koi8-r"], "koi8-u": ["koi8-u"],
}


def _upper_half(name: str) -> tuple[str, str]:
    """Latin-1 characters that differ in the charset, and what to put for them; those
    without a meaning come last and vanish."""
    pairs = [(chr(b), bytes([b]).decode(name, "ignore")) for b in range(128, 256)]
    differ = sorted(((a, b) for a, b in pairs if a != b), key=lambda p: not p[1])
    return "".join(a for a, _ in differ), "".join(b for _, b in differ)


def utf8_text(content: Column) -> Column:
    """UTF-8 text of a body; undecodable bytes are dropped."""
    raw = content.cast("string")
    held = F.replace(raw, F.lit(_REPLACEMENT), F.lit(_HELD))
    cleaned = F.replace(F.make_valid_utf8(held), F.lit(_REPLACEMENT), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(cleaned, F.lit(_HELD), F.lit(_REPLACEMENT)))


def _charset(encoding: Column, default: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.when(encoding != "", encoding), default)))


def body_text(body, charset: str) -> str | None:
    """Text of a body in a charset of any name, bad bytes dropped; names that are no charset count as UTF-8."""
    import codecs

    if body is None:
        return None
    try:
        codec = codecs.lookup(charset)
        if codec._is_text_encoding and codec.name not in _HOST_NAMES:
            text = codec.decode(bytes(body), "ignore")[0]
            return text.encode("utf-8", "ignore").decode("utf-8")  # a lone surrogate is dropped too
    except (LookupError, ValueError):  # unknown, a name with NUL, or a codec that cannot drop what is bad
        pass
    return bytes(body).decode("utf-8", "ignore")


def decode_bodies(df: DataFrame, default_encoding: Column | str = "utf-8", content: str = "content",
                  encoding: str = "encoding", out: str = "raw_html") -> DataFrame:
    """Adds ``out``: the body in its declared encoding, else the default one.

    UTF-8, Latin-1 and the other one-byte charsets are decoded by built-in functions, the
    latter as Latin-1 whose upper half is replaced. Only bodies in another charset reach the
    Arrow function; for all other rows it is handed NULL. A body without any charset, or with
    one that is unknown or no text encoding, is read as UTF-8. No row is lost, and the input is read once.
    """
    default = F.lit(default_encoding) if isinstance(default_encoding, str) else default_encoding
    charset = F.coalesce(_charset(F.col(encoding), default), F.lit("utf-8"))
    body = F.col(content)
    latin = F.decode(body, "ISO-8859-1")
    text = F.when(charset.isin(_UTF8), utf8_text(body)).when(charset.isin(_LATIN1), latin)
    for name, aliases in ONE_BYTE.items():
        text = text.when(charset.isin(aliases), F.translate(latin, *_upper_half(name)))
    common = _UTF8 + _LATIN1 + [a for aliases in ONE_BYTE.values() for a in aliases]

    @F.pandas_udf("string")
    def to_text(bodies, charsets):
        import pandas as pd

        return pd.Series([body_text(b, c) for b, c in zip(bodies, charsets)], dtype=object)

    rare = F.when(~charset.isin(common), body)
    return df.withColumn(out, text.otherwise(to_text(rare, charset)))
