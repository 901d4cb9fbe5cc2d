"""Similarity fingerprint of a text and its distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfurrow.functions.binding import bind

# Fixed value: pages nearer than this many bits count as unchanged.
SIMILARITY_THRESHOLD = 3


def tokens(text: Column) -> Column:
    """Runs of ``[A-Za-z0-9_]``; empty tokens at the edges are kept."""
    return F.split(text, r"[^\w]+")


def token_hash(token: Column) -> Column:
    """First 64 bits of the md5 of a token, as a signed number."""
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


# Hashes counted at a time: eight byte-wide counters share a signed number, so the
# top one may reach 127.
_BLOCK = 127


def _block_counts(block: Column) -> Column:
    """Eight numbers; byte ``j`` of number ``k`` counts bit ``k + 8 j`` of the hashes."""
    low_bits = F.lit(0x0101010101010101)
    return F.aggregate(
        block, F.array_repeat(F.lit(0).cast("bigint"), 8),
        lambda acc, h: F.transform(acc, lambda c, k: c + _shift_right(h, k).bitwiseAND(low_bits)))


def simhash_of(hashes: Column) -> Column:
    """Fingerprint of an array of token hashes: bits set in more than half of them.

    Counters of 32 bits, two to a number, hold the totals, which is more than an
    array can have elements; number ``i`` counts bits ``i`` and ``i + 32``.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    half = F.lit(0xFFFFFFFF)

    def add(totals, block):
        return bind(_block_counts(block), lambda counts: F.transform(
            totals, lambda t, i: t + _shift_right(F.get(counts, i % 8), i - i % 8).bitwiseAND(F.lit(0x000000FF000000FF))))

    def vote(hs):
        n = F.size(hs)
        starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(_BLOCK))
        totals = F.aggregate(
            F.transform(starts, lambda s: F.slice(hs, s, F.lit(_BLOCK))), F.array_repeat(zero, 32), add)

        def bits(total, i):
            low = F.when(total.bitwiseAND(half) * 2 > n, F.call_function("shiftleft", one, i)).otherwise(zero)
            high = F.when(_shift_right(total, F.lit(32)) * 2 > n, F.call_function("shiftleft", one, i + 32)).otherwise(zero)
            return low.bitwiseOR(high)

        return F.aggregate(F.transform(totals, bits), zero, lambda a, b: a.bitwiseOR(b))

    return bind(hashes, vote)


def simhash(text: Column) -> Column:
    """64-bit similarity hash of a whole text: per-bit majority vote over the token
    hashes, repeated tokens counting each time. One row in, one value out."""
    return simhash_of(F.transform(tokens(text), token_hash))


def distance(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def is_changed(new_hash: Column, stored_hash: Column) -> Column:
    """A page is changed if it was not stored or differs in enough bits."""
    return F.coalesce(distance(new_hash, stored_hash) >= SIMILARITY_THRESHOLD, F.lit(True))
