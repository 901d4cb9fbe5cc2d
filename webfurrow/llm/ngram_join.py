"""Near-duplicate documents by the Jaccard similarity of word shingles: a parity-sketch join.

A document's shingles are dealt by hash to the blocks of a sketch. A block holds the XOR of the
hashes of its shingles: the parities of 64 bit planes. A shingle that only one of two documents has
changes one block, so the number of blocks that differ is at most the symmetric difference. Two
documents as similar as asked differ by at most ``D`` shingles, so all but ``D`` of the blocks that
are filled in either agree (pigeonhole), and the first ``D + 1`` filled blocks of each, in an order
common to all, have one in common. Only these are joined. Documents meet within a size band;
candidates are then cut by a dense parity sketch, whose Hamming distance is at most the symmetric
difference too, and verified on the exact sets.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.llm.common import LOWER_TABLE, Memo, connected, small_batches, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE = 5
#: Two documents link if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Blocks of a band per difference that its largest pair may have.
SPREAD = 1.25
#: Attempts with another deal and twice the blocks for sets that fill too few blocks; the last has a block for each shingle.
DEALS = 4
#: 64-bit words of the shortest dense sketch.
DENSE = 8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's shingles."""

    def __init__(self, size: int = SHINGLE):
        import xxhash

        self.size = size
        self.memo = Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint64)
        words = WORD.findall(text.lower() if text.isascii() else text.translate(LOWER_TABLE))
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):  # a polynomial over the words' hashes
            out += h[i:len(h) - k + 1 + i] * np.uint64(pow(0x9E3779B97F4A7C15, i + 1, 1 << 64))
        return np.unique(mix(out))


def most_apart(n: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of a set of ``n`` and one that links with it."""
    # union <= n * 100 / percent, and at least `percent` of the union is shared.
    return n * 100 // percent - n


def band_of(n: int) -> int:
    """Bands double: band b holds sizes from 2**b up to 2**(b + 1) - 1."""
    return n.bit_length() - 1


def keys_of(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Join keys of a set: the first ``D + 1`` filled blocks, in its band and in the next if a partner may be there."""
    n, out = len(hashes), []
    apart = most_apart(n, percent)
    band = band_of(n)
    for b in (band, band + 1) if n * 100 >= percent << (band + 1) else (band,):
        largest = most_apart((2 << b) - 1, percent)
        for deal in range(DEALS + 1):
            last = deal == DEALS
            blocks = (int(SPREAD * largest) + 2) << deal
            if largest == 0:
                blocks = 1
            scattered = mix(hashes, 100 + deal)
            if last:
                filled = scattered  # a block for each shingle
            else:
                block = scattered % np.uint64(blocks)
                order = np.argsort(block, kind="stable")
                block = block[order]
                first = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
                parity = np.bitwise_xor.reduceat(hashes[order], first)
                filled = parity ^ mix(block[first], 300)
            keys = np.sort(mix(filled ^ np.uint64(b * 16 + deal), 400))
            # A pair that only empty blocks would have shown is looked for in the next deal, by both.
            out.append(keys[:apart + 1])
            if last or len(keys) > apart:
                break
    return np.unique(np.concatenate(out))


def dense_words(n: int) -> int:
    """64-bit words of the dense sketch of a set of ``n``: about two bits for each shingle, and a power of two,
    so that a longer sketch folds onto a shorter one."""
    return max(DENSE, (1 << band_of(n)) // 32)


def dense_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of ``64 * dense_words(n)`` bits, each shingle flipping one. The low bits of a bit's place
    tell the place within a word's column, so folding halves keeps parities right."""
    bits = 64 * dense_words(len(hashes))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def describe(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, digest, n, same, sketch, short, keys``: size and hash of the set, dense sketch, the same folded to
    ``DENSE`` words, and join keys. A set that its task has had before brings no sketch and no keys again;
    a row without id brings none at all, and none are held back for it."""
    small_batches(docs.sparkSession)

    def run(batches):
        shingle, seen = Shingler(), set()
        for rows in batches:
            out = []
            for doc, named, digest, text in zip(rows.doc_id, rows.named, rows.digest, rows.text, strict=True):
                h = shingle(text)
                same = set_hash(h)
                if not len(h) or not named or (len(h), same) in seen:
                    out.append((doc, named, digest, len(h), same, None, None, None))
                    continue
                seen.add((len(h), same))
                sketch = dense_sketch(h)
                out.append((doc, named, digest, len(h), same, sketch, folded(sketch, DENSE), _signed(keys_of(h, percent))))
            yield pd.DataFrame(out, columns=["doc_id", "named", "digest", "n", "same", "sketch", "short", "keys"])

    # Pandas would make ids of a batch with a null among them floats, so null goes beside the id.
    given = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"),
                        F.md5("text").alias("digest"), "text")
    made = given.mapInPandas(run, "doc_id long, named boolean, digest string, n long, same long, sketch array<long>, short array<long>, keys array<long>")
    return made.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def set_hash(h: np.ndarray) -> int:
    return int(_signed(np.bitwise_xor.reduce(mix(h, 600), keepdims=True))[0]) if len(h) else 0


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n, same, hashes``: the shingle set of each document, with its size and hash."""
    small_batches(docs.sparkSession)

    def run(batches):
        shingle = Shingler()
        for rows in batches:
            sets = [shingle(t) for t in rows.text]
            yield pd.DataFrame({"doc_id": rows.doc_id, "n": list(map(len, sets)), "same": list(map(set_hash, sets)),
                                "hashes": list(map(_signed, sets))})

    return docs.mapInPandas(run, "doc_id long, n long, same long, hashes array<long>")


def _sizes_allow(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _distance_allows(distance: Column, n: Column, m: Column, percent: int) -> Column:
    """|A xor B| <= (100 - percent) / (100 + percent) * (|A| + |B|) for a link."""
    return distance * (100 + percent) <= (n + m) * (100 - percent)


def _near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and folded sketches allow a link of two described documents; generated code throughout."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    distance = sum((F.bit_count(F.col(f"{a}.short")[i].bitwiseXOR(F.col(f"{b}.short")[i])) for i in range(DENSE)), F.lit(0))
    return _sizes_allow(n, m, percent) & _distance_allows(distance, n, m, percent)


def possible(pairs: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of sets (``a``, ``b``) that pass the size bound and the bound of the whole sketches."""
    left = leads.select(F.col("id").alias("a"), F.struct("n", "sketch").alias("x"))
    right = leads.select(F.col("id").alias("b"), F.struct("n", "sketch").alias("y"))

    def halved(sketch: Column, other: Column) -> Column:
        half = (F.size(sketch) / 2).cast("int")  # sizes that allow a link differ by one band at most
        return F.when(F.size(sketch) > F.size(other), F.zip_with(
            F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(sketch)

    x, y = F.col("x.sketch"), F.col("y.sketch")
    distance = F.aggregate(F.zip_with(halved(x, y), halved(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))),
                           F.lit(0), lambda total, n: total + n)
    sized = pairs.join(left, ["a"]).join(right, ["b"]).filter(_sizes_allow(F.col("x.n"), F.col("y.n"), percent))
    return sized.filter(_distance_allows(distance, F.col("x.n"), F.col("y.n"), percent)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, alone: DataFrame, percent: int) -> DataFrame:
    """The pairs whose exact sets link. Only the sets of documents in a pair are shuffled, one document for a set."""
    pairs = stage(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    wanted = stage(alone.join(ids, ["id"], "left_semi").select("id", "n", "same", F.col("lead").alias("doc_id")), "wanted")
    found = sets_of(docs.join(wanted.select("doc_id").distinct(), ["doc_id"], "left_semi"))
    # Rows may share an id, even with the text: a set is known by its size and hash.
    sets = stage(found.join(wanted, ["doc_id", "n", "same"]).dropDuplicates(["id"]).select("id", "hashes"), "sets")
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def link(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            shared = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * shared >= percent * (len(a) + len(b) - shared))
        return pd.Series(out, dtype=bool)

    return (pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("_x")), ["a"])
            .join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("_y")), ["b"])
            .filter(link("_x", "_y")).select("a", "b"))


def group_near_duplicates(docs: DataFrame, percent: int = PERCENT, column: str = "text",
                          doc_id: str = "doc_id", digests: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and, with ``digests``, ``text_md5`` and ``group``: one row per row of ``docs``.

    Documents link if ``100 * |A and B| >= percent * |A or B|`` for their sets of five-word shingles;
    with fewer words the whole sequence is the only shingle. A document without words, or with null
    text, is empty and linked with nothing. ``component_id`` is the smallest id reachable by links.
    Rows that share an id are documents of their own, linked by their texts only: their components may then
    have one id, and ``group`` (null without words or id) tells them apart. Rows without id are left out of groups and
    keep a null component. No pair is dropped: in a key that many documents hold, all
    pairs that are not together yet are held against the bounds.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("string").alias("text"))
    described = stage(describe(rows, percent).withColumn("row", F.monotonically_increasing_id()), "described")
    filled = described.filter("n > 0 and doc_id is not null")
    # Equal sets get one number; the document with the least id of each is looked at for all.
    alone = stage(filled.groupBy("n", "same").agg(F.min("doc_id").alias("lead")).withColumn("id", F.monotonically_increasing_id()), "alone")
    sketched = filled.filter("sketch is not null")
    leads = stage(sketched.select("n", "same", "sketch", "short").join(alone.drop("lead"), ["n", "same"])
                  .select("id", "n", "sketch", "short").dropDuplicates(["id"]), "leads")
    # Keys held by one row only are dropped at once.
    raw = rows.filter("doc_id is not null")
    of_key = Window.partitionBy("key")
    held = (sketched.select(F.explode("keys").alias("key"), "row").withColumn("held", F.count("*").over(of_key))
            .filter("held > 1").select("key", "row"))
    numbers = sketched.select("row", "n", "same").join(alone, ["n", "same"]).select("row", "id")
    several = held.join(numbers, ["row"]).select("key", "id").distinct()
    shared = stage(several.withColumn("least", F.min("id").over(of_key)), "shared")
    # First each member against the least of its key: groups of near copies come together in linear work.
    star = shared.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    links = stage(verified(possible(star, leads, percent), raw, alone, percent), "links")
    placed = stage(connected(leads.select("id"), links), "placed")
    # Then, in keys whose members are not all together yet, every member outside the largest
    # component of the key against the others. Members of one component need no further look.
    more = stage(verified(
        possible(cross_pairs(shared.select("key", "id"), placed, leads, percent), leads, percent), raw, alone, percent), "more")
    joined = connected(leads.select("id"), links.unionByName(more))
    of_set = alone.join(joined, ["id"])
    least = of_set.groupBy("component").agg(F.min("lead").alias("component_id"))
    found = (described.select("doc_id", "digest", "n", "same")
             .join(of_set.join(least, ["component"]).select("n", "same", "component", "component_id"), ["n", "same"], "left"))
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
                        *([F.col("digest").alias("text_md5"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("group")]
                          if digests else []))


def cross_pairs(shared: DataFrame, placed: DataFrame, leads: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (``a < b``) of one key in different components that pass the size and sketch bounds.

    Each member outside the key's largest component meets every member of another component; what
    the bounds rule out is never a row, and members that are together already never meet.
    """
    located = (shared.join(placed, ["id"])
               .join(leads.select("id", F.struct("n", "short").alias("d")), ["id"]))
    largest = (located.groupBy("key", "component").agg(F.count("*").alias("n"))
               .groupBy("key").agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.count("*").alias("parts"))
               .filter("parts > 1").drop("parts"))
    open_keys = stage(located.join(largest, ["key"]).withColumn("out", F.col("component") != F.col("main")), "located")
    x = open_keys.filter("out").select("key", F.col("id").alias("p"), F.col("component").alias("pc"), F.col("d").alias("x"))
    y = open_keys.select("key", F.col("id").alias("q"), F.col("component").alias("qc"), "out", F.col("d").alias("y"))
    meet = x.join(y, (x.key == y.key) & (F.col("pc") != F.col("qc")) & (~F.col("out") | (F.col("p") < F.col("q")))
                  & _near("x", "y", percent))
    return meet.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
