"""Benchmark decontamination: a prefix-filtered join of documents with windows of benchmark items.

Built-in functions only. A window is contained in a document only if all its words are, so one
word is a necessary prefix: the window's rarest one. It is looked up in every document; the place
where it is found fixes the place of the whole window (positional bound), which must lie inside
the document (length bound) and is compared word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.llm.common import lower_ascii, stage, without

WORDS_PER_WINDOW = 10
#: What lies between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A lookup is broadcast in blocks of so many bytes at most.
BLOCK_BYTES = 24 << 20
OUTPUT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def windows_of(items: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """``item_id, words``: each run of ``size`` words of an item, or all words of a shorter one."""
    split = items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), words_of(F.col(f"`{text}`")).alias("all"))
    last = F.greatest(F.size("all") - size, F.lit(0))
    return (split.filter(F.size("all") > 0)
            .select("item_id", "all", F.explode(F.sequence(F.lit(0), last)).alias("at"))
            .select("item_id", F.slice("all", F.col("at") + 1, F.lit(size)).alias("words")))


def blocks_of(table: DataFrame, key: str, block_bytes: int) -> list[DataFrame]:
    """The staged ``table`` in parts whose measured size is below ``block_bytes`` on average."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    if n == 1:
        return [F.broadcast(table)]
    return [F.broadcast(table.filter(F.pmod(F.xxhash64(F.lit("block"), key), F.lit(n)) == i)) for i in range(n)]


def find_windows(rows: DataFrame, windows: DataFrame, block_bytes: int) -> DataFrame:
    """Places of ``windows`` (``wid``, ``words``) in ``rows`` (``doc``, ``words``): ``doc, wid, start, stop``."""
    vocabulary = stage(windows.select(F.explode("words").alias("word")).distinct(), "vocabulary")
    spread = rows.select(F.explode("words").alias("word"))
    counted = reduce(DataFrame.unionByName, [
        spread.join(block, ["word"]).groupBy("word").agg(F.count("*").alias("n"))
        for block in blocks_of(vocabulary, "word", block_bytes)])
    # A word that no document has rules its windows out: the inner join drops the pair, the count shows it.
    ranked = (windows.select("wid", "words", F.posexplode("words").alias("offset", "word")).join(counted, ["word"])
              .groupBy("wid", "words").agg(F.min(F.struct("n", "word", "offset")).alias("rarest"), F.count("*").alias("known"))
              .filter(F.col("known") == F.size("words"))
              .select("wid", F.col("words").alias("window"), "rarest.word", "rarest.offset"))
    prefixes = stage(ranked, "prefixes")
    placed = rows.select("doc", "words", F.posexplode("words").alias("at", "word"))
    start = F.col("at") - F.col("offset")
    inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
    equal = F.slice("words", F.when(inside, start + 1).otherwise(1), F.size("window")) == F.col("window")
    return reduce(DataFrame.unionByName, [
        placed.join(block, ["word"]).filter(inside & equal)
        .select("doc", "wid", start.alias("start"), (start + F.size("window")).alias("stop"))
        for block in blocks_of(prefixes, "wid", block_bytes)])


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WORDS_PER_WINDOW, doc_id: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` to every row of ``docs``.

    A word is hit if it stands inside some occurrence of a window of some item; ``n_items`` counts the
    items with an occurring window, and the digest is of their ids, sorted as strings. Null texts
    have no words; a document without hits has the digest of no ids. Rows that repeat an id are
    judged by their own text. An item without words has no window; items without id hit, but are
    not listed. Existing columns of the added names are replaced.

    Documents are not shuffled: only places of verified windows are. The windows are looked up in
    blocks of bounded size, each broadcast; a larger benchmark has more blocks.
    """
    kept = without(docs, OUTPUT)
    content = F.col(f"`{text}`").cast("string")
    doc = F.struct(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.coalesce(content, F.lit(""))).alias("text"))
    rows = docs.select(doc.alias("doc"), words_of(F.col(f"`{text}`")).alias("words"))
    named = stage(windows_of(items, size, item_id, item_text)
                  .withColumn("wid", F.md5(F.array_join("words", " "))).distinct(), "windows")
    windows = named.select("wid", "words").distinct()
    hits = stage(find_windows(rows, windows, block_bytes).distinct(), "hits")
    # Words covered: each place adds what lies beyond all places that start before it.
    earlier = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("stop").over(earlier), F.lit(0))
    covered = (hits.select("doc", "start", "stop").distinct()
               .select("doc", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", reach)).alias("new"))
               .groupBy("doc").agg(F.sum("new").alias("n_hit")))
    listed = (hits.select("doc", "wid").distinct().join(named.select("wid", "item_id"), ["wid"])
              .groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("ids")))
    found = stage(covered.join(listed, ["doc"]).select(
        F.col("doc.id").alias("_id"), F.col("doc.text").alias("_text"), "n_hit", F.size("ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "found")
    own = kept.withColumns({"n_words": F.size(words_of(F.col(f"`{text}`"))).cast("bigint"),
                            "_hash": F.xxhash64(F.coalesce(content, F.lit("")))})
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    joined = own.join(found, same, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept.columns], "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
