"""Ranked lexical search over K2-treaps: quadtrees of the term-document grid that hold the largest impact of each cell.

Documents are indexed in ranges. The grid of a range has a row for each term and a column for each
document; a cell that is not empty is cut into four, down to single places, and every node keeps the
largest impact below it. A query walks the paths of its rows down together: a stretch of columns is
bounded by its nodes' maxima, and the stretches with the highest bounds are halved first, until none
left can reach the best documents found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.llm.common import BATCH_ROWS, LOWER_TABLE, arrow_rows, lower_ascii, stage

#: Documents and characters of one range, at most, but for a longer document.
RANGE_DOCS, RANGE_CHARS = 4096, 8_000_000
#: Queries that meet a range in one row, about.
BLOCK_ITEMS = 512
#: Numbers worked on at a time, and those kept for stretches still open before the deepest go first.
STEP_NUMBERS, OPEN_NUMBERS = 16_384, 16_000_000

# What counts as a term, and the scale of weights and impacts.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
JVM_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IMPACT, SLOPE, BASE, TILT = 1_000_000_000, 1000, 20, 50

# Numbers are squeezed; terms stand in lines, with a blank between two, and their sizes in lists alike.
POSTINGS = ("ids binary, lengths binary, n_docs long, n_terms long, terms array<string>, sizes array<array<int>>, "
            "columns binary, counts binary")
INDEX = "ids binary, terms array<string>, sizes array<array<int>>, height int, masks binary, drops binary, top long"
#: Terms of one line: what an explode holds at once.
LINE_TERMS = 4096
#: A row group ends with the range that fills it, so that tasks write and read ranges one by one, however many
#: they have. Spark's writer else looks at its memory after 100 rows, and its reader takes 4,096 rows at once.
GROUPS = {"parquet.block.size": 1 << 20, "parquet.page.size.row.check.min": 1}


def squeeze(numbers: np.ndarray) -> bytes:
    """An array's bytes, compressed, after how many they are: Spark copies a row several times on its way."""
    return numbers.nbytes.to_bytes(8, "little") + pa.compress(pa.py_buffer(np.ascontiguousarray(numbers)), codec="zstd", asbytes=True)


def unsqueeze(squeezed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(pa.py_buffer(squeezed)[8:], int.from_bytes(squeezed[:8], "little"), codec="zstd"), dtype=kind)


class RangeWriter:
    """Collects the documents of one range: their terms by number, and how often each occurs."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def full(self, text: str) -> bool:
        return bool(self.ids) and (len(self.ids) >= RANGE_DOCS or self.chars + len(text) > RANGE_CHARS)

    def add(self, doc: int, terms: list[str], chars: int) -> None:
        number = self.number.setdefault
        places = np.fromiter((number(t, len(self.number)) for t in terms), dtype=np.int32, count=len(terms))
        rows, counts = np.unique(places, return_counts=True)
        self.ids.append(doc)
        self.lengths.append(len(terms))
        self.rows.append(rows)
        self.counts.append(counts.astype(np.int32))
        self.chars += chars

    def postings(self) -> dict:
        """Documents by id, terms from the most to the least frequent, and where each occurs how often."""
        order = sorted(range(len(self.ids)), key=self.ids.__getitem__)
        rows = np.concatenate([self.rows[d] for d in order])
        counts = np.concatenate([self.counts[d] for d in order])
        columns = np.repeat(np.arange(len(order), dtype=np.int32), [len(self.rows[d]) for d in order])
        sizes = np.bincount(rows, minlength=len(self.number))
        by_size = np.argsort(-sizes, kind="stable")
        place = np.empty(len(by_size), dtype=np.int32)
        place[by_size] = np.arange(len(by_size))
        sort = np.argsort(place[rows], kind="stable")
        terms, sizes = list(self.number), sizes[by_size].astype(np.int32)
        lines = range(0, len(terms), LINE_TERMS)
        return {"ids": squeeze(np.array([self.ids[d] for d in order], dtype="<i8")),
                "lengths": squeeze(np.array([self.lengths[d] for d in order], dtype="<i8")),
                "n_docs": len(order), "n_terms": int(sum(self.lengths)),
                "terms": [" ".join([terms[i] for i in by_size[a:a + LINE_TERMS]]) for a in lines],
                "sizes": [sizes[a:a + LINE_TERMS] for a in lines], "columns": squeeze(columns[sort].astype("<i4")),
                "counts": squeeze(counts[sort].astype("<i4"))}


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower() if text.isascii() else text.translate(LOWER_TABLE))


def document_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ``POSTINGS`` from rows of ``id, text``; documents without a term are left out."""
    own = RangeWriter()
    for batch in batches:
        for doc, text in zip(batch["id"].tolist(), batch["text"].tolist(), strict=True):
            terms = terms_of(text)
            if not terms:
                continue
            if own.full(text):
                yield pd.DataFrame([own.postings()])
                own = RangeWriter()
            own.add(doc, terms, len(text))
    if own.ids:
        yield pd.DataFrame([own.postings()])


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Puts a zero before each of the lower 32 bits."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Nodes from the root down, level by level in Z-order: which of its four quarters each has, and by how much
    its maximum falls short of its parent's. The last level, single places, has no quarters."""
    codes = spread_bits(rows) << np.uint64(1) | spread_bits(columns)
    order = np.argsort(codes)
    codes, best = codes[order], impacts[order]
    masks, drops = [], []
    for _ in range(height):
        quarter = (codes & np.uint64(3)).astype(np.uint8)
        parents = codes >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        above = np.maximum.reduceat(best, starts)
        masks.append(np.bitwise_or.reduceat(np.left_shift(np.uint8(1), quarter), starts))
        drops.append(np.repeat(above, np.diff(starts, append=len(codes))) - best)
        codes, best = parents[starts], above
    return np.concatenate(masks[::-1]), np.concatenate(drops[::-1]), int(best[0])


def impacts_of(counts: np.ndarray, lengths: np.ndarray, columns: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence is worth by its number in the document and the length of the document."""
    shares = np.array([100 - TILT + TILT * n * n_docs // n_terms for n in lengths.tolist()], dtype=np.int64)[columns]
    return (IMPACT * counts) // (SLOPE * counts + BASE * shares)


class Treap:
    """A range of the index in memory. Nodes are numbered from the root; ``child`` is the first child of each."""

    def __init__(self, ids: bytes, terms: list[str], height: int, masks: bytes, drops: bytes, top: int):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.row = {term: i for i, term in enumerate(terms)}
        self.height = height
        self.masks = np.frombuffer(masks, dtype=np.uint8)
        quarters = np.array([bin(m).count("1") for m in range(16)], dtype=np.uint8)
        self.below = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], dtype=np.int64)
        children = quarters[self.masks]
        self.child = 1 + np.cumsum(children, dtype=np.int32) - children
        drops = np.frombuffer(drops, dtype="<i4")
        self.best = np.empty(1 + len(drops), dtype=np.int32)
        self.best[0] = top
        start, stop = 0, 1  # a level of inner nodes, whose children are the next level
        for _ in range(height):
            first = stop
            after = first + int(children[start:stop].sum())
            self.best[first:after] = np.repeat(self.best[start:stop], children[start:stop]) - drops[first - 1:after - 1]
            start, stop = first, after

    def search(self, terms: list[str], weights: list[int], found: TopDocuments) -> None:
        """Adds the documents of this range that belong to the best for the weighted terms."""
        own = [(self.row[t], w) for t, w in zip(terms, weights, strict=True) if t in self.row and w > 0]
        if not own:
            return
        rows, weight = (np.array(x, dtype=np.int64) for x in zip(*own, strict=True))
        # Open stretches of columns: level, number of the stretch on it, node of each row (-1 if empty), bound.
        level, stretch = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        nodes = np.zeros((1, len(rows)), dtype=np.int32)
        bound = np.array([int(self.best[0]) * int(weight.sum())])
        step = max(1, STEP_NUMBERS // len(rows))
        while len(bound):
            near = np.flatnonzero(bound >= found.least)
            if len(near) < len(bound):
                level, stretch, nodes, bound = level[near], stretch[near], nodes[near], bound[near]
                if not len(bound):
                    return
            if len(bound) <= step:
                chosen = np.ones(len(bound), dtype=bool)
            else:
                wanted = bound if nodes.size < OPEN_NUMBERS else level
                chosen = np.zeros(len(bound), dtype=bool)
                chosen[np.argpartition(-wanted, step)[:step]] = True
            at, mine = level[chosen], nodes[chosen]
            bit = (rows[None, :] >> (self.height - 1 - at)[:, None]) & 1
            inside = mine >= 0
            mask = np.where(inside, self.masks[np.where(inside, mine, 0)], 0)
            halves = []
            for half in (0, 1):
                quarter = 2 * bit + half
                there = (mask >> quarter) & 1 == 1
                down = np.where(there, self.child[np.where(inside, mine, 0)] + self.below[mask, quarter], -1)
                score = np.where(there, self.best[down], 0).astype(np.int64) @ weight
                some = there.any(axis=1)
                halves.append((at[some] + 1, 2 * stretch[chosen][some] + half, down[some].astype(np.int32), score[some]))
            new = [np.concatenate(parts) for parts in zip(*halves, strict=True)]
            done = new[0] == self.height
            found.add(new[3][done], self.ids[new[1][done]])
            kept = ~chosen
            level, stretch, nodes, bound = (np.concatenate([old[kept], more[~done]])
                                            for old, more in zip((level, stretch, nodes, bound), new, strict=True))


class TopDocuments:
    """The ``size`` best documents so far, by score and then id. ``least``: a lower score cannot come in."""

    def __init__(self, size: int):
        self.size, self.least = size, 1
        self.scores, self.docs = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.least
        if not good.any():
            return
        scores, docs = np.concatenate([self.scores, scores[good]]), np.concatenate([self.docs, docs[good]])
        order = np.lexsort((docs, -scores))[:self.size]
        self.scores, self.docs = scores[order], docs[order]
        if len(order) == self.size:
            self.least = int(self.scores[-1])


def build_index(docs: DataFrame, doc_id: str = "doc_id", column: str = "text") -> tuple[DataFrame, int]:
    """The index, a row of ``INDEX`` for each range of documents, and the number of documents with a term.

    Terms are runs of digits, letters and characters above U+007F, A-Z lower-cased. All of them are
    indexed, with all their places. The impact of a term in a document of ``n`` terms is ``10^9 tf div (1000 tf + 20
    m)`` with ``m = 50 + 50 n N div L`` for ``N`` documents of ``L`` terms in all. Documents without id or without
    a term are no documents; rows that repeat an id are documents of their own. Texts are indexed whole.
    """
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{column}`").cast("string").alias("text"))
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        ranges = stage(given.filter("id IS NOT NULL AND text IS NOT NULL").mapInPandas(document_ranges, POSTINGS), "postings", "zstd", **GROUPS)
    total = ranges.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = int(total["docs"] or 0), int(total["terms"] or 0)

    def build(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                sizes, lengths = np.concatenate(list(r.sizes)), unsqueeze(r.lengths, "<i8")
                counts, columns = unsqueeze(r.counts, "<i4").astype(np.int64), unsqueeze(r.columns, "<i4")
                height = max(1, (max(len(sizes), len(lengths)) - 1).bit_length())
                masks, drops, top = build_treap(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), columns,
                                                impacts_of(counts, lengths, columns, n_docs, n_terms).astype("<i4"), height)
                yield pd.DataFrame([{"ids": r.ids, "terms": r.terms, "sizes": r.sizes, "height": height, "masks": squeeze(masks),
                                     "drops": squeeze(drops), "top": top}])

    with arrow_rows(spark, 1):
        return stage(ranges.select("ids", "lengths", "terms", "sizes", "columns", "counts").mapInPandas(build, INDEX),
                     "treaps", "zstd", **GROUPS), n_docs


def term_weights(index: DataFrame, n_docs: int, wanted: DataFrame) -> DataFrame:
    """``term, weight`` of the terms of ``wanted`` that occur: ``floor(1000 ln((2 N + 2) / (2 df + 1)))``."""
    lines = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("l")).select(F.split("l.terms", " ").alias("terms"), "l.sizes")
    sizes = lines.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.sizes").alias("df"))
    found = sizes.join(wanted.select("term").distinct(), ["term"]).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    return found.select("term", weight.cast("bigint").alias("weight"))


def search(index: DataFrame, n_docs: int, items: DataFrame, size: int = 50, item_id: str = "item_id", column: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``size`` documents of highest score above 0 for each item.

    The score sums weight times impact over the item's terms, each taken once; equal scores go by
    ascending id. Rows of one item id are one item; one without a term that occurs has no rows. Items are
    taken in blocks against all ranges. A task keeps the best documents of each item over its ranges, so
    that what it has found bounds the search in the next; what meets for the last ranking is ``size`` rows
    an item and task.
    """
    spark = index.sparkSession
    kind = items.schema[item_id].dataType
    text = lower_ascii(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    terms = stage(items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.explode(F.regexp_extract_all(
        text, F.lit(JVM_TERM), F.lit(0))).alias("term")).distinct(), "item-terms")
    weighted = terms.join(term_weights(index, n_docs, terms), ["term"])
    parts = max(1, -(-terms.select("item").distinct().count() // BLOCK_ITEMS))
    per_item = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    # Staged, so that Spark knows their size: it broadcasts them if they are small, and else shuffles.
    blocks = stage(per_item.groupBy(F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int").alias("block"))
                   .agg(F.collect_list(F.struct("item", "t")).alias("items"))
                   .select("block", F.col("items.item").alias("items"), F.transform("items", lambda i: i["t"]["term"]).alias("item_terms"),
                           F.transform("items", lambda i: i["t"]["weight"]).alias("weights")), "item-blocks")

    def find(batches):
        best: dict[str, TopDocuments] = {}
        held, treap = None, None
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = (r.ids, list(r.terms), r.masks, r.drops, r.top)
                if held != own:  # the blocks of a range come one after another
                    treap = None  # gone before the next is there
                    held, treap = own, Treap(unsqueeze(r.ids, "<i8"), " ".join(r.terms).split(" "), r.height,
                                             unsqueeze(r.masks, "u1"), unsqueeze(r.drops, "<i4"), r.top)
                for item, words, weights in zip(r.items, r.item_terms, r.weights, strict=True):
                    treap.search(words, weights, best.setdefault(item, TopDocuments(size)))
        for item, top in best.items():
            if len(top.docs):
                yield pd.DataFrame({"item": item, "doc_id": top.docs, "score": top.scores})

    met = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, ["block"])
    with arrow_rows(spark, 1):
        found = stage(met.select("ids", "terms", "height", "masks", "drops", "top", F.col("items"), "item_terms", "weights")
                      .mapInPandas(find, "item string, doc_id long, score long"), "found")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= size)
            .select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score"))
