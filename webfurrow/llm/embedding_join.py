"""Near-duplicate vectors: an epsilon grid order join on leading principal dimensions.

Unit vectors with cosine ``c`` are ``sqrt(2 - 2c)`` apart, and no further on any set of orthogonal
axes. Vectors are sorted by the grid cells of that width on the leading principal axes and cut into
blocks of equal size, which are intervals of the sequence. The whole sequence is joined with itself by
halving: two intervals whose boxes are too far apart are dropped, others are halved again, first down
to blocks, by joins over the boxes, then inside each pair of blocks down to a few vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webfurrow.llm.common import BATCH_ROWS, arrow_rows, connected, stage

#: Axes of the grid and of the boxes.
AXES = 12
#: Bytes of the vectors of a block in double precision; a task holds two blocks. A block is sent once for each
#: block it may meet, so larger ones mean less to send.
BLOCK_BYTES = 16 << 20
#: Vectors in the smallest interval that is compared as a whole.
LEAF = 128
OUTPUT = ["n_links", "component_id", "kept"]


def usable(column: str):
    """Whether a vector takes part: not null, empty or zero, all components finite."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows, size: int) -> np.ndarray:
    """Unit vectors in double precision, filled up with zeros to ``size``."""
    out = np.zeros((len(rows), size))
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    scale = np.abs(out).max(axis=1, keepdims=True)  # keeps squares in range
    out /= np.where(scale == 0, 1, scale)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


def principal_axes(vectors: DataFrame, size: int, axes: int) -> np.ndarray:
    """Leading eigenvectors of the second moments of all unit vectors. Each task adds up one matrix."""
    def moments(batches):
        total = np.zeros((size, size))
        for rows in batches:
            u = unit(rows.v, size)
            total += u.T @ u
        yield pd.DataFrame({"row": range(size), "sums": list(total)})

    sums = (vectors.select("v").mapInPandas(moments, "row int, sums array<double>")
            .select("row", F.posexplode("sums").alias("col", "x")).groupBy("row", "col").agg(F.sum("x").alias("x")))
    matrix = np.zeros((size, size))
    for r in sums.collect():  # the square of the vector length
        matrix[r["row"], r["col"]] = r["x"]
    _, vectors_ = np.linalg.eigh((matrix + matrix.T) / 2)
    return vectors_[:, ::-1][:, :axes]


def box_distance2(lo_a, hi_a, lo_b, hi_b) -> float:
    gap = np.maximum(0.0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return float(gap @ gap)


class Side:
    """A block in memory: unit vectors, their projections, and what a link to each is worth."""

    def __init__(self, ids, weights, dims, raw: bytes, size: int, axes: np.ndarray):
        self.ids, self.weights, self.dims = np.asarray(ids), np.asarray(weights), np.asarray(dims)
        flat = np.frombuffer(raw, dtype=np.float64).reshape(len(self.ids), size)
        self.u, self.y = flat, flat @ axes

    def box(self, s: slice):
        return self.y[s].min(axis=0), self.y[s].max(axis=0)


def near_pairs(a: Side, b: Side, same: bool, cosine: float, reach2: float):
    """Yields (rows of a, rows of b) that link. ``same``: a is b, and each pair is wanted once."""
    todo = [(slice(0, len(a.ids)), slice(0, len(b.ids)))]
    while todo:
        s, t = todo.pop()
        if same and s.start > t.start or box_distance2(*a.box(s), *b.box(t)) > reach2:
            continue
        n, m = s.stop - s.start, t.stop - t.start
        if n <= LEAF and m <= LEAF:
            hit = (a.u[s] @ b.u[t].T >= cosine) & (a.dims[s][:, None] == b.dims[t][None, :])
            if same and s == t:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            if len(i):
                yield i + s.start, j + t.start
            continue
        # Halve both to equal length so that a block with itself gives equal intervals again.
        cut = lambda x: [x] if x.stop - x.start <= LEAF else [
            slice(x.start, (x.start + x.stop) // 2), slice((x.start + x.stop) // 2, x.stop)]
        todo += [(p, q) for p in cut(s) for q in cut(t)]


def join_blocks(a: Side, b: Side, same: bool, cosine: float, reach2: float) -> pd.DataFrame:
    """One row per vector with a link: worth of its links, and a vector that it is connected with here.

    The rows are at most as many as the vectors, however many pairs link.
    """
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    shift = 0 if same else len(a.ids)
    weights = a.weights if same else np.concatenate([a.weights, b.weights])
    worth, root = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in near_pairs(a, b, same, cosine, reach2):
        j = j + shift
        np.add.at(worth, i, weights[j])
        np.add.at(worth, j, weights[i])
        # Within these links one of each pair of trees is enough.
        for p, q in {(top(x), top(y)) for x, y in zip(i.tolist(), j.tolist(), strict=True)}:
            p, q = top(p), top(q)
            root[max(p, q)] = min(p, q)
    with_links = np.flatnonzero(worth)
    return pd.DataFrame({"rep": ids[with_links], "worth": worth[with_links],
                         "other": ids[[top(i) for i in with_links]]})


def meeting_blocks(boxes: DataFrame, axes: int, reach2: float) -> DataFrame:
    """Pairs of blocks (``a <= b``) whose boxes are near enough. ``boxes``: block (numbered from 0), lo, hi.

    Starts with the whole sequence against itself. In each round every pair of intervals left is halved
    on both sides, and the halves that are provably apart are dropped; what meets the driver is the
    number of blocks.
    """
    spark = boxes.sparkSession
    count = boxes.count()
    pairs = spark.range(1 if count else 0).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    halves = F.explode(F.array(*[F.struct((2 * F.col("a") + i).alias("a"), (2 * F.col("b") + j).alias("b")) for i in (0, 1) for j in (0, 1)]))
    gap2 = sum((F.pow(F.greatest(F.lit(0.0), F.col("lo_b")[i] - F.col("hi_a")[i], F.col("lo_a")[i] - F.col("hi_b")[i]), 2.0)
                for i in range(axes)), F.lit(0.0))
    for level in range((count - 1).bit_length() - 1, -1, -1):
        interval = F.shiftright("block", level)
        box = boxes.groupBy(interval.alias("i")).agg(
            F.array(*[F.min(F.col("lo")[i]) for i in range(axes)]).alias("lo"), F.array(*[F.max(F.col("hi")[i]) for i in range(axes)]).alias("hi"))
        left, right = (box.select(F.col("i").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}")) for x in "ab")
        halved = pairs.select(halves.alias("p")).select("p.a", "p.b").filter("a <= b")
        pairs = stage(halved.join(left, ["a"]).join(right, ["b"]).filter(gap2 <= reach2).select("a", "b"), "intervals")
    return pairs


def near_vectors(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding",
                 block_bytes: int = BLOCK_BYTES, axes: int = AXES) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors``.

    Two rows link if the cosine of their vectors, in double precision, is at least ``cosine``; other
    columns are not looked at. Equal vectors are joined once and counted by their number. A vector that
    is null, empty or zero, or has a null or non-finite component, links with nothing, and vectors of
    different length never link. ``component_id`` is the smallest id reachable by links. Rows without
    id keep a null component.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    good = rows.filter(usable("v") & F.col("vec_id").isNotNull())
    # Equal vectors: two independent hashes of all components.
    same = F.struct(F.xxhash64("v"), F.xxhash64(F.reverse("v"), F.lit(1)))
    classes = stage(good.withColumn("same", same).groupBy("same").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")), "classes")
    size = classes.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    block = max(1, block_bytes // (8 * size))
    reach2 = (2 - 2 * cosine) + 1e-9
    width = reach2 ** 0.5
    with arrow_rows(spark, BATCH_ROWS):
        basis = principal_axes(classes, size, min(axes, size))
    k = basis.shape[1]

    def place(batches):
        for part in batches:
            y = unit(part.v, size) @ basis
            yield part.assign(cells=list(np.floor(y / width).astype(np.int32)))

    def number(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for rows_ in batches:
            yield rows_.assign(part=part, at=range(at, at + len(rows_)))
            at += len(rows_)

    # The grid order: cells on the first axis, then the second, and so on.
    grid = [F.col("cells")[i] for i in range(k)]
    placed = classes.select("rep", "weight", "v").mapInPandas(place, "rep long, weight long, v array<double>, cells array<int>")
    parts = max(1, -(-classes.count() // block))
    ordered = placed.repartitionByRange(parts, *grid, "rep").sortWithinPartitions(*grid, "rep").drop("cells")
    with arrow_rows(spark, BATCH_ROWS):
        numbered = stage(ordered.mapInPandas(number, "rep long, weight long, v array<double>, part int, at long"), "ordered")
    # Blocks are cut by rows of the whole sequence, however it was dealt. There is one count for each part.
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    cut = numbered.join(before, ["part"]).withColumn("at", F.col("at") + F.col("before")).withColumn("block", F.expr(f"at div {block}"))

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        u = unit(part.v, size)
        y = u @ basis
        return pd.DataFrame({
            "block": [int(part.block.iloc[0])], "ids": [part.rep.to_numpy()], "weights": [part.weight.to_numpy()],
            "dims": [part.v.map(len).to_numpy()], "raw": [u.tobytes()], "lo": [y.min(axis=0)], "hi": [y.max(axis=0)]})

    with arrow_rows(spark, BATCH_ROWS):
        blocks = stage(cut.select("block", "at", "rep", "weight", "v").groupBy("block").applyInPandas(
            packed, "block long, ids array<long>, weights array<long>, dims array<int>, raw binary, lo array<double>, hi array<double>"), "blocks")
    meet = meeting_blocks(blocks.select("block", "lo", "hi"), k, reach2)

    def compare(batches):
        for pairs in batches:
            for p in pairs.itertuples(index=False):
                one = Side(p.ids, p.weights, p.dims, p.raw, size, basis)
                two = one if p.ids2 is None else Side(p.ids2, p.weights2, p.dims2, p.raw2, size, basis)
                yield join_blocks(one, two, p.ids2 is None, cosine, reach2)

    payload = ["ids", "weights", "dims", "raw"]
    other = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}2") for c in payload])
    # A block with itself is sent once.
    sides = meet.withColumn("b", F.when(F.col("a") < F.col("b"), F.col("b")))
    with arrow_rows(spark, 1):  # a row here is a pair of blocks
        found = stage(sides.join(blocks.select(F.col("block").alias("a"), *payload), ["a"]).join(other, ["b"], "left")
                      .mapInPandas(compare, "rep long, worth long, other long"), "found")
    worth = found.groupBy("rep").agg(F.sum("worth").alias("worth"))
    linked = connected(classes.select(F.col("rep").alias("id")),
                       found.select(F.col("rep").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    of_class = (classes.select("same", "rep", "weight").join(worth, ["rep"], "left")
                .join(linked.withColumnRenamed("id", "rep"), ["rep"])
                .select("same", (F.col("weight") - 1 + F.coalesce("worth", F.lit(0))).alias("n_links"), "component"))
    keyed = rows.withColumn("same", F.when(usable("v") & F.col("vec_id").isNotNull(), same))
    return (keyed.select("vec_id", "same").join(of_class, ["same"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id") == F.col("component_id")))
