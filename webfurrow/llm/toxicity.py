"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Mapping
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.llm.common import Memo, per_text, small_batches

#: Labelled documents of each class the model learns from at most, chosen by a hash of the id.
SAMPLE_PER_CLASS = 5000
#: Terms are hashed to so many buckets; all that the sample holds, with their levels, are the machine's inputs.
BUCKETS = 1 << 22
FACTORS = 8
STEPS = 60
#: An input's weight moves by the square of how telling it is alone, as a share of the most telling one;
#: its factors move by this at least, so that a term which tells only with another can be learned.
LEAST = 0.02
PREFIXES = (4, 5, 6, 7)
#: A term is an input once for each of these numbers of different words of the text that share it: one
#: chance word with a telling beginning says less than three.
LEVELS = (1, 2, 3)
WORD = re.compile(r"[^\W_]+")


def terms(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself and its beginnings, which inflected forms share."""
    import xxhash

    names = [f"w {word}", *(f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(dict.fromkeys(xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names))


def inputs_of(text: str | None, memo: Mapping[str, tuple[int, ...]]) -> np.ndarray:
    """Inputs of a text, sorted: ``bucket * len(LEVELS) + level`` of each bucket and each level it reaches."""
    words = set(WORD.findall((text or "").lower()))
    held, times = np.unique(np.fromiter(chain.from_iterable(map(memo.__getitem__, words)), dtype=np.int64), return_counts=True)
    return np.sort(np.concatenate([held[times >= least] * len(LEVELS) + i for i, least in enumerate(LEVELS)]))


class Machine:
    """P(toxic) of a set of inputs: a bias, a weight and a factor vector per input; the inner products
    of the vectors are the weights of pairs. ``buckets`` are the inputs, sorted."""

    def __init__(self, buckets, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.buckets, self.bias, self.weights, self.factors = buckets, bias, weights, factors
        self.names = np.asarray(buckets, dtype=np.int64)

    def inputs(self, memo: Memo, text: str | None) -> np.ndarray:
        found = inputs_of(text, memo)
        place = np.searchsorted(self.names, found)
        inside = place < len(self.names)
        return place[inside][self.names[place[inside]] == found[inside]]

    def memo(self) -> Memo:
        kept = np.zeros(BUCKETS, dtype=bool)
        kept[self.names // len(LEVELS)] = True
        return Memo(lambda word: tuple(b for b in terms(word) if kept[b]))

    def probability(self, rows: np.ndarray) -> float:
        v = self.factors[rows].astype(float)
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum())
        return float(1.0 / (1.0 + np.exp(-np.clip(self.bias + self.weights[rows].sum(dtype=float) + pairs, -30, 30))))


def _sums(groups: np.ndarray, n: int):
    """Function that adds up values by group; ``groups`` is sorted, groups without a value get 0."""
    start = np.flatnonzero(np.diff(groups, prepend=-1))
    full = groups[start]

    def add(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, dtype=values.dtype)
        if len(start):
            out[full] = np.add.reduceat(values, start)
        return out

    return add


def fit(x, y: np.ndarray, factors: int = FACTORS, steps: int = STEPS, rate: float = 0.05, shrink: float = 1e-4,
        scales: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by full-batch Adam on the logistic loss; the two classes weigh the same.

    ``x`` is a matrix of 0 and 1, or ``row, column, columns`` of its ones in order of row. ``scales``
    of weights and factors say how far each input may go for the same penalty. One factor is worked
    on at a time, so memory is a few numbers for each one of the matrix.
    """
    row, column, m = (*np.nonzero(x), x.shape[1]) if isinstance(x, np.ndarray) else x
    n, single = len(y), np.float32
    order = np.argsort(column, kind="stable")
    row_of, by_row, by_column = row[order], _sums(row, n), _sums(column[order], m)
    near, far = (np.ones(m, single), np.ones(m, single)) if scales is None else (s.astype(single) for s in scales)
    rng = np.random.default_rng(7)
    parameters = [np.zeros(1, single), np.zeros(m, single), rng.normal(0, 0.02, (factors, m)).astype(single)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(single)
    for step in range(1, steps + 1):
        b, w, v = parameters[0], parameters[1] * near, parameters[2] * far
        xv = np.stack([by_row(part[column]) for part in v])
        z = b + by_row(w[column]) + 0.5 * ((xv ** 2).sum(axis=0) - by_row((v ** 2).sum(axis=0)[column]))
        g = (share * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)).astype(single)
        gx = by_column(g[row_of])
        gv = np.stack([by_column((g * part)[row_of]) for part in xv]) - gx * v
        gradients = [np.array([g.sum()]), gx * near + shrink * parameters[1], gv * far + shrink * parameters[2]]
        now = rate * (1 - step / (steps + 1))
        for p, d, (first, second) in zip(parameters, gradients, moments, strict=True):
            first += 0.1 * (d - first)
            second += 0.001 * (d * d - second)
            p -= now * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return float(parameters[0][0]), parameters[1] * near, (parameters[2] * far).T.copy()


def scales_of(row: np.ndarray, column: np.ndarray, m: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far weights and factors may go: by how unevenly the two classes hold an input. None is 0 for factors."""
    held, clean = (np.bincount(column, weights=part[row], minlength=m) for part in (y, 1 - y))
    p, q = (held + 0.5) / (y.sum() + 1), (clean + 0.5) / ((1 - y).sum() + 1)
    telling = np.abs(p - q) / np.sqrt(p * (1 - p) / (y.sum() + 1) + q * (1 - q) / ((1 - y).sum() + 1))
    near = (telling / max(telling.max(initial=0.0), 1e-9)) ** 2
    return near, np.maximum(near, LEAST)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Learns from ``labels`` (``doc_id``, ``toxic``) and the texts of the same ids.

    At most about ``per_class`` labelled ids of each class are used. Their ids, at most a few
    thousand, are what the texts are filtered by. Every input of the sample is kept; how far its
    weight may go depends on how unevenly the two classes hold it. The machine is fitted in one
    task over the bounded sample. Labels that are null, and ids without text, teach nothing; without one class the
    machine is a constant.
    """
    usable = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Machine([], 30.0 if counts.get(1) else -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    chance = F.pmod(F.xxhash64(F.lit("toxic sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    chosen = usable.filter(chance < share).limit(4 * per_class)
    small_batches(docs.sparkSession)

    def described(batches):
        memo = Memo(terms)
        for rows in batches:
            found = [inputs_of(text, memo).astype(np.int32) for text in rows.text]
            yield pd.DataFrame({"doc_id": rows.doc_id, "toxic": rows.toxic, "inputs": found})

    # The chosen ids are at most 4 * per_class rows of two numbers: a proven bound.
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), ["doc_id"])
              .select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
              .mapInPandas(described, "doc_id long, toxic int, inputs array<int>"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "toxic"], kind="stable")
        y = rows.toxic.to_numpy()
        flat = np.concatenate([*rows.inputs, np.zeros(0, dtype=np.int32)])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(b) for b in rows.inputs])
        names, column = np.unique(flat, return_inverse=True)
        column = column.astype(np.int32)
        bias, weights, factors = fit((row, column, len(names)), y, scales=scales_of(row, column, len(names), y))
        return pd.DataFrame({"buckets": [names.astype(np.int32).tobytes()], "bias": [bias], "weights": [weights.tobytes()],
                             "factors": [factors.tobytes()]})

    model = sample.groupBy().applyInPandas(learn, "buckets binary, bias double, weights binary, factors binary").collect()
    if not model:
        return Machine([], 0.0, np.zeros(0), np.zeros((0, FACTORS)))
    m = model[0]
    return Machine(np.frombuffer(m["buckets"], np.int32), m["bias"], np.frombuffer(m["weights"], np.float32),
                   np.frombuffer(m["factors"], np.float32).reshape(-1, FACTORS))


def score_toxicity(docs: DataFrame, model: Machine, threshold: float = 0.7, column: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``).

    Null counts as empty; a text without a known term gets the score of the bias alone. Only the
    text is read, whole; rows are never moved; existing columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.buckets, model.bias, model.weights, model.factors))  # bounded by BUCKETS and LEVELS

    def make():
        machine = Machine(*shared.value)
        memo = machine.memo()
        return lambda texts: {"score": [machine.probability(machine.inputs(memo, t)) for t in texts]}

    scored = per_text(docs.drop("predicted"), make, "score double", column)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
