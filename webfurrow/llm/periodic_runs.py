"""Periodic runs of words: Lyndon roots by Baier's grouping, extended by longest common extensions.

A run is a stretch with a smallest period that fits into it often enough and that neither neighbour
extends. Each run holds a root that is the longest Lyndon word starting at its place, under the order
of the words or under its reverse. The first phase of Baier's suffix sorter puts the suffixes into
groups by just these words, so it gives the length of the longest Lyndon word at every place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.llm.common import per_text, without

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Times a text is cut at words too rare for a run before what is left is searched.
CUTS = 8
OUTPUT = ["runs", "collapsed"]


def lyndon_lengths(symbols: list[int], kinds: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each place. ``symbols``: 0 to ``kinds`` - 1.

    Groups are taken from the highest down. The places that point at a place of the group, by being the
    nearest one to its left in a lower group, get the word of the group as often as they are pointed at
    behind their own; they leave their group for a new one just above it. Each place is taken out of the
    line once, so the nearest lower place is its left neighbour, and the work is linear.
    """
    n = len(symbols)
    group = list(symbols)
    members: list[list[int]] = [[] for _ in range(kinds)]
    for place, symbol in enumerate(symbols):
        members[symbol].append(place)
    width = [1] * kinds
    below, above = list(range(-1, kinds - 1)), list(range(1, kinds + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    lengths = [0] * n
    top = kinds - 1
    while top >= 0:
        word = width[top]
        pointed: dict[tuple[int, int], list[int]] = {}
        last, times = -1, 0
        for place in members[top]:
            if group[place] != top:
                continue  # has moved up since
            lengths[place] = word
            before, after = left[place], right[place]
            if after < n:
                left[after] = before
            if before < 0:
                continue
            right[before] = after
            if before == last:
                times += 1
                continue
            if times:
                pointed.setdefault((times, group[last]), []).append(last)
            last, times = before, 1
        if times:
            pointed.setdefault((times, group[last]), []).append(last)
        members[top] = []
        for times, old in sorted(pointed, reverse=True):  # the most often pointed at end up highest
            new, over = len(width), above[old]
            places = pointed[times, old]
            for place in places:
                group[place] = new
            members.append(places)
            width.append(width[old] + times * word)
            below.append(old)
            above.append(over)
            below[over] = above[old] = new
        top = below[top]
    return lengths


class Extensions:
    """Longest common extensions of pairs of places, to the right and to the left.

    Level ``k`` names the blocks of ``2 ** k`` symbols, equal blocks alike, so an extension is read off
    from the highest level down, for all pairs at once. The levels end where no block occurs twice, and
    take ``8 n`` bytes each.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.levels = [np.asarray(symbols, dtype=np.int64)]
        while True:
            size, names = 1 << len(self.levels), self.levels[-1]
            if size > self.n:
                break
            pairs = names[:self.n - size + 1] * (int(names.max()) + 1) + names[size // 2:size // 2 + self.n - size + 1]
            kinds, level = np.unique(pairs, return_inverse=True)
            if len(kinds) == len(pairs):
                break
            self.levels.append(level.astype(np.int64))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree from ``a`` and from ``b`` on, where ``a < b``."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(b + got + (1 << k) <= self.n)
            names = self.levels[k]
            same = fits[names[a[fits] + got[fits]] == names[b[fits] + got[fits]]]
            got[same] += 1 << k
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that agree before ``a`` and before ``b``, where ``a < b``."""
        got = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(a - got - (1 << k) >= 0)
            names = self.levels[k]
            same = fits[names[a[fits] - got[fits] - (1 << k)] == names[b[fits] - got[fits] - (1 << k)]]
            got[same] += 1 << k
        return got


def all_runs(symbols: np.ndarray, least_length: int, least_exponent: int) -> np.ndarray:
    """Rows of start, length and period of the runs, by start and then period. ``symbols``: whole numbers from 0, none left out."""
    n, kinds = len(symbols), int(symbols.max()) + 1
    reach = Extensions(symbols)
    places = np.arange(n)
    found = []
    for ordered in (symbols, kinds - 1 - symbols):
        period = np.array(lyndon_lengths(ordered.tolist(), kinds), dtype=np.int64)
        short = np.flatnonzero(period * least_exponent <= n)
        start, p = places[short], period[short]
        before, after = reach.left(start, start + p), reach.right(start, start + p)
        length = before + p + after
        keep = (length >= least_length) & (length >= least_exponent * p)
        found.append(np.stack([start[keep] - before[keep], length[keep], p[keep]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(symbols: np.ndarray, least_length: int, least_exponent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of the text that may hold a run, each with its start and its symbols numbered anew.

    Every word of a run stands in it at least ``least_exponent`` times, so a word that is rarer in a part
    is in no run of it and extends none: the part is cut there, again and again.
    """
    todo = [(0, len(symbols), 0)]
    while todo:
        start, stop, cuts = todo.pop()
        if stop - start < max(least_length, least_exponent):
            continue
        _, part, counts = np.unique(symbols[start:stop], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[part] < least_exponent)
        if not len(rare) or cuts == CUTS:
            yield start, part
            continue
        edges = np.concatenate([[-1], rare, [stop - start]])
        for i in np.flatnonzero(np.diff(edges) > least_length):
            todo.append((start + int(edges[i]) + 1, start + int(edges[i + 1]), cuts + 1))


def runs_of(symbols: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows of start, length and period of every run, by start and then period."""
    found = [np.empty((0, 3), dtype=np.int64)]
    for start, part in stretches(symbols, least_length, least_exponent):
        runs = all_runs(part, least_length, least_exponent)
        runs[:, 0] += start
        found.append(runs)
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def words_of(text: str | None) -> list[bytes]:
    """Words between blanks, tabs, line feeds and the like (U+0020, U+0009 to U+000D), as UTF-8."""
    return (text or "").encode("utf-8", "replace").split()  # bytes are split at just these


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words without those that repeat: of every run only its first period stays."""
    if not len(runs):
        return b" ".join(words).decode()
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()]).decode()


def find_runs(docs: DataFrame, column: str = "text", least_length: int = LEAST_LENGTH,
              least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Adds ``runs``, structs of ``start``, ``length`` and ``period`` in words, and ``collapsed``, the text without repeats.

    A run is a stretch of at least ``least_length`` words and ``least_exponent`` (two or more) times its
    smallest period that neither neighbour extends; runs are ordered by start, then period. ``collapsed``
    keeps the words that no run contains after its first period, joined by one blank. Null counts as
    empty: no runs and an empty text. Whole texts are searched, however long; repeated rows give equal
    rows and columns of the added names are replaced. No row is moved between tasks; a task holds a batch
    of texts and, for the longest stretch, a few numbers a word and level of its blocks.
    """
    if least_exponent < 2:
        raise ValueError("a run holds its period at least twice")

    def make():
        def run(texts):
            out = {name: [] for name in ("_starts", "_lengths", "_periods", "collapsed")}
            for text in texts:
                words = words_of(text)
                runs = runs_of(pd.factorize(np.array(words, dtype=object))[0], least_length, least_exponent) if words \
                    else np.empty((0, 3), dtype=np.int64)
                for name, numbers in zip(("_starts", "_lengths", "_periods"), runs.T, strict=True):
                    out[name].append(numbers.tolist())
                out["collapsed"].append(collapse(words, runs))
            return out
        return run

    kept = without(docs, OUTPUT)
    found = per_text(kept, make, "_starts array<long>, _lengths array<long>, _periods array<long>, collapsed string", column)
    runs = F.arrays_zip(F.col("_starts").alias("start"), F.col("_lengths").alias("length"), F.col("_periods").alias("period"))
    return found.select(*[F.col(f"`{c}`") for c in kept.columns], runs.alias("runs"), "collapsed")
