"""Language identification: piece unigrams with the segmentation summed out."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.llm.common import per_text, small_batches

#: Labelled documents per language that a model learns from at most; a language with more gives a sample by hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: Longer words are scored as pieces of this many letters, so that probabilities stay in range.
LONGEST = 30
#: Probability of a letter that no piece covers.
FLOOR = 1e-7
START = "▁"
UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lattice:
    """Finds the pieces of many words at once. A word starts with the mark of a word start."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        hashes = np.array([self.hash_of(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    @classmethod
    def hash_of(cls, piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c)) * int(cls.BASE)) & 0xFFFFFFFFFFFFFFFF
        return h

    def by_length(self, words: list[str]):
        """Yields (places in ``words``, matrix of code points) for each length."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            places = np.flatnonzero(lengths == n)
            codes = np.frombuffer("".join(words[p] for p in places).encode("utf-32-le"), dtype=np.uint32)
            yield places, codes.reshape(len(places), n)

    def arcs(self, codes: np.ndarray):
        """Yields (start, end, ids or -1) for every stretch that is a piece of some word."""
        n = codes.shape[1]
        for start in range(n):
            h = np.zeros(len(codes), dtype=np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = (h + codes[:, end - 1]) * self.BASE
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                ids = np.where(self.hashes[at] == h, self.ids[at], -1)
                if end == start + 1 or (ids >= 0).any():
                    yield start, end, ids

    def forward(self, codes: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of each word (rows) for each language (columns of ``p``), over all segmentations.

        ``p`` has a last row for a letter no piece covers.
        """
        alpha = np.zeros((codes.shape[1] + 1, len(codes), p.shape[1]))
        alpha[0] = 1.0
        for start, end, ids in self.arcs(codes):
            if end == start + 1:
                alpha[end] += alpha[start] * p[ids]  # -1 picks the last row
            else:
                hit = np.flatnonzero(ids >= 0)
                alpha[end][hit] += alpha[start][hit] * p[ids[hit]]
        return alpha[-1]

    def expected(self, codes: np.ndarray, weights: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, by a forward and a backward pass (one language)."""
        n, arcs = codes.shape[1], list(self.arcs(codes))
        alpha, beta = np.zeros((n + 1, len(codes))), np.zeros((n + 1, len(codes)))
        alpha[0], beta[n] = 1.0, 1.0
        probability = [np.where(ids >= 0, p[ids], FLOOR if end == start + 1 else 0.0) for start, end, ids in arcs]
        for (start, end, _), q in zip(arcs, probability, strict=True):
            alpha[end] += alpha[start] * q
        for (start, end, _), q in sorted(zip(arcs, probability, strict=True), key=lambda x: -x[0][0]):
            beta[start] += beta[end] * q
        used = np.zeros(len(p))
        scale = weights / alpha[n]
        for (start, end, ids), q in zip(arcs, probability, strict=True):
            hit = ids >= 0
            np.add.at(used, ids[hit], (alpha[start] * q * beta[end] * scale)[hit])
        return used


def marked(word: str) -> list[str]:
    word = START + word
    return [word[i:i + LONGEST] for i in range(0, len(word), LONGEST)]


def vocabulary(model_path: str) -> list[str]:
    """Lower-cased letter pieces of a public vocabulary, in its order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(model.get_piece_size())]
    pieces = [model.id_to_piece(i).lower() for i, odd in enumerate(special) if not odd]
    return list(dict.fromkeys(p for p in pieces if WORD.fullmatch(p.lstrip(START)) and START not in p[1:] or p == START))


def fit_language(texts: list[str], pieces: list[str], rounds: int = 4) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over its distinct words."""
    lattice, counts = Lattice(pieces), {}
    for text in texts:
        for word in words_of(text):
            counts[word] = counts.get(word, 0) + 1
    parts: dict[str, int] = {}
    for word, n in counts.items():
        for part in marked(word):
            parts[part] = parts.get(part, 0) + n
    p = np.full(len(pieces), 1.0 / max(1, len(pieces)))
    if not parts:
        return p
    names, weights = list(parts), np.array(list(parts.values()), dtype=float)
    for _ in range(rounds):
        used = np.full(len(pieces), 0.01)  # no piece is impossible in any language
        for places, codes in lattice.by_length(names):
            used += lattice.expected(codes, weights[places], p)
        p = used / used.sum()
    return p


def train(labelled: DataFrame, model_path: str, per_language: int = SAMPLE_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Language -> piece probabilities, from columns ``doc_id``, ``text`` and ``lang``.

    At most about ``per_language`` documents of a language are used, chosen by a hash of the id;
    each language is fitted in a task of its own. Rows with null text or language teach nothing.
    What returns to the driver is one number per piece and language.
    """
    usable = labelled.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items()
                                        for v in (lang, min(1.0, per_language / n))]), F.col("lang"))
    chance = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    small_batches(labelled.sparkSession)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"])
        p = fit_language(rows.text.tolist(), vocabulary(model_path))
        return pd.DataFrame({"lang": [key[0]], "p": [p.tolist()]})

    fitted = usable.filter(chance < share).groupBy("lang").applyInPandas(fit, "lang string, p array<double>")
    return {r["lang"]: np.array(r["p"]) for r in sorted(fitted.collect(), key=lambda r: r["lang"])}


class Identifier:
    """Scores texts with a trained model; keeps a bounded memo of words."""

    def __init__(self, model: dict[str, np.ndarray], model_path: str, memory: int = 200_000):
        self.languages = sorted(model)
        pieces = vocabulary(model_path)
        self.lattice = Lattice(pieces)
        self.p = np.vstack([np.array([model[name] for name in self.languages]).T, np.full((1, len(self.languages)), FLOOR)])
        self.memory = memory
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def learn(self, words: list[str]) -> None:
        parts = sorted({part for w in words for part in marked(w)})
        logs = np.zeros((len(parts), len(self.languages)))
        for places, codes in self.lattice.by_length(parts):
            logs[places] = np.log(self.lattice.forward(codes, self.p))
        of = {part: i for i, part in enumerate(parts)}
        rows = [logs[[of[part] for part in marked(w)]].sum(axis=0) if len(w) >= LONGEST else logs[of[START + w]] for w in words]
        first = len(self.known)
        self.known.update({w: first + i for i, w in enumerate(words)})
        self.scores = np.concatenate([self.scores, np.array(rows)])

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        split = [words_of(t) if t else [] for t in texts]
        if len(self.known) > self.memory:
            self.known, self.scores = {}, np.zeros((0, len(self.languages)))
        new = sorted({w for words in split for w in words}.difference(self.known))
        if new and self.languages:
            self.learn(new)
        names, scores = [], []
        for words in split:
            if not words or not self.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
            logs = self.scores[rows].sum(axis=0)
            best = int(np.argmax(logs))
            names.append(self.languages[best])
            scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
        return {"lang_pred": names, "score": scores}


def identify(docs: DataFrame, model: dict[str, np.ndarray], model_path: str, column: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the share of the best language in the summed likelihoods.

    A text that is null or has no letter gives ``und`` with score 0, and so does an empty model.
    Ties go to the first language by name. Only the text is read; rows are never moved; existing
    columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return Identifier(shared.value, model_path)

    return per_text(docs, make, "lang_pred string, score double", column)
