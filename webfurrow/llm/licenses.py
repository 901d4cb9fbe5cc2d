"""Licence scan: phrases and tags by Aho-Corasick, licence expressions by shunting-yard."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame

from webfurrow.llm.common import LOWER_TABLE, per_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The phrases every scan counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further phrases and their labels.
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "apache software license": "apache",
    "boost software license": "bsl", "bsd license": "bsd", "cc by nc": "cc-by-nc", "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "eclipse public license": "epl",
    "isc license": "isc", "lesser general public license": "lgpl", "mit license": "mit",
    "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit",
    "proprietary and confidential": "proprietary", "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
}
TAGS = ("spdx-license-identifier:", "license-expression:")

# How freely a text under a licence may be used, 1 as one likes and 0 not at all.
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "mit": 0.9, "isc": 0.9, "bsd": 0.9, "apache": 0.9, "bsl": 0.9,
    "zlib": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3,
    "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "reserved": 0.1, "proprietary": 0.0,
}
UNKNOWN = 0.2
#: An exception ("with") never makes a licence stricter, and opens a copyleft licence for linking.
WITH_EXCEPTION = 0.6
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")


def freedom(name: str) -> float:
    """Value of a licence name; version and suffixes are dropped until the name is known."""
    parts = re.split(r"[-+]", name.replace("apache2", "apache"))
    for n in range(len(parts), 0, -1):
        if (key := "-".join(parts[:n])) in FREEDOM:
            return FREEDOM[key]
    return UNKNOWN


def evaluate(tokens: Sequence[str]) -> tuple[list[str], float] | None:
    """Names and value of an expression; None if it is not well formed.

    Shunting-yard: operators wait on a stack until one of lower precedence, a closing bracket or
    the end. ``or`` leaves the choice (the larger value), ``and`` binds to both (the smaller),
    ``with`` adds an exception to the licence on its left.
    """
    values: list[float] = []
    waiting: list[str] = []
    names: list[str] = []
    operand = True  # whether an operand may come next

    def apply() -> bool:
        op = waiting.pop()
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append({"or": max(left, right), "and": min(left, right), "with": max(left, WITH_EXCEPTION)}[op])
        return True

    exception = False
    for token in tokens:
        if token == "(":
            if not operand or exception:
                return None
            waiting.append(token)
        elif token == ")":
            if operand:
                return None
            while waiting and waiting[-1] != "(":
                if not apply():
                    return None
            if not waiting:
                return None
            waiting.pop()
        elif token in PRECEDENCE:
            if operand:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                if not apply():
                    return None
            waiting.append(token)
            operand, exception = True, token == "with"
        else:
            if not operand:
                return None
            values.append(0.0 if exception else freedom(token))
            if not exception:
                names.append(token)
            operand, exception = False, False
    if operand:
        return None
    while waiting:
        if waiting[-1] == "(" or not apply():
            return None
    return names, values[0]


def read_expression(text: str, at: int) -> list[str]:
    """Tokens from ``at``, as long as they can belong to an expression of one line."""
    tokens, operand, depth = [], True, 0
    while m := TOKEN.match(text, at):
        token = m[1]
        if token == ")" and depth == 0 or token not in PRECEDENCE and token not in "()" and not operand:
            break
        tokens.append(token.rstrip(".:") if token not in "()" else token)
        depth += (token == "(") - (token == ")")
        operand = token in PRECEDENCE or token == "("
        at = m.end()
    while tokens and tokens[-1] in PRECEDENCE:  # the sentence went on
        tokens.pop()
    return tokens


class Scanner:
    def __init__(self):
        import ahocorasick

        self.phrases = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            self.phrases.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE))
        self.phrases.make_automaton()
        self.tags = ahocorasick.Automaton()
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.tags.make_automaton()

    def __call__(self, text: str | None) -> dict:
        text = (text or "").translate(LOWER_TABLE) if not (text or "").isascii() else (text or "").lower()
        words = WORD.findall(text)
        line = f" {' '.join(words)} "
        starts, base, found, value = [], set(), {}, 1.0
        counted, seen = 0, 0  # words before `seen`, a place in the line
        for end, (size, label, is_base) in sorted(self.phrases.iter(line), key=lambda hit: hit[0] - hit[1][0]):
            begin = end - size
            counted += line.count(" ", seen, begin)
            seen = begin
            found[label] = freedom(label)
            if is_base:
                starts.append(counted)
                base.add(label)
        expressions = []
        for end, _ in self.tags.iter(text):
            if (tokens := read_expression(text, end + 1)) and (parsed := evaluate(tokens)):
                names, worth = parsed
                expressions.append(" ".join(tokens))
                value = min(value, worth)
                found.update({name: 1.0 for name in names if name not in found})
        value = min([value, *found.values()])
        return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None),
                "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(found)), "score": value if found else 0.0,
                "expressions": sorted(set(expressions))}


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, expressions array<string>")


def scan_licenses(docs: DataFrame, column: str = "text") -> DataFrame:
    """Adds counts and places of the base phrases, all labels, a score and the licence expressions read.

    The score is 0 without any label, else how freely the text may be used if all its notices hold
    (1: as one likes). Null counts as empty: no words, no labels, null places. Phrases that overlap
    all count; labels are distinct and sorted. Texts are scanned whole, rows are never moved, and
    existing columns of the same names are replaced.
    """
    names = [part.strip().split(" ")[0] for part in SCHEMA.split(", ")]

    def make():
        scan = Scanner()

        def run(texts):
            rows = [scan(t) for t in texts]
            return {n: [None if r[n] is None else r[n] for r in rows] for n in names}
        return run

    return per_text(docs, make, SCHEMA, column)
