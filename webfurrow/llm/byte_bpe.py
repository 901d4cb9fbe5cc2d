"""Byte-level pair encoding and decoding by replaying merges over a batch of words."""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfurrow.llm.common import per_text, small_batches, without


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTable:
    """Ranks of pairs of ids, and of pairs of bytes as an array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.first = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], dtype=np.int64)
        #: left id * SHIFT + right id -> id of the joined token, which is also the rank of the merge
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * SHIFT + right] = rank


NONE = 1 << 40
SHIFT = 1 << 32


def replay(words: list[bytes], table: MergeTable) -> list[bytes]:
    """Ids of each non-empty word, packed. The words are one corpus; no word is merged on its own.

    An inverted index maps the rank of a pair to the positions where it stands, over all
    words laid end to end. Ranks are replayed in ascending order; all positions of a rank are
    merged from left to right, and only the pairs of the two touched neighbours enter the
    index. If a merge gives a pair of no higher rank than the one being replayed, the rest of
    that word's positions waits in the index until the lower pair is done, as it would if the
    word were merged alone.
    """
    if not words:
        return []
    text = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(text)
    ends = np.cumsum([len(w) for w in words])
    ids = table.of_byte[text].tolist()
    first = np.full(n, NONE, dtype=np.int64)
    first[:-1] = table.first[text[:-1], text[1:]]
    first[ends - 1] = NONE  # no pair reaches into the next word
    following = np.arange(1, n + 1)
    following[ends - 1] = -1
    preceding = np.arange(-1, n - 1)
    preceding[ends[:-1]] = -1
    preceding[0] = -1
    after, before, pair = following.tolist(), preceding.tolist(), first.tolist()
    # The index starts with the byte pairs, sorted by rank and then position.
    order = np.argsort(first, kind="stable")[:int((first < NONE).sum())]
    starts = np.flatnonzero(np.diff(first[order], prepend=-1))
    index = {int(first[order[s]]): order[s:e].tolist()
             for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True)} if len(order) else {}
    heap = sorted(index)
    joins = table.pairs.get
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank)
        places.sort()
        waits = -1
        for i in places:
            if pair[i] != rank:
                continue  # merged away, or listed twice
            if i < waits:
                if rank in index:
                    index[rank].append(i)
                else:
                    index[rank] = [i]
                    heapq.heappush(heap, rank)
                continue
            j = after[i]
            ids[i] = rank
            pair[j] = -1
            k = after[i] = after[j]
            low = NONE
            if k >= 0:
                before[k] = i
                pair[i] = low = joins(rank * SHIFT + ids[k], NONE)
                if low < NONE:
                    if low in index:
                        index[low].append(i)
                    else:
                        index[low] = [i]
                        heapq.heappush(heap, low)
            else:
                pair[i] = NONE
            h = before[i]
            if h >= 0:
                pair[h] = new = joins(ids[h] * SHIFT + rank, NONE)
                if new < NONE:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(heap, new)
                    low = min(low, new)
            if low <= rank:
                waits = int(ends[np.searchsorted(ends, i, side="right")])
    alive = np.array(pair) >= 0
    packed = np.array(ids, dtype="<u4")[alive].tobytes()
    stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
    return [packed[s:e] for s, e in zip([0, *stops[:-1]], stops, strict=True)]


class ByteEncoder:
    """Encodes and decodes texts of a task batch by batch.

    Ids of words seen before are kept as packed bytes up to ``memory`` words, so that a batch
    replays merges for its new words only.
    """

    def __init__(self, rank_path: str, pattern: str, memory: int = 300_000):
        import regex

        self.table = MergeTable(load_ranks(rank_path))
        self.tokens = {rank: token for token, rank in self.table.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.memory = memory

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        parts = [self.find(t) for t in texts]
        if len(self.known) > self.memory:
            self.known.clear()
        new = sorted({word for part in parts for word in part}.difference(self.known))
        raw = [w.encode() for w in new]
        whole = self.table.ranks.get
        # A word that is a token needs no replay: the ranks hold it whole.
        ready = {w: np.array(whole(r), dtype="<u4").tobytes() for w, r in zip(new, raw, strict=True) if r in self.table.ranks}
        rest = [(w, r) for w, r in zip(new, raw, strict=True) if w not in ready]
        self.known.update(ready)
        self.known.update(zip([w for w, _ in rest], replay([r for _, r in rest], self.table), strict=True))
        look = self.known.__getitem__
        return [b"".join(map(look, part)) for part in parts]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, unpack(packed)))


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, column: str = "text", ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if ``ids``, the ids as ``token_ids``.

    Null counts as empty: no ids, both digests those of no bytes. Texts of any length are encoded
    whole; repeated rows give equal rows; columns of these names are replaced. A task holds one
    batch of texts and a bounded memo of words.
    """
    def make():
        encoder = ByteEncoder(rank_path, pattern)

        def run(texts):
            packed = encoder.encode([t or "" for t in texts])
            out = {"n_tokens": [len(p) // 4 for p in packed],
                   "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                   "decoded_sha256": [hashlib.sha256(encoder.decode(p)).hexdigest() for p in packed]}
            if ids:
                out["token_ids"] = [unpack(p) for p in packed]
            return out
        return run

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if ids else "")
    return per_text(docs, make, schema, column)


def decode_ids(docs: DataFrame, rank_path: str, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``column``'s ids as ``out``; null ids give null, invalid UTF-8 its replacement character."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        tokens = {rank: token for token, rank in load_ranks(rank_path).items()}
        return pd.Series([None if v is None else b"".join(tokens[int(i)] for i in v).decode("utf-8", "replace")
                          for v in values], dtype=object)

    return without(docs, [out]).withColumn(out, decoded(F.col(f"`{column}`")))
