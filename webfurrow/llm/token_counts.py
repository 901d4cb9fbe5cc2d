"""Token counts of a piece vocabulary by heap-and-linked-list pair merging."""

from __future__ import annotations

import heapq
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.llm.common import Memo, per_text

SPACE = "▁"


class PieceCounter:
    """Counts the tokens of texts for a piece vocabulary with byte fallback.

    The vocabulary file is only read for pieces and scores; the merging is done here. A
    text is cut where no piece can reach across: before a run of spaces and around line
    breaks. If some piece of another vocabulary did, the text would stay whole.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        # A higher score merges first, so its negative is the rank.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.rank)
        lines = any("\n" in piece for piece in self.rank)
        self.parts = re.compile(r"(?s).+" if inner or lines else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.cost = Memo(lambda c: 1 if c in self.rank else len(c.encode()))
        self.memo = Memo(self.count_part)

    def count_part(self, part: str) -> int:
        """Initial symbols minus merges. A character without a piece costs its bytes and never merges."""
        rank, n = self.rank.get, len(part)
        total = sum(map(self.cost.__getitem__, part))
        if n == 1:
            return total
        symbols = list(part)
        # pair[i]: rank of the symbol at i joined to the next one, None if that is no piece or i is gone.
        pair = [rank(part[i:i + 2]) for i in range(n - 1)] + [None]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i, r in enumerate(pair) if r is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            r, i = heapq.heappop(heap)
            if pair[i] != r:
                continue  # one of the two was merged meanwhile
            merges += 1
            j = after[i]
            symbols[i] += symbols[j]
            pair[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = r = rank(symbols[i] + symbols[k])
                if r is not None:
                    heapq.heappush(heap, (r, i))
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = r = rank(symbols[h] + symbols[i])
                if r is not None:
                    heapq.heappush(heap, (r, h))
        return total - merges

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.memo.__getitem__, self.parts.findall(marked)))


def count_tokens(docs: DataFrame, model_path: str, limit: int | Column = 4096, column: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row.

    Null counts as empty: 0 bytes, 0 tokens. Rows are never moved, so repeated rows, ties and
    empty tables need no rule; columns of the three names are replaced. Texts of any length are
    counted whole; memory is bounded by one batch and the memo of words.
    """
    def make():
        counter = PieceCounter(model_path)
        return lambda texts: {"n_tokens": [counter(t) for t in texts]}

    counted = per_text(docs.drop("n_bytes", "over_limit"), make, "n_tokens long", column)
    size = F.coalesce(F.octet_length(F.col(f"`{column}`").cast("string")), F.lit(0)).cast("bigint")
    return counted.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > F.lit(limit)})
