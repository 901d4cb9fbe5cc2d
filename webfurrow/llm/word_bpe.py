"""Pair encoding of lower-cased words over a table of distinct words, and decoding through the id-to-piece table.

Texts are split in blocks. A block keeps its texts as numbers into its own list of words; the lists of all
blocks give the table of distinct words, and each of them is encoded once. The ids come back to the
blocks by the words' numbers, meet the id-to-piece table there, and are put in the places of the words.
Texts are split twice, for the lists and for the numbers, since to store either takes more than the time.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfurrow.llm.common import per_text, small_batches, without

#: Characters and texts of a block, at most, but for a longer text, which is a block of its own.
BLOCK_CHARS, BLOCK_TEXTS = 40_000_000, 200_000
#: Words of a list in one batch.
LIST_ROWS = 50_000
OUTPUT = ["token_ids", "decoded"]

# How the vocabulary marks the end of a word, and how its file says that texts are split.
WORD_END = "</w>"
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters whose properties have not changed since the tables that vocabularies of this kind were used with.
_SETTLED = r"\x00-\u0557\u1e00-\u1eff\u2010-\u2064\u20ac\u3000-\u3029\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one above 255."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordVocabulary:
    """Pieces, merges and special pieces of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [{}])[0]
        if model["end_of_word_suffix"] != WORD_END or split.get("pattern") != {"Regex": _PARTS} or spec["decoder"] is not None:
            raise ValueError(f"{path} is no vocabulary of lower-cased words with word ends")
        if len(model["vocab"]) + len(spec["added_tokens"]) > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        #: (left id, right id) -> rank, id of the joined piece
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            self.merges.setdefault((self.ids[left], self.ids[right]), (rank, self.ids[left + right]))

    def pieces(self) -> dict[int, str]:
        return {i: piece for piece, i in (self.ids | self.special).items()}

    def encode(self, word: str) -> list[int]:
        """Ids of one word: the lowest-ranked pair is merged, the leftmost first, until none is left."""
        if word in self.special:
            return [self.special[word]]
        spelled = [self.letters[b] for b in word.encode("utf-8")]
        spelled[-1] += WORD_END
        ids: list[int | None] = [self.ids[s] for s in spelled]
        n, merge = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(*found, i, i + 1) for i in range(n - 1) if (found := merge((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, joined, i, j = heapq.heappop(heap)
            # A pair is up to date if its two places still stand, side by side, with the pieces it joins.
            if ids[i] is None or after[i] != j or ids[j] is None or merge((ids[i], ids[j]), (0, None))[1] != joined:
                continue
            ids[i], ids[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := merge((joined, ids[k]))) is not None:
                    heapq.heappush(heap, (*found, i, k))
            h = before[i]
            if h >= 0 and (found := merge((ids[h], joined))) is not None:
                heapq.heappush(heap, (*found, h, i))
        return [i for i in ids if i is not None]


def splitter(path: str) -> Callable[[str], list[str]]:
    """The words of a text. Special pieces in a text are words of their own, found before lower-casing.

    Plain texts are split here. A text with a character outside the settled ones is split by the
    library's own tables, since those of two libraries seldom have the same age.
    """
    import regex
    from tokenizers import Tokenizer

    special = sorted(WordVocabulary(path).special, key=len, reverse=True)
    around = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else lambda text: [text]
    ascii_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
    words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+").findall
    settled = re.compile(f"[{_SETTLED}]*").fullmatch
    library = Tokenizer.from_file(path)
    steps = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def plain(text: str) -> list[str]:
        if text.isascii():
            return ascii_words(text.lower())
        if settled(text):
            # A capital sigma is lower-cased alike wherever it stands.
            return words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        clean = steps[0](text)
        return [clean[start:stop] for _, (start, stop) in steps[1](clean)]

    known = set(special)

    def split(text: str) -> list[str]:
        parts = around(text)
        if len(parts) == 1:
            return plain(text)
        return [word for part in parts for word in ([part] if part in known else plain(part))]

    return split


def pack(numbers: Sequence[int], kinds: int) -> bytes:
    """Numbers below ``kinds``: their lower 16 bits and then, if there are so many, what is above, which is mostly zero; deflated."""
    x = np.asarray(numbers, dtype=np.uint32)
    low = x.astype("<u2").tobytes()
    return zlib.compress(low if kinds <= 1 << 16 else low + (x >> 16).astype(np.uint8 if kinds <= 1 << 24 else "<u2").tobytes(), 1)


def unpack(packed: bytes, kinds: int) -> np.ndarray:
    packed = zlib.decompress(packed)
    if kinds <= 1 << 16:
        return np.frombuffer(packed, dtype="<u2").astype(np.int64)
    high = np.uint8 if kinds <= 1 << 24 else "<u2"
    n = len(packed) // (2 + np.dtype(high).itemsize)
    return np.frombuffer(packed, dtype="<u2", count=n) + (np.frombuffer(packed, dtype=high, offset=2 * n).astype(np.int64) << 16)


class Numbers(dict):
    """Numbers its keys in the order they are asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


def checksum(marks) -> int:
    """One number for the words of a block in their order, from a number for each."""
    return zlib.crc32(np.asarray(marks, dtype="<u4").tobytes())


def _block_rows(path: str, column: str, block_chars: int, lists: bool):
    """Function of Arrow batches. With ``lists``: the words of each block with their places, the block's number and the word's
    in one. Else: the other columns, the block, a checksum of its words, and the numbered words in the place of the text. Blocks are cut
    by the order of the rows alone, so that both see the same."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, made = splitter(path), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []
        known = Numbers()
        texts_in, chars = 0, 0

        def flush():
            block = (part << 20) + made
            if lists:
                words = list(known)
                if len(words) > 1 << 26:
                    raise ValueError("a text has more words than a block can number")
                for at in range(0, len(words), LIST_ROWS):
                    some = words[at:at + LIST_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(
                        (block << 26) + np.arange(at, at + len(some), dtype=np.int64))], names=["word", "place"])
                return
            table = pa.Table.from_batches(held)
            for name, values in (("_block", pa.array([block] * len(numbers), pa.int64())),
                                 ("_check", pa.array([checksum([zlib.crc32(w.encode()) for w in known])] * len(numbers), pa.int64())),
                                 ("_numbers", pa.array([pack(x, len(known)) for x in numbers], pa.binary()))):
                table = table.append_column(name, values)
            yield from table.combine_chunks().to_batches()

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column))
            others = batch.drop_columns([column])
            start = 0
            for i, text in enumerate(texts.to_pylist()):
                found = split(text) if text else []
                if texts_in and (chars + len(text or "") > block_chars or texts_in >= BLOCK_TEXTS):
                    if i > start:
                        held.append(others.slice(start, i - start))
                    yield from flush()
                    held, numbers, known, texts_in, chars, start, made = [], [], Numbers(), 0, 0, i, made + 1
                own = np.array(list(map(known.__getitem__, found)), dtype=np.uint32)
                texts_in, chars = texts_in + 1, chars + len(text or "")
                if not lists:
                    numbers.append(own)
            if not lists:
                held.append(others.slice(start))
        if texts_in:
            yield from flush()

    return run


def _put_back(columns: list[str], path: str):
    """Function of a block's rows and its words: ids in the places of the words, and the pieces of the ids."""
    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        kinds = words.num_rows
        order = np.argsort(words.column("place").to_numpy())
        if rows.num_rows and rows.column("_check")[0].as_py() != checksum(words.column("mark").to_numpy()[order]):
            raise RuntimeError("the rows came in another order the second time; stage the documents first")
        packed = words.column("ids").take(pa.array(order)).to_pylist()
        sizes = np.array([len(p) for p in packed], dtype=np.int64) // 2
        flat = np.frombuffer(b"".join(packed), dtype="<u2").astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        # The id-to-piece table has as many rows as the vocabulary; each word of the block is spelled once.
        pieces = pieces_of(path)
        spelled = [" ".join([pieces[i] for i in flat[a:b]]) for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]
        token_ids, decoded = [], []
        for packed in rows.column("_numbers").to_pylist():
            numbers = unpack(packed, kinds)
            own = sizes[numbers]
            inside = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            token_ids.append(flat[np.repeat(starts[numbers], own) + inside])
            decoded.append(" ".join(map(spelled.__getitem__, numbers.tolist())))
        return (rows.select(columns).append_column("token_ids", pa.array(token_ids, pa.list_(pa.int32())))
                .append_column("decoded", pa.array(decoded, pa.string())))

    return run


@lru_cache(maxsize=1)
def pieces_of(path: str) -> dict[int, str]:
    return WordVocabulary(path).pieces()


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, piece``: as many rows as the vocabulary has pieces, whatever the corpus."""
    return spark.createDataFrame(list(pieces_of(path).items()), "id int, piece string")


def decode_ids(table: DataFrame, key: str, path: str, ids: str = "token_ids") -> DataFrame:
    """``key, decoded`` of any table of ids: each id is joined with its piece, and pieces are put in order again.

    ``key`` must be unique and not null. Rows without ids, or with null for them, have an empty text; an
    id that no piece has is left out.
    """
    placed = table.select(key, F.posexplode_outer(ids).alias("_at", "id"))
    found = placed.join(F.broadcast(piece_table(table.sparkSession, path)), ["id"], "left")  # bounded by the vocabulary
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("_at", "piece"))))
    return found.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), " ").alias("decoded"))


def encode_distinct(words: DataFrame, path: str) -> DataFrame:
    """A table of distinct words with ``ids``, packed in 16 bits each: each row's ``word`` is encoded."""
    def make():
        vocabulary = WordVocabulary(path)
        return lambda batch: {"ids": [np.array(vocabulary.encode(word), dtype="<u2").tobytes() for word in batch]}

    return per_text(words, make, "ids binary", "word")


def encode_words(docs: DataFrame, path: str, column: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns of ``docs`` but ``column``, in whose place stand ``token_ids`` and ``decoded``.

    ``decoded`` is what the vocabulary's decoder makes of the ids, special pieces included: pieces joined by
    one blank. Null counts as empty: no ids and an empty string. Special pieces in a text become their
    ids. Whole texts are encoded; repeated rows, ids and clashing names need no care, since a row is
    never looked up by its columns; columns of the added names are replaced. An empty table gives no rows.

    The rows must come in the same order each time they are read, as those of files do; if they don't, the
    job fails and the documents have to be staged first. A task holds one block of texts. The shuffles carry, per
    block, its distinct words and its texts as numbers; no group is larger than a block, or than the number of
    blocks a word occurs in.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = without(docs, [*OUTPUT, "_block", "_numbers", "_check"])
    others = [c for c in kept.columns if c != column]
    text = F.col(f"`{column}`").cast("string").alias(column)
    fields = [f for f in kept.schema.fields if f.name != column]
    # The table of distinct words: where each stands and, worked out once, its ids. It is dealt by the word
    # before it is grouped, as few words of a block stand there twice.
    given = kept.select(*[F.col(f"`{c}`") for c in others], text)
    listed = given.mapInArrow(_block_rows(path, column, block_chars, True), "word string, place long")
    distinct = listed.repartition("word").groupBy("word").agg(F.collect_list("place").alias("places"))
    back = encode_distinct(distinct, path).select(
        F.explode("places").alias("place"), F.crc32("word").alias("mark"), "ids").withColumn("_of", F.shiftright("place", 26))
    rows = given.mapInArrow(_block_rows(path, column, block_chars, False), T.StructType([
        *fields, T.StructField("_block", T.LongType()), T.StructField("_check", T.LongType()), T.StructField("_numbers", T.BinaryType())]))
    out = T.StructType([*fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return rows.groupBy("_block").cogroup(back.groupBy("_of")).applyInArrow(_put_back(others, path), out)
