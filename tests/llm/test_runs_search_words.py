"""Runs, ranked search and word encoding against plain versions and the library."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_texts import ODD, SF
from webfurrow.llm import lexical_search, periodic_runs, queries, word_bpe


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- runs

def plain_lyndon(s):
    def lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))
    return [max(n for n in range(1, len(s) - i + 1) if lyndon(s[i:i + n])) for i in range(len(s))]


def plain_runs(words, least_length, least_exponent):
    n, found = len(words), []
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least_exponent * q):
                w = words[i:i + length]
                if not any(w[p:] == w[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_symbols(rnd):
    n, kinds = rnd.randint(1, 80), rnd.randint(1, 4)
    s = [rnd.randrange(kinds) for _ in range(n)]
    a, p = rnd.randrange(n), rnd.randint(1, 9)
    return [s[i] if i < a or rnd.random() < 0.01 else s[a + (i - a) % p] if a + (i - a) % p < n else s[i] for i in range(n)]


def test_lyndon_words_of_every_place():
    rnd = random.Random(5)
    for _ in range(400):
        s = made_symbols(rnd)[:16]
        kinds = {c: i for i, c in enumerate(sorted(set(s)))}
        s = [kinds[c] for c in s]
        assert periodic_runs.lyndon_lengths(s, len(kinds)) == plain_lyndon(s)
        back = [len(kinds) - 1 - c for c in s]
        assert periodic_runs.lyndon_lengths(back, len(kinds)) == plain_lyndon(back)


@pytest.mark.parametrize("least", [(2, 2), (6, 3), (24, 3)])
def test_runs_equal_a_plain_search(least):
    rnd = random.Random(least[0])
    for _ in range(400):
        s = made_symbols(rnd)
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(s), *least).tolist()] == plain_runs(s, *least)


def test_long_repeats_are_found_whole():
    runs = periodic_runs.runs_of(np.arange(300_000) % 7)
    assert runs.tolist() == [[0, 300_000, 7]]
    assert periodic_runs.runs_of(np.zeros(100_000, dtype=int)).tolist() == [[0, 100_000, 1]]


def run_contract(doc_id, text):
    words = periodic_runs.words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24, 3)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_run_query_is_its_contract(spark, tmp_path):
    given = [(r["doc_id"], " ".join((r["text"] or "").split(" ")[:900])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    odd = [t for t in ODD if t is None or len(t) < 5000] + [
        "a b c " * 30, " x".join("uv" * 40), "one\x0btwo\x1cthree four " * 12, "q " * 24, "q " * 23, "a b " * 6 + "z " + "a b " * 20]
    rows = given + [(1000 + i, t) for i, t in enumerate(odd * 4)] + [(None, "k l " * 20), (7, "again and again " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((run_contract(*r) for r in rows), key=repr)
    assert sum(r[1] for r in got) > 30


def test_runs_with_clashing_columns_and_without_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 12, 5, "x")], "doc_id long, text string, Runs int, collapsed string")
    row = periodic_runs.find_runs(df).first()
    assert row["collapsed"] == "a b" and [tuple(r) for r in row["runs"]] == [(0, 24, 2)]
    assert periodic_runs.find_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, least_exponent=1)


# ---- ranked search

def plain_search(docs, items, size=50):
    found = [(i, lexical_search.terms_of(t)) for i, t in docs if i is not None and t]
    counted = [(i, Counter(terms), len(terms)) for i, terms in found if terms]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = {}
    for _, c, _ in counted:
        for term in c:
            df[term] = df.get(term, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(lexical_search.terms_of(text or ""))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c, n in counted:
            m = 50 + 50 * n * n_docs // n_terms
            scores.append((-sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                                for t in terms if t in c), i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:size], 1)]
    return sorted(out, key=repr)


@pytest.fixture
def small_ranges(monkeypatch):
    """Ranges and blocks small enough to have many of them."""
    monkeypatch.setattr(lexical_search, "RANGE_DOCS", 7)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 3)


def test_search_equals_scoring_every_document(spark, small_ranges):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    made = [" ".join(rnd.choice(words[:rnd.choice([5, 60])]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts = made + made[:60] + [None, "", "...", "W1 w1 W2", "é w1", "w3 " * 5000, "世界 😀 w2", None]
    docs = [(i if i != 17 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (4, "w9 w10")]
    items = [(f"i{k}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for k in range(12)]
    items += [("i0", "w59 é"), ("same", "w1"), ("same", "w1"), ("none", "zzz"), ("null", None), ("sign", "!!"), ("wide", " ".join(words) + " 世界")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    index, n_docs = lexical_search.build_index(df)
    assert n_docs == sum(1 for i, t in docs if i is not None and t and lexical_search.terms_of(t))
    asked = spark.createDataFrame(items, "item_id string, text string")
    for size in (50, 3):
        got = lexical_search.search(index, n_docs, asked, size)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, size)


def test_search_without_documents_or_items(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    index, n_docs = lexical_search.build_index(docs)
    assert (n_docs, lexical_search.search(index, n_docs, items).collect()) == (0, [])
    index, n_docs = lexical_search.build_index(items.selectExpr("1L AS doc_id", "text", "2 AS ids", "3 AS terms"))
    assert lexical_search.search(index, n_docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical_search.search(index, n_docs, items.selectExpr("5 AS item_id", "text")).collect()] == \
        plain_search([(1, "one two")], [(5, "one two")])


def test_a_task_holds_one_of_its_ranges_at_a_time(spark, monkeypatch):
    staged, stage = {}, lexical_search.stage

    def kept(df, name, *args, **kw):
        staged[name] = stage(df, name, *args, **kw)
        return staged[name]

    monkeypatch.setattr(lexical_search, "stage", kept)
    rnd = random.Random(2)
    docs = [(i, " ".join(f"{rnd.randrange(10**12):x}" for _ in range(20))) for i in range(3 * 4096)]  # one part, three ranges
    index, n_docs = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    for name in ("postings", "treaps"):  # a row group is what is written, and read, at once
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in staged[name].inputFiles()]
        assert [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)] == [1, 1, 1]
    items = [(f"i{k}", " ".join(rnd.choice(docs[rnd.randrange(len(docs))][1].split(" ")) for _ in range(6))) for k in range(20)]
    got = lexical_search.search(index, n_docs, spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_ranges_of_the_same_ids_are_searched_each(spark):
    docs = [(5, f"w{i % 7} x{i} " * (1 + i % 3)) for i in range(40)]
    index, n_docs = lexical_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(40))
    items = [("a", "w1 w2 x3"), ("b", "x17 x38"), ("c", " ".join(f"w{i}" for i in range(7)))]
    got = lexical_search.search(index, n_docs, spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_squeezed_numbers_come_back():
    for numbers in (np.arange(1000, dtype="<i8")[::-3], np.zeros(0, dtype="<i4"), np.array([255, 0], dtype="u1")):
        assert lexical_search.unsqueeze(lexical_search.squeeze(numbers), numbers.dtype.str).tolist() == numbers.tolist()


def test_treap_keeps_maxima_of_every_cell():
    rng = np.random.default_rng(3)
    places = np.unique(rng.integers(0, 50, (200, 2)), axis=0)
    worth = rng.integers(1, 1000, len(places))
    masks, drops, top = lexical_search.build_treap(places[:, 0], places[:, 1], worth, 6)
    treap = lexical_search.Treap(np.arange(64).astype("<i8").tobytes(), [str(i) for i in range(50)], 6, masks.tobytes(),
                                 drops.astype("<i4").tobytes(), top)
    nodes = [(0, 0, 0, 0)]
    for level in range(6):
        below = []
        for node, r, c, _ in nodes:
            for q in range(4):
                if treap.masks[node] >> q & 1:
                    below.append((int(treap.child[node] + treap.below[treap.masks[node], q]), 2 * r + q // 2, 2 * c + q % 2, 0))
        nodes = below
        for node, r, c, _ in nodes:
            side = 1 << (5 - level)
            inside = (places[:, 0] // side == r) & (places[:, 1] // side == c)
            assert treap.best[node] == worth[inside].max()
    assert len(nodes) == len(places)


# ---- word encoding

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.WORDS)


def made_texts():
    rnd = random.Random(4)
    letters = "abcXYZ 'sStTrReE  0123\n\t.,!?-_é́ÑΣς世界😀İßﬁ \x1c\x85<|endoftext|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 70))) for _ in range(600)]
    return texts + ["a<|endoftext|>b <|STARTOFTEXT|><|startoftext|>", "ΑΣ ΑΣΑ", "՘Ᲊ \U0001f9ff࢏", "it's we'll ,'s 'S"]


@pytest.mark.parametrize("block_chars", [200, 4_000_000])
def test_words_equal_the_library_and_decode(spark, library, block_chars):
    texts = [*ODD, *made_texts(), "same text", "same text"]
    rows = [(i if i % 50 else None, t, f"b{i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _Block string, n int").repartition(3)
    got = {r["n"]: r for r in word_bpe.encode_words(docs, queries.WORDS, block_chars=block_chars).collect()}
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "n", "token_ids", "decoded"}
    for doc_id, text, _, n in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[n]["token_ids"] == want and got[n]["doc_id"] == doc_id, text
        assert got[n]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_ids_of_any_table_are_decoded_by_a_join(spark, library):
    texts = made_texts()[:80]
    rows = [(n, library.encode(t, add_special_tokens=False).ids) for n, t in enumerate(texts)] + [(500, []), (501, None)]
    got = dict(map(tuple, word_bpe.decode_ids(spark.createDataFrame(rows, "n int, token_ids array<int>"), "n", queries.WORDS).collect()))
    assert got == {n: library.decode(ids or [], skip_special_tokens=False) for n, ids in rows}


def test_numbers_are_packed_by_their_bound():
    rnd = random.Random(6)
    for kinds in (1, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1, 1 << 31):
        numbers = [rnd.randrange(kinds) for _ in range(50)] + [0, kinds - 1]
        assert word_bpe.unpack(word_bpe.pack(numbers, kinds), kinds).tolist() == numbers
        assert word_bpe.unpack(word_bpe.pack([], kinds), kinds).tolist() == []


def test_settled_characters_are_split_as_the_library_does(library):
    import re
    split, vocabulary = word_bpe.splitter(queries.WORDS), word_bpe.WordVocabulary(queries.WORDS)
    settled = re.compile(f"[{word_bpe._SETTLED}]").fullmatch
    marks = [c for c in map(chr, range(0x10000)) if settled(c)]
    for start in range(0, len(marks), 20):
        text = " ".join(f"a{c}b 1{c}{c}?" for c in marks[start:start + 20])
        assert [i for w in split(text) for i in vocabulary.encode(w)] == library.encode(text, add_special_tokens=False).ids


def test_word_query_is_its_contract(spark, library):
    for r in queries.op13_word_bpe(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), ["doc_id"]).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_words_of_an_empty_table_and_other_vocabularies(spark):
    assert word_bpe.encode_words(spark.createDataFrame([], "doc_id long, text string"), queries.WORDS).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "  ")], "doc_id long, text string")
    assert sorted(map(tuple, word_bpe.encode_words(empty, queries.WORDS).collect())) == [(1, [], ""), (2, [], "")]
    with pytest.raises(Exception, match="vocabulary of lower-cased words"):
        word_bpe.WordVocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = word_bpe.piece_table(spark, queries.WORDS)
    assert pieces.count() == 49_408 and pieces.agg(F.countDistinct("id")).first()[0] == 49_408
