"""Joins of documents and vectors, and the pipeline, against plain versions."""

import random

import numpy as np
import pytest

from tests.llm import brute
from webfurrow.llm import embedding_join, ngram_join
from webfurrow.llm.common import connected


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    ids = [*range(0, 42), 90, 95, 100]
    got = connected(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    want = {i: 0 if i <= 40 else 90 if i >= 90 else i for i in ids}
    assert {r["id"]: r["component"] for r in got.collect()} == want
    none = connected(spark.createDataFrame([(3,)], "id long"), spark.createDataFrame([], "a long, b long"))
    assert [tuple(r) for r in none.collect()] == [(3, 3)]


def made_documents():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for n in list(range(1, 40)) * 3 + [60, 100, 300, 1000] * 3:  # near copies of every size
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(4):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, n // 30))):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.4:
                w = w[:len(w) - rnd.randint(0, len(w) // 5)] or w
            out.append(" ".join(w))
    passage = " ".join(rnd.choice(words) for _ in range(60))
    out += [" ".join(rnd.choice(words) for _ in range(rnd.randint(10, 60))) + " " + passage for _ in range(150)]
    chain = [rnd.choice(words) for _ in range(200)]
    for _ in range(60):  # each links with the next few only
        chain = chain[3:] + [rnd.choice(words) for _ in range(3)]
        out.append(" ".join(chain))
    out += ["one two three four five six seven"] * 40 + [None, "", " \n", "A", "a", "a a a a a a a a", "a a a a a"]
    return [(1000 - i, t) for i, t in enumerate(out)]


def test_near_duplicates_equal_all_pairs(spark):
    rows = made_documents()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.group_near_duplicates(docs).collect())
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(tuple(r) for r in ngram_join.group_near_duplicates(docs).collect()) == brute.near_duplicates(rows)


def test_near_duplicates_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.group_near_duplicates(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = ngram_join.group_near_duplicates(some).collect()
    assert len(got) == 4 and {r["component_id"] for r in got if r["doc_id"]} == {1}


def test_near_duplicates_of_rows_that_share_an_id(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one), (2, one), (2, other), (5, other + " end"), (7, None), (7, one), (1, "b"), (1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:3] for r in ngram_join.group_near_duplicates(docs, digests=True).collect())
    assert got == sorted([(1, 46, 1), (2, 46, 1), (2, 46, 2), (5, 47, 2), (7, 0, 7), (7, 46, 1), (1, 1, 1), (1, 1, 1)])


def test_pipeline_drops_copies_only(spark):
    import corpus_pipeline

    one, other = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one), (2, one), (2, other), (2, other), (3, other + " end"), (4, None), (4, None), (5, ""), (None, one), (None, one), (1, one + " x"),
            (6, "alone"), (6, "other alone"), (None, None)]
    want = [(1, min(one, one + " x", key=lambda t: brute.md5(t))), (2, other), (4, None), (5, ""), (6, "alone"), (6, "other alone"),
            (None, None), (None, one), (None, one)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], schema).repartition(4)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_near_duplicates_when_a_row_without_id_comes_first(spark):
    text = " ".join(f"w{i}" for i in range(60))
    far = 1 << 60  # ids that a float cannot hold
    rows = [(None, text), (far + 3, text), (far + 1, text), (far + 5, text + " more"), (None, None), (far + 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [tuple(r) for r in ngram_join.group_near_duplicates(docs).collect()]
    assert sorted(r for r in got if r[0]) == [(far + 1, 56, far + 1), (far + 3, 56, far + 1), (far + 5, 57, far + 1), (far + 7, 1, far + 7)]
    assert sorted(r[1:] for r in got if r[0] is None) == [(0, None), (56, None)]


def test_keys_meet_for_every_linked_pair():
    rng = np.random.default_rng(1)
    for n in [*range(4, 60), 100, 127, 128, 255, 256, 700]:
        for _ in range(4):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            apart = int(rng.integers(0, ngram_join.most_apart(n) + 1))
            gone = int(rng.integers(0, apart + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, apart - gone, dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(ngram_join.keys_of(a), ngram_join.keys_of(b))), (n, apart)
                x, y = ngram_join.dense_sketch(a), ngram_join.dense_sketch(b)
                least = min(len(x), len(y))
                bits = np.unpackbits((ngram_join.folded(x, least) ^ ngram_join.folded(y, least)).view(np.uint8)).sum()
                assert bits <= len(a) + len(b) - 2 * shared


def plain_vectors(rows, cosine=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, n = [], [0] * len(rows)
    for k, i in enumerate(good):
        for j in good[k + 1:]:
            a, b = rows[i][1], rows[j][1]
            if len(a) == len(b):
                a, b = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links.append((i, j))
                    n[i] += 1
                    n[j] += 1
    comp = brute.components([k for k, _ in rows], links)
    return sorted((k, n[i], comp[i], k == comp[i]) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 40])
def test_near_vectors_equal_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(int(i), (centres[i % 20] * (i % 3 + 1) + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.6])).tolist()) for i in range(400)]
    rows += [(500 + i, rows[5][1]) for i in range(60)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15 + [None]), (1004, []),
             (1005, rows[5][1][:7]), (1006, rows[7][1][:7]), (1007, [float("inf")] + [1.0] * 15)]
    vectors = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in embedding_join.near_vectors(vectors, block_bytes=block * 16 * 8).collect())
    assert got == plain_vectors(rows)


def test_blocks_are_cut_by_rows_however_they_are_dealt(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(211)
    boxes = [(i, [i / 10, 0.0], [i / 10 + 0.05, 1.0]) for i in range(13)]
    found = embedding_join.meeting_blocks(spark.createDataFrame(boxes, "block long, lo array<double>, hi array<double>"), 2, 0.16 ** 2)
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(13) for b in range(a, min(13, a + 3))]
    assert sorted(map(tuple, embedding_join.near_vectors(df, 0.9).collect())) == plain_vectors64(rows, 0.9)


def plain_vectors64(rows, cosine):
    u = np.array([v for _, v in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.argwhere(np.triu(u @ u.T >= cosine, 1)).tolist()
    comp = brute.components([k for k, _ in rows], near)
    n = np.bincount(np.array(near, dtype=int).ravel(), minlength=len(rows))
    return sorted((k, int(n[i]), comp[i], k == comp[i]) for i, (k, _) in enumerate(rows))


def test_near_vectors_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_join.near_vectors(empty).count() == 0


def test_pipeline_equals_plain_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "contamination", "personal_data", "encoding"]
    extra = spark.createDataFrame([(90001, None, "en", "s", 0), (90002, "12 34", "en", "s", 5), (90003, "", "en", "s", 0)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), "/root/testdata/sf0.001")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(rows)
    first = {d for d, _, c in brute.near_duplicates(list(rows.items())) if d == c}
    one = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r["doc_id"] for r in one.collect()} == first and one.columns == docs.columns
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    windows = brute.item_windows(items)
    clean = {d for d, t in rows.items() if not brute.contamination(t, windows)["contaminated"]}
    got = corpus_pipeline.contamination(spark, docs, "/root/testdata/sf0.001")
    assert {r["doc_id"] for r in got.collect()} == clean and 0 < len(clean) < len(rows)
    redacted = corpus_pipeline.personal_data(spark, docs, "").collect()
    assert all(not brute.pii(r["text"])[1] and r["n_chars"] == len(r["text"]) for r in redacted)
    assert any(r["text"] != rows[r["doc_id"]] for r in redacted)
    ran = {r["doc_id"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert ran == first & clean


def test_pipeline_rows_equal_the_library_on_redacted_texts(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from webfurrow.llm import byte_bpe, queries

    item = "which of the two rivers that meet below the old bridge is the longer one"
    kept = {1: ("mail a.b@c.org or +1 (555) 123-4567 before noon \U0001F600 10.0.0.1", "mail [EMAIL] or [PHONE] before noon \U0001F600 [IP]"),
            2: ("her password: hunter2 and his e-mail: jane [at] mail [dot] org", "her password: [SECRET] and his e-mail: [EMAIL]"),
            3: ("write to 1.2.3.4@5.6.7.8 today, $1 \\1 [EMAIL]", "write to [EMAIL] today, $1 \\1 [EMAIL]"),
            4: ("<|endoftext|> is three words here",) * 2, None: ("a row without id",) * 2}
    lost = [(5, kept[1][0]), (6, f"she asks: {item}?"), (7, None), (8, "12 34"), (9, "")]
    rows = [(d, text, "en", "s", len(text or "")) for d, text in [*[(d, texts[0]) for d, texts in kept.items()], *lost]]
    sf = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([("i1", item), ("i2", None)], "item_id string, text string").write.parquet(f"{sf}/benchmark.parquet")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=byte_bpe.load_ranks(queries.RANKS))
    want = {}
    for d, (_, text) in kept.items():
        ids = library.encode_ordinary(text)
        want[d] = (len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(text))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = got.collect()
    assert len(found) == len(want) and {r[0]: tuple(r)[1:] for r in found} == want
