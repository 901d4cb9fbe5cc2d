"""Operators that look at one text at a time, against plain versions, libraries and held-out labels."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from webfurrow.llm import byte_bpe, decontamination, language_id, licenses, pii, queries, sharding, token_counts, toxicity
from webfurrow.llm.common import stage

SF = "/root/testdata/sf0.001"
LONG = "alpha beta9 " * 20_000
ODD = [None, "", " ", "\n\n", "0", "é", "世界😀", "▁ ▁", LONG, "x" * 30_000, "1" * 3_000, "a." * 2_000,
       "CC BY-NC; cc by. All Rights Reserved all rights reserved", "the GNU General Public License",
       "a@b.c+d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "+1 (222) 555-2485 +12345678901234567890",
       "4111 1111-1111 1111 and 4111111111111112", "call 555-123-4567 now", "jane [at] mail [dot] org"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    letters = "ab1234567890 .+-()@%é\n😀:=[at]CC BY all rights reserved "
    made = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 90))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([*ODD, *made, "same text", "same text"])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = texts + [(10_000 + r["doc_id"], r["text"]) for r in given]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts_equal_the_library(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for r in token_counts.count_tokens(docs, queries.PIECES).collect():
        assert r["n_tokens"] == len(model.encode(r["text"] or "")), r["doc_id"]
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 4096)


def test_byte_pairs_equal_the_library_and_round_trip(docs):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.load_ranks(queries.RANKS))
    encoded = byte_bpe.encode_texts(docs, queries.RANKS, public_tokenizers.PATTERN)
    for r in byte_bpe.decode_ids(encoded, queries.RANKS).collect():
        want = library.encode_ordinary(r["text"] or "")
        assert r["token_ids"] == want and r["n_tokens"] == len(want) and r["decoded"] == (r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == brute.sha(r["text"] or "")


def test_replay_waits_for_a_lower_pair():
    # "abc" ranks below "ab", so the second "ab" of a word must wait until "abc" is done.
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 301, b"ca": 302, b"cab": 303}
    table = byte_bpe.MergeTable(ranks)

    def alone(word):
        parts = [word[i:i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 12))) for _ in range(500)]
    assert [byte_bpe.unpack(p) for p in byte_bpe.replay(words, table)] == [alone(w) for w in words]
    assert byte_bpe.replay([], table) == []


def test_license_scan_equals_plain_search(docs):
    for r in licenses.scan_licenses(docs).collect():
        want = brute.licenses(r["text"])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("text, names, value", [
    ("mit or gpl-2.0-only", ["mit", "gpl-2.0-only"], 0.9), ("mit and gpl-3.0", ["mit", "gpl-3.0"], 0.4),
    ("mit or gpl-3.0 and cc-by-nc-4.0", ["mit", "gpl-3.0", "cc-by-nc-4.0"], 0.9),
    ("( mit or gpl-3.0 ) and cc-by-nc-4.0", ["mit", "gpl-3.0", "cc-by-nc-4.0"], 0.2),
    ("gpl-2.0 with classpath-exception-2.0", ["gpl-2.0"], 0.6), ("unheard-of", ["unheard-of"], licenses.UNKNOWN)])
def test_license_expressions(text, names, value):
    assert licenses.evaluate(text.split()) == (names, value)


@pytest.mark.parametrize("text", ["", "and mit", "mit or", "( mit", "mit )", "mit gpl", "mit with ( x )"])
def test_broken_license_expressions(text):
    assert licenses.evaluate(text.split()) is None


def test_license_tag_is_read_to_its_end():
    row = licenses.Scanner()("x\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib\nnext line")
    assert row["expressions"] == ["( mit or apache-2.0 ) and zlib"] and row["labels"] == "apache-2.0,mit,zlib" and row["score"] == 0.9


def test_contamination_equals_plain_search(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(900, None), (901, ""), (902, "cc by"), (903, "cc by"), (904, "alpha beta9 " * 7), (None, "世界😀")]
    windows = brute.item_windows([i for i in items if i[0] is not None])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [by_id(decontamination.find_contamination(docs, benchmark, block_bytes=n)) for n in (24 << 20, 20_000)]
    assert found[0] == found[1]  # more blocks, same rows
    for r in found[0].values():
        want = brute.contamination(r["text"], windows)
        if "世界" not in (r["text"] or ""):
            assert {k: r[k] for k in want} == want, r["doc_id"]
        else:  # an item without id hits but is not listed
            assert r["contaminated"] and r["n_items"] == 0


def test_personal_data_keeps_every_base_span(docs):
    models = pii.train(docs)
    for r in pii.find_pii(docs, models).collect():
        want, listed = brute.pii(r["text"])
        spans = [s for s in r["spans"].split(",") if s]
        assert {k: r[k] for k in want} == want and set(listed) <= set(spans), r["doc_id"]
    redacted = stage(pii.redact(docs, models), "redacted")
    clean = by_id(redacted)
    assert clean[0]["text"] is None and clean[1]["text"] == "" and clean[8]["text"] == LONG
    assert clean[ODD.index("a@b.c+d@e.f x@y@z.com")]["text"] == "[EMAIL][EMAIL] x@[EMAIL]"
    assert pii.find_pii(redacted, models).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert redacted.columns == docs.columns


def test_written_examples_are_every_place_before_every_value(spark):
    wanted = sorted((kind, right, before + value + after) for kind, sides in pii.EXAMPLES.items() for right, groups in zip((True, False), sides)
                    for befores, values in groups for before in befores for value in values for after in ("", " today", ".\nNext"))
    rows = pii.examples(spark).collect()
    assert sorted((r["kind"], r["right"], r["text"]) for r in rows) == wanted and {r["fold"] for r in rows} == {0, 1, 2, 3}


def test_long_secrets_are_redacted_whole(spark):
    models = {kind: pii.Boosted(0.0, [], 0.0) for kind in pii.KINDS}  # every proposal passes
    secret = "eyJhbGciOiJIUzI1NiJ9." + "Ab3_x-Z9" * 150 + ".Tail0"
    assert len(secret) > 1000
    docs = spark.createDataFrame([(1, f"use token={secret} now"), (2, f'api_key: "{secret * 20}"')], "doc_id long, text string")
    clean = by_id(stage(pii.redact(docs, models), "redacted"))
    assert clean[1]["text"] == "use token=[SECRET] now" and clean[2]["text"] == 'api_key: "[SECRET]"'
    spans = by_id(pii.find_pii(docs, models))
    assert spans[1]["spans"] == f"secret:10:{10 + len(secret)}"


@pytest.fixture(scope="module")
def judges(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_trees_use_context(judges):
    context = {"cue", "against", "sign", "quote", "edge", "start"}
    for kind, model in judges.items():
        assert len(model.splits() & context) >= 2 and not math.isinf(model.threshold), kind


FOUND = {
    "password: hunter2": "secret:10:17", "tel 555 123 44": "phone:4:14", "token:    'abcd1234efgh'": "secret:11:23",
    "jane [at] a.b.c.d.e.f.g.h.org": "email:0:29", "server 2001:db8::1 down": "ip:7:18", "card 4111.1111.1111.1111": "card:5:24",
    "mail " + "x" * 100 + " [at] host [dot] com": "email:5:125", "call +1 (222) 555-2485 or a@b.com": "email:26:33,phone:5:22",
    "tel 555 123 44 card 4012 8888 8888 1882 10.1.1.1": "ip:40:48,card:20:39,phone:4:14"}
LEFT = ["see note [at] chapter.seven today", "page 123-456-789 of index", "order 2020 12 3456 7890", "password: required", "meet at 12:30:45",
        "serial 4111/1111/1111/1111", "", "std::vector<int>", "a: b: c", "1 2 3 4 5 6"]


def test_candidates_are_judged_by_format_and_context(spark, judges):
    rows = list(enumerate([*FOUND, *LEFT, None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.find_pii(docs, judges))
    assert {t: got[i]["spans"] for i, t in rows if t in FOUND} == FOUND
    assert all(got[i]["spans"] == "" for i, t in rows if t not in FOUND)


def test_overlaps_go_to_the_higher_odds(spark):
    spans = [("phone", 0, 10, 1.0), ("card", 5, 20, 3.0), ("ip", 18, 25, 2.0), ("secret", 30, 40, 0.5), ("email", 35, 36, None),
             ("ip", 36, 38, 0.1), ("email", 50, 60, None), ("phone", 55, 65, None), ("card", 70, 72, 1.0), ("phone", 70, 72, 1.0)]
    rnd = random.Random(2)
    rnd.shuffle(spans)
    df = spark.createDataFrame([(spans,), ([],)], "s array<struct<kind:string,start:int,stop:int,odds:double>>")
    got = [sorted((s["kind"], s["start"]) for s in r["k"]) for r in df.select(pii.settled(F.col("s")).alias("k")).collect()]
    assert got == [[("card", 5), ("card", 70), ("email", 35), ("email", 50), ("ip", 36), ("phone", 55)], []]


def test_many_spans_in_one_text(spark, judges):
    many = "a@b.c " * 16_000
    docs = spark.createDataFrame([(1, many), (2, "é 1.2.3.4 x " * 1000)], "doc_id long, text string").coalesce(1)
    pii.find_pii(docs, judges).collect()  # plans and compiles
    began = time.time()
    got = by_id(pii.find_pii(docs.withColumn("text", F.concat("text", F.lit("."))), judges))
    assert got[1]["n_email"] == 16_000 and got[1]["spans"].endswith("email:95994:95999") and got[2]["n_ip"] == 1000
    clean = by_id(stage(pii.redact(docs, judges), "redacted"))
    assert clean[1]["text"] == "[EMAIL] " * 16_000 and clean[2]["text"] == "é [IP] x " * 1000
    assert time.time() - began < 60  # most of it is planning; a quadratic pass takes minutes


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.filter(~queries.held_out()), queries.PIECES)
    rows = language_id.identify(docs.filter(queries.held_out()), model, queries.PIECES).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in language_id.identify(odd, model, queries.PIECES).collect():
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.identify(odd, {}, queries.PIECES).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    p = np.array([[0.3], [0.2], [0.1], [0.15], [0.2], [0.05]])
    word = "▁aba"

    def total(i):
        return 1.0 if i == len(word) else sum(p[pieces.index(word[i:j]), 0] * total(j)
                                              for j in range(i + 1, len(word) + 1) if word[i:j] in pieces)

    lattice = language_id.Lattice(pieces)
    (_, codes), = lattice.by_length([word])
    assert lattice.forward(codes, np.vstack([p, [[language_id.FLOOR]]]))[0, 0] == pytest.approx(total(0))
    # Every letter is covered once, so uses weighted by their length give the length of the word.
    used = lattice.expected(codes, np.ones(1), p[:, 0])
    assert sum(n * len(piece) for n, piece in zip(used, pieces, strict=True)) == pytest.approx(len(word))


def test_toxicity_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.filter(~queries.held_out()))
    rows = toxicity.score_toxicity(docs.join(labels.filter(queries.held_out()), "doc_id"), model).collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    none = toxicity.train(docs, labels.filter("false"))
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, none).collect()} == {0}


def test_inputs_tell_how_many_words_share_a_term():
    memo = {w: toxicity.terms(w) for w in ("fooled", "foolish", "foolery")}
    n = len(toxicity.LEVELS)
    begins = toxicity.terms("fooled")[1]  # the first four letters, which all three share
    assert begins in toxicity.terms("foolish") and begins in toxicity.terms("foolery")
    reached = [{k % n for k in toxicity.inputs_of(t, memo) if k // n == begins}
               for t in ("fooled", "fooled fooled", "fooled Foolish", "fooled foolish, foolery", None)]
    assert reached == [{0}, {0}, {0, 1}, {0, 1, 2}, set()]


def test_machine_learns_a_pair_that_weights_cannot():
    rng = np.random.default_rng(0)
    x = (rng.random((400, 2)) < 0.5).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(int)  # either alone, never both
    b, w, v = toxicity.fit(x, y, steps=600)
    z = b + x @ w + 0.5 * (((x @ v) ** 2).sum(axis=1) - x @ (v ** 2).sum(axis=1))
    assert ((z > 0) == (y == 1)).all()


def test_every_word_of_the_sample_is_an_input_and_pairs_are_learned(spark):
    rnd = random.Random(4)
    families = [f"{a}{b}{c}{d}" for a in "bdfg" for b in "aeio" for c in "klmn" for d in "aeiou"]
    rows, labels = [], []
    for i in range(1600):  # each toxic document holds one of 320 words of its own kind
        toxic = i % 2
        words = [f"z{rnd.randrange(400):03d}q" for _ in range(12)]
        words.append(families[i // 2 % 320] + "xyx" if toxic else f"y{rnd.randrange(320):03d}w")
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    known = set(map(int, model.buckets))
    assert all(toxicity.terms(f + "xyx")[0] * len(toxicity.LEVELS) in known for f in families)
    scored = toxicity.score_toxicity(docs, model, threshold=0.5).select("doc_id", "predicted").collect()
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in scored) >= 0.97 * len(scored)
    # A pair none of whose words tells alone, among telling words of other documents.
    rng = np.random.default_rng(3)
    x = np.zeros((1200, 600))
    a, b = rng.random((2, 1200)) < 0.5
    x[:, 0], x[:, 1], x[:, 2:] = a, b, rng.random((1200, 598)) < 0.01
    y = (a == b).astype(int)
    row, column = np.nonzero(x)
    _, far = toxicity.scales_of(row, column, 600, y)
    assert (far > 0).all()
    _, _, v = toxicity.fit((row, column, 600), y, steps=600, scales=(np.ones(600), far))
    assert v[0] @ v[1] > 1


def test_shards_are_even_and_whole(spark, docs):
    rows = sharding.shard_documents(docs, shards=5).collect()
    assert len(rows) == docs.count()
    load, slots, groups = {}, {}, {}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(r["text"], set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for text, s in groups.items() if text is not None)
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    many = sharding.shard_documents(docs, shards=3, items_per_shard=2, rows_per_part=7).collect()  # bundles and parts
    assert sorted(r["doc_id"] for r in many) == sorted(r["doc_id"] for r in rows)
    assert {s: sorted(r["slot"] for r in many if r["shard"] == s) for s in range(3)} == {
        s: list(range(sum(r["shard"] == s for r in many))) for s in range(3)}


def test_longest_first():
    assert sharding.longest_first([(3, "a"), (9, "b"), (5, "c"), (4, "d")], 2) == {"b": 0, "c": 1, "d": 1, "a": 0}
    assert sharding.longest_first([], 2) == {}


def test_empty_tables_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    machine = toxicity.Machine([], 0.0, np.zeros(0), np.zeros((0, toxicity.FACTORS)))
    operators = {
        "n_tokens": lambda d: token_counts.count_tokens(d, queries.PIECES),
        "ids_sha256": lambda d: byte_bpe.encode_texts(d, queries.RANKS, public_tokenizers.PATTERN),
        "labels": licenses.scan_licenses, "n_hit": lambda d: decontamination.find_contamination(d, benchmark),
        "spans": lambda d: pii.find_pii(d, pii.train(d)), "score": lambda d: toxicity.score_toxicity(d, machine),
        "lang_pred": lambda d: language_id.identify(d, {}, queries.PIECES), "slot": sharding.shard_documents}
    wide = docs.filter("doc_id < 12").selectExpr("doc_id", "text", "'x' as `odd name`", *[f"'old' as {n}" for n in operators],
                                                 "cast(null as string) as start", "1 as words", "'z' as item")
    for name, run in operators.items():
        assert run(docs.filter("false")).count() == 0
        out = run(wide)
        assert len({c.lower() for c in out.columns}) == len(out.columns) and set(wide.columns) <= set(out.columns)
        got = out.collect()
        assert len(got) == 12 and all(r[name] != "old" and r["odd name"] == "x" and r["words"] == 1 for r in got), name
    assert toxicity.train(docs, labels).buckets == []
