"""The queries of the operators of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfurrow.llm import (byte_bpe, decontamination, embedding_join, language_id, lexical_search, licenses, ngram_join,
                           periodic_runs, pii, sharding, token_counts, toxicity, word_bpe)
from webfurrow.llm.common import table
from webfurrow.llm.sql import SQL  # noqa: F401  with the queries

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "documents").filter(~held_out())
    model = language_id.train(learn, PIECES)
    found = language_id.identify(texts(spark, sf_dir), model, PIECES)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(texts(spark, sf_dir)).drop("text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group_near_duplicates(texts(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(texts(spark, sf_dir), PIECES).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(texts(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "toxic")
    docs = texts(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(texts(spark, sf_dir)).drop("text")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode_texts(texts(spark, sf_dir), RANKS, public_tokenizers.PATTERN, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return pii.find_pii(docs, pii.train(docs)).drop("text")


def looped(doc_id: Column, text: Column) -> Column:
    """The texts that the run query looks at: one in ten, by the checksum of its id, repeats a stretch up to its end."""
    hashed = F.crc32(doc_id.cast("string"))
    words, seed = F.col("_words"), F.floor(hashed / 10)
    n = F.size(words)
    start = F.pmod(seed, n)
    period = 1 + F.floor((n - start) / (3 + F.pmod(seed, F.lit(8))))
    place = lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int")
    loop = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")
    return F.when((hashed % 10 == 0) & (n > 0), loop).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.when(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.col("text"))
    words = F.regexp_extract_all(chosen, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = texts(spark, sf_dir).withColumn("_words", words).select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(
        b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, n_docs = lexical_search.build_index(texts(spark, sf_dir))
    return lexical_search.search(index, n_docs, table(spark, sf_dir, "benchmark"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = word_bpe.encode_words(texts(spark, sf_dir), WORDS)
    return encoded.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_license_scan, op3_ngram_join, op4_token_counts, op5_decontamination, op6_toxicity,
    op7_embedding_join, op8_sharding, op9_byte_bpe, op10_pii,
    op11_periodic_runs, op12_lexical_search, op13_word_bpe)}
