"""From raw documents to token ids: language, near duplicates, contamination, personal data, encoding.

Each stage takes all that the one before it kept, written as Parquet, and all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webfurrow.llm import byte_bpe, decontamination, language_id, ngram_join, pii
from webfurrow.llm.common import stage, table
from webfurrow.llm.queries import PIECES, RANKS, held_out

#: Share of the best language in the summed likelihoods that a document needs to stay.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language: null texts, texts without a letter, and those the
    model finds no language for with ``LEAST_LANGUAGE_SCORE``."""
    model = language_id.train(docs.filter(~held_out()), PIECES)
    found = language_id.identify(docs, model, PIECES)
    stays = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(stays).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without words are in no group.

    Rows that share an id are documents of their own; of those with the smallest id of a group the first
    by the text's digest stays. Rows equal in id and text are one document. Rows without id stay, all.
    """
    groups = stage(ngram_join.group_near_duplicates(docs, digests=True), "groups").filter("group IS NOT NULL")
    row = F.struct("doc_id", "text_md5")
    first = groups.groupBy("group").agg(F.min(row).alias("first"))
    # The rows to drop grow with the corpus, so they are never broadcast: one plan at every size.
    later = groups.join(first, ["group"]).filter(row != F.col("first")).select(
        F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct().hint("merge")
    marked = docs.withColumn("_digest", F.md5("text"))
    kept = marked.join(later, (marked.doc_id == later._id) & (marked._digest == later._md5), "left_anti")
    same = F.row_number().over(Window.partitionBy("doc_id", "_digest").orderBy(F.lit(0)))
    return kept.withColumn("_same", same).filter("_same = 1 OR doc_id IS NULL").select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which some window of a benchmark item occurs."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every span of personal data; ``n_chars`` follows the text."""
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, as digests with their number."""
    encoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination),
          ("personal_data", personal_data), ("encoding", encoding)]

#: No SQL can express the learned stages; the tests compare the result with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
