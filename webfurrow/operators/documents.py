"""Documents: the last good version of a page and its ten latest fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfurrow.operators.lookup import first_n
from webfurrow.operators.seen import KEY
from webfurrow.schemas import DOCUMENTS

# Length of the history, and the time format of its entries.
HISTORY_LENGTH = 10
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm"

BODY = ["url", "raw_html", "blocked", "hash", "domain", "comments", "social"]
INFO = ["url", "raw_html", "blocked", "fetched_time", "status", "history", "hash", "domain", "comments", "social"]
SHORT_INFO = ["url", "fetched_time", "status", "domain", "comments", "social"]


def time_text(at: Column) -> Column:
    return F.date_format(at, TIME_FORMAT)


def with_document_defaults(df: DataFrame) -> DataFrame:
    """Document columns with defaults; time and status come from the newest history
    entry if there is one, else from the row's own columns."""
    types = {f.name: f.dataType.simpleString() for f in DOCUMENTS.fields}
    own = {"fetched_time": "string", "status": "int"}

    def column(name):
        kind = types.get(name) or own[name]
        return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)

    empty_history = F.array().cast(types["history"])
    defaults = {"url": F.lit(""), "raw_html": F.lit(""), "blocked": F.lit(False), "hash": F.lit(0),
                "domain": F.lit(""), "comments": F.lit(0), "history": empty_history,
                "social": F.from_json(F.lit("{}"), types["social"])}
    newest = F.get(column("history"), F.lit(0))
    keys = [c for c in KEY if c in df.columns]
    values = {n: F.coalesce(column(n), d.cast(types[n])) for n, d in defaults.items()}
    values["fetched_time"] = F.when(newest.isNotNull(), newest["fetched_time"]).otherwise(
        F.coalesce(column("fetched_time"), F.lit("")))
    values["status"] = F.when(newest.isNotNull(), newest["status"]).otherwise(
        F.coalesce(column("status"), F.lit(0)))
    return df.select(*keys, *[values[n].alias(n) for n in INFO])


def short_info(df: DataFrame) -> DataFrame:
    """The columns to share without the page itself."""
    full = with_document_defaults(df)
    return full.select(*[c for c in KEY if c in full.columns], *SHORT_INFO)


def document_changes(known: DataFrame, batch: DataFrame, max_doc_bytes: int | None = None) -> DataFrame:
    """What a batch of fetched documents does to the stored ones, a row per key.

    ``known``: spider, key, history of the stored documents, no page bodies.
    ``batch``: KEY, BODY columns, fetched_at, status; any number of rows per key.
    Result: KEY, ``body`` struct (NULL keeps the stored one), new ``history`` and
    ``existed``. A row over ``max_doc_bytes`` that would be stored is skipped.
    """
    good = F.col("status") == 200
    fits = (F.octet_length("raw_html") <= max_doc_bytes) if max_doc_bytes is not None else F.lit(True)
    fits = F.coalesce(fits, F.lit(True))
    at = F.struct("fetched_at", "url")
    micros = F.unix_micros(F.col("fetched_at").cast("timestamp"))
    # The last good row, and without one the first row.
    rank = F.struct(good, F.when(good, micros).otherwise(-micros), F.col("url"))
    bodies = batch.filter(fits).groupBy(*KEY).agg(
        F.max_by(F.struct(*BODY), rank).alias("body"),
        F.max(good).alias("any_good"), F.min(at).alias("first_stored"))
    # Ten rows per key leave each task, whatever the number of fetches.
    recent = first_n(
        batch.filter(fits | ~good).select(*KEY, at.alias("at"), time_text(F.col("fetched_at")).alias("fetched_time"), "status"),
        KEY, [F.col("at").desc()], HISTORY_LENGTH)
    recent = recent.groupBy(*KEY).agg(
        F.sort_array(F.collect_list(F.struct("at", "fetched_time", "status")), asc=False).alias("recent"))
    touched = known.select(*KEY, "history").join(recent.select(*KEY), KEY, "left_semi")
    joined = (recent.join(bodies, KEY, "left")
              .join(touched.withColumn("existed", F.lit(True)), KEY, "left")
              .withColumn("existed", F.coalesce("existed", F.lit(False))))
    stored = F.filter("recent", lambda r: F.col("existed") | F.coalesce(r["at"] >= F.col("first_stored"), F.lit(False)))
    entries = F.transform(stored, lambda r: F.struct(r["fetched_time"].alias("fetched_time"), r["status"].alias("status")))
    old = F.coalesce("history", F.array().cast(DOCUMENTS["history"].dataType))
    return joined.select(
        *KEY, F.when(F.coalesce("any_good", F.lit(False)) | ~F.col("existed"), F.col("body")).alias("body"),
        F.slice(F.concat(entries, old), 1, HISTORY_LENGTH).alias("new_history"),
        "existed", F.size(entries).alias("n_new")).filter("n_new > 0").drop("n_new")


def merge_documents(documents: DataFrame, batch: DataFrame, max_doc_bytes: int | None = None) -> DataFrame:
    """Stored documents after the batch. Untouched rows pass the join once, and if
    the batch is small Spark broadcasts it, so their bodies are not shuffled."""
    changes = document_changes(documents, batch, max_doc_bytes)
    updates = changes.filter("existed").select(*KEY, "body", "new_history")
    kept = documents.join(updates, KEY, "left").select(
        *KEY, *[F.when(F.col("body").isNotNull(), F.col(f"body.{c}")).otherwise(F.col(c)).alias(c) for c in BODY],
        F.coalesce("new_history", "history").alias("history"))
    added = changes.filter("not existed").select(*KEY, "body.*", F.col("new_history").alias("history"))
    return kept.unionByName(added)


def delete_documents(documents: DataFrame, unwanted: DataFrame) -> DataFrame:
    """Documents without those of the unwanted keys."""
    return documents.join(unwanted.select(*KEY).distinct(), KEY, "left_anti")
