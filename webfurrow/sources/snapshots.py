"""The tables of a running crawl in a shared folder: one version per batch, of which only changes are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfurrow.operators.alias_groups import ALIASES, GROUPS, SeenGroups, SeenStep, grouped
from webfurrow.operators.components import Stage
from webfurrow.operators.documents import BODY
from webfurrow.operators.seen import KEY
from webfurrow.schemas import CHANGE_FEED, DOCUMENTS, FRONTIER, HISTORY
from webfurrow.session import staged_under
from webfurrow.sources.deltas import DeltaTable

DOCUMENT_STATE = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("history", HISTORY),
    T.StructField("body_version", T.LongType()),
])
_BODIES = T.StructType([f for f in DOCUMENTS.fields if f.name in KEY + BODY])
_HASH = T.StructType([T.StructField("spider", T.StringType()), T.StructField("key", T.StringType()),
                      T.StructField("dhash", T.LongType())])
_FEED = T.StructType([*_HASH.fields[:2], T.StructField("url", T.StringType()), _HASH["dhash"],
                      T.StructField("fetched_at", T.TimestampType())])
#: Where the lists are that a name stands in.
_PLACES = T.StructType([*_HASH.fields[:2], T.StructField("comp", T.LongType())])
#: Tables a version of which is what its batch gave out.
SCHEMAS = {"fetch_feed": _FEED, "change_feed": CHANGE_FEED, "document_bodies": _BODIES}
#: Tables with a state: schema, key, columns of the bucket.
STATES = {
    "places": (_PLACES, KEY, KEY),
    "aliases": (ALIASES, ["spider", "comp", "grp", "key"], ["comp"]),
    "groups": (GROUPS, ["spider", "comp", "grp"], ["comp"]),
    "frontier": (FRONTIER, FRONTIER.fieldNames(), ["spider", "url"]),
    "document_state": (DOCUMENT_STATE, KEY, KEY),
    "last_hash": (_HASH, KEY, KEY),
}


class Snapshots:
    """Version ``n`` of a table is written from version ``n - 1`` only, so a batch
    that is run again overwrites its own files with the same rows."""

    def __init__(self, spark: SparkSession, root: str, **table_options):
        self.spark = spark
        self.root = root
        self.states = {name: DeltaTable(spark, self.path(name), *what, **table_options) for name, what in STATES.items()}

    def path(self, table: str, version: int | None = None) -> str:
        folder = f"{self.root}/{table}"
        return folder if version is None else f"{folder}/version={version}"

    def write(self, table: str, version: int, df: DataFrame) -> None:
        names = SCHEMAS[table].fieldNames()
        df.select(*names).write.mode("overwrite").parquet(self.path(table, version))

    def read(self, table: str, version: int) -> DataFrame:
        if table in self.states:
            return self.states[table].read(version)
        return self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table, version))

    def read_all(self, table: str, up_to: int) -> DataFrame:
        """All versions of an append-only table, with their number as ``version``."""
        schema = T.StructType([*SCHEMAS[table].fields, T.StructField("version", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.path(table)).filter(F.col("version") <= up_to)

    def discard(self, table: str, version: int) -> None:
        """Delete the files of a version no longer needed."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table, version))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def retain(self, version: int) -> None:
        """Delete what only versions before the last one mention. The last one is kept to be written again."""
        for state in self.states.values():
            state.retain(version)

    def start(self, seen: DataFrame | None = None, frontier: DataFrame | None = None,
              documents: DataFrame | None = None) -> None:
        """Write the tables before the first batch as version -1."""
        empty = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        if seen is None:
            lists = None
        else:
            stage = staged_under(self.path("_staging", -1))
            lists = grouped(seen, stage).staged(stage)
        self.states["aliases"].start(-1, lists and lists.aliases)
        self.states["groups"].start(-1, lists and lists.groups)
        self.states["places"].start(-1, lists and _places(lists))
        self.states["frontier"].start(-1, frontier)
        self.discard("_staging", -1)
        self.write("change_feed", -1, empty["change_feed"])
        self.states["document_state"].start(-1, documents and documents.withColumn("body_version", F.lit(-1).cast("bigint")))
        self.write("document_bodies", -1, documents or empty["document_bodies"])

    # ---- seen table

    def read_seen(self, version: int) -> SeenGroups:
        return SeenGroups(self.read("aliases", version), self.read("groups", version))

    def seen_at(self, version: int) -> StoredSeen:
        return StoredSeen(self, version)

    def write_seen(self, version: int, step: SeenStep) -> None:
        """Stores what a step changed of the lists it touched."""
        before, after = step.before, step.state
        old, new = _places(before), _places(after)
        self.states["aliases"].write(version, after.aliases.subtract(before.aliases), _without(before.aliases, after.aliases, STATES["aliases"][1]))
        self.states["groups"].write(version, after.groups.subtract(before.groups), _without(before.groups, after.groups, STATES["groups"][1]))
        self.states["places"].write(version, new.subtract(old), _without(old, new, KEY))

    # ---- documents

    def write_documents(self, version: int, changes: DataFrame) -> None:
        """Store document changes. Page bodies are only appended; of the state, without
        bodies, only the changed rows are written."""
        bodies = changes.filter(F.col("body").isNotNull()).select(*KEY, "body.*")
        self.write("document_bodies", version, bodies)
        old = self.states["document_state"].around(version - 1, changes.select(*KEY)).select(*KEY, "body_version")
        rows = changes.join(old, KEY, "left").select(*KEY, F.col("new_history").alias("history"), F.when(
            F.col("body").isNotNull(), F.lit(version).cast("bigint")).otherwise(F.col("body_version")).alias("body_version"))
        self.states["document_state"].write(version, rows)

    def documents(self, version: int) -> DataFrame:
        """The document table at a version: each state row with its stored body."""
        state = self.read("document_state", version).withColumnRenamed("body_version", "version")
        bodies = self.read_all("document_bodies", version)
        return state.join(bodies, [*KEY, "version"]).select(*DOCUMENTS.fieldNames())


def _places(lists: SeenGroups) -> DataFrame:
    return lists.aliases.select(*KEY, "comp").distinct()


def _without(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.select(*key).join(new.select(*key), key, "left_anti")


@dataclass(frozen=True)
class StoredSeen:
    """The seen table of a version, read where it is asked for only."""

    store: Snapshots
    version: int

    def around(self, wanted: DataFrame, stage: Stage) -> tuple[DataFrame, SeenGroups]:
        """See ``SeenGroups.around``. The names tell their components, whose buckets are the only ones read."""
        places = self.store.states["places"].around(self.version, wanted)
        known = stage(places.join(wanted, KEY, "left_semi").select(*KEY, "comp"), "known-keys")
        comps = known.select("comp").distinct()
        aliases, groups = (self.store.states[t].around(self.version, comps).join(comps, "comp", "left_semi").select(
            *STATES[t][0].fieldNames()) for t in ("aliases", "groups"))
        return known, SeenGroups(aliases, groups).staged(stage)


@dataclass(frozen=True)
class StoredDocuments:
    """The document state of a version, read where it is asked for only."""

    store: Snapshots
    version: int

    def around(self, keys: DataFrame) -> DataFrame:
        return self.store.states["document_state"].around(self.version, keys).select(*KEY, "history")
