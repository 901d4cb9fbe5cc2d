"""Tables of which a batch writes its changes only: hash buckets with appended segments, merged when read.

A version of a table is a manifest: for each bucket the segments that hold its rows, oldest first. A
batch adds one segment to the buckets it changes; a bucket with too many is written anew as a
single one. Buckets a batch does not touch are neither read nor written, and what no kept manifest
mentions is deleted.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table, and segments of a bucket before it is written anew.
BUCKETS, SEGMENTS = 16, 8


@dataclass(frozen=True)
class DeltaTable:
    """``key``: columns that tell rows apart. ``by``: those of them that a row's bucket is computed from.

    Version ``n`` is written from version ``n - 1`` and the batch only, into folders of its own, and its manifest last:
    a batch that is run again overwrites its own files, and one that died leaves none that count.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    key: Sequence[str]
    by: Sequence[str]
    buckets: int = BUCKETS
    segments: int = SEGMENTS

    # ---- folders

    def _path(self, *parts: object) -> str:
        return "/".join([self.root, *map(str, parts)])

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._files(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        fs, at = self._files(path)
        fs.delete(at, True)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    # ---- versions

    def manifest(self, version: int) -> dict[int, list[int]]:
        """Bucket -> its segments. At most ``buckets * (segments + 1)`` numbers, however large the table."""
        fs, at = self._files(self._path("manifest", f"{version}.json"))
        stream = fs.open(at)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(bucket): segments for bucket, segments in json.loads(text).items()}

    def _commit(self, version: int, manifest: dict[int, list[int]]) -> None:
        fs, at = self._files(self._path("manifest", f"{version}.json"))
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()

    def _write_segment(self, segment: int, rows: DataFrame) -> list[int]:
        """Writes rows by bucket; the buckets that got some."""
        path = self._path("data", f"segment={segment}")
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return [int(n.removeprefix("bucket=")) for n in self._names(path) if n.startswith("bucket=")]

    def start(self, version: int, rows: DataFrame | None = None) -> None:
        """The first version."""
        manifest = {}
        if rows is not None:
            segment = 2 * (version + 2)
            full = rows.select(*self.schema.fieldNames(), F.lit(False).alias("_gone"))
            manifest = {b: [segment] for b in self._write_segment(segment, full)}
        self._commit(version, manifest)

    def write(self, version: int, puts: DataFrame | None = None, gone: DataFrame | None = None) -> None:
        """Version ``version``: the one before with rows of ``puts`` put in by key, and without the keys of ``gone``.

        A key that is in both is put. Neither the old rows nor untouched buckets are read.
        """
        manifest = self.manifest(version - 1)
        names = self.schema.fieldNames()
        parts = []
        if puts is not None:
            parts.append(puts.select(*names, F.lit(False).alias("_gone")))
        if gone is not None:
            none = [F.col(f.name) if f.name in self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            parts.append(gone.select(*none, F.lit(True).alias("_gone")))
        changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if len(parts) > 1:
            changes = self._merged(changes.withColumn("segment", (~F.col("_gone")).cast("int")), keep_gone=True)
        segment = 2 * (version + 2)  # even numbers: changes; odd ones: buckets written anew
        for bucket in self._write_segment(segment, changes):
            manifest.setdefault(bucket, []).append(segment)
        full = [b for b, s in manifest.items() if len(s) > self.segments]
        if full:
            written = self._write_segment(segment + 1, self._read(manifest, full).withColumn("_gone", F.lit(False)))
            for bucket in full:
                manifest[bucket] = [segment + 1] if bucket in written else []
        self._commit(version, {b: s for b, s in manifest.items() if s})

    def retain(self, version: int, keep: int = 2) -> None:
        """Deletes what only versions older than the last ``keep`` up to ``version`` mention."""
        kept = [int(n.removesuffix(".json")) for n in self._names(self._path("manifest")) if n.endswith(".json")]
        for old in [v for v in kept if v <= version - keep]:
            self._delete(self._path("manifest", f"{old}.json"))
        used = {s for v in kept if v > version - keep for segments in self.manifest(v).values() for s in segments}
        for name in self._names(self._path("data")):
            number = int(name.removeprefix("segment="))
            # A segment of a later version may be written just now.
            if number not in used and number < 2 * (version + 2):
                self._delete(self._path("data", name))

    # ---- reading

    def _merged(self, rows: DataFrame, keep_gone: bool = False) -> DataFrame:
        rest = [n for n in [*self.schema.fieldNames(), "_gone"] if n not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "segment").alias("r"))
        if not keep_gone:
            last = last.filter("NOT r._gone")
        flat = last.select(*self.key, "r.*")
        return flat.select(*self.schema.fieldNames(), *(["_gone"] if keep_gone else []))

    def _read(self, manifest: dict[int, list[int]], only: Iterable[int] | None) -> DataFrame:
        wanted = sorted(manifest) if only is None else sorted(set(only) & set(manifest))
        paths = [self._path("data", f"segment={s}", f"bucket={b}") for b in wanted for s in manifest[b]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        fields = [*self.schema.fields, T.StructField("_gone", T.BooleanType()), T.StructField("segment", T.IntegerType()),
                  T.StructField("bucket", T.IntegerType())]
        rows = self.spark.read.schema(T.StructType(fields)).option("basePath", self._path("data")).parquet(*paths)
        return self._merged(rows.drop("bucket"))

    def read(self, version: int, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, of some buckets or of all."""
        return self._read(self.manifest(version), only)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys, which have the ``by`` columns: at most as many as there are."""
        return [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]

    def around(self, version: int, keys: DataFrame) -> DataFrame:
        """The rows of a version in the buckets of the keys."""
        return self.read(version, self.buckets_of(keys))
