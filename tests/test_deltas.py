"""Tables by delta against a dictionary; what is read, written and kept."""

import os
import random

from pyspark.sql import functions as F

from webfurrow.sources.deltas import DeltaTable

SCHEMA = "k string, part int, n long"


def table(spark, path, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return DeltaTable(spark, str(path), schema, ["k", "part"], ["k"], **{"buckets": 4, "segments": 3, **options})


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def files(path):
    return {os.path.relpath(os.path.join(folder, f), path): os.path.getsize(os.path.join(folder, f))
            for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_versions_are_the_dictionary(spark, tmp_path):
    rng, t, model = random.Random(3), table(spark, tmp_path), {}
    start = [(f"k{i}", i % 3, i) for i in range(40)]
    t.start(-1, rows(spark, start))
    model = {(k, p): n for k, p, n in start}
    sizes = []
    for version in range(12):
        puts = {(f"k{rng.randrange(60)}", rng.randrange(3)): rng.randrange(1000) for _ in range(8)}
        gone = [(f"k{rng.randrange(60)}", rng.randrange(3)) for _ in range(6)]
        data = [(*k, n) for k, n in puts.items()]
        t.write(version, rows(spark, data), spark.createDataFrame(gone, "k string, part int"))
        if version == 5:  # a batch that is run again
            t.write(version, rows(spark, data), spark.createDataFrame(gone, "k string, part int"))
        for key in gone:
            model.pop(key, None)
        model.update(puts)
        if version % 4 == 3:
            assert {(r.k, r.part): r.n for r in t.read(version).collect()} == model
            assert max(len(s) for s in t.manifest(version).values()) <= 3
        t.retain(version)
        sizes.append(len(files(tmp_path)))
    # No more than the segments two manifests mention.
    assert max(sizes) <= 2 * 4 * 4 and {(r.k, r.part): r.n for r in t.read(11).collect()} == model
    assert {(r.k, r.part): r.n for r in t.read(10).collect()}  # the one before can be read, to be built on again


def test_untouched_buckets_are_neither_read_nor_written(spark, tmp_path):
    t = table(spark, tmp_path, buckets=16)
    t.start(-1, rows(spark, [(f"k{i}", 0, i) for i in range(400)]))
    before = files(tmp_path)
    touched = rows(spark, [("k7", 0, -7), ("k8", 1, -8)])
    buckets = set(t.buckets_of(touched))
    t.write(0, touched)
    new = {f for f in files(tmp_path) if f not in before}
    assert new and {int(f.split("bucket=")[1].split("/")[0]) for f in new} == buckets
    assert {f: s for f, s in files(tmp_path).items() if f in before} == before
    near = t.around(0, touched)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in near.inputFiles()} == buckets
    assert {r.n for r in near.filter("k IN ('k7', 'k8')").collect()} == {-7, 8, -8}
    assert t.read(0).count() == 401


def test_disk_after_many_small_batches_is_bounded(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2, segments=4)
    t.start(-1)
    sizes = []
    for version in range(50):
        t.write(version, spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).alias("part"), (F.col("id") * version).alias("n")))
        t.retain(version)
        sizes.append(sum(files(tmp_path).values()))
    assert max(sizes[25:]) <= 1.2 * max(sizes[:25])
    assert t.read(49).agg(F.sum("n")).first()[0] == 49 * sum(range(200))


def test_empty_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    t.start(-1)
    assert t.read(-1).collect() == [] and t.read(-1).columns == ["k", "part", "n"]
    t.write(0, rows(spark, []), spark.createDataFrame([("a", 1)], "k string, part int"))
    assert t.read(0).collect() == []
    t.write(1, rows(spark, [("a", 1, 5), (None, 2, 6)]))
    t.write(2, None, spark.createDataFrame([("a", 1)], "k string, part int"))
    assert [tuple(r) for r in t.read(2).collect()] == [(None, 2, 6)]
