"""Groups of aliases, components and as-of lookups against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from webfurrow import schemas
from webfurrow.operators import alias_groups as ag
from webfurrow.operators.components import components
from webfurrow.operators.lookup import as_of
from webfurrow.plans.replay import known_at, store
from webfurrow.session import default_stage


class Plain:
    """The seen table as a dictionary: key -> hash, count, names."""

    def __init__(self):
        self.seen = {}

    def delete(self, key):
        for name in self.seen.get(key, (0, 0, []))[2]:
            self.seen.pop(name, None)

    def hit(self, key, n):
        for name in self.seen.get(key, (0, 0, []))[2]:
            if name in self.seen:
                page_hash, count, names = self.seen[name]
                self.seen[name] = (page_hash, count + n, names)
        return key in self.seen

    def store(self, key, names, page_hash):
        old = self.seen.get(key)
        every = sorted({key, *names, *(old[2] if old else [])})
        for name in every:
            self.seen[name] = (page_hash, 1, every)
        return old is None, old is None or bin(old[0] ^ page_hash).count("1") >= 3


def happen(rng, keys, n, *tables):
    """The same events on all tables, whose answers must agree."""
    for number in range(n):
        key, kind = rng.choice(keys), rng.random()
        if kind < 0.15:
            answers = {t.delete(key) for t in tables}
        elif kind < 0.5:
            hits = rng.randint(1, 3)
            answers = {t.hit(key, hits) for t in tables}
        else:
            names, page_hash = [key, *rng.sample(keys, rng.randint(0, 2))], rng.randint(0, 15)
            answers = {t.store(key, names, page_hash, *([f"g{number}"] if isinstance(t, ag.Replay) else [])) for t in tables}
        assert len(answers) == 1


def test_replay_is_the_plain_table():
    rng = random.Random(3)
    for _ in range(500):
        plain, replay = Plain(), ag.Replay()
        happen(rng, "abcdefgh"[:rng.randint(2, 8)], rng.randint(1, 40), plain, replay)
        flat = {k: (replay.groups[g].page_hash, replay.groups[g].count + extra, sorted(replay.groups[g].live | replay.groups[g].stale))
                for k, (g, extra) in replay.of_key.items()}
        assert flat == plain.seen


@pytest.fixture(scope="module")
def mixed(spark):
    """Tables of several spiders after many events, with names that have moved between lists."""
    rng, tables = random.Random(11), {}
    for number in range(12):
        plain = Plain()
        happen(rng, [f"{c}{number % 3}" for c in "abcdefg"], 30, plain)
        tables[f"s{number}"] = plain
    rows = [(s, k, h, n, names) for s, t in tables.items() for k, (h, n, names) in t.seen.items()]
    return tables, spark.createDataFrame(rows, schemas.SEEN)


def as_tables(flat):
    out = {}
    for r in flat.collect():
        out.setdefault(r.spider, {})[r.key] = (r.page_hash, r["count"], r.alternatives)
    return out


def test_groups_hold_any_flat_table(spark, mixed):
    tables, flat = mixed
    stage = default_stage(spark, "groups")
    state = ag.grouped(flat, stage)
    assert as_tables(state.flat()) == {s: t.seen for s, t in tables.items() if t.seen}
    # Lists that share a name have one component.
    assert state.aliases.groupBy("spider", "key").agg(F.countDistinct("comp").alias("n")).filter("n > 1").count() == 0
    rng = random.Random(1)
    hits = [(s, f"{c}{n}", rng.randint(1, 5)) for s in tables for c in "abz" for n in range(3)]
    raised, found = ag.hit(state, spark.createDataFrame(hits, "spider string, key string, n long"), stage)
    known = {(s, k) for s, k, n in hits if k in tables[s].seen}
    want = {s: Plain() for s in tables}
    for s, t in tables.items():
        want[s].seen = dict(t.seen)
    for s, k, n in hits:
        want[s].hit(k, n)
    assert {tuple(r) for r in found.collect()} == known
    assert as_tables(raised.flat()) == {s: t.seen for s, t in want.items() if t.seen}
    gone = [(s, f"a{n}") for s in tables for n in range(3)]
    left = ag.remove(raised, spark.createDataFrame(gone, "spider string, key string"), stage)
    lists = {(s, k): want[s].seen.get(k, (0, 0, []))[2] for s, k in gone}
    for (s, _), names in lists.items():
        for name in names:
            want[s].seen.pop(name, None)
    assert as_tables(left.flat()) == {s: t.seen for s, t in want.items() if t.seen}


def test_pages_are_stored_one_by_one(spark, mixed):
    tables, flat = mixed
    stage, rng = default_stage(spark, "store"), random.Random(8)
    want = {s: Plain() for s in tables}
    for s, t in tables.items():
        want[s].seen = dict(t.seen)
    pages = []
    for n in range(150):
        s = rng.choice(sorted(tables))
        keys = [f"{c}{rng.randint(0, 2)}" for c in rng.sample("abcdefghij", 3)]
        pages.append((s, f"http://{keys[0]}/", rng.randint(0, 15), [f"https://{k}" for k in keys], n))
        want[s].store(keys[0], keys, pages[-1][2])
    df = spark.createDataFrame(pages, "spider string, url string, dhash long, alternatives array<string>, n int").withColumn(
        "fetched_at", F.timestamp_seconds(F.col("n"))).drop("n").repartition(5)
    assert as_tables(store(ag.grouped(flat, stage), df, stage).flat()) == {s: t.seen for s, t in want.items()}


def test_a_large_group_costs_what_it_holds(spark):
    names, stage = 10_000, default_stage(spark, "large")
    page = spark.range(1).select(
        F.lit("s").alias("spider"), F.lit("http://k0").alias("url"), F.lit(5).cast("long").alias("dhash"),
        F.transform(F.sequence(F.lit(0), F.lit(names - 1)), lambda n: F.concat(F.lit("http://k"), n)).alias("alternatives"),
        F.timestamp_seconds(F.lit(0)).alias("fetched_at"))
    empty = ag.SeenGroups(spark.createDataFrame([], ag.ALIASES), spark.createDataFrame([], ag.GROUPS))
    state = store(empty, page, stage)
    state = ag.SeenGroups(stage(state.aliases, "a"), stage(state.groups, "g"))
    assert (state.aliases.count(), state.groups.count()) == (names, 1)
    hits = spark.range(names).select(F.lit("s").alias("spider"), F.concat(F.lit("k"), "id").alias("key"), F.lit(2).alias("n"))
    raised, _ = ag.hit(state, hits, stage)
    assert raised.groups.first()["count"] == 1 + 2 * names
    assert raised.aliases.filter("extra <> 0").count() == 0
    again = store(raised, page.withColumn("dhash", F.lit(9).cast("long")), stage)
    assert (again.aliases.count(), again.groups.first()["count"], again.groups.first()["page_hash"]) == (names, 1, 9)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(-5, -5)]
    least = {n: n for e in edges for n in e}
    for _ in range(len(least)):
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), default_stage(spark, "components")).collect()))
    assert got == least


def test_last_event_before_each_row(spark):
    rng = random.Random(4)
    events = [(rng.choice("ab"), rng.randrange(40_000), n) for n in range(60)]
    rows = [(rng.choice("abc"), rng.randrange(40_000), n) for n in range(200)]
    at = F.timestamp_seconds("t")
    e, r = (spark.createDataFrame(x, "k string, t long, n int").withColumn("at", at).drop("t") for x in (events, rows))
    got = {x.n: x.last and x.last.n for x in as_of(r, e, ["k"], ["at", "n"], F.date_trunc("hour", F.col("at")), "last").collect()}
    assert got == {n: max(((te, ne) for ke, te, ne in events if ke == k and (te, ne) <= (t, n)), default=(None, None))[1] for k, t, n in rows}


def test_links_know_the_pages_of_their_time(spark):
    visits = spark.createDataFrame([("s", "p", 10, "u", 1), ("s", "q", 20, "v", 2)], "spider string, key string, t long, visit string, n int")
    links = spark.createDataFrame([("s", "p", 5, "a", 3), ("s", "p", 10, "u", 1), ("s", "p", 10, "z", 4), ("s", "q", 9000, "a", 5),
                                   ("s", "old", 1, "a", 6), ("t", "p", 99, "a", 7)], "spider string, key string, t long, visit string, n int")
    timed = lambda df: df.withColumn("at", F.timestamp_seconds("t")).drop("t")
    stored = spark.createDataFrame([("s", "old")], "spider string, key string")
    got = {r.n: r.known for r in known_at(timed(links), timed(visits), stored, ["at", "visit", "n"]).collect()}
    assert got == {3: False, 1: False, 4: True, 5: True, 6: True, 7: False}
