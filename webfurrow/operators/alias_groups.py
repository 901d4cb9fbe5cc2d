"""The seen table by groups of aliases: what it costs grows with the aliases and hits, not with their product.

A stored page writes one list of names. All keys that were stored with the list last belong to its
group, which holds the page hash and the counter once. A key can also stand in older lists, those of
pages whose alias it was before: it then follows its own group but still gets the hits of the older
ones, which it keeps as ``extra``.

``aliases``: a row for each name of a list. ``live`` rows are the stored keys with their group; the others
only stand in the list. ``groups``: a row per list. Lists that share a name have the same ``comp``, so
rows of different ``comp`` never touch each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webfurrow.functions.fingerprint import SIMILARITY_THRESHOLD
from webfurrow.operators.components import Stage, components

ALIASES = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("comp", T.LongType()),
    T.StructField("grp", T.StringType()),
    T.StructField("live", T.BooleanType()),
    T.StructField("extra", T.LongType()),
])
GROUPS = T.StructType([
    T.StructField("spider", T.StringType()),
    T.StructField("comp", T.LongType()),
    T.StructField("grp", T.StringType()),
    T.StructField("page_hash", T.LongType()),
    T.StructField("count", T.LongType()),
])
KEY = ["spider", "key"]
#: Order of the visits of a batch: time, then URL, then all that tells two visits apart.
ORDER = ["at", "visit", "tie", "row"]


@dataclass(frozen=True)
class SeenGroups:
    aliases: DataFrame
    groups: DataFrame

    def keys(self) -> DataFrame:
        """Stored keys: spider, key."""
        return self.aliases.filter("live").select(*KEY)

    def around(self, wanted: DataFrame, stage: Stage) -> tuple[DataFrame, SeenGroups]:
        """``spider, key, comp`` of the wanted keys (each once) that stand in a list, and all lists of these components."""
        known = stage(self.aliases.join(wanted, KEY, "left_semi").select(*KEY, "comp").distinct(), "known-keys")
        comps = known.select("comp").distinct()
        lists = SeenGroups(self.aliases.join(comps, "comp", "left_semi").select(*ALIASES.fieldNames()),
                           self.groups.join(comps, "comp", "left_semi").select(*GROUPS.fieldNames()))
        return known, lists.staged(stage)

    def staged(self, stage: Stage) -> SeenGroups:
        return SeenGroups(stage(self.aliases, "lists"), stage(self.groups, "list-groups"))

    def after(self, step: SeenStep) -> SeenGroups:
        """The whole table after a step that was taken on it."""
        comps = step.before.aliases.select("comp").distinct()
        return SeenGroups(
            self.aliases.join(comps, "comp", "left_anti").select(*ALIASES.fieldNames()).unionByName(step.state.aliases),
            self.groups.join(comps, "comp", "left_anti").select(*GROUPS.fieldNames()).unionByName(step.state.groups))

    def flat(self) -> DataFrame:
        """The seen table with one row per stored key and its whole list of names."""
        names = self.aliases.groupBy("spider", "grp").agg(F.array_sort(F.collect_list("key")).alias("alternatives"))
        whole = self.groups.join(names, ["spider", "grp"])
        return self.aliases.filter("live").select(*KEY, "grp", "extra").join(whole, ["spider", "grp"]).select(
            *KEY, "page_hash", (F.col("count") + F.col("extra")).alias("count"), "alternatives")


@dataclass(frozen=True)
class SeenStep:
    """``judged``: row, is_new, is_changed of each stored visit. ``unknown``: links whose page was not stored
    when they were found, with the ORDER of their page where it matters. ``before`` and ``state``: the
    touched lists before and after the batch; all others stay as they are."""

    judged: DataFrame
    unknown: DataFrame
    before: SeenGroups
    state: SeenGroups


def node(spider: Column, key: Column) -> Column:
    """Number of a key. Keys that share a number only share a component."""
    return F.xxhash64(spider, key)


def grouped(seen: DataFrame, stage: Stage) -> SeenGroups:
    """Groups of a flat seen table."""
    names = F.array_sort(F.array_union(F.coalesce("alternatives", F.array().cast("array<string>")), F.array("key")))
    rows = stage(seen.withColumn("names", names).select(
        *KEY, "page_hash", "count", "names",
        F.md5(F.concat_ws("\0", "spider", F.coalesce(F.col("page_hash").cast("string"), F.lit("")), "names")).alias("grp")), "flat-seen")
    groups = rows.groupBy("spider", "grp").agg(F.min("page_hash").alias("page_hash"), F.min("count").alias("count"), F.first("names").alias("names"))
    members = stage(groups.select("spider", "grp", F.col("count").alias("least"), F.explode("names").alias("key"))
                    .withColumn("node", node(F.col("spider"), F.col("key"))), "members")
    labels = members.groupBy("spider", "grp").agg(F.min("node").alias("label"))
    # Only lists that share a name have to be brought together.
    shared = stage(members.groupBy(*KEY).agg(F.count("*").alias("lists")).filter("lists > 1").select(*KEY), "shared")
    if shared.isEmpty():
        of_group = labels.withColumnRenamed("label", "comp")
    else:
        edges = members.join(shared, KEY, "left_semi").join(labels, ["spider", "grp"]).select(F.col("label").alias("a"), F.col("node").alias("b"))
        joined = components(edges, stage).select(F.col("node").alias("label"), F.col("label").alias("comp"))
        of_group = stage(labels.join(joined, ["label"], "left").select("spider", "grp", F.coalesce("comp", "label").alias("comp")), "comps")
    own = rows.select(*KEY, F.col("grp").alias("own"), "count")
    aliases = members.join(own, KEY, "left").join(of_group, ["spider", "grp"]).select(
        *KEY, "comp", "grp", F.coalesce(F.col("own") == F.col("grp"), F.lit(False)).alias("live"),
        F.when(F.col("own") == F.col("grp"), F.col("count") - F.col("least")).otherwise(F.lit(0)).cast("bigint").alias("extra"))
    return SeenGroups(aliases, groups.join(of_group, ["spider", "grp"]).select(*GROUPS.fieldNames()))


def hit(state: SeenGroups, counts: DataFrame, stage: Stage) -> tuple[SeenGroups, DataFrame]:
    """The lists after ``n`` hits on each key of ``counts`` (spider, key, n), and the keys that are stored.

    A list is raised once, however many names it has. Only names that have moved to another list get
    their share by name.
    """
    found = stage(state.aliases.filter("live").join(counts, KEY).select(*KEY, "grp", "n"), "hits")
    per_group = found.groupBy("spider", "grp").agg(F.sum("n").alias("n"))
    surplus = state.aliases.filter("NOT live").join(per_group, ["spider", "grp"]).groupBy(*KEY).agg(F.sum("n").alias("surplus"))
    aliases = (state.aliases.join(surplus, KEY, "left")
               .withColumn("extra", F.col("extra") + F.when(F.col("live"), F.coalesce("surplus", F.lit(0))).otherwise(0)).drop("surplus"))
    groups = (state.groups.join(per_group, ["spider", "grp"], "left")
              .withColumn("count", F.col("count") + F.coalesce("n", F.lit(0))).drop("n"))
    return SeenGroups(aliases.select(*ALIASES.fieldNames()), groups.select(*GROUPS.fieldNames())), found.select(*KEY)


def remove(state: SeenGroups, keys: DataFrame, stage: Stage) -> SeenGroups:
    """The lists after all names of the lists of ``keys`` (spider, key) were deleted.

    A deleted name stays in the other lists it stands in, and a list without a stored key goes.
    """
    lists = state.aliases.filter("live").join(keys.select(*KEY).distinct(), KEY, "left_semi").select("spider", "grp").distinct()
    gone = stage(state.aliases.join(lists, ["spider", "grp"], "left_semi").select(*KEY).distinct(), "gone")
    left = state.aliases.join(gone.withColumn("_gone", F.lit(True)), KEY, "left")
    cut = F.col("live") & F.col("_gone").isNotNull()
    empty = stage(left.groupBy("spider", "grp").agg(F.max(cut).alias("cut"), F.max(F.col("live") & ~cut).alias("kept"))
                  .filter("cut AND NOT kept").select("spider", "grp"), "empty")
    rows = left.withColumns({"live": F.col("live") & ~cut, "extra": F.when(cut, 0).otherwise(F.col("extra")).cast("bigint")}).drop("_gone")
    return SeenGroups(rows.select(*ALIASES.fieldNames()).join(empty, ["spider", "grp"], "left_anti").select(*ALIASES.fieldNames()),
                      state.groups.join(empty, ["spider", "grp"], "left_anti"))


class Group:
    """A list of names in memory: its live keys, the other names, and live keys with an own surplus."""

    __slots__ = ("page_hash", "count", "live", "stale", "raised")

    def __init__(self, page_hash, count):
        self.page_hash, self.count = page_hash, count
        self.live: set[str] = set()
        self.stale: set[str] = set()
        self.raised: set[str] = set()


class Replay:
    """The lists of one component, changed by one event after the other. Each call costs what it changes."""

    def __init__(self):
        self.of_key: dict[str, list] = {}  # key -> [group id, extra]
        self.groups: dict[str, Group] = {}

    def load_group(self, grp, page_hash, count):
        self.groups[grp] = Group(page_hash, count)

    def load_alias(self, key, grp, live, extra):
        group = self.groups[grp]
        if live:
            self.of_key[key] = [grp, extra]
            group.live.add(key)
            if extra:
                group.raised.add(key)
        else:
            group.stale.add(key)

    def _leave(self, key):
        """Takes a live key out of its group, where only its name stays; a group without live keys is gone."""
        grp = self.of_key.pop(key)[0]
        group = self.groups[grp]
        group.live.discard(key)
        group.raised.discard(key)
        group.stale.add(key)
        if not group.live:
            del self.groups[grp]

    def delete(self, key):
        """Deletes all names of the key's list."""
        if key in self.of_key:
            group = self.groups[self.of_key[key][0]]
            for name in [*group.live, *group.stale]:
                if name in self.of_key:
                    self._leave(name)

    def hit(self, key, n) -> bool:
        """Raises the counters of all names of the key's list; whether the key is stored."""
        if key not in self.of_key:
            return False
        group = self.groups[self.of_key[key][0]]
        group.count += n
        for name in group.stale:
            if (own := self.of_key.get(name)) is not None:
                own[1] += n
                self.groups[own[0]].raised.add(name)
        return True

    def store(self, key, names, page_hash, new_id) -> tuple[bool, bool]:
        """Stores a page; whether it was new and whether it has changed."""
        own = self.of_key.get(key)
        grp = new_id if own is None else own[0]
        if own is None:
            new = changed = True
            group = self.groups[grp] = Group(page_hash, 1)
            taken = set(names)
        else:
            group = self.groups[grp]
            new = False
            # Fixed rule: a hash that is not there counts as changed.
            changed = group.page_hash is None or page_hash is None or (
                ((group.page_hash ^ page_hash) & 0xFFFFFFFFFFFFFFFF).bit_count() >= SIMILARITY_THRESHOLD)
            taken = {*names, *group.stale} - group.live
        for name in taken:
            group.live.add(name)  # before it leaves another group, so that this one never runs empty
            if name in self.of_key:
                self._leave(name)
            self.of_key[name] = [grp, 0]
            group.stale.discard(name)
        for name in group.raised:
            self.of_key[name][1] = 0
        group.raised.clear()
        group.page_hash, group.count = page_hash, 1
        return new, changed


# Kinds of rows a component is replayed from, in the order they come for one visit.
_GROUP, _ALIAS, _DELETE, _HIT_BEFORE, _STORE, _HIT_AFTER = range(6)
_IN = ["label", "kind", "spider", "key", "row", "grp", "live", "n", "page_hash", "names"]
_OUT = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("label", T.LongType()), T.StructField("spider", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("row", T.LongType()), T.StructField("grp", T.StringType()),
    T.StructField("live", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("page_hash", T.LongType()),
    T.StructField("known", T.BooleanType()), T.StructField("changed", T.BooleanType())])


def _replay_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_IN``, component after component and in order, to rows of ``_OUT``. Holds one component's lists."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_OUT)
    label, spiders, out = None, {}, []

    def close():
        for spider, replay in spiders.items():
            for grp, group in replay.groups.items():
                out.append((_GROUP, label, spider, None, None, grp, None, group.count, group.page_hash, None, None))
                out.extend((_ALIAS, label, spider, key, None, grp, True, replay.of_key[key][1], None, None, None) for key in group.live)
                out.extend((_ALIAS, label, spider, key, None, grp, False, 0, None, None, None) for key in group.stale)

    def made():
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for at, kind, spider, key, row, grp, live, n, page_hash, names in zip(*(batch.column(c).to_pylist() for c in _IN), strict=True):
            if at != label:
                close()
                label, spiders = at, {}
            replay = spiders.get(spider)
            if replay is None:
                replay = spiders[spider] = Replay()
            if kind == _GROUP:
                replay.load_group(grp, page_hash, n)
            elif kind == _ALIAS:
                replay.load_alias(key, grp, live, n)
            elif kind == _DELETE:
                replay.delete(key)
            elif kind == _STORE:
                new, changed = replay.store(key, names, page_hash, grp)
                out.append((_STORE, label, spider, key, row, None, None, None, None, not new, changed))
            else:
                out.append((kind, label, spider, key, row, None, None, n, None, replay.hit(key, n), None))
        yield made()
    close()
    yield made()


@dataclass(frozen=True)
class Replayed:
    """What a batch did: visits judged, links found known or not, and the lists of the touched components after it."""

    visits: DataFrame  # row, is_new, is_changed
    hits: DataFrame  # spider, key, row and same of the place, known
    state: SeenGroups


def new_group_id(order: list[str] = ORDER) -> Column:
    return F.md5(F.concat_ws("\0", "spider", "main", *[F.col(c).cast("string") for c in order]))


def replay(stored: SeenGroups, events: DataFrame, hits: DataFrame | None, stage: Stage) -> Replayed:
    """Replays the events of each component in their order, as if they came one by one.

    ``stored``: aliases and groups of the components, with their new ``label``. ``events``: label, spider,
    ORDER, ``gone`` (key to delete or NULL), ``main`` (key to store or NULL), ``names``, ``dhash``.
    ``hits``: label, spider, key, n, ORDER of the last event at or before them and ``same``, whether they are
    links of that event's own page, which come before it is stored. A task reads its components from a
    sorted partition, one after the other, and holds the names of one.
    """
    none = F.lit(None)

    def rows(df: DataFrame, kind: Column | int, **given) -> DataFrame:
        types = {"label": "bigint", "kind": "int", "spider": "string", "key": "string", "row": "bigint", "grp": "string", "live": "boolean",
                 "n": "bigint", "page_hash": "bigint", "names": "array<string>", "at": "timestamp", "visit": "string", "tie": "bigint"}
        values = {"kind": F.lit(kind) if isinstance(kind, int) else kind, **given}
        return df.select(*[(values[c] if c in values else F.col(c) if c in df.columns else none).cast(t).alias(c) for c, t in types.items()])

    parts = [
        rows(stored.groups, _GROUP, n=F.col("count")),
        rows(stored.aliases, _ALIAS, n=F.col("extra")),
        rows(events.filter("gone IS NOT NULL"), _DELETE, key=F.col("gone"), names=none),
        rows(events.filter("main IS NOT NULL"), _STORE, key=F.col("main"), page_hash=F.col("dhash"), grp=new_group_id())]
    if hits is not None:
        parts.append(rows(hits, F.when(F.col("same"), _HIT_BEFORE).otherwise(_HIT_AFTER)))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    ordered = every.repartition("label").sortWithinPartitions("label", *ORDER, "kind").select(*_IN)
    done = stage(ordered.mapInArrow(_replay_rows, _OUT), "replayed")
    alias = done.filter(F.col("kind") == _ALIAS).select(
        "spider", "key", F.col("label").alias("comp"), "grp", "live", F.col("n").alias("extra")).select(*ALIASES.fieldNames())
    group = done.filter(F.col("kind") == _GROUP).select("spider", F.col("label").alias("comp"), "grp", "page_hash", F.col("n").alias("count"))
    return Replayed(
        visits=done.filter(F.col("kind") == _STORE).select("row", (~F.col("known")).alias("is_new"), F.col("changed").alias("is_changed")),
        hits=done.filter(F.col("kind").isin(_HIT_BEFORE, _HIT_AFTER)).select(
            "spider", "key", "row", (F.col("kind") == _HIT_BEFORE).alias("same"), "known"),
        state=SeenGroups(alias, group))
