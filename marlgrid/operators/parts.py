"""Named tables as immutable parts under one manifest, and what stands on that: keyed tables, whole snapshots.

A write adds folders and never changes one.  The manifest lists, for each table, the folder of each of its parts; a new version of it
appears by one rename and replaces any number of parts of any number of tables at once.  A crash before it leaves the version before
whole, and of two writers who began at one version the second fails.  Parts that a change doesn't touch keep their files.

The rename must be atomic and must fail where the target stands (HDFS, local disks).  An object store has no such rename; there the manifest's folder
belongs on a file system that has one, and the parts can stay in the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlgrid.operators.relational import latest_per_key
from marlgrid.operators.snapshot import file_system, move, versions

MANIFEST = "name string, part string, path string, schema string"


class Store:
    """The tables under `root` as of one version of its manifest: the newest one when it was opened, unless given."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        found = versions(spark, f"{self.root}/_manifest")
        self.version = version if version is not None else (found[-1] if found else 0)
        # one row a part: the layout's size, not the data's
        rows = spark.read.schema(MANIFEST).parquet(f"{self.root}/_manifest/v{self.version}").collect() if self.version else []
        self._parts: dict[str, dict[str, str]] = {}
        self._schemas: dict[str, str] = {}
        for r in rows:
            self._schemas[r["name"]] = r["schema"]
            own = self._parts.setdefault(r["name"], {})
            if r["path"]:
                own[r["part"]] = r["path"]

    def names(self) -> list[str]:
        return sorted(self._parts)

    def parts(self, name: str) -> dict[str, str]:
        """The folder of each part."""
        return dict(self._parts[name])

    def read(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """A table, or some of its parts, whose folders alone are then listed and read."""
        schema = StructType.fromJson(json.loads(self._schemas[name]))
        own = self._parts[name]
        paths = [own[p] for p in (own if parts is None else parts) if p in own]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def stage(self, df: DataFrame, part: str) -> tuple[dict[str, str], str]:
        """df written as parts by the column `part`, which is left out of them: (folder of each part, schema), for commit()."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(part).parquet(folder)
        fs, P = file_system(self.spark, folder)
        names = [str(f.getPath().getName()) for f in fs.listStatus(P(folder)) if f.isDirectory()]
        return {unquote(n.split("=", 1)[1]): f"{folder}/{n}" for n in names}, df.drop(part).schema.json()

    def commit(self, changes: Mapping[str, tuple[Mapping[str, str | None], str]], whole: Sequence[str] = ()) -> Store:
        """The next version: staged parts take the place of those of their name, None takes a part away; of the tables in `whole` no other part stays.

        An error if another version has come since this one was read; nothing is changed then.
        """
        parts, schemas = {n: dict(p) for n, p in self._parts.items()}, dict(self._schemas)
        for name, (new, schema) in changes.items():
            own = {} if name in whole else parts.setdefault(name, {})
            own.update(new)
            parts[name], schemas[name] = {k: v for k, v in own.items() if v}, schema
        rows = [(n, p, path, schemas[n]) for n, own in parts.items() for p, path in (own or {"": ""}).items()]
        fresh, target = f"{self.root}/_manifest/next-{uuid.uuid4().hex}", f"{self.root}/_manifest/v{self.version + 1}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(fresh)
        try:
            move(self.spark, fresh, target)
        except Exception:
            fs, P = file_system(self.spark, fresh)
            fs.delete(P(fresh), True)
            raise
        return Store(self.spark, self.root, self.version + 1)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest `keep` versions names, and older versions; the number of folders deleted."""
        found = versions(self.spark, f"{self.root}/_manifest")
        held = {path for v in found[-keep:] for own in Store(self.spark, self.root, v)._parts.values() for path in own.values()}
        fs, P = file_system(self.spark, self.root)
        gone = 0
        for batch in fs.listStatus(P(f"{self.root}/data")):
            base = f"{self.root}/data/{batch.getPath().getName()}"
            dead = [f for f in fs.listStatus(P(base)) if f.isDirectory() and f"{base}/{f.getPath().getName()}" not in held]
            alive = any(path.startswith(f"{base}/") for path in held)
            for f in dead if alive else [batch]:
                fs.delete(f.getPath(), True)
                gone += 1
        for v in found[:-keep]:
            fs.delete(P(f"{self.root}/_manifest/v{v}"), True)
        return gone


# --- keyed tables -----------------------------------------------------------------------------------------------------

#: Keys sampled to set the ranges of a table, and the most ranges.
SAMPLED, MOST_RANGES = 20_000, 1024


def range_of(key: Column, bounds: Sequence) -> Column:
    """How many of the bounds, which ascend, are at or below the key: a binary search in the JVM.  Null keys belong to range 0."""
    if not bounds:
        return F.lit(0)
    held, size = F.array(*[F.lit(b) for b in bounds]), len(bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(size.bit_length()))])
    below = lambda at, s: F.coalesce((at + s <= size) & (F.get(held, at + s - 1) <= key), F.lit(False))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(below(at, s), at + s).otherwise(at))


def _bounds(df: DataFrame, key: str, ranges: int) -> list:
    """Keys that cut df into about equal ranges, from a share of its rows by a hash of their keys."""
    n = df.count()
    share = int(min(1.0, SAMPLED / max(1, n)) * (1 << 30))
    some = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share)).select(key).distinct().limit(2 * SAMPLED).collect())
    return sorted({some[len(some) * i // ranges] for i in range(1, ranges)} if len(some) >= ranges else set(some[1:]))


def create_keyed(store: Store, name: str, df: DataFrame, keys: Sequence[str], rows_a_range: int = 1_000_000, ranges: int | None = None) -> Store:
    """A table laid out by ranges of its first key, each one part."""
    want = ranges or min(MOST_RANGES, max(1, -(-df.count() // rows_a_range)))
    bounds = _bounds(df, keys[0], want)
    kind = next(f.dataType for f in df.schema if f.name == keys[0]).simpleString()
    told = store.spark.createDataFrame([(i, b) for i, b in enumerate(bounds)], f"place int, bound {kind}").withColumn("part", F.lit("all"))
    # few small files a range, and a range that a hot key fills is dealt over several tasks
    dealt = df.withColumn("_range", range_of(F.col(keys[0]), bounds)).hint("rebalance", F.col("_range"))
    return store.commit({name: store.stage(dealt.sortWithinPartitions("_range", keys[0]), "_range"), f"{name}.ranges": store.stage(told, "part")}, whole=[name, f"{name}.ranges"])


def keyed_bounds(store: Store, name: str) -> list:
    return [r["bound"] for r in store.read(f"{name}.ranges").orderBy("place").collect()]


def touched_ranges(keys: DataFrame, key: str, bounds: Sequence) -> list[str]:
    """The ranges that hold any of the keys: at most one row a range."""
    return sorted(str(r[0]) for r in keys.select(range_of(F.col(key), bounds).alias("r")).distinct().collect())


def merged_parts(store: Store, name: str, new: DataFrame, keys: Sequence[str], drop: DataFrame | None = None) -> tuple[dict[str, str | None], str]:
    """The staged parts of a merge: rows of `new` take the place of those with their keys, and keys in `drop` go; only the ranges that
    hold any of these keys are read and written."""
    bounds = keyed_bounds(store, name)
    gone = new.select(*keys) if drop is None else new.select(*keys).unionByName(drop.select(*keys))
    touched = touched_ranges(gone, keys[0], bounds)
    old = store.read(name, touched)
    # rows are of one key only once in new, so what is left and what comes never meet
    left = old.join(gone.distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
    dealt = left.withColumn("_range", range_of(F.col(keys[0]), bounds)).hint("rebalance", F.col("_range"))
    parts, schema = store.stage(dealt.sortWithinPartitions("_range", keys[0]), "_range")
    return {p: parts.get(p) for p in touched}, schema


def merge_keyed(store: Store, name: str, new: DataFrame, keys: Sequence[str], newest_first: Sequence[Column] = (), drop: DataFrame | None = None) -> Store:
    """A keyed table with new rows in place of those of their keys.  Of rows of one key in `new` the first by newest_first holds; without an order
    all come in, as an append of them would."""
    once = latest_per_key(new, keys, newest_first) if newest_first else new
    return store.commit({name: merged_parts(store, name, once, keys, drop)})


def read_keys(store: Store, name: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of some keys, from the ranges that hold them."""
    return store.read(name, touched_ranges(keys, key, keyed_bounds(store, name))).join(keys.select(key).distinct(), key, "left_semi")


# --- snapshots --------------------------------------------------------------------------------------------------------


def persist_whole(tables: Mapping[str, DataFrame], root: str, spark: SparkSession) -> tuple[Store, dict[str, str | None]]:
    """All tables of some snapshots at once: each is written by snapshot_id, and one manifest makes all of them visible; (store, error of each table).

    If any table fails, none changes, and every reader goes on with the snapshots before.
    """
    store = Store(spark, root)
    staged, errors = {}, {}
    for name, df in tables.items():
        try:
            staged[name] = store.stage(df, "snapshot_id")
            errors[name] = None
        except Exception as e:  # reported for its table; the others are tried, so that all errors are known
            errors[name] = str(e)[:300]
    return (store.commit(staged) if not any(errors.values()) else store), errors


def snapshot_rows(store: Store, name: str, snapshot_id: str) -> DataFrame:
    """A table's rows of one snapshot, from its folder alone."""
    return store.read(name, [snapshot_id]).withColumn("snapshot_id", F.lit(snapshot_id))
