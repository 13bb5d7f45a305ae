"""Snapshots: keyed replacement, promotion and rollback by one pointer, retention, the embedding cache and its budget."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.operators.relational import latest_per_key, replace_by_key
from marlgrid.operators.staging import numbered

DAY_MS = 86_400_000


def persist(tables: dict[str, DataFrame], root: str) -> dict[str, str | None]:
    """Writes each table partitioned by snapshot_id, replacing only the snapshots it holds; an error's text for each that failed."""
    out: dict[str, str | None] = {}
    for name, df in tables.items():
        try:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{root}/{name}")
            out[name] = None
        except Exception as e:  # one table's failure is reported, the others are still written
            out[name] = str(e)[:300]
    return out


def gates(results: DataFrame) -> DataFrame:
    """(snapshot_id, passed, failed_gates): a snapshot passes if its persist, vector and smoke gates all did; a missing gate failed."""
    wide = results.groupBy("snapshot_id").agg(*[F.coalesce(F.max(F.when(F.col("gate") == g, F.col("ok").cast("int"))), F.lit(0)).alias(g) for g in ("persist", "vector", "smoke")])
    failed = F.array_join(F.array_compact(F.array(*[F.when(F.col(g) == 0, g) for g in ("persist", "vector", "smoke")])), ",")
    return wide.select("snapshot_id", (failed == "").alias("passed"), failed.alias("failed_gates"))


def file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder in one step; an error if the target is there already, so that of two writers one fails.  That holds on HDFS and local disks; an
    object store has no such rename, so pointers, manifests and read models belong on a file system that has one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs, P = file_system(spark, source)
    a, b = fs.makeQualified(P(source)), fs.makeQualified(P(target))
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, no_options)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, P = file_system(spark, path)
    if not fs.exists(P(path)):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(P(path))]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def _swap(spark: SparkSession, path: str, row: DataFrame) -> None:
    """Adds the next version of a one-row table: a finished copy becomes visible by one rename, and the newest version holds.

    No version is taken away before the next one stands, so a crash at any point leaves a pointer; of two writers one fails.
    """
    fs, P = file_system(spark, path)
    old = versions(spark, path)
    fresh, name = f"{path}/next-{uuid.uuid4().hex}", f"{path}/v{(old[-1] if old else 0) + 1}"
    row.coalesce(1).write.parquet(fresh)
    try:
        move(spark, fresh, name)
    except Exception:
        fs.delete(P(fresh), True)
        raise
    for v in old[:-KEPT_POINTERS]:
        fs.delete(P(f"{path}/v{v}"), True)


#: Versions of the pointer that stay beside the newest.
KEPT_POINTERS = 10


def pointer(spark: SparkSession, path: str) -> str | None:
    """The active snapshot; None before the first promotion."""
    found = versions(spark, path)
    row = spark.read.parquet(f"{path}/v{found[-1]}").first() if found else None
    return row["snapshot_id"] if row else None


def active_rows(df: DataFrame, path: str) -> DataFrame:
    """df's rows of the active snapshot, which prunes its partitions; none before the first promotion.  The pointer is one row, read anew by each call."""
    return df.where(F.col("snapshot_id") == F.lit(pointer(df.sparkSession, path)))


class ActiveSnapshot:
    """The active snapshot, read again after `ttl_ms`."""

    def __init__(self, spark: SparkSession, path: str, ttl_ms: int = 60_000):
        self._spark, self._path, self._ttl, self._held = spark, path, ttl_ms, (None, None)

    def get(self, now_ms: int) -> str | None:
        read_at, value = self._held
        if read_at is None or now_ms - read_at >= self._ttl:
            self._held = now_ms, pointer(self._spark, self._path)
        return self._held[1]


def stamped(snapshots: DataFrame, snapshot_id: str, now_ms: int) -> DataFrame:
    """snapshots with the promotion's time on the promoted row."""
    return snapshots.withColumn("promoted_at_ms", F.when(F.col("snapshot_id") == snapshot_id, F.lit(now_ms).cast("long")).otherwise(F.col("promoted_at_ms")))


def promote(spark: SparkSession, snapshot_id: str, results: DataFrame, path: str, now_ms: int) -> None:
    """Makes a snapshot the active one if its gates passed and it isn't already."""
    if pointer(spark, path) == snapshot_id:
        raise ValueError(f"{snapshot_id} is active already")
    row = gates(results.where(F.col("snapshot_id") == snapshot_id)).first()
    if not row or not row["passed"]:
        raise ValueError(f"{snapshot_id} failed: {row['failed_gates'] if row else 'no results'}")
    _swap(spark, path, spark.createDataFrame([(snapshot_id, now_ms)], "snapshot_id string, promoted_at_ms long"))


def rollback(spark: SparkSession, snapshot_id: str, snapshots: DataFrame, path: str, now_ms: int, days: int = 30) -> None:
    """Returns to a snapshot that was promoted within `days` and not deactivated."""
    ok = F.col("promoted_at_ms").isNotNull() & F.col("deactivated_at_ms").isNull() & (F.col("promoted_at_ms") >= now_ms - days * DAY_MS)
    if not snapshots.where((F.col("snapshot_id") == snapshot_id) & ok).take(1):
        raise ValueError(f"{snapshot_id} can't be returned to")
    _swap(spark, path, spark.createDataFrame([(snapshot_id, now_ms)], "snapshot_id string, promoted_at_ms long"))


def retention(snapshots: DataFrame, active: str, now_ms: int, days: int = 30) -> DataFrame:
    """snapshots with deactivated_at_ms set for those promoted before the window that are neither active nor deactivated."""
    due = F.col("promoted_at_ms").isNotNull() & F.col("deactivated_at_ms").isNull() & (F.col("snapshot_id") != active) & (F.col("promoted_at_ms") < now_ms - days * DAY_MS)
    return snapshots.withColumn("deactivated_at_ms", F.when(due, F.lit(now_ms).cast("long")).otherwise(F.col("deactivated_at_ms")))


def retained_cache(cache: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    """The embedding cache without rows that nothing has used within the window."""
    return cache.where(F.coalesce("last_used_at_ms", "emitted_at_ms") >= now_ms - days * DAY_MS)


def staging_due(runs: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    """The staging folders (run_id, path) of runs that ended before the window; runs under way keep theirs."""
    return runs.where(F.col("ended_at_ms").isNotNull() & (F.col("ended_at_ms") < now_ms - days * DAY_MS)).select("run_id", "path")


def plan(spark: SparkSession, run_id: str, sources: Sequence[str], skipped: Sequence[str] = ()) -> DataFrame:
    """(run_id, snapshot_id, source, planned): a run's snapshot and the sources that it takes, all but those skipped."""
    rows = [(run_id, f"snap_{run_id}", s, s not in set(skipped)) for s in sources]
    return spark.createDataFrame(rows, "run_id string, snapshot_id string, source string, planned boolean")


def latest_plan(pointer_row: DataFrame, plans: DataFrame) -> DataFrame:
    """The pointer's row with its snapshot's newest plan, null where it has none."""
    newest = latest_per_key(plans, ["snapshot_id"], [F.desc("planned_at_ms"), F.asc("plan_id")])
    return pointer_row.join(newest, "snapshot_id", "left")


def cache_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(content_hash, request_id, hit): the first request of each hash, empty texts left out, and whether the cache has it."""
    first = latest_per_key(requests.where(F.coalesce(F.length("text"), F.lit(0)) > 0), ["content_hash"], [F.asc("request_id")])
    return first.join(cache.select("content_hash", F.lit(True).alias("found")).distinct(), "content_hash", "left").select("content_hash", "request_id", F.coalesce("found", F.lit(False)).alias("hit"))


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    return replace_by_key(cache, new, ["content_hash"])


def budget_cut(requests: DataFrame, tokens: str, order: str, batch: int, cap: int) -> DataFrame:
    """requests with batch_no and `embedded`: batches in order until the one that would exceed the cap."""
    placed = numbered(requests, order, tokens).withColumn("batch_no", F.floor((F.col("position") - 1) / batch).cast("long"))
    # a later batch can't fit once one was refused: the running sum never falls
    total = placed.groupBy("batch_no").agg(F.max("running").alias("so_far"))
    return placed.drop("running").join(total, "batch_no").withColumn("embedded", F.col("so_far") <= cap)


def smoke(hits: DataFrame, baseline: DataFrame, bootstrap: bool = False) -> DataFrame:
    """(n, hit_rate, threshold, passed): top-1 hits over the baseline's queries against its smallest rate; an empty baseline passes only at bootstrap."""
    joined = baseline.join(hits.select("query_id", "top_id"), "query_id", "left")
    out = joined.agg(F.count("*").alias("n"), F.avg(F.coalesce((F.col("top_id") == F.col("expected_id")).cast("double"), F.lit(0.0))).alias("hit_rate"), F.min("baseline_rate").alias("threshold"))
    return out.withColumn("passed", F.when(F.col("n") == 0, F.lit(bootstrap)).otherwise(F.col("hit_rate") >= F.col("threshold")))


def resume_point(steps: DataFrame, log: DataFrame) -> DataFrame:
    """The first step by ordinal without a success in the log."""
    return steps.join(log.where("status = 'succeeded'").select("step").distinct(), "step", "left_anti").orderBy("ordinal").limit(1)


def reversal_plan(log: DataFrame) -> DataFrame:
    """Succeeded steps, last first-success first, with the details of their last success."""
    done = log.where("status = 'succeeded'")
    return done.groupBy("step").agg(F.min("position").alias("first_at"), F.max_by("detail", "position").alias("detail")).orderBy(F.desc("first_at"))
