"""Tables between steps: lineage cut by a written table in the shared folder, and numbering without a window over all rows."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone already; the folder is then the cluster's to clean
        pass


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; one under /tmp where that is unset and all runs on one machine."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith(("local[", "local,")) and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that every machine can reach")
        base = f"/tmp/checkpoints/{os.getpid()}"
    folder = f"{base.rstrip('/')}/marlgrid-steps-{context.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: computed once, and safe from the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows over all tasks: a well compressed table is one small file, which one task would read and then work on alone."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has gone already, and a catalog of its own with it
        pass


def bucketed(df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """df as a table dealt by a hash of the keys and sorted by them, in the shared folder: a join on the keys reads it in place, and only the
    other side moves.  There are as many buckets as shuffle partitions, unless given."""
    spark = df.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"marlgrid_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.read.table(name)


@contextmanager
def in_bucket_order(spark: SparkSession):
    """Within it, plans take the rows of bucketed() as sorted, as they are: it writes one file a bucket.  Nor are they made anew while they run: the
    buckets fix how rows are dealt, and short rounds would spend a third of their time on it."""
    told = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in told}
    for name, value in told.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def numbered(df: DataFrame, order: str | Sequence[str | Column], value: str | None = None) -> DataFrame:
    """df with `position` from 1 in order, and `running`, the sum of value up to it.

    Range partitions are numbered on their own and written once; their counts and sums, one row each, then shift them.
    """
    by = [order] if isinstance(order, str) else list(order)
    amount = F.col(value) if value else F.lit(0)
    own = Window.partitionBy("_part").orderBy(*by)
    placed = df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    local = cut(placed.withColumn("_at", F.row_number().over(own)).withColumn("_sum", F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    ends = local.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(amount).alias("_total"))
    before = Window.orderBy("_part")  # one row a partition
    shifts = ends.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_rows"), (F.sum("_total").over(before) - F.col("_total")).alias("_shift"))
    out = local.join(F.broadcast(shifts), "_part").withColumn("position", F.col("_at") + F.col("_rows")).withColumn("running", F.col("_sum") + F.col("_shift"))
    return out.drop("_part", "_at", "_sum", "_rows", "_shift", *([] if value else ["running"]))
