"""Observability: query history, attribution, presence of tables, refreshes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.operators.relational import page

#: States of a statement that is done.
DONE = ("FINISHED", "SUCCEEDED")


def query_history(statements: DataFrame, now_ms: int, hours: int = 24, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of statements (statement_id, status, started_at_ms, duration_ms) of the last hours (1 to 168): the newest `most`,
    and over them query_count, avg_duration_ms and failure_count."""
    hours = min(max(1, hours), 168)
    recent = statements.where((F.col("started_at_ms") >= now_ms - hours * 3_600_000) & (F.col("started_at_ms") <= now_ms))
    rows = recent.withColumn("status", F.coalesce("status", F.lit("UNKNOWN"))).withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0)).cast("long")).orderBy(F.desc("started_at_ms"), "statement_id").limit(most)
    summary = rows.agg(F.count("*").alias("query_count"), F.coalesce(F.floor(F.avg("duration_ms")), F.lit(0)).cast("long").alias("avg_duration_ms"), F.count_if(~F.upper("status").isin(*DONE)).alias("failure_count"))
    return rows, summary


def attribution(calls: DataFrame, keys: Sequence[str], now_ms: int, days: int = 7, most: int = 20) -> DataFrame:
    """By key over the last days: calls, mean latency (whole ms), tokens; the most called first, `most` at most.  calls: observed_at_ms, latency_ms, total_tokens."""
    recent = calls.where((F.col("observed_at_ms") >= now_ms - days * 86_400_000) & (F.col("observed_at_ms") <= now_ms))
    by = recent.groupBy(*keys).agg(F.count("*").alias("calls"), F.coalesce(F.avg("latency_ms"), F.lit(0)).cast("long").alias("mean_latency_ms"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"))
    return page(by, [F.desc("calls"), *[F.asc(k) for k in keys]], most)


def presence(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(table_name, present, n): name -> path of each table; whether anything is there, and its rows (null where nothing is)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for name, path in tables.items():
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(conf).exists(where)
        rows = spark.read.parquet(path).agg(F.count("*").alias("n")) if there else spark.range(1).select(F.lit(None).cast("long").alias("n"))
        parts.append(rows.select(F.lit(name).alias("table_name"), F.lit(there).alias("present"), "n"))
    return reduce(DataFrame.unionByName, parts)


def catalog_columns(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """(database, table_name, column_name, ordinal, data_type) of the session catalog's tables, in order: names and types alone."""
    known = [d.name for d in spark.catalog.listDatabases()]
    rows = [(d, t.name, c.name, i, c.dataType) for d in sorted(set(known) & set(databases or known)) for t in spark.catalog.listTables(d) if not t.isTemporary for i, c in enumerate(spark.catalog.listColumns(t.name, d))]
    return spark.createDataFrame(rows, "database string, table_name string, column_name string, ordinal long, data_type string")


def refresh_history(runs: DataFrame, now_ms: int, most: int = 50) -> DataFrame:
    """runs (run_id, started_at_ms, duration_ms, status), newest first, with when they ended and how many whole days ago that was; runs under way have neither."""
    ended = F.col("started_at_ms") + F.col("duration_ms")
    rows = runs.select("run_id", "status", "started_at_ms", ended.alias("ended_at_ms"), F.floor((F.lit(now_ms) - ended) / 86_400_000).cast("long").alias("freshness_days"))
    return page(rows, [F.desc("started_at_ms"), F.asc("run_id")], most)
