"""Reading the driver's tables, and graphs and claims derived from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts_ms, epoch milliseconds."""
    return load(spark, sf_dir, "events").withColumn("ts_ms", F.unix_millis(F.col("ts").cast("timestamp")))


#: kind, child table, child key, parent prefix, parent key, child prefix, weight
LINKS = (
    ("nation_of", "nation", "n_nationkey", "region", "n_regionkey", "nation", 0.95),
    ("customer_of", "customer", "c_custkey", "nation", "c_nationkey", "customer", 0.85),
    ("supplier_of", "supplier", "s_suppkey", "nation", "s_nationkey", "supplier", 0.75),
    ("order_of", "orders", "o_orderkey", "customer", "o_custkey", "order", 0.5),
)


def derived_edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("nation_of", "customer_of", "supplier_of", "order_of")) -> DataFrame:
    """(src, dst, kind, weight): parents to children by key columns, ids as type:key."""
    parts = [load(spark, sf_dir, t).where(F.col(pk).isNotNull()).select(F.concat(F.lit(f"{parent}:"), pk).alias("src"), F.concat(F.lit(f"{child}:"), ck).alias("dst"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight")) for kind, t, ck, parent, pk, child, weight in LINKS if kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def edges_sql(kinds: tuple[str, ...] = ("nation_of", "customer_of", "supplier_of", "order_of")) -> str:
    return " union all ".join(f"select '{parent}:' || {pk} as src, '{child}:' || {ck} as dst, '{kind}' as kind, cast({weight} as double) as weight from {t} where {pk} is not null" for kind, t, ck, parent, pk, child, weight in LINKS if kind in kinds)
