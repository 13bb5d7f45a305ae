"""Table profiles: one pass for all columns of all tables, candidate keys, claims, pivots, readiness and feature rules."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.operators.staging import cut

SKIPPED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def _fields(df: DataFrame, most: int) -> list[T.StructField]:
    return [f for f in df.schema if not isinstance(f.dataType, SKIPPED)][:most]


def described(tables: Mapping[str, DataFrame], most: int = 20) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) of the first `most` columns of plain types of each table: the schemas alone, no rows are read."""
    rows = [(name, f.name, i, f.dataType.simpleString()) for name, df in tables.items() for i, f in enumerate(_fields(df, most))]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal long, data_type string")


def profiles(tables: Mapping[str, DataFrame], most: int = 20) -> DataFrame:
    """(table_name, column_name, ordinal, data_type, row_count, null_count, distinct_count) for the first `most` columns of plain types of each table.

    Each table is read once.  A row becomes one short row for each column, its number and two hashes of the value (96 bits, which two of
    10**10 different values share with a chance below 1e-9); those are counted by value with partial counts before the shuffle, and the
    counts by column.  No value travels, and no row once for each of its columns.  The result is written once.
    """
    parts, number, names = [], 0, []
    for name, df in tables.items():
        own = _fields(df, most)
        cells = []
        for f in own:
            value = F.col(f"`{f.name}`")
            # -0.0 and 0.0 are one value
            value = (value + 0.0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else value
            cells.append(F.struct(F.lit(number).alias("c"), F.when(value.isNotNull(), F.xxhash64(value)).alias("v"), F.hash(value).alias("w")))
            names.append((number, name, f.name, f.dataType.simpleString()))
            number += 1
        if own:
            parts.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.c", "x.v", "x.w"))
    columns = described(tables, most)
    if not parts:
        return columns.select("*", *[F.lit(0).cast("long").alias(c) for c in ("row_count", "null_count", "distinct_count")])
    by_value = reduce(DataFrame.unionByName, parts).groupBy("c", "v", "w").agg(F.count("*").alias("n"))
    counts = by_value.groupBy("c").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("v").alias("distinct_count"))
    spark = columns.sparkSession
    numbered_ = spark.createDataFrame([(n, t, c) for n, t, c, _ in names], "c int, table_name string, column_name string")
    told = columns.join(numbered_.join(counts, "c", "left"), ["table_name", "column_name"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("row_count", "null_count", "distinct_count")]
    return cut(told.select("table_name", "column_name", "ordinal", "data_type", *zero))


def profile(df: DataFrame, name: str, most: int = 20) -> DataFrame:
    """profiles() of one table."""
    return profiles({name: df}, most)


def schema_rollup(profiles_: DataFrame, family: Column) -> DataFrame:
    """(family, n_tables, n_rows, n_columns, tables) of profiles, by a family that is told from the table's name."""
    by_table = profiles_.groupBy("table_name").agg(F.max("row_count").alias("n"), F.count("*").alias("c"))
    return by_table.groupBy(family.alias("family")).agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_rows"), F.sum("c").alias("n_columns"), F.array_join(F.sort_array(F.collect_list("table_name")), ",").alias("tables"))


def candidate_keys(profiles: DataFrame) -> DataFrame:
    """(table_name, keys): columns without nulls and with as many values as rows, sorted, comma-separated; empty where none."""
    is_key = (F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("distinct_count") == F.col("row_count"))
    return profiles.groupBy("table_name").agg(F.array_join(F.sort_array(F.collect_list(F.when(is_key, F.col("column_name")))), ",").alias("keys"))


def claims(profiles: DataFrame, catalog: str, schema: str, observed_at_ms: int) -> DataFrame:
    """The claims that profiles make: (subject, predicate, object_ref, value_text, observed_at_ms)."""
    table = F.concat(F.lit(f"{catalog}.{schema}."), F.col("table_name"))
    column = F.concat(table, F.lit("."), F.col("column_name"))
    of_column = F.array(
        F.struct(table.alias("subject"), F.lit("HAS_COLUMN").alias("predicate"), column.alias("object_ref"), F.col("data_type").alias("value_text")),
        F.struct(column.alias("subject"), F.lit("NULL_COUNT").alias("predicate"), table.alias("object_ref"), F.col("null_count").cast("string").alias("value_text")),
        F.struct(column.alias("subject"), F.lit("DISTINCT_COUNT").alias("predicate"), table.alias("object_ref"), F.col("distinct_count").cast("string").alias("value_text")),
    )
    of_table = F.array(
        F.struct(table.alias("subject"), F.lit("EXISTS").alias("predicate"), F.lit(None).cast("string").alias("object_ref"), F.lit("true").alias("value_text")),
        F.struct(table.alias("subject"), F.lit("BELONGS_TO").alias("predicate"), F.lit(f"{catalog}.{schema}").alias("object_ref"), F.lit(None).cast("string").alias("value_text")),
        F.struct(table.alias("subject"), F.lit("ROW_COUNT").alias("predicate"), F.lit(None).cast("string").alias("object_ref"), F.col("row_count").cast("string").alias("value_text")),
    )
    keys = candidate_keys(profiles).select(table.alias("subject"), F.lit("GRAIN_CHECK").alias("predicate"), F.lit(None).cast("string").alias("object_ref"), F.col("keys").alias("value_text"))
    a = profiles.select(F.explode(of_column).alias("c")).select("c.*")
    b = profiles.groupBy("table_name").agg(F.max("row_count").alias("row_count")).select(F.explode(of_table).alias("c")).select("c.*")
    return a.unionByName(b).unionByName(keys).withColumn("observed_at_ms", F.lit(observed_at_ms).cast("long"))


def structure_claims(columns: DataFrame, catalog: str, schema: str, observed_at_ms: int) -> DataFrame:
    """The claims that need no counts, of described(): EXISTS, BELONGS_TO and HAS_COLUMN."""
    empty = columns.select("*", *[F.lit(0).cast("long").alias(c) for c in ("row_count", "null_count", "distinct_count")])
    return claims(empty, catalog, schema, observed_at_ms).where("predicate in ('EXISTS', 'BELONGS_TO', 'HAS_COLUMN')")


def pivoted(rows: DataFrame) -> DataFrame:
    """(subject, row_count, n_columns, grain): claims of tables, one row a subject; counts are numbers before they are compared, the newest holds."""
    number = F.col("value_text").try_cast("long")
    tables = rows.where(F.col("predicate").isin("EXISTS", "ROW_COUNT", "HAS_COLUMN", "GRAIN_CHECK"))
    newest = F.max(F.when(F.col("predicate") == "ROW_COUNT", F.struct("observed_at_ms", number.alias("v"))))["v"]
    return tables.groupBy("subject").agg(newest.alias("row_count"), F.count_if(F.col("predicate") == "HAS_COLUMN").alias("n_columns"), F.max(F.when(F.col("predicate") == "GRAIN_CHECK", F.col("value_text"))).alias("grain"))


def suggestion_confidence(has_rows: Column, has_grain: Column, has_columns: Column, many_tables: Column) -> Column:
    total = 0.72 + F.when(has_rows, 0.08).otherwise(0.0) + F.when(has_grain, 0.05).otherwise(0.0) + F.when(has_columns, 0.05).otherwise(0.0) + F.when(many_tables, 0.03).otherwise(0.0)
    return F.least(F.lit(0.92), F.round(total, 2))


def validation_bucket(seed: str, key: Column, percent: int = 20) -> Column:
    """validation or train, from a hash of seed and key; the same on every run and engine."""
    bucket = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(bucket < percent, "validation").otherwise("train")


# Metrics where less is better.
LOWER_IS_BETTER = ("rmse", "mae", "mape", "log_loss", "false_positive_rate")


def metric_passes(metric: Column, value: Column, floor: Column) -> Column:
    return F.when(metric.isin(*LOWER_IS_BETTER), value <= floor).otherwise(value >= floor)


def support_matrix(evidence: DataFrame, phases: list[str], most: int = 8) -> DataFrame:
    """evidence (system, phase, status, ref) as one row for each system: every phase's status, `not_observed` by default, at most `most` distinct
    references, and a confidence by the share of phases that were observed."""
    wide = evidence.groupBy("system").pivot("phase", phases).agg(F.max("status"))
    refs = evidence.groupBy("system").agg(F.array_join(F.slice(F.sort_array(F.collect_set("ref")), 1, most), ",").alias("evidence"))
    seen = reduce(lambda a, b: a + b, [F.col(p).isNotNull().cast("int") for p in phases])
    label = F.when(seen == len(phases), "high").when(seen > 0, "medium").otherwise("low")
    return wide.withColumn("confidence", label).select("system", *[F.coalesce(F.col(p), F.lit("not_observed")).alias(p) for p in phases], "confidence").join(refs, "system")
