"""Small file sources and the sinks: JSON lines, claim logs, skill manifests; appends, keyed writes, read models."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlgrid.functions.text import pointer_parts
from marlgrid.operators.snapshot import file_system, move, versions


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of a declared schema, a JSON document a line; lines that aren't JSON have only `_corrupt`."""
    declared = schema if isinstance(schema, str) else schema.toDDL()
    return spark.read.schema(f"{declared}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of one JSON array or object that spans lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(path, skill_id, pointer, meta, ext) of skill manifests: the top-level `id` and `exemplar_of` lines of each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    line = lambda key: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{key}:\s*[\"']?([^\"'\n]*)", 1)), F.lit(""))
    out = whole.select("path", line("id").alias("skill_id"), line("exemplar_of").alias("pointer"))
    return out.withColumn("_p", pointer_parts("pointer")).select("path", "skill_id", "pointer", "_p.meta", "_p.ext")


def information_schema(tables: Mapping[str, DataFrame], views: Mapping[str, str] | None = None) -> tuple[list[tuple], list[tuple]]:
    """(columns, views) of a catalog: (table, column, ordinal, type) and (view, definition's SHA-256)."""
    import hashlib

    columns = [(t, f.name, i, f.dataType.simpleString()) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema)]
    return columns, [(v, hashlib.sha256(d.encode()).hexdigest()) for v, d in sorted((views or {}).items())]


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Adds rows to a table: claims, events, invocations, audit rows."""
    df.write.mode("append").partitionBy(*partition).parquet(path)


def merge_current(current: DataFrame, new: DataFrame, key: str = "claim_id") -> DataFrame:
    """current with new's rows in place of those of the same key."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def publish(df: DataFrame, path: str, snapshot_id: str) -> int:
    """A read model of one snapshot as a new folder under path, which becomes visible once it is whole; an error if it would be
    empty, and then the one before stands.  Returns its rows.  read_model() reads the newest."""
    spark, own = df.sparkSession, df.where(F.col("snapshot_id") == snapshot_id)
    fs, P = file_system(spark, path)
    fresh = f"{path}/next-{uuid.uuid4().hex}"
    own.write.parquet(fresh)
    n = spark.read.schema(own.schema).parquet(fresh).count()
    if not n:
        fs.delete(P(fresh), True)
        raise ValueError(f"{snapshot_id} has no rows to publish")
    before = versions(spark, path)
    move(spark, fresh, f"{path}/v{(before[-1] if before else 0) + 1}")
    return n


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")
