"""Claims: table profiles out of them, their quality, mentions, evidence, containment."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgrid.operators.staging import cut


def table_profiles(rows: DataFrame) -> DataFrame:
    """claims (subject, predicate, object_ref, value_text, observed_at_ms) by table: newest row count, sorted columns, columns with nulls."""
    own = rows.where(F.col("predicate").isin("ROW_COUNT", "HAS_COLUMN")).withColumn("table", F.col("subject"))
    nulls = rows.where((F.col("predicate") == "NULL_COUNT") & (F.col("value_text").try_cast("long") > 0)).select(F.col("object_ref").alias("table"), F.col("subject").alias("with_nulls"))
    a = own.groupBy("table").agg(F.max(F.when(F.col("predicate") == "ROW_COUNT", F.struct("observed_at_ms", F.col("value_text").try_cast("long").alias("v"))))["v"].alias("row_count"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("predicate") == "HAS_COLUMN", F.col("object_ref")))), ",").alias("columns"))
    b = nulls.groupBy("table").agg(F.countDistinct("with_nulls").alias("n_with_nulls"))
    return a.join(b, "table", "left").select("table", "row_count", "columns", F.coalesce("n_with_nulls", F.lit(0)).alias("n_with_nulls"))


def quality(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(n_claims, n_subjects, n_without_value, n_unanchored): subjects that no anchor resolves count as unanchored."""
    joined = rows.join(anchors.select(F.col("subject").alias("a_")).distinct(), F.col("subject") == F.col("a_"), "left")
    return joined.agg(F.count("*").alias("n_claims"), F.countDistinct("subject").alias("n_subjects"), F.count_if(F.col("value_text").isNull()).alias("n_without_value"), F.countDistinct(F.when(F.col("a_").isNull(), F.col("subject"))).alias("n_unanchored"))


def mentions(rows: DataFrame, known: DataFrame, key: str = "target") -> tuple[DataFrame, DataFrame]:
    """(valid, questions) of mention rows: malformed ones and unknown targets become questions with a reason."""
    joined = rows.join(known.select(key, F.lit(True).alias("_known")).distinct(), key, "left")
    reason = F.when(F.col(key).isNull() | (F.trim(key) == ""), "empty_target").when(F.col("confidence").isNull() | ~F.col("confidence").between(0, 1), "bad_confidence").when(F.col("_known").isNull(), "unknown_target")
    told = joined.withColumn("reason", reason).drop("_known")
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def is_grounded(evidence_kinds: Column, trusted: Sequence[str], refs: Column, prefixes: Sequence[str]) -> Column:
    """Whether evidence comes from a trusted kind and some reference has a known prefix."""
    known = F.exists(refs, lambda r: F.coalesce(r.rlike("^(" + "|".join(prefixes) + ")"), F.lit(False)))
    return F.coalesce(F.arrays_overlap(evidence_kinds, F.array(*[F.lit(t) for t in trusted])) & known, F.lit(False))


def visible(name: Column, allow: Sequence[str], block: Sequence[str], blocked_prefixes: Sequence[str]) -> Column:
    """Names in the allow list (or any, if it is empty) that are neither blocked nor under a blocked prefix."""
    out = name.isin(*allow) if allow else F.lit(True)
    out = out & ~name.isin(*block) if block else out
    for p in blocked_prefixes:
        out = out & ~name.startswith(p)
    return out


def signature(df: DataFrame, id_col: str, hash_col: str, spread: int = 1 << 16) -> DataFrame:
    """(n_blocks, signature): one digest of all rows in id order, whatever their partitions.

    Rows fall into ranges of `spread` ids (ids are integers, one hash each); a range has one digest over its hashes in id order,
    and the whole one over those of the ranges in order.  A range's rows are bounded, and the ranges, one short row each, are
    digested again in ranges of themselves until one is left.
    """
    level = df.select((F.col(id_col).cast("long")).alias("id"), F.col(hash_col).alias("h"))
    n_blocks, joined = None, F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda r: r["h"]), ""), 256)
    while True:
        level = level.groupBy(F.floor(F.col("id") / spread).cast("long").alias("id")).agg(joined.alias("h"))
        level = cut(level)
        n = level.count()
        n_blocks = n if n_blocks is None else n_blocks
        if n <= spread:
            break
    return level.agg(F.lit(n_blocks).cast("long").alias("n_blocks"), F.coalesce(joined, F.sha2(F.lit(""), 256)).alias("signature"))


#: Hashes that travel as one string.
JOINED = 4096


def ordered_signature(df: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(signature): the SHA-256 of all hashes one after another in id order, hashes of equal ids by value; a null hash counts as empty.

    One digest over all rows is a single stream by its definition.  Tasks sort ranges of ids and join each range's hashes into pieces of
    JOINED rows; the driver feeds the pieces to the digest, a range at a time and in turn, so that it holds one range's hashes and never the
    table's, whatever its size.  signature() is the digest that tasks can work out side by side.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(hash_col, F.lit("")).alias("h"))

    def joined(batches):
        for batch in batches:
            hashes = batch.column("h").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(["".join(hashes[at : at + JOINED]) for at in range(0, len(hashes), JOINED)])], ["piece"])

    pieces = cut(rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").mapInArrow(joined, "piece string").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    digest = hashlib.sha256()
    # a range's pieces are read by its number; ranges and pieces are in order
    for (part,) in sorted(tuple(r) for r in pieces.select("part").distinct().collect()):
        for r in pieces.where(F.col("part") == part).orderBy("at").select("piece").toLocalIterator():
            digest.update(r["piece"].encode())
    return df.sparkSession.createDataFrame([(digest.hexdigest(),)], "signature string")


def containment(rows: DataFrame) -> DataFrame:
    """(parent, n_children, children): BELONGS_TO claims as an adjacency list, all children in order."""
    up = rows.where("predicate = 'BELONGS_TO'").select(F.col("object_ref").alias("parent"), "subject").distinct()
    return up.groupBy("parent").agg(F.count("*").alias("n_children"), F.array_join(F.sort_array(F.collect_list("subject")), ",").alias("children"))


def multi_query_evidence(hits: DataFrame, provenance: DataFrame) -> DataFrame:
    """hits (query_no, entity_id, score, ref) of several queries: each entity's first, with its source kinds and the `METHOD path` in its reference."""
    first = hits.groupBy("entity_id").agg(F.min(F.struct("query_no", (-F.col("score")).alias("s"), "ref")).alias("h")).select("entity_id", "h.query_no", (-F.col("h.s")).alias("score"), "h.ref")
    kinds = provenance.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("source_kinds"))
    operation = F.nullif(F.regexp_extract("ref", r"\b(GET|PUT|POST|PATCH|DELETE) (/\S*)", 0), F.lit(""))
    return first.join(kinds, "entity_id", "left").withColumn("operation", operation)
