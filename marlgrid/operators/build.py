"""Graph build: authority, upserts, edges, provenance, roll-ups, exemplar links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlgrid.functions.text import POINTER, pointer_parts
from marlgrid.operators.relational import latest_per_key, zero_filled

# How far each kind of source is trusted, and where the tiers begin.
AUTHORITY = {"sdk": 1.0, "openapi": 0.95, "docs": 0.85, "labs": 0.75, "blog": 0.5, "hand": 0.0}
HIGH, MEDIUM = 0.85, 0.5
#: Mentions below this confidence make no edge.
MENTION_FLOOR = 0.7
HALF_LIFE_DAYS = 365.0
DAY_MS = 86_400_000


def authority(source: Column) -> Column:
    out = F
    for kind, weight in AUTHORITY.items():
        out = out.when(source == kind, weight)
    return out.otherwise(0.0)


def tier(weight: Column) -> Column:
    return F.when(weight >= HIGH, "high").when(weight >= MEDIUM, "medium").otherwise("low")


def tier_rank(name: Column) -> Column:
    return F.when(name == "high", 2).when(name == "medium", 1).otherwise(0)


def recency_decayed(published_ms: Column, now_ms: int, base: float = 0.5, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """base halved every half-life; half of it without a date; dates to come count as now."""
    days = F.greatest(F.lit(0), F.lit(now_ms) - published_ms) / float(DAY_MS)
    return F.when(published_ms.isNull(), base * 0.5).otherwise(base * F.pow(F.lit(0.5), days / half_life_days))


def upsert_by_authority(rows: DataFrame, key: str = "entity_id", weight: str = "authority", arrival: str = "ordinal") -> DataFrame:
    """One row a key: the most trusted, the first to arrive among equals; an exemplar that any contributor named is kept."""
    best = latest_per_key(rows, [key], [F.desc(weight), F.asc(arrival)])
    if "exemplar" not in rows.columns:
        return best
    named = rows.where("exemplar is not null").groupBy(key).agg(F.min_by("exemplar", arrival).alias("_named"))
    return best.join(named, key, "left").withColumn("exemplar", F.coalesce("exemplar", "_named")).drop("_named")


def deduped_edges(edges: DataFrame) -> DataFrame:
    """One row for each snapshot, source, target and kind, with the largest weight and time."""
    return edges.groupBy("snapshot_id", "src_id", "dst_id", "edge_kind").agg(F.max("weight").alias("weight"), F.max("recorded_at_ms").alias("recorded_at_ms"))


def deduped_provenance(rows: DataFrame) -> DataFrame:
    """The newest row of each snapshot, entity, source, reference and hash; the largest commit among equals."""
    return rows.groupBy("snapshot_id", "entity_id", "source_kind", "ref", "content_hash").agg(F.max(F.struct("parsed_at_ms", "commit_sha")).alias("m")).select("snapshot_id", "entity_id", "source_kind", "ref", "content_hash", "m.parsed_at_ms", "m.commit_sha")


def meta_rollup(extensions: DataFrame) -> DataFrame:
    """By parent: its extensions, sorted source kinds, best tier and newest time."""
    best = F.max(tier_rank(F.col("tier")))
    return extensions.groupBy("meta_skill_id").agg(F.count("*").alias("n_extensions"), F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("sources"), F.when(best == 2, "high").when(best == 1, "medium").otherwise("low").alias("tier"), F.max("recorded_at_ms").alias("recorded_at_ms"))


def top_rollup(orders: DataFrame, metas: DataFrame) -> DataFrame:
    """Counts for every top order, zero where nothing belongs to it."""
    return zero_filled(orders, metas.groupBy("top_order_id").agg(F.count("*").alias("n_meta_skills"), F.sum("n_extensions").alias("n_extensions")), "top_order_id", ["n_meta_skills", "n_extensions"])


def mention_edges(mentions: DataFrame, taxonomy: DataFrame, now_ms: int) -> DataFrame:
    """Edges from confident mentions of known entities, weighted by decayed authority and confidence."""
    sure = mentions.where(F.col("confidence") >= MENTION_FLOOR).join(taxonomy.select(F.col("meta_skill_id").alias("dst_id")), "dst_id", "left_semi")
    return sure.select("src_id", "dst_id", F.lit("mentions").alias("edge_kind"), (recency_decayed(F.col("published_at_ms"), now_ms) * F.col("confidence")).alias("weight"))


def linked_exemplars(pointers: DataFrame, extensions: DataFrame, metas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(linked, stubs, broken) of pointers (skill_id, pointer): to an extension; to a known parent without it, which gets a stub; and why not."""
    parsed = pointers.withColumn("p", pointer_parts("pointer")).select("skill_id", "pointer", F.col("p.meta").alias("meta_skill_id"), F.col("p.ext").alias("extension_id"))
    known = parsed.join(metas.select("meta_skill_id", F.lit(True).alias("has_meta")), "meta_skill_id", "left").join(extensions.select("extension_id", "meta_skill_id", F.lit(True).alias("has_ext")), ["extension_id", "meta_skill_id"], "left")
    linked = known.where("has_ext").select("skill_id", "meta_skill_id", "extension_id")
    stubs = known.where("has_meta and has_ext is null").select("extension_id", "meta_skill_id", F.col("skill_id").alias("exemplar")).groupBy("extension_id", "meta_skill_id").agg(F.min("exemplar").alias("exemplar"))
    broken = known.where("has_meta is null").select("skill_id", "pointer", F.when(~F.coalesce(F.col("pointer").rlike(POINTER), F.lit(False)), "malformed_pointer").otherwise("unknown_meta_skill").alias("reason"))
    return linked, stubs, broken
