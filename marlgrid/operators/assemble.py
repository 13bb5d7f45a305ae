"""The capability graph out of its sources: each contributes extensions, edges and provenance, which are then merged by authority.

Every source is a table or None; what a source names that no route leads to is unlinked.  Sources contribute in the order
SDK methods, exemplars, API operations, documentation, labs, posts; ties of authority keep the earlier contributor.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.functions.text import minted_id
from marlgrid.operators.build import AUTHORITY, MENTION_FLOOR, deduped_edges, deduped_provenance, linked_exemplars, recency_decayed, tier
from marlgrid.operators.relational import latest_per_key, zero_filled
from marlgrid.operators.staging import cut


@dataclass(frozen=True)
class Taxonomy:
    """Where things belong.  metas: (meta_skill_id, top_order_id, title); tops: (top_order_id, title).

    modules: SDK module -> parent; prefixes: API path prefix -> parent, the first that fits; sections: documentation section -> parent;
    phases: labs phase -> parent, with `default_phase` for commands of none; rules: (extension_id, sections, words) that tie pages to extensions.
    """

    metas: DataFrame
    tops: DataFrame
    modules: Mapping[str, str] = field(default_factory=dict)
    prefixes: Sequence[tuple[str, str]] = ()
    sections: Mapping[str, str] = field(default_factory=dict)
    phases: Mapping[str, str] = field(default_factory=dict)
    default_phase: str | None = None
    rules: Sequence[tuple[str, Sequence[str], Sequence[str]]] = ()


@dataclass
class Contribution:
    """What one source adds; any part can be None."""

    extensions: DataFrame | None = None
    edges: DataFrame | None = None
    provenance: DataFrame | None = None
    parents: DataFrame | None = None
    unlinked: DataFrame | None = None


EXTENSION = "extension_id string, meta_skill_id string, title string, synopsis string, effect_class string, when_to_use string, authority double, lifecycle string, surface string, source_kind string, indexed_at_ms long, deprecated_by string, exemplar string, stage int, ordinal long"
EDGE = "src_id string, dst_id string, edge_kind string, weight double, recorded_at_ms long"
PROVENANCE = "entity_id string, source_kind string, ref string, content_hash string, parsed_at_ms long, commit_sha string"


def _mapped(value: Column, pairs: Mapping[str, str]) -> Column:
    """The value's entry, null where it has none."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[value]


def first_line(doc: Column, most: int = 280) -> Column:
    return F.substring(F.substring_index(F.trim(F.coalesce(doc, F.lit(""))), "\n", 1), 1, most)


def spoken(name: Column) -> Column:
    """A name with its underscores as spaces and its words capitalised."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def _contribution(routed: DataFrame, kind: str, stage: int, at_ms: int, entity: str, columns: dict, slug: Column, ref: Column, commit: Column | None = None) -> Contribution:
    """routed: rows with `meta`, `entity`, content_hash and ordinal; one extension, one `derives` edge and one provenance row each."""
    weight = AUTHORITY[kind]
    rows = routed.where("meta is not null").select("*", F.concat("meta", F.lit("/ext:"), minted_id(slug)).alias("extension_id"))
    constant = {"authority": F.lit(weight), "source_kind": F.lit(kind), "indexed_at_ms": F.lit(at_ms).cast("long"), "deprecated_by": F.lit(None).cast("string"), "exemplar": F.lit(None).cast("string"), "stage": F.lit(stage)}
    extensions = rows.select("extension_id", F.col("meta").alias("meta_skill_id"), *[c.alias(n) for n, c in (columns | constant).items()], "ordinal")
    edges = rows.select(F.col("extension_id").alias("src_id"), F.col(entity).alias("dst_id"), F.lit("derives").alias("edge_kind"), F.lit(weight).alias("weight"), F.lit(at_ms).cast("long").alias("recorded_at_ms"))
    provenance = rows.select(F.col("extension_id").alias("entity_id"), F.lit(kind).alias("source_kind"), ref.alias("ref"), "content_hash", F.lit(at_ms).cast("long").alias("parsed_at_ms"), (F.lit(None).cast("string") if commit is None else commit).alias("commit_sha"))
    parents = rows.select(F.col("meta").alias("meta_skill_id"), F.lit(kind).alias("source_kind"), F.lit(at_ms).cast("long").alias("parsed_at_ms"))
    return Contribution(extensions, edges, provenance, parents, routed.where("meta is null").select(F.col(entity).alias("entity_id")))


def from_sdk(methods: DataFrame, taxonomy: Taxonomy, at_ms: int, version: str | None = None) -> Contribution:
    """methods: method_id, module, class_name, name, doc, effect, deprecated, paginates_id, successor_id, content_hash, ordinal.

    A method that only pages through another one which is there as well makes no extension.  A deprecated method's extension names
    its successor's, and an edge leads there."""
    routed = methods.withColumn("meta", _mapped(F.lower("module"), taxonomy.modules))
    peers = methods.select(F.col("method_id").alias("peer_")).distinct()
    own = routed.join(peers, routed["paginates_id"] == F.col("peer_"), "left").where("peer_ is null or meta is null").drop("peer_")
    columns = {
        "title": spoken(F.col("name")),
        "synopsis": first_line(F.col("doc")),
        "effect_class": F.coalesce("effect", F.lit("unclassified")),
        "when_to_use": F.substring(F.coalesce("doc", F.lit("")), 1, 500),
        "lifecycle": F.when(F.col("deprecated"), "deprecated").otherwise("ga"),
        "surface": F.lit("sdk"),
    }
    made = _contribution(own, "sdk", 0, at_ms, "method_id", columns, F.col("name"), F.concat_ws(".", "module", "class_name", "name"), F.lit(version).cast("string"))
    placed = own.where("meta is not null").select("method_id", "successor_id", "ordinal", F.concat("meta", F.lit("/ext:"), minted_id("name")).alias("extension_id"))
    later = placed.select(F.col("method_id").alias("successor_id"), F.col("extension_id").alias("next_id"))
    links = placed.where("successor_id is not null").join(later, "successor_id").where("extension_id != next_id")
    newest = links.groupBy("extension_id").agg(F.max_by("next_id", "ordinal").alias("named_"))
    made.extensions = made.extensions.join(newest, "extension_id", "left").withColumn("deprecated_by", F.col("named_")).drop("named_")
    made.edges = made.edges.unionByName(links.select(F.col("extension_id").alias("src_id"), F.col("next_id").alias("dst_id"), F.lit("deprecates").alias("edge_kind"), F.lit(AUTHORITY["sdk"]).alias("weight"), F.lit(at_ms).cast("long").alias("recorded_at_ms")))
    return made


def from_openapi(operations: DataFrame, taxonomy: Taxonomy, at_ms: int) -> Contribution:
    """operations: operation_id, raw_id, method, path, summary, description, effect, deprecated, content_hash, ordinal."""
    meta = F.lit(None).cast("string")
    for prefix, target in reversed(taxonomy.prefixes):
        meta = F.when(F.col("path").startswith(prefix), target).otherwise(meta)
    slug = F.lower(F.coalesce("raw_id", F.substring_index("operation_id", ":", -1)))
    columns = {
        "title": F.coalesce("summary", spoken(slug)),
        "synopsis": first_line(F.coalesce("summary", "description")),
        "effect_class": F.coalesce("effect", F.lit("unclassified")),
        "when_to_use": F.substring(F.coalesce("description", "summary", F.lit("")), 1, 500),
        "lifecycle": F.when(F.col("deprecated"), "deprecated").otherwise("ga"),
        "surface": F.lit("sdk"),
    }
    return _contribution(operations.withColumn("meta", meta), "openapi", 2, at_ms, "operation_id", columns, slug, F.concat_ws(" ", "method", "path"))


def from_labs(callables: DataFrame, taxonomy: Taxonomy, at_ms: int, revision: str | None = None) -> Contribution:
    """callables: callable_id, qualname, name, doc, phase, is_method, is_command, content_hash, ordinal; commands, and functions of a known phase."""
    own = callables.where(F.col("is_command") | (~F.col("is_method") & (F.col("phase") != "unknown")))
    routed = own.withColumn("meta", F.coalesce(_mapped(F.col("phase"), taxonomy.phases), F.lit(taxonomy.default_phase).cast("string")))
    columns = {
        "title": spoken(F.col("name")),
        "synopsis": first_line(F.col("doc")),
        "effect_class": F.when(F.col("phase") == "transpile", "write").otherwise("read"),
        "when_to_use": F.substring(F.coalesce("doc", F.lit("")), 1, 500),
        "lifecycle": F.lit("public-preview"),
        "surface": F.when(F.col("is_command"), "cli").otherwise("sdk"),
    }
    return _contribution(routed, "labs", 4, at_ms, "callable_id", columns, F.col("name"), F.concat(F.lit("labs:"), "qualname"), F.lit(revision).cast("string"))


def from_docs(pages: DataFrame, current: DataFrame, taxonomy: Taxonomy, at_ms: int) -> Contribution:
    """pages: page_id, section_root, title, url, content_hash, chunk_ids, ordinal; current: the extensions so far.

    A page belongs to its section's parent, which cites its chunks.  By the rules it also belongs to extensions that are there; those cite
    its chunks, and a stub among them is filled from the first such page."""
    weight = AUTHORITY["docs"]
    routed = pages.withColumn("meta", _mapped(F.col("section_root"), taxonomy.sections))
    linked = routed.where("meta is not null")
    words = F.lower(F.concat_ws(" ", F.coalesce("section_root", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))))
    hits = [F.when(F.col("section_root").isin(*roots) & reduce(lambda a, b: a | b, [F.contains(words, F.lit(w)) for w in tokens]), F.lit(ext)) for ext, roots, tokens in taxonomy.rules]
    targets = linked.select("*", F.explode(F.array_compact(F.array(*hits, F.lit(None).cast("string")))).alias("extension_id")).join(current.select("extension_id"), "extension_id", "left_semi")
    cites = linked.select(F.col("meta").alias("src_id"), "chunk_ids").unionByName(targets.select(F.col("extension_id").alias("src_id"), "chunk_ids"))
    edges = cites.select("src_id", F.explode("chunk_ids").alias("dst_id"), F.lit("cites").alias("edge_kind"), F.lit(weight).alias("weight"), F.lit(at_ms).cast("long").alias("recorded_at_ms"))
    said = linked.select(F.col("meta").alias("entity_id"), "url", "content_hash").unionByName(targets.select(F.col("extension_id").alias("entity_id"), "url", "content_hash"))
    provenance = said.select("entity_id", F.lit("docs").alias("source_kind"), F.col("url").alias("ref"), "content_hash", F.lit(at_ms).cast("long").alias("parsed_at_ms"), F.lit(None).cast("string").alias("commit_sha"))
    parents = linked.select(F.col("meta").alias("meta_skill_id"), F.lit("docs").alias("source_kind"), F.lit(at_ms).cast("long").alias("parsed_at_ms"))
    page = targets.select("extension_id", F.col("title").alias("page_title"), F.col("ordinal").alias("page_ordinal"))
    filled = page.join(current, "extension_id").select("extension_id", "meta_skill_id", "title", F.substring(F.coalesce(F.nullif("page_title", F.lit("")), "synopsis"), 1, 280).alias("synopsis"), "effect_class", "when_to_use", F.lit(weight).alias("authority"), "lifecycle", F.lit("docs").alias("surface"), F.lit("docs").alias("source_kind"), F.lit(at_ms).cast("long").alias("indexed_at_ms"), "deprecated_by", "exemplar", F.lit(3).alias("stage"), F.col("page_ordinal").alias("ordinal"))
    return Contribution(filled, edges, provenance, parents, routed.where("meta is null").select(F.col("page_id").alias("entity_id")))


def from_posts(posts: DataFrame, chunks: DataFrame, mentions: DataFrame | None, taxonomy: Taxonomy, at_ms: int, now_ms: int) -> Contribution:
    """posts: post_id, url, published_at_ms, content_hash; chunks: chunk_id, post_id, content_hash; mentions: chunk_id, meta_skill_id, confidence.

    Without mentions posts leave provenance alone and every chunk is unlinked.  With them, confident mentions of known parents make
    edges that weigh the post's decayed authority times the confidence; chunks without a confident mention are unlinked."""
    if mentions is None:
        provenance = posts.select(F.lit("corpus:blog").alias("entity_id"), F.lit("blog").alias("source_kind"), F.col("url").alias("ref"), "content_hash", F.lit(at_ms).cast("long").alias("parsed_at_ms"), F.lit(None).cast("string").alias("commit_sha"))
        return Contribution(provenance=provenance, unlinked=chunks.select(F.col("chunk_id").alias("entity_id")))
    sure = mentions.where(F.col("confidence") >= MENTION_FLOOR)
    known = sure.join(taxonomy.metas.select("meta_skill_id"), "meta_skill_id", "left_semi").join(chunks, "chunk_id").join(posts.select("post_id", "url", "published_at_ms"), "post_id")
    weight = recency_decayed(F.col("published_at_ms"), now_ms, AUTHORITY["blog"]) * F.col("confidence")
    edges = known.select(F.col("meta_skill_id").alias("src_id"), F.col("chunk_id").alias("dst_id"), F.lit("mentions").alias("edge_kind"), weight.alias("weight"), F.lit(at_ms).cast("long").alias("recorded_at_ms"))
    provenance = known.select(F.col("meta_skill_id").alias("entity_id"), F.lit("blog").alias("source_kind"), F.col("url").alias("ref"), "content_hash", F.lit(at_ms).cast("long").alias("parsed_at_ms"), F.lit(None).cast("string").alias("commit_sha"))
    parents = known.select("meta_skill_id", F.lit("blog").alias("source_kind"), F.lit(at_ms).cast("long").alias("parsed_at_ms"))
    unlinked = chunks.join(sure.select("chunk_id"), "chunk_id", "left_anti").select(F.col("chunk_id").alias("entity_id"))
    return Contribution(edges=edges, provenance=provenance, parents=parents, unlinked=unlinked)


def merged(rows: DataFrame) -> DataFrame:
    """One row an extension: the most trusted, the earliest among equals; an exemplar that any of them names is kept."""
    best = latest_per_key(rows, ["extension_id"], [F.desc("authority"), F.asc("stage"), F.asc("ordinal")])
    named = rows.where("exemplar is not null").groupBy("extension_id").agg(F.min_by("exemplar", F.struct("stage", "ordinal")).alias("named_"))
    return best.join(named, "extension_id", "left").withColumn("exemplar", F.coalesce("exemplar", "named_")).drop("named_")


@dataclass
class Graph:
    tops: DataFrame
    metas: DataFrame
    extensions: DataFrame
    edges: DataFrame
    provenance: DataFrame
    unlinked: DataFrame
    broken: DataFrame


def build(
    spark: SparkSession,
    taxonomy: Taxonomy,
    snapshot_id: str,
    at_ms: int,
    now_ms: int,
    sdk: DataFrame | None = None,
    exemplars: DataFrame | None = None,
    openapi: DataFrame | None = None,
    docs: DataFrame | None = None,
    labs: DataFrame | None = None,
    posts: tuple[DataFrame, DataFrame, DataFrame | None] | None = None,
    version: str | None = None,
    revision: str | None = None,
) -> Graph:
    """The graph of the sources that are given; without any, every top order with counts of zero and nothing else.

    exemplars: (skill_id, pointer); a pointer to an extension of a known parent that isn't there makes a stub of no authority."""
    parts: list[Contribution] = []
    if sdk is not None:
        parts.append(from_sdk(sdk, taxonomy, at_ms, version))
    if openapi is not None:
        parts.append(from_openapi(openapi, taxonomy, at_ms))
    broken = spark.createDataFrame([], "skill_id string, pointer string, reason string")
    if exemplars is not None:
        # exemplars come right after the SDK, whose extensions they point to
        so_far = merged(parts[0].extensions) if sdk is not None else spark.createDataFrame([], EXTENSION)
        known = so_far.select(F.substring_index("extension_id", "/ext:", -1).alias("extension_id"), F.regexp_replace("meta_skill_id", "^meta:", "").alias("meta_skill_id"))
        metas = taxonomy.metas.select(F.regexp_replace("meta_skill_id", "^meta:", "").alias("meta_skill_id"))
        linked, stubs, broken = linked_exemplars(exemplars, known, metas)
        full = F.concat(F.lit("meta:"), "meta_skill_id", F.lit("/ext:"), "extension_id")
        of = linked.select(full.alias("extension_id"), "skill_id").groupBy("extension_id").agg(F.min("skill_id").alias("skill_"))
        if sdk is not None:
            parts[0].extensions = parts[0].extensions.join(of, "extension_id", "left").withColumn("exemplar", F.coalesce("exemplar", "skill_")).drop("skill_")
        blank = F.lit("")
        made = stubs.select(full.alias("extension_id"), F.concat(F.lit("meta:"), "meta_skill_id").alias("meta_skill_id"), spoken(F.replace("extension_id", F.lit("-"), F.lit("_"))).alias("title"), blank.alias("synopsis"), F.lit("unclassified").alias("effect_class"), blank.alias("when_to_use"), F.lit(AUTHORITY["hand"]).alias("authority"), F.lit("ga").alias("lifecycle"), F.lit("hand").alias("surface"), F.lit("hand").alias("source_kind"), F.lit(at_ms).cast("long").alias("indexed_at_ms"), F.lit(None).cast("string").alias("deprecated_by"), "exemplar", F.lit(1).alias("stage"), F.lit(0).cast("long").alias("ordinal"))
        pointed = made.select("extension_id", "meta_skill_id", "exemplar").unionByName(of.select("extension_id", F.substring_index("extension_id", "/", 1).alias("meta_skill_id"), F.col("skill_").alias("exemplar")))
        provenance = pointed.select(F.col("extension_id").alias("entity_id"), F.lit("hand").alias("source_kind"), F.col("exemplar").alias("ref"), F.substring(F.sha2("exemplar", 256), 1, 16).alias("content_hash"), F.lit(at_ms).cast("long").alias("parsed_at_ms"), F.lit(None).cast("string").alias("commit_sha"))
        parents = pointed.select("meta_skill_id", F.lit("hand").alias("source_kind"), F.lit(at_ms).cast("long").alias("parsed_at_ms"))
        edges = pointed.select(F.col("exemplar").alias("src_id"), F.col("extension_id").alias("dst_id"), F.lit("exemplifies").alias("edge_kind"), F.lit(1.0).alias("weight"), F.lit(at_ms).cast("long").alias("recorded_at_ms"))
        parts.append(Contribution(made, edges, provenance, parents))
    if docs is not None:
        current = [p.extensions for p in parts if p.extensions is not None]
        so_far = cut(merged(reduce(DataFrame.unionByName, current))) if current else spark.createDataFrame([], EXTENSION)
        parts.append(from_docs(docs, so_far, taxonomy, at_ms))
    if labs is not None:
        parts.append(from_labs(labs, taxonomy, at_ms, revision))
    if posts is not None:
        parts.append(from_posts(*posts, taxonomy, at_ms, now_ms))

    def every(name: str, schema: str) -> DataFrame:
        found = [getattr(p, name) for p in parts if getattr(p, name) is not None]
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    stamp = F.lit(snapshot_id).alias("snapshot_id")
    extensions = cut(merged(every("extensions", EXTENSION)).withColumn("tier", tier(F.col("authority"))).join(taxonomy.metas.select("meta_skill_id", "top_order_id"), "meta_skill_id", "left").drop("stage", "ordinal").withColumn("snapshot_id", F.lit(snapshot_id)))
    edges = deduped_edges(every("edges", EDGE).select(stamp, "*"))
    provenance = deduped_provenance(every("provenance", PROVENANCE).select(stamp, "*"))
    kinds = F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])
    rolled = every("parents", "meta_skill_id string, source_kind string, parsed_at_ms long").groupBy("meta_skill_id").agg(F.array_join(F.sort_array(F.collect_set("source_kind")), ",").alias("source_kinds"), F.max(kinds[F.col("source_kind")]).alias("best"), F.max("parsed_at_ms").alias("indexed_at_ms"))
    metas = cut(taxonomy.metas.join(rolled, "meta_skill_id").select(stamp, "meta_skill_id", "top_order_id", "title", "source_kinds", tier(F.col("best")).alias("authority"), "indexed_at_ms"))
    counts = metas.groupBy("top_order_id").agg(F.count("*").alias("n_metas")).join(extensions.groupBy("top_order_id").agg(F.count("*").alias("n_extensions"), F.count("exemplar").alias("n_exemplars")), "top_order_id", "full")
    tops = zero_filled(taxonomy.tops.select("top_order_id", "title"), counts, "top_order_id", ["n_metas", "n_extensions", "n_exemplars"])
    return Graph(tops, metas, extensions, edges, provenance, every("unlinked", "entity_id string"), broken)
