"""Retrieval over claims, edges and vectors: lexical top-k, structural seeds, personalised PageRank, two substrates, vector search.

claims: claim_id, subject, predicate, value_json, metadata_json, ordinal (the order of arrival, which settles ties).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgrid.functions.text import claim_text, jaccard, token_set
from marlgrid.operators.claims import mentions
from marlgrid.operators.graph import bfs, decayed_walk, ppr
from marlgrid.operators.staging import cut, numbered


@dataclass(frozen=True)
class SearchSettings:
    """Fixed values of the search: seeds, weights and PageRank's constants."""

    seed_ceiling: int = 50
    structural_from: int = 5
    depth: int = 2
    w_doc: float = 0.4
    w_struct: float = 0.6
    alpha: float = 0.15
    tolerance: float = 1e-6
    rounds: int = 100


def lexical(query: str, claims: DataFrame, most: int | None = 50, null_word: str | None = None) -> DataFrame:
    """claims with `score`, the Jaccard similarity of the token sets, above 0; the best `most`, earlier ones first in ties."""
    text = claim_text(F.col("subject"), F.col("predicate"), F.col("value_json"), F.col("metadata_json"), null_word)
    scored = claims.withColumn("score", jaccard(token_set(F.lit(query)), token_set(text))).where("score > 0")
    return scored if most is None else scored.orderBy(F.desc("score"), "ordinal").limit(most)


def structural_seeds(found: DataFrame, edges: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(seed_rank, subject, predicate, score): two hops from the subjects of the best lexical refs; a repeated subject walks again."""
    w = Window.orderBy(F.desc("score"), "ordinal")
    top = found.orderBy(F.desc("score"), "ordinal").limit(s.structural_from).withColumn("seed_rank", F.row_number().over(w).cast("long"))
    walks = bfs(edges, top.select(F.col("subject").alias("seed")).distinct(), s.depth)
    return top.select("seed_rank", F.col("subject").alias("seed")).join(walks, "seed").select("seed_rank", F.col("node").alias("subject"), "predicate", "score", "depth")


def personalization(found: DataFrame, structural: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(node, mass): lexical and structural scores by subject, weighted, adding up to 1."""
    bag = found.select("subject", (F.col("score") * s.w_doc).alias("m")).unionByName(structural.select("subject", (F.col("score") * s.w_struct).alias("m")))
    total = bag.agg(F.sum("m").alias("total"))
    return bag.groupBy(F.col("subject").alias("node")).agg(F.sum("m").alias("m")).join(F.broadcast(total)).select("node", (F.col("m") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))).alias("mass"))


def search(query: str, claims: DataFrame, edges: DataFrame, k: int = 20, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(ref_id, subject, predicate, score, via): lexical and structural refs with their PageRank, the k best.

    A lexical ref scores w_doc * lexical + (1 - w_doc) * rank, a structural one w_struct * (structural + rank) / 2.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # each is used several times: the claims are read once, and of all ranks those asked for are kept
    found = cut(lexical(query, claims, s.seed_ceiling))
    structural = cut(structural_seeds(found, edges, s))
    asked = found.select("subject").unionByName(structural.select("subject")).distinct()
    rank = ppr(edges, personalization(found, structural, s), s.alpha, s.tolerance, s.rounds).withColumnRenamed("score", "rank")
    rank = cut(rank.join(asked, F.col("node") == F.col("subject"), "left_semi"))
    a = found.join(rank, F.col("subject") == F.col("node"), "left").select(F.col("claim_id").alias("ref_id"), "subject", "predicate", (s.w_doc * F.col("score") + (1 - s.w_doc) * F.coalesce("rank", F.lit(0.0))).alias("score"), F.lit("lexical").alias("via"))
    once = structural.groupBy("subject", "predicate").agg(F.min_by("score", "seed_rank").alias("score"))
    b = once.join(rank, F.col("subject") == F.col("node"), "left").select(F.concat_ws(":", F.lit("walk"), "predicate", "subject").alias("ref_id"), "subject", "predicate", (s.w_struct * (F.col("score") + F.coalesce("rank", F.lit(0.0))) / 2).alias("score"), F.lit("structural").alias("via"))
    return a.unionByName(b.join(a.select("ref_id"), "ref_id", "left_anti")).orderBy(F.desc("score"), "ref_id").limit(k)


def dual_search(query: str, workspace: DataFrame, capability: DataFrame, edges: DataFrame, k: int = 20, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(subject, substrate, score, rank): both substrates' lexical refs, the capability's weighted by its claims' authority
    (authority_weight, 0.85 where missing; the workspace's is 1), ranked together; a subject in both goes to the one with the
    higher weighted score, to the workspace in a tie."""
    sides = []
    for name, claims, weight in (("workspace", workspace, F.lit(1.0)), ("capability", capability, F.coalesce(numeric(capability, "authority_weight"), F.lit(0.85)))):
        found = lexical(query, claims, s.seed_ceiling)
        sides.append(found.select("claim_id", "subject", "predicate", "ordinal", (F.col("score") * weight).alias("score"), F.lit(name).alias("substrate")))
    both = cut(sides[0].unionByName(sides[1]))
    structural = cut(structural_seeds(both, edges, s))
    rank = ppr(edges, personalization(both, structural, s), s.alpha, s.tolerance, s.rounds).withColumnRenamed("score", "rank")
    best = both.groupBy("subject").agg(F.max(F.when(F.col("substrate") == "workspace", F.col("score"))).alias("w"), F.max(F.when(F.col("substrate") == "capability", F.col("score"))).alias("c"))
    owned = best.select("subject", F.when(F.col("w").isNull(), "capability").when(F.col("c").isNull() | (F.col("w") >= F.col("c")), "workspace").otherwise("capability").alias("substrate"), F.greatest("w", "c").alias("lexical"))
    ranked = owned.join(rank, F.col("subject") == F.col("node"), "left").withColumn("rank", F.coalesce("rank", F.lit(0.0)))
    return ranked.select("subject", "substrate", (s.w_doc * F.col("lexical") + (1 - s.w_doc) * F.col("rank")).alias("score"), "rank").orderBy(F.desc("score"), "subject").limit(k)


def numeric(df: DataFrame, column: str) -> Column:
    """The column as a double where its type is a number's; null for every other type, booleans and strings of digits too, and where it is absent.

    Of a variant column each row's own type counts."""
    kind = next((f.dataType for f in df.schema if f.name == column), None)
    if isinstance(kind, T.VariantType):
        return F.when(F.expr(f"schema_of_variant({column})").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.expr(f"try_variant_get({column}, '$', 'double')"))
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects for which the two substrates hold the same predicate with different values."""
    other = b.select("subject", "predicate", F.col("value_json").alias("other"))
    return a.join(other, ["subject", "predicate"]).where(~F.col("value_json").eqNullSafe(F.col("other"))).select("subject").distinct()


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def vector_top_k(vectors: DataFrame, query: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score) of the k vectors nearest to the one row of query by cosine; k is at most 20, ties go to the smaller id."""
    one = F.broadcast(query.select(F.col(vector_col).alias("q")).limit(1))
    return vectors.join(one).select(id_col, cosine(F.col(vector_col), F.col("q")).alias("score")).where("score is not null").orderBy(F.desc("score"), id_col).limit(min(max(1, k), 20))


def lookup(chunks: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """(predicate, subject, chunk_id, confidence, text): a document's chunks (document_id, chunk_id, chunk_text) as CONTENT claims, and what was
    found in them (chunk_id, target, confidence) as MENTIONS of known targets; malformed and unknown ones are QUESTION rows, with the reason as text."""
    content = chunks.select(F.lit("CONTENT").alias("predicate"), F.col("document_id").alias("subject"), "chunk_id", F.lit(None).cast("double").alias("confidence"), F.col("chunk_text").alias("text"))
    good, questions = mentions(found.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), known)
    said = good.select(F.lit("MENTIONS").alias("predicate"), F.col("target").alias("subject"), "chunk_id", "confidence", F.lit(None).cast("string").alias("text"))
    asked = questions.select(F.lit("QUESTION").alias("predicate"), F.col("target").alias("subject"), "chunk_id", "confidence", F.col("reason").alias("text"))
    return content.unionByName(said).unionByName(asked)


def top_label(vectors: DataFrame, queries: DataFrame, label: str, most: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, top_id): for each query (query_id, q) the label of the nearest other vector by cosine, ties to the smaller id.

    Up to `most` queries stand in the plan of one scan.  A longer list is dealt into blocks of that many, each of which meets all vectors; each query keeps one
    row a task."""
    asked = queries.select("query_id", F.transform("q", lambda x: x.cast("double")).alias("q"))
    few = asked.limit(most + 1).collect()
    if not few:
        return queries.select("query_id", F.lit(None).cast("string").alias("top_id"))
    rows = vectors.select(id_col, label, vector_col)
    if len(few) <= most:
        own = F.array(*[F.struct(F.lit(r["query_id"]).alias("query_id"), F.array(*[F.lit(x) for x in r["q"]]).alias("q")) for r in few])
        met = rows.withColumn("a", F.explode(own))
    else:
        blocks = numbered(asked, "query_id").groupBy(F.floor((F.col("position") - 1) / most).cast("int").alias("block")).agg(F.collect_list(F.struct("query_id", "q")).alias("own"))
        blocks = cut(blocks)
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks.count() - 1))).alias("block")
        met = rows.select("*", each).join(blocks, "block").drop("block").withColumn("a", F.explode("own")).drop("own")
    scored = met.where(F.col(id_col) != F.col("a.query_id")).select(F.col("a.query_id").alias("query_id"), F.struct(cosine(F.col(vector_col), F.col("a.q")).alias("s"), (-F.col(id_col)).alias("v"), F.col(label).alias("label")).alias("r"))
    return scored.groupBy("query_id").agg(F.max("r")["label"].alias("top_id"))


def similar_neighbours(hits: DataFrame, entity_id: str, near: int = 5) -> DataFrame:
    """(entity_id, label, relation, hop) of vector hits (entity_id, meta_skill_id, chunk_text, score) where no edges are at hand.

    A hit under the entity's own parent is a sibling, any other one a mention; siblings and the first `near` are one hop away.
    The entity itself, hits without an id and repeated ones are left out."""
    parent = entity_id.split("/")[0] if "/" in entity_id else ""
    once = hits.where((F.coalesce("entity_id", F.lit("")) != "") & (F.col("entity_id") != entity_id))
    best = once.groupBy("entity_id").agg(F.max(F.struct("score", "meta_skill_id", "chunk_text")).alias("b")).select("entity_id", "b.*")
    # at most the hits of one search
    place = F.row_number().over(Window.orderBy(F.desc("score"), "entity_id"))
    sibling = F.coalesce((F.col("meta_skill_id") != "") & (F.col("meta_skill_id") == parent), F.lit(False))
    told = best.withColumn("place", place)
    return told.select("entity_id", F.nullif(F.substring(F.coalesce("chunk_text", F.lit("")), 1, 60), F.lit("")).alias("label"), F.when(sibling, "sibling").otherwise("mentions").alias("relation"), F.when(sibling | (F.col("place") <= near), 1).otherwise(2).alias("hop"))


def ask_context(hits: DataFrame, edges: DataFrame, texts: DataFrame, seeds: int = 5, fetched: int = 15, context: int = 12) -> DataFrame:
    """(node, score, source, text): the hits, then the neighbours of the best ones by decayed walk with their text, once each; the first `context`."""
    best = hits.orderBy(F.desc("score"), "node").limit(seeds).select("node")
    around = decayed_walk(edges, best, most=fetched)
    rows = hits.select("node", "score", F.lit(0).alias("tier"), F.lit("hit").alias("source")).unionByName(around.select("node", "score", F.lit(1).alias("tier"), F.lit("neighbour").alias("source")))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("tier", F.desc("score")))).where("n = 1")
    return first.join(texts.select("node", "text"), "node", "left").orderBy("tier", F.desc("score"), "node").limit(context).select("node", "score", "source", "text")
