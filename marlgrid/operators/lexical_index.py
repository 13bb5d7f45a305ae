"""Lexical retrieval from an inverted index: a query reads the postings of its own tokens, and not those that can't matter.

The index is three tables: postings (token, ordinal, size: a claim's place and its number of tokens), sorted by token so that a filter on tokens
skips row groups; tokens (token, n), how many claims hold each; claims, sorted by ordinal.  A Jaccard similarity is worked out from postings alone:
overlap / (tokens of the query + size - overlap).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.functions.text import claim_text, token_set
from marlgrid.operators.staging import cut


@dataclass(frozen=True)
class LexicalIndex:
    """Where an index lies; read it from any session."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def build_index(claims: DataFrame, folder: str, null_word: str | None = None) -> LexicalIndex:
    """An index over claims (subject, predicate, value_json, metadata_json, ordinal, which is unique, and others)."""
    spark = claims.sparkSession
    claims.repartitionByRange("ordinal").sortWithinPartitions("ordinal").write.parquet(f"{folder}/claims")
    text = claim_text(F.col("subject"), F.col("predicate"), F.col("value_json"), F.col("metadata_json"), null_word)
    sets = spark.read.parquet(f"{folder}/claims").select("ordinal", token_set(text).alias("t"))
    # written first: the ranges are drawn from a sample, for which the texts would be taken apart once more
    postings = cut(sets.select(F.explode("t").alias("token"), "ordinal", F.size("t").alias("size")))
    # a token that many claims hold is dealt over several ranges, by ordinal
    postings.repartitionByRange("token", "ordinal").sortWithinPartitions("token", "size", "ordinal").write.parquet(f"{folder}/postings")
    counted = spark.read.parquet(f"{folder}/postings").groupBy("token").agg(F.count("*").alias("n"))
    counted.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{folder}/tokens")
    return LexicalIndex(spark, folder)


def least_overlap(score: float, n_query: int) -> int:
    """The fewest shared tokens with which a claim can reach a score: an overlap of o gives o / n_query at most."""
    return max(1, math.ceil(score * n_query * (1 - 1e-12)))


def ranked(index: LexicalIndex, query: str, most: int | None = 50) -> DataFrame:
    """(ordinal, score) of the best `most` claims by Jaccard similarity above 0, earlier ones first in ties; all of them without `most`.

    The rarest tokens' postings give a first floor: the score of a claim with no more overlap than found there, at the most-th place.  A claim that
    reaches it shares so many tokens that it must hold one of the query's rarest n - least + 1 (the prefix), and its size lies between floor * n and
    n / floor.  Only prefix postings of such sizes make candidates; the other tokens' postings only count towards them.
    """
    spark = index.spark
    tokens = spark.range(1).select(token_set(F.lit(query)).alias("t")).first()["t"]
    known = {r["token"]: r["n"] for r in index.table("tokens").where(F.col("token").isin(tokens)).collect()} if tokens else {}
    order, n = sorted(known, key=lambda t: (known[t], t)), len(tokens)
    postings = index.table("postings")
    score = lambda overlap: F.col(overlap) / (F.lit(n) + F.col("size") - F.col(overlap))
    if not order:
        return spark.createDataFrame([], "ordinal long, score double").select(F.col("ordinal").cast(postings.schema["ordinal"].dataType), "score")
    if most is None:
        met = postings.where(F.col("token").isin(order)).groupBy("ordinal").agg(F.count("*").alias("overlap"), F.first("size").alias("size"))
        return met.select("ordinal", score("overlap").alias("score"))
    floor, held, rare = 0.0, 0, []
    for t in order:  # as many of the rarest tokens as surely have `most` claims, and more up to a fourth of all postings: each raises the floor
        if rare and held >= most * len(rare) and held + known[t] > sum(known.values()) / 4:
            break
        rare.append(t)
        held += known[t]
    first = postings.where(F.col("token").isin(rare)).groupBy("ordinal").agg(F.count("*").alias("overlap"), F.first("size").alias("size"))
    best = first.select(score("overlap").alias("score")).orderBy(F.desc("score")).limit(most).collect()  # at most `most` numbers
    if len(best) == most:
        floor = min(r["score"] for r in best)
    # tokens that no claim has only make the query longer
    prefix = order[: max(1, n - least_overlap(floor, n) + 1 - (n - len(order)))] if floor else order
    fits = (F.col("size") >= math.floor(floor * n)) & (F.col("size") <= (math.ceil(n / floor) if floor else (1 << 31) - 1))
    made = postings.where(F.col("token").isin(prefix) & fits).groupBy("ordinal").agg(F.count("*").alias("overlap"), F.first("size").alias("size"))
    rest = order[len(prefix) :]
    if rest:
        more = postings.where(F.col("token").isin(rest) & fits).select("ordinal").join(made.select("ordinal"), "ordinal", "left_semi").groupBy("ordinal").agg(F.count("*").alias("more"))
        made = made.join(more, "ordinal", "left").withColumn("overlap", F.col("overlap") + F.coalesce("more", F.lit(0)))
    return made.select("ordinal", score("overlap").alias("score")).orderBy(F.desc("score"), "ordinal").limit(most)


def lexical_indexed(query: str, index: LexicalIndex, most: int | None = 50) -> DataFrame:
    """retrieval.lexical() from an index: the claims with `score`, the same rows in the same order."""
    found = ranked(index, query, most)
    claims = index.table("claims")
    if most is None:
        return claims.join(found, "ordinal").select(*claims.columns, "score")
    top = {r["ordinal"]: r["score"] for r in found.collect()}  # at most `most` rows
    told = index.spark.createDataFrame(list(top.items()), f"ordinal {claims.schema['ordinal'].dataType.simpleString()}, score double")
    own = claims.where(F.col("ordinal").isin(list(top))) if top else claims.limit(0)
    return own.join(F.broadcast(told), "ordinal").select(*claims.columns, "score").orderBy(F.desc("score"), "ordinal")
