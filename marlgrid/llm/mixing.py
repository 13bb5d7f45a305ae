"""Mixing sources to target weights (operator 12): weighted fair queueing, in DataFrame functions only.

Every source is a queue of its shuffled documents, served once, twice, ... up to `most` times over.  A document's virtual finish
time is the running sum of its source's words, divided by the source's target.  All documents are sorted by that time and
taken until the budget is spent; the document that a queue serves at that moment is cut there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.llm.common import table, text_or_empty

#: A word: a run of characters that are neither a space nor a tab, line break, form feed or other of 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(df: DataFrame, order: Sequence[str | Column], values: Sequence[str], name: str, tidy: bool = False) -> DataFrame:
    """df with `position` from 1 in order, and for each value `before_<value>`, its sum over the rows before.

    Range partitions are summed on their own and written; their totals, one row a partition, shift them.  The order must be total but for
    rows that are alike, so that no range holds more than its share.
    """
    own = Window.partitionBy("_part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    local = table(placed.select("*", F.row_number().over(own).cast("long").alias("position"), *[(F.sum(v).over(upto) - F.col(v)).alias(f"before_{v}") for v in values]), name, tidy)
    totals = local.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = totals.select("_part", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in ("rows", *values)])
    out = local.join(F.broadcast(shifts), "_part").withColumn("position", F.col("position") + F.col("_rows"))
    return out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"_{v}") for v in values}).drop("_part", "_rows", *[f"_{v}" for v in values])


def targets(sizes: DataFrame, budget: int, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, place, offset, target, quota) of (source, source_size): what each source gives to a mix of `budget` words.

    Sources by code point, null last, weigh as `weights` says, which repeats; they share the budget by weight, but none gives more than `most` times its
    size, and what is over goes to the others by weight.  quota is the target in whole words, offset the size of all sources before.

    Sources fill up in order of cap / weight.  One is full if its share of what the ones before it leave is its cap or more; the first
    that is not full has the level of all that are not.  That is settled in whole numbers.
    """
    pick = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = running(sizes, [F.col("source").asc_nulls_last()], ["source_size"], "mix-sources").withColumnsRenamed({"position": "place", "before_source_size": "offset"})
    placed = placed.withColumn("weight", pick).withColumn("cap", F.col("source_size") * most)
    filling = table(running(placed.withColumn("fills_at", F.col("cap") / F.col("weight")), ["fills_at", "place"], ["cap", "weight"], "mix-filling").drop("position"), "mix-filling", tidy=False)
    all_weight = filling.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    left, rest = F.lit(budget).cast("decimal(20,0)") - F.col("before_cap"), (F.lit(all_weight) - F.col("before_weight")).cast("decimal(12,0)")
    full = left * F.col("weight").cast("decimal(6,0)") >= F.col("cap").cast("decimal(20,0)") * rest
    level = filling.where(~full).orderBy("fills_at", "place").select(left.cast("long").alias("left"), rest.cast("long").alias("rest")).first()
    target, quota = F.col("cap").cast("double"), F.col("cap")
    if level:
        share, parts = max(0, level["left"]), level["rest"]
        target = F.when(full, target).otherwise(F.lit(share).cast("double") * F.col("weight") / F.lit(parts))
        quota = F.when(full, quota).otherwise(F.col("weight") * F.lit(share // parts) + F.expr(f"({share % parts}L * weight) div {parts}L"))
    return filling.select("source", "source_size", "place", "offset", target.alias("target"), F.least(quota.cast("long"), F.col("cap")).alias("quota"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, budget: int | None = None, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each time that the mix takes a document, and one with taken = 0 for each document that it never takes: row (a number of the
    document's row), doc_id, key, source, size, source_size, target, pass (from 0), finish, at (words of the mix before it), taken (words).

    The budget is all documents' words, unless given.  Each source gives its target in whole words, so the mix falls short of the budget by less
    than one word a source; no document is taken for more than `most` times its words.  The shuffle's key is a digest of the seed, the id and the text, so reruns agree.
    Null texts have no words; rows without a source are a source of their own, which comes last; rows repeated are documents of their own, and so
    are rows without an id.  A source without words has the target 0.  An empty table gives an empty mix; extra columns are ignored, whatever their names.
    """
    text = text_or_empty(text_col)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text).alias("size"), key.alias("key"))
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sizes = table(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes", tidy=False)
    if budget is None:
        budget = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = table(targets(sizes, budget, weights, most).withColumnRenamed("source", "of"), "mix-targets", tidy=False)
    own = rows.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # rows of one key are alike, so their numbers, which may differ from run to run, settle only which of them comes first
    queued = running(own, ["place", "key", "row"], ["size"], "mix-queues", tidy=True).withColumn("start", F.col("before_size") - F.col("offset"))

    def served(turn: Column) -> Column:
        begins = turn * F.col("source_size") + F.col("start")
        given = F.least(F.col("size"), F.col("quota") - begins)
        return F.struct(turn.cast("int").alias("pass"), given.alias("words"), F.try_divide(begins + given, F.col("target")).alias("finish"))

    turns = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), served), lambda t: t["words"] > 0)
    items = queued.withColumn("turn", F.explode_outer(turns)).select("row", "doc_id", "key", "source", "place", "size", "source_size", "target", "turn.*")
    # documents that are never taken come last and are spread by their numbers
    items = items.withColumn("words", F.coalesce("words", F.lit(0).cast("long")))
    timed = running(items, [F.col("finish").asc_nulls_last(), "place", "row"], ["words"], "mix-items", tidy=True)
    limit = F.least(F.col("words"), F.greatest(F.lit(0).cast("long"), F.lit(budget).cast("long") - F.col("before_words")))
    return timed.select("row", "doc_id", "key", "source", "size", "source_size", "target", "pass", "finish", F.when(limit > 0, F.col("before_words")).alias("at"), limit.alias("taken"))


def mixed_texts(docs: DataFrame, items: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, doc_id, source, pass, text): the mix itself, in no order of rows (`at` has it); a document that was cut has its first words, with single spaces between."""
    text = text_or_empty(text_col)
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    texts = docs.select(key.alias("text_key"), text.alias("text")).dropDuplicates(["text_key"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("taken").cast("int")), " ")
    return items.where("taken > 0").join(texts, F.col("key") == F.col("text_key")).select("at", "doc_id", "source", "pass", F.when(F.col("taken") == F.col("size"), F.col("text")).otherwise(cut).alias("text"))


def mix_digests(items: DataFrame) -> DataFrame:
    """One row a document of mix(): doc_id, size, source_size, target, taken, first_at (words of the mix before its first turn; null if it is never taken)."""
    once = items.groupBy("row").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").alias("taken"), F.min("at").alias("first_at"))
    return once.drop("row")
