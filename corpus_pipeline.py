"""A training corpus from the documents table, in five stages; each is written as Parquet and read again by the next.

toxicity: documents that the classifier chain calls toxic go.  near_dedup: of each class of near copies the smallest id
stays.  suffix_dedup: every byte that a 100-byte string covers which also starts earlier goes; characters that this cuts
in two go as well, and documents left without text stay with an empty one.  secrets: found secrets are replaced by their
kind.  packing: what is left becomes sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.llm import near_dup, packing, secret_scan, suffix_dedup, toxicity
from marlgrid.llm.common import load, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text the chain calls toxic go; null and empty texts, repeated rows and rows without an id are judged like any other.
    Without labels nothing is toxic; an empty table stays empty; columns other than those of documents are dropped."""
    found = toxicity.judged(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))
    return found.where("not toxic").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the rows with the smallest id stay.  Rows that share an id are one document, so they stay or go
    together; rows without an id, and texts without words (null, empty), have no copies and stay; an empty table stays empty."""
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the bytes that repeat an earlier document's; rows without an id come first, and rows repeated with
    one id and text lose the same bytes.  Null and short texts stay as they are; an empty table stays empty."""
    left = suffix_dedup.remove_repeats(docs, keep=("lang", "source", "text"))
    # a text that lost nothing stays as it was, null too
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(whole_characters(F.col("kept")))
    return left.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def whole_characters(data):
    """The bytes as text; bytes that no longer form a character go, and so do replacement characters then."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with each secret's characters replaced by its kind; rows with one text are scanned once.  Null texts stay
    null; rows repeated or without an id are treated like any other; an empty table stays empty."""
    return secret_scan.redacted(docs.select(*COLUMNS), table(secret_scan.scan_new(docs), "ledger"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence of 2048 tokens, without the ids themselves.  A null text is packed as an empty one; rows repeated or
    without an id are packed as often as they stand; an empty table gives no pieces."""
    import public_tokenizers as tokenizers

    return packing.pack_digests(packing.pack(docs, tokenizers.path("byte_bpe_50k.json"), 2048, 1, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


STAGES = [("toxicity", toxicity_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_dedup_stage), ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; each one's rows are a Parquet table in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL can express neither the classifier nor the sketches; tests hold the stages against plain Python.
ORACLE_SQL = None
