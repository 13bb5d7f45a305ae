"""Embeddings: requests cut by a budget, vectors from a callable in batches with retries, a cache, metadata, keyed upserts."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlgrid.functions.text import token_estimate_chars
from marlgrid.operators.relational import latest_per_key
from marlgrid.operators.snapshot import budget_cut, cache_plan
from marlgrid.operators.staging import cut, shared_folder

VECTOR = "content_hash string, embedding array<double>, error_kind string, error string, attempts int"
# Fixed values of the stand-in vectors: the seed's range, the waves' steps and their height.
SEED_RANGE, SEED_STEP, PLACE_STEP, HEIGHT = 1_000_003, 0.001, 0.017, 0.05


def synthetic_vector(text: Column, dims: int) -> Column:
    """A deterministic stand-in for a text's embedding: a sinusoid whose phase comes from the first 8 bytes of the text's SHA-256."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    # the 64-bit seed modulo the range, from its two halves
    high, low = (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
    seed = ((high % SEED_RANGE) * ((1 << 32) % SEED_RANGE) + low) % SEED_RANGE
    wave = lambda i: F.round(F.sin((seed + i) * SEED_STEP + i * PLACE_STEP) * HEIGHT, 6)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: wave(i))


class BatchLedger:
    """The finished batches of embedding calls, a file for each under its id, in a folder that every task can reach (a path, or a URI that
    pyarrow's file systems open).  A file appears whole, by a rename."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def _at(self, name: str):
        fs, path = pafs.FileSystem.from_uri(self.root) if ":/" in self.root else (pafs.LocalFileSystem(), self.root)
        return fs, f"{path}/{name}"

    def get(self, batch_id: str) -> pa.Table | None:
        fs, path = self._at(f"{batch_id}.parquet")
        return pq.read_table(path, filesystem=fs) if fs.get_file_info(path).type == pafs.FileType.File else None

    def put(self, batch_id: str, hashes: Sequence[str], vectors: Sequence[Sequence[float]]) -> None:
        fs, path = self._at(f"{batch_id}.parquet")
        fresh = f"{path}.{uuid.uuid4().hex}.tmp"
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        pq.write_table(pa.table({"content_hash": list(hashes), "embedding": pa.array([np.asarray(v, float) for v in vectors], pa.list_(pa.float64()))}), fresh, filesystem=fs)
        fs.move(fresh, path)

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(content_hash, embedding) of all finished batches, each hash once; none before the first."""
        schema = "content_hash string, embedding array<double>"
        fs, path = self._at("")
        found = [f for f in fs.get_file_info(pafs.FileSelector(path.rstrip("/"), allow_not_found=True)) if f.path.endswith(".parquet")]
        return spark.read.schema(schema).parquet(f"{self.root}/*.parquet").dropDuplicates(["content_hash"]) if found else spark.createDataFrame([], schema)


def batch_id(hashes: Sequence[str], dims: int) -> str:
    """The same for the same texts in the same order, in any task and any run."""
    return hashlib.sha256("\n".join([str(dims), *hashes]).encode()).hexdigest()[:32]


def _embedded(embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dims: int, retries: int, wait: Callable[[int], None], ledger: BatchLedger):
    """Rows of one batch each to rows of one vector each.  A batch that the ledger holds is not called for; one that is done goes there before
    anything else can fail, so a task that is run again finds it."""

    def called(texts: list[str]) -> tuple[list | None, Exception | None, int]:
        why = None
        for tries in range(1, retries + 2):
            try:
                got = list(embed(texts))
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                return got, None, tries
            except Exception as e:  # tried again, then reported for each of the batch's requests
                why = e
                if tries <= retries:
                    wait(tries)
        return None, why, retries + 1

    def run(batches):
        for batch in batches:
            for items in batch.column("items").to_pylist():
                hashes = [i["content_hash"] for i in items]
                own = batch_id(hashes, dims)
                held = ledger.get(own)
                if held is not None:
                    got, why, tries = held.column("embedding").to_pylist(), None, 0
                else:
                    got, why, tries = called([i["text"] for i in items])
                    if got is not None and all(len(v) == dims for v in got):
                        ledger.put(own, hashes, got)
                out = []
                for k, h in enumerate(hashes):
                    if got is None:
                        out.append((h, None, type(why).__name__, str(why)[:200], tries))
                    elif len(got[k]) != dims:
                        out.append((h, None, "DimensionMismatch", f"{len(got[k])} for {dims}", tries))
                    else:
                        out.append((h, np.asarray(got[k], float), None, None, tries))
                kinds = (pa.string(), pa.list_(pa.float64()), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["content_hash", "embedding", "error_kind", "error", "attempts"])

    return run


def embed(requests: DataFrame, cache: DataFrame, call: Callable[[Sequence[str]], Sequence[Sequence[float]]], dims: int, token_cap: int, batch: int = 128, retries: int = 3, wait: Callable[[int], None] = lambda n: None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vectors, plan) of requests (request_id, content_hash, text): plan has hit, batch_no and embedded for each distinct text; vectors the new ones, and an error for each that failed.

    The cache (content_hash, embedding) comes first, with what the ledger holds of earlier runs.  Misses form batches in order of their request, up to the one that would
    exceed the cap on tokens.  A batch is one row and one call; one that fails is tried again, `retries` times; a vector of another length is an error of its own.

    ledger: the folder of finished batches, which outlasts this run if it is given.  A task or run that is started again calls for no finished batch.
    """
    spark = requests.sparkSession
    book = BatchLedger(ledger or f"{shared_folder(spark)}/embedding-{uuid.uuid4().hex}")
    if ledger:
        cache = cache.select("content_hash", "embedding").unionByName(book.vectors(spark))
    hits = cache_plan(requests, cache)
    texts = latest_per_key(requests.select("content_hash", "request_id", "text"), ["content_hash"], [F.asc("request_id")]).select("content_hash", "text")
    misses = hits.where("not hit").join(texts, "content_hash").withColumn("tokens", F.greatest(F.lit(1), token_estimate_chars("text")))
    placed = cut(budget_cut(misses, "tokens", "request_id", batch, token_cap))
    told = hits.join(placed.select("content_hash", "batch_no", "embedded"), "content_hash", "left").select("content_hash", "request_id", "hit", "batch_no", F.coalesce("embedded", F.lit(False)).alias("embedded"))
    # a batch is a row: at most `batch` texts
    own = placed.where("embedded").groupBy("batch_no").agg(F.sort_array(F.collect_list(F.struct("position", "content_hash", "text"))).alias("items")).select("items")
    return cut(own.mapInArrow(_embedded(call, dims, retries, wait, book), VECTOR)), told


def vector_metadata(extensions: DataFrame, *chunks: tuple[DataFrame, str]) -> DataFrame:
    """(content_hash, entity_id, entity_kind, meta_skill_id, chunk_text, source_url): extensions by their corpus hash, and chunks of each kind; of one hash the last kind given holds.

    extensions: extension_id, meta_skill_id, title, synopsis, when_to_use, content_hash; chunks: chunk_id, content_hash, chunk_text, page_id."""
    none = F.lit(None).cast("string")
    said = F.concat_ws("\n\n", "title", "synopsis", "when_to_use")
    parts = [extensions.select("content_hash", F.col("extension_id").alias("entity_id"), F.lit("extension").alias("entity_kind"), "meta_skill_id", said.alias("chunk_text"), F.lit("").alias("source_url"), F.lit(0).alias("part"))]
    for i, (rows, kind) in enumerate(chunks):
        parts.append(rows.select("content_hash", F.col("chunk_id").alias("entity_id"), F.lit(kind).alias("entity_kind"), none.alias("meta_skill_id"), F.coalesce("chunk_text", F.lit("")).alias("chunk_text"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("source_url"), F.lit(i + 1).alias("part")))
    return latest_per_key(reduce(DataFrame.unionByName, parts), ["content_hash"], [F.desc("part"), F.desc("entity_id")]).drop("part")


def index_rows(vectors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Vectors with their metadata by content hash; vectors that nothing refers to are left out."""
    return vectors.where("embedding is not null").join(metadata, "content_hash")


def upserted(index: DataFrame, new: DataFrame, key: str = "entity_id") -> DataFrame:
    """The index with new rows in place of those of the same key, one row a key (the larger content hash among repeated ones)."""
    once = latest_per_key(new, [key], [F.desc("content_hash")])
    return index.join(once.select(key), key, "left_anti").unionByName(once)
