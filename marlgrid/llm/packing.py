"""Packing (operator 4): concatenate and cut.

Pass one encodes every document once, writes its ids with its start inside the partition, and the partitions' token
totals.  Prefix sums over those totals (one row a partition) give every document its global offset.  Pass two cuts the
stream into fixed windows; a document that crosses a window's edge leaves one boundary record on each side.  Only the last
window of the whole stream can hold padding.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.llm.bpe import PIECE_CHARS, encode, pieces
from marlgrid.llm.common import ship, table, text_or_empty

# Up to here both libraries' character classes agree (tested for every character); other texts go to the tokenizers library.
_PLAIN = re.compile("[^\u0000-\u024f]")
_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    """The tokenizer of a file as it stands there, and the strings of its added tokens; one for each worker process."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        _TOKENIZERS[path] = own, tuple(t.content for t in own.get_added_tokens_decoder().values())
    return _TOKENIZERS[path]


def token_ids(text: str, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None) -> np.ndarray:
    """The ids that the tokenizers library gives, as little-endian unsigned 32-bit integers.

    With the same vocabulary as a rank file, texts of Latin letters take the faster library, whose ids are the same.  A text
    that holds an added token's string (such as <|endoftext|>) goes to the tokenizers library whole, which gives it that token's id.
    """
    tokenizer, added = _tokenizer(tokenizer_path)
    special = any(a in text for a in added)
    if ranks_path and not special and not _PLAIN.search(text):
        return encode(ranks_path, pattern, text)
    # the pattern of byte-level files is the one that the safe boundaries of pieces() hold for
    parts = pieces(text) if ranks_path and not special and len(text) > PIECE_CHARS else (text,)
    return np.concatenate([np.array(tokenizer.encode(p, add_special_tokens=False).ids, "<u4") for p in parts])


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, part, local_start, n_tokens, ids): pass one, written to the shared folder.

    ids hold two bytes each where the partition's batch allows it, else four; `wide` tells which.
    """
    ship(df.sparkSession)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, counts, blobs, wide = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(token_ids(text, tokenizer_path, ranks_path, pattern), np.uint32(end_id))
                big = bool(ids.max() > 0xFFFF)
                starts.append(at)
                counts.append(len(ids))
                blobs.append(ids.astype("<u4" if big else "<u2").tobytes())
                wide.append(big)
                at += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(starts), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.array(wide, pa.bool_())], ["doc_id", "part", "local_start", "n_tokens", "ids", "wide"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, part int, local_start long, n_tokens long, ids binary, wide boolean")


def pack(df: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, is_boundary.

    Every id of a document (its text's ids, then end_id) lies in exactly one piece; sequence_id and offset are global and
    gapless from 0.  A null text counts as empty (the end id alone); repeated rows are packed as often as they stand; a row with
    a null id is packed like any other and keeps it; an empty table gives no pieces; extra columns are dropped, whatever their
    names.  A task holds one text and its ids at a time, however long.  is_boundary marks pieces of documents that a window's edge cuts.
    """
    store = table(tokenized(df, tokenizer_path, end_id, ranks_path, pattern), "packed-ids")
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row a partition: the second pass of the prefix sums.
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = store.join(F.broadcast(offsets), "part").select("doc_id", "n_tokens", (F.col("base") + F.col("local_start")).alias("global_start"), "ids", "wide")

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "is_boundary")}
            for doc, n, begin, blob, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(blob, "<u4" if wide else "<u2").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(n - at, window - offset)
                    for k, v in zip(out, (doc, at, length, ids[at : at + length].tobytes(), n, sequence, offset, length < n), strict=True):
                        out[k].append(v)
                    at += length
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, is_boundary boolean")


def pack_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "is_boundary")


def crc(ids) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
