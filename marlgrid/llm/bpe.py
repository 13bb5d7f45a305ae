"""Byte-level BPE encoding and decoding with a local rank file (operator 9), and the id streams that packing uses.

The ids are those of the tiktoken library for the given ranks and split pattern.  Long texts are cut before encoding at
safe boundaries, where no match of the pattern can run across, so that the ids stay those of the whole text.  A match is
encoded whole, however long it is: its merges have no boundary inside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.llm.common import ship, text_or_empty

#: Texts above this many characters are encoded piece by piece.
PIECE_CHARS = 100_000
#: Runs of white space from this length on are matched here: the pattern's look-ahead keeps a state for each of their
#: characters, and the library gives up on runs of about a million.
SPACE_RUN = 50_000

# Characters whose class is the same in every version of Unicode and every library: letters of large scripts, ASCII
# digits, signs that are none of those, and four kinds of white space.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u04ff\u05d0-\u05ea\u0621-\u063a\u0905-\u0939\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_DIGIT = "0-9"
_SIGN = "!\"#$%&()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~\u3001\u3002\uff01\uff0c\uff1a\uff1f"
_BLANK = " \t\n\r"
# Every match of the pattern holds one class alone, but for one leading space and for an apostrophe before a letter.  So
# none runs across a change of class unless it is from white space or an apostrophe; and since the only look-ahead is the
# one after white space, what is matched before such a change does not depend on what follows it.
_SAFE = re.compile(
    f"(?<=[{_LETTER}{_DIGIT}{_SIGN}'])(?=[{_BLANK}])|(?<=[{_LETTER}])(?=[{_DIGIT}{_SIGN}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_SIGN}'])|(?<=[{_SIGN}])(?=[{_LETTER}{_DIGIT}])"
)
# The characters of white space in the library's patterns.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % SPACE_RUN)
_ENCODERS: dict = {}


def rank_encoder(path: str, pattern: str):
    """The tiktoken encoding of a rank file; one for each worker process."""
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding(f"ranks:{path}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


#: Takes a text as one match.
WHOLE = "(?s:.+)"


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """text in order, cut at safe boundaries at least `size` characters apart; a stretch without one stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode(ranks_path: str, pattern: str, text: str, size: int = PIECE_CHARS) -> np.ndarray:
    """The ids of a text, each match of the pattern encoded separately, as little-endian unsigned 32-bit integers.

    A long run of white space is one match but for its last character, which goes with what follows; at the text's end it is
    one match whole.
    """
    encoder = rank_encoder(ranks_path, pattern)
    if len(text) <= size:
        return np.array(encoder.encode_ordinary(text), "<u4")
    found, at = [], 0

    def add(part: str, by) -> None:
        found.append(np.array(by.encode_ordinary(part), "<u4"))

    for run in _SPACES.finditer(text):
        stop = run.end() if run.end() == len(text) else run.end() - 1
        for part in pieces(text[at : run.start()], size):
            add(part, encoder)
        add(text[run.start() : stop], rank_encoder(ranks_path, WHOLE))
        at = stop
    for part in pieces(text[at:], size):
        add(part, encoder)
    return np.concatenate(found)


def encode_decode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(id, ids binary, decoded binary): the ids of every whole text as little-endian unsigned 32-bit integers, and the raw bytes they decode to.

    A null text counts as empty: no ids, no bytes.  Repeated rows are encoded as often as they stand; a null id stays null;
    an empty table gives an empty one; other columns are dropped, whatever their names.  Texts are split only at safe
    boundaries, so very long ones give the ids of the whole; a task holds one text and its ids at a time.
    """
    spark = df.sparkSession
    ship(spark)

    def run(batches):
        encoder = rank_encoder(ranks_path, pattern)
        for batch in batches:
            ids, raw = [], []
            for text in batch.column(1).to_pylist():
                found = encode(ranks_path, pattern, text, piece_chars)
                ids.append(found.tobytes())
                raw.append(encoder.decode_bytes(found.tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, ids binary, decoded binary")


def encode_digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of encode_decode(): doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = encode_decode(df, ranks_path, pattern, id_col, text_col)
    return done.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
