"""Toxicity (operator 8): a classifier chain of linear models.

The categories are predicted in order; each model sees the text's features and the probabilities of the categories before it.
It is trained with out-of-fold predictions of those, so that what it sees in training is as good as what it sees later.
A text's features are whether a word, or a word's first 4, 5 or 6 bytes, occurs in it, over the whole text; a bounded number
of them is chosen by their association with a category.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.llm.common import ship, table, text_or_empty
from marlgrid.llm.near_dup import normal

U = np.uint64
BITS = 20
PREFIXES = (4, 5, 6)
CHUNK_CHARS = 1 << 20
#: At most so many labelled documents, those with the smallest hash of their id, train the chain.
TRAIN_ROWS = 12_000
#: At most so many features for a category.
FEATURES = 128
FOLDS = 5
_RNG = np.random.Generator(np.random.PCG64(4242))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_BASE = int(_RNG.integers(1 << 60, 1 << 62)) | 1
_POWERS: list = []


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature number) of all words and prefixes of normal texts, with repeats."""
    global _POWERS
    data = np.frombuffer("\n".join(texts).encode("utf-8", "replace") + b"\n", np.uint8)
    if not _POWERS or len(_POWERS[0]) <= len(data):
        n = max(len(data) + 1, 2 * CHUNK_CHARS)
        up, down = np.ones(n, U), np.ones(n, U)
        up[1:], down[1:] = U(_BASE), U(pow(_BASE, -1, 1 << 64))
        _POWERS = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    gap = (data == 32) | (data == 10)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    text = np.searchsorted(np.flatnonzero(data == 10), begin)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _POWERS[0][: len(data)], out=sums[1:])
    owners, found = [], []
    for size in (0, *PREFIXES):
        own = np.flatnonzero(end - begin > size) if size else np.arange(len(begin))
        stop = begin[own] + size if size else end[own]
        h = (sums[stop] - sums[begin[own]]) * _POWERS[1][begin[own]] + U(size)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        owners.append(text[own])
        found.append((h >> U(64 - BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(found)


def _chunks(texts: list[str]):
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK_CHARS):
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 15) -> np.ndarray:
    """Weights, the constant first, by penalised Newton steps; without a positive label the probability is next to 0."""
    if not y.sum():
        return np.concatenate([[-30.0], np.zeros(x.shape[1])])
    x = np.concatenate([np.ones((len(x), 1), x.dtype), x], 1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        curve = ((x * (p * (1 - p)).astype(x.dtype)[:, None]).T @ x).astype(float) + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


@dataclass
class Chain:
    categories: tuple[str, ...]
    #: feature number -> column, -1 for those not chosen
    columns: np.ndarray
    n_columns: int
    weights: list[np.ndarray]
    #: for each category the probability from which it is said to hold
    thresholds: list[float]

    def matrix(self, texts: list[str]) -> np.ndarray:
        owner, found = features(texts)
        column = self.columns[found]
        keep = column >= 0
        x = np.zeros((len(texts), self.n_columns))
        x[owner[keep], column[keep]] = 1
        return x

    def predict(self, texts: list[str]) -> np.ndarray:
        """A probability for each text (row) and category (column)."""
        out = np.zeros((len(texts), len(self.categories)))
        for at, part in _chunks([normal(t) for t in texts]):
            x = self.matrix(part)
            for c, w in enumerate(self.weights):
                out[at : at + len(part), c] = _probability(w, np.concatenate([x, out[at : at + len(part), :c]], 1))
        return out


#: Thresholds to choose from.
THRESHOLDS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The smallest of those with the best F1 on out-of-fold probabilities; the middle one where nothing is positive."""
    if not y.sum():
        return 0.5
    f1 = [2 * (y[p >= t].sum()) / max(1, (p >= t).sum() + y.sum()) for t in THRESHOLDS]
    return THRESHOLDS[int(np.argmax(f1))]


def picked(total: np.ndarray, yes: list[np.ndarray], positives: list[int], n: int, most: int) -> np.ndarray:
    """Feature numbers whose occurrence differs most between a category's two kinds of text, `most` for each category.

    total: in how many of n texts each feature occurs; yes: in how many of a category's positive ones, of which there are `positives`."""
    chosen: list[int] = []
    for own, n_yes in zip(yes, positives, strict=True):
        if not n_yes or n_yes == n:
            continue
        no, n_no = total - own, n - n_yes
        p, q = (own + 0.5) / (n_yes + 1), (no + 0.5) / (n_no + 1)
        pooled = total / n
        score = np.abs(p - q) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-6) * (1 / n_yes + 1 / n_no))
        score[total < 5] = 0
        best = np.argsort(-score, kind="stable")[:most]
        chosen += best[score[best] > 3].tolist()
    return np.array(sorted(set(chosen)), np.int64)


def counted(present: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Features x (all texts, those of each category): in how many texts each occurs."""
    out = np.zeros((1 << BITS, 1 + labels.shape[1]), np.int64)
    for k, own in enumerate([np.ones(len(present), bool), *(labels.T > 0)]):
        some = [p for p, v in zip(present, own, strict=True) if v]
        if some:
            out[:, k] = np.bincount(np.concatenate(some), minlength=1 << BITS)
    return out


def chosen_columns(found: np.ndarray) -> np.ndarray:
    """feature number -> column, -1 for those that are not in found."""
    columns = np.full(1 << BITS, -1, np.int32)
    columns[found] = np.arange(len(found))
    return columns


def train(present: list[np.ndarray], labels: np.ndarray, categories: tuple[str, ...], most: int = FEATURES, folds: int = FOLDS) -> Chain:
    """present: each text's feature numbers, without repeats; labels: 0 or 1 for each text (row) and category (column)."""
    counts = counted(present, labels)
    columns = chosen_columns(picked(counts[:, 0], list(counts[:, 1:].T), labels.sum(0).tolist(), len(present), most))
    x = np.zeros((len(present), int((columns >= 0).sum())), np.float32)
    for i, p in enumerate(present):
        c = columns[p]
        x[i, c[c >= 0]] = 1
    return linked(x, labels, categories, columns, folds)


def linked(x: np.ndarray, labels: np.ndarray, categories: tuple[str, ...], columns: np.ndarray, folds: int = FOLDS) -> Chain:
    """The chain over a matrix of texts by chosen features: each link is trained on the probabilities that models of other folds gave for those before."""
    fold = np.arange(len(x)) % folds
    weights, thresholds, earlier = [], [], np.zeros((len(x), 0), np.float32)
    for y in labels.T.astype(float):
        seen = np.concatenate([x, earlier], 1)
        unseen = np.zeros(len(x))
        for f in range(folds):
            rest, own = fold != f, fold == f
            if own.any() and rest.any():
                unseen[own] = _probability(logistic(seen[rest], y[rest]), seen[own])
        weights.append(logistic(seen, y))
        thresholds.append(best_threshold(unseen, y))
        earlier = np.concatenate([earlier, unseen[:, None].astype(np.float32)], 1)
    return Chain(categories, columns, x.shape[1], weights, thresholds)


def _present(texts: list[str]):
    """Lists of feature numbers without repeats, for some of the texts at a time."""
    for _, part in _chunks([normal(t) for t in texts]):
        owner, found = features(part)
        key = np.unique(owner * (1 << BITS) + found)
        edges = np.searchsorted(key, np.arange(len(part) + 1) << BITS)
        yield [key[a:b] & ((1 << BITS) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fit(docs: DataFrame, labels: DataFrame, categories: dict, max_rows: int = TRAIN_ROWS, most: int = FEATURES) -> Chain:
    """categories: name -> boolean Column of labels, in the chain's order.

    At most max_rows labelled documents are used.  Labels with nulls and documents without a label are left out; of repeated rows the largest label and
    the smallest text count, so that an id that many rows share is one text before anything else.

    Two passes over those texts, whole and of any length: one counts in how many each of the 2**BITS features occurs, the other gives each text's
    chosen features as bits.  The driver holds 2**BITS numbers for each category and max_rows * most bits, a task as many numbers and one batch of texts.
    """
    spark = docs.sparkSession
    ship(spark)
    flags = [c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    ys = [f"y{i}" for i in range(len(flags))]
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc"), *flags).dropna().groupBy("doc").agg(*[F.max(y).alias(y) for y in ys])
    # at most max_rows rows of a few numbers each
    wanted = wanted.orderBy(F.xxhash64("doc"), "doc").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text")).join(F.broadcast(wanted), "doc")
    rows = table(rows.groupBy("doc").agg(F.min("text").alias("text"), *[F.first(y).alias(y) for y in ys]), "labelled-texts")

    def count(batches):
        total = np.zeros((1 << BITS, 1 + len(ys)), np.int64)
        for batch in batches:
            y, at = np.stack([np.asarray(batch.column(c)) for c in ys], 1), 0
            for present in _present(batch.column("text").to_pylist()):
                own = y[at : at + len(present)] > 0
                at += len(present)
                for p, v in zip(present, own, strict=True):
                    total[p, 0] += 1
                    for k in np.flatnonzero(v):
                        total[p, k + 1] += 1
        seen = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(c) for c in total[seen].T)], ["f", "n", *ys])

    # one row a feature at most
    sums = rows.select("text", *ys).mapInArrow(count, "f long, n long, " + ", ".join(f"{y} long" for y in ys)).groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n", *ys)]).toArrow()
    totals = np.zeros((1 << BITS, 1 + len(ys)), np.int64)
    totals[np.asarray(sums.column("f"))] = np.stack([np.asarray(sums.column(c)) for c in ("n", *ys)], 1)
    told = rows.agg(F.count("*"), *[F.coalesce(F.sum(y), F.lit(0)) for y in ys]).first()
    columns = chosen_columns(picked(totals[:, 0], list(totals[:, 1:].T), list(told[1:]), told[0], most))
    width = int((columns >= 0).sum())

    def bits(batches):
        for batch in batches:
            out = []
            for present in _present(batch.column("text").to_pylist()):
                x = np.zeros((len(present), width), bool)
                for i, p in enumerate(present):
                    c = columns[p]
                    x[i, c[c >= 0]] = True
                out += [r.tobytes() for r in np.packbits(x, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out, pa.binary()), *(batch.column(y) for y in ys)], ["doc", "found", *ys])

    got = rows.mapInArrow(bits, "doc long, found binary, " + ", ".join(f"{y} int" for y in ys)).toPandas().sort_values("doc")
    x = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for b in got["found"]], np.uint8).reshape(len(got), -(-width // 8)), axis=1, count=width) if len(got) else np.zeros((0, width))
    return linked(x.astype(np.float32), got[ys].to_numpy(), tuple(categories), columns)


def scored(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """docs with a column p_<category> (double) for each category, from whole texts; a null text counts as empty.

    Rows, repeated ones too, come back as they are; columns of the same names are replaced; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [f"p_{c}" for c in chain.categories]
    kept = docs.drop(*names)
    rows = kept.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns)], text_or_empty(text_col).alias("seen_text"))
    own = spark.sparkContext.broadcast(chain)  # of fixed size: 2**BITS column numbers and the weights

    def run(batches):
        for batch in batches:
            p = own.value.predict(batch.column("seen_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(p[:, c]) for c in range(p.shape[1]))], [*batch.schema.names[:-1], *names])

    kinds = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.schema)), *(f"{n} double" for n in names)])
    done = rows.mapInArrow(run, kinds)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept.columns)], *names)


#: The chain of the labels table: quality first, then toxic texts of low quality, then toxicity, which both feed.  On held-out rows the middle
#: link helps: of 796 documents the chain is wrong on 16, without it on 24 (README).
def label_categories() -> dict:
    return {"low_quality": F.col("quality") == 0, "toxic_and_low": (F.col("toxic") == 1) & (F.col("quality") == 0), "toxic": F.col("toxic") == 1}


def judged(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """docs with the chain's probabilities and `toxic`, whether that category's reaches the threshold (by default the chain's own)."""
    chain = fit(docs, labels, label_categories())
    own = chain.thresholds[chain.categories.index("toxic")] if threshold is None else threshold
    return scored(docs, chain).withColumn("toxic", F.col("p_toxic") >= own)
