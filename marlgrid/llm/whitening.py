"""Embedding whitening (operator 13): Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The rows X stay distributed.  Each step is one pass over them, which computes Xc and then its product with X transposed.  A left vector
u is never stored: it is X times a short vector c, so a pass forms all earlier left vectors anew, measures what is left of them in the new
one, and their share is taken out (full reorthogonalisation).  Right vectors are short and are orthogonalised on the driver.  The small
bidiagonal matrix's singular value decomposition gives components and deviations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.llm.common import ship, table
from marlgrid.llm.vectors import usable

#: Rows packed into one block.
BLOCK = 1024
#: Components are scaled to long and kept within this range, so that a shift can't overflow it.
MOST = 9.0e18
LONG = 1 << 63
#: Directions whose deviation is below this share of the largest are no components: doubles can't tell them from zero.
LEAST = 1e-9
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(dims, ids, x): blocks of up to BLOCK usable vectors of one length, whose components are floor(scale * c) + shift, as 64-bit integers."""
    whole = F.transform(vector_col, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * scale))).cast("long") + shift)
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))

    def pack(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes, values = np.asarray(lists.value_lengths()), np.asarray(lists.flatten(), np.int64)
            ends = np.cumsum(sizes)
            dims, ids, data = [], [], []
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                x = values[(ends[own] - d)[:, None] + np.arange(d)]
                for at in range(0, len(own), BLOCK):
                    dims.append(d)
                    ids.append(batch.column("id").take(pa.array(own[at : at + BLOCK])).to_pylist())
                    data.append(x[at : at + BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["dims", "ids", "x"])

    return rows.mapInArrow(pack, "dims int, ids array<long>, x binary")


class Rows:
    """The blocks of one length of vectors, their number n and their sums, one for each dimension."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims, self.n = blocks.select("ids", "x"), dims, 0

        def add(batches):
            n, total, most = 0, [0] * dims, 0
            for batch in batches:
                for data in batch.column("x"):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims)
                    n, most = n + len(x), max(most, int(x.max()), -int(x.min()))
                    small = most < LONG // max(1, len(x))
                    total = [t + int(s) for t, s in zip(total, x.sum(0) if small else x.astype(object).sum(0), strict=True)]
            told = [Decimal(v) for v in [*total, n, most]]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 2), pa.int32()), pa.array(told, pa.decimal128(38, 0))], ["i", "v"])

        told = self.blocks.select("x").mapInArrow(add, "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("s"), F.max("v").alias("m")).collect()
        by = {r["i"]: r for r in told}
        self.sums = [int(by[i]["s"]) for i in range(dims)] if by else [0] * dims
        self.n, most = (int(by[dims]["s"]), int(by[dims + 1]["m"])) if by else (0, 0)
        #: whether n * x - sum stays within a long
        self.small = self.n * most * 2 < LONG

    def deviations(self) -> Callable[[object], np.ndarray]:
        """A function of a block's bytes: n * x - sum, exactly."""
        n, sums, dims, small = self.n, self.sums, self.dims, self.small
        kind = np.int64 if small else object

        def of(data) -> np.ndarray:
            x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dims)
            return n * x.astype(kind) - np.array(sums, kind)

        return of

    def summed(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of a vector that `of` makes from a block's centred rows; one vector a task, added up by place."""
        deviations, n = self.deviations(), self.n

        def part(batches):
            total = None
            for batch in batches:
                for data in batch.column("x"):
                    got = of(deviations(data).astype(float) / n)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        told = self.blocks.select("x").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(len(told))
        for r in told:
            out[r["i"]] = r["v"]
        return out


def step(rows: Rows, c: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """For u = Xc: the products of the earlier left vectors (X times a column each) with u, X transposed times u, and u's squared length."""
    k = earlier.shape[1]

    def products(x: np.ndarray) -> np.ndarray:
        both = x @ np.column_stack([c, earlier])
        u = both[:, 0]
        return np.concatenate([both[:, 1:].T @ u, x.T @ u, [u @ u]])

    got = rows.summed(products)
    return got[:k], got[k:-1], float(got[-1])


def bidiagonal(rows: Rows, length: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) with X V = U B: V orthogonal, B upper bidiagonal, after as many steps as there are dimensions.

    Where a step leaves nothing (the rank is used up, or equal deviations), it goes on with a new direction at a right angle to all before.
    length: the root of the sum of all squared entries, against which nothing is measured.
    """
    d, rng = rows.dims, np.random.default_rng(seed)
    right, short, back = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    alphas, betas, beta = [], [], 0.0
    nothing = length * 1e-13

    def orthogonal(w: np.ndarray) -> np.ndarray:
        for _ in range(2):
            w = w - right @ (right.T @ w)
        return w

    v = rng.normal(size=d)
    v /= np.linalg.norm(v)
    for k in range(d):
        c = v - beta * short[:, -1] if k else v
        for _ in range(3):
            e, g, squared = step(rows, c, short)
            c, g, squared = c - short @ e, g - back @ e, squared - float(e @ e)
            if float(e @ e) <= 1e-12 * squared or squared <= nothing**2:
                break
        alpha = math.sqrt(max(squared, 0.0))
        if alpha <= nothing:
            alpha, c, g = 0.0, np.zeros(d), np.zeros(d)
        else:
            c, g = c / alpha, g / alpha
        right = np.column_stack([right, v])
        short, back = np.column_stack([short, c]), np.column_stack([back, g])
        alphas.append(alpha)
        if k + 1 == d:
            break
        w = orthogonal(g - alpha * v)
        beta = float(np.linalg.norm(w))
        if beta <= nothing:
            beta = 0.0
            while np.linalg.norm(w) < 1e-3:
                w = orthogonal(rng.normal(size=d) / math.sqrt(d))
            w = orthogonal(w / np.linalg.norm(w))
        v = w / np.linalg.norm(w)
        betas.append(beta)
    return right, np.diag(alphas) + np.diag(betas, 1)


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable vector's coordinates along the components of the covariance, over their standard deviations.

    A component c becomes x = floor(scale * c) + shift (kept within 9e18 either way).  The covariance has the divisor n and is taken of centred
    rows; components are numbered from 1 by falling variance, `components` of them at most, fewer where the rows span less; where all rows are alike
    there is none and no row comes back.  deviation is the sum of (n * x - sum)^2 over the dimensions, exact, and the end of a long's range
    beyond that.  identity_error is the largest entry of the whitened rows' covariance minus the identity.

    Null, empty and non-finite vectors, and those with null components, take no part.  Vectors of the commonest length count, of the smaller one in a
    tie; others take no part.  Repeated rows count as often as they stand; a null id stays.  An empty table gives an empty one;
    extra columns are dropped, whatever their names.

    The driver holds three matrices of dims x dims, and tasks one block of rows at a time.
    """
    spark = vectors.sparkSession
    ship(spark)
    every = table(packed(vectors, id_col, vector_col, scale, shift), "whitening-blocks")
    common = every.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "dims").first()
    nothing = spark.createDataFrame([], OUT)
    if not common:
        return nothing
    rows = Rows(every.where(F.col("dims") == common["dims"]), common["dims"])
    length = math.sqrt(float(rows.summed(lambda x: np.array([float((x * x).sum())]))[0]))
    if not length:
        return nothing
    right, small = bidiagonal(rows, length)
    _, sigma, turned = np.linalg.svd(small)
    keep = min(components, int((sigma > LEAST * sigma[0]).sum()))
    explained = (sigma**2 / (sigma**2).sum())[:keep]
    out = (right @ turned.T)[:, :keep] / (sigma[:keep] / math.sqrt(rows.n))

    def spread(x: np.ndarray) -> np.ndarray:
        y = x @ out
        return np.concatenate([(y.T @ y).ravel(), y.sum(0)])

    got = rows.summed(spread)
    mean = got[keep * keep :] / rows.n
    error = float(np.abs(got[: keep * keep].reshape(keep, keep) / rows.n - np.outer(mean, mean) - np.eye(keep)).max())
    deviations, n, small_enough = rows.deviations(), rows.n, rows.small

    def answer(batches):
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("x"), strict=True):
                dev = deviations(data)
                fits = small_enough and float(np.abs(dev).max(initial=0)) ** 2 * dev.shape[1] < LONG
                square = (dev * dev).sum(1) if fits else np.array([min(LONG - 1, sum(int(v) ** 2 for v in r)) for r in dev], np.int64)
                y = (dev.astype(float) / n) @ out
                m = len(y)
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(pa.array(np.repeat(np.arange(m), keep))), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), m)), pa.array(np.full(m * keep, n)), pa.array(np.repeat(square, keep)), pa.array(y.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * keep, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.blocks.mapInArrow(answer, OUT)
