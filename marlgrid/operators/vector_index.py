"""A stored vector index by coarse cells: searches read a few cells and rank them exactly, upserts rewrite the cells they touch.

Cells are the nearest of some centroids by cosine.  Rows are parts of a store by cell; a keyed table tells each id's cell, so that an upsert finds the
rows it replaces without a scan.  Cells and their rows, the ids and the centroids change with one manifest.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.operators.parts import Store, create_keyed, merged_parts, read_keys
from marlgrid.operators.relational import latest_per_key
from marlgrid.operators.retrieval import cosine
from marlgrid.operators.staging import cut

#: Vectors sampled to fit the centroids, and to measure how many cells a search must read.
SAMPLE, ASKED = 20_000, 64
MOST_CELLS = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True, initial=0.0), 5e-324)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over a bounded sample; an empty cell keeps its centre."""
    c = x[np.random.default_rng(4).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 2048] @ c.T).argmax(1) for at in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = np.bincount(own, minlength=len(c)) > 0
        c = np.where(full[:, None], _unit(total), c)
    return c


def _celled(rows: DataFrame, centres: np.ndarray, vector_col: str) -> DataFrame:
    """rows with their cell; the centroids, MOST_CELLS at most, go with the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(vector_col).flatten(), float).reshape(-1, centres.shape[1])
            cell = (_unit(x) @ centres.T).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, cell int")


def _usable(vector_col: str, dims: int):
    # a NaN compares as larger than any number
    whole = F.forall(vector_col, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf"))) & F.exists(vector_col, lambda v: v != 0)
    return F.coalesce((F.size(vector_col) == dims) & whole, F.lit(False))


def build(store: Store, name: str, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, recall: float = 0.95, k: int = 20) -> Store:
    """An index over vectors (one row an id; null, zero and odd-sized ones are left out): about sqrt(n) cells, up to MOST_CELLS, unless given.

    A search reads as many of the nearest cells as give `recall` at k on ASKED sampled vectors, measured against all rows.
    """
    n = vectors.count()
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    some = vectors.where(share & F.col(vector_col).isNotNull()).select(id_col, F.transform(vector_col, lambda v: v.cast("double")).alias("v")).limit(2 * SAMPLE).collect()
    dims = Counter(len(r["v"]) for r in some).most_common(1)[0][0] if some else 0
    fit = sorted((r[0], r["v"]) for r in some if len(r["v"]) == dims and any(r["v"]) and all(v is not None and np.isfinite(v) for v in r["v"]))
    if not fit:
        raise ValueError("no vectors to build an index on")
    x = _unit(np.array([v for _, v in fit]))
    centres = _centroids(x, cells or int(min(MOST_CELLS, max(1, round(n**0.5)))))
    rows = cut(_celled(vectors.where(_usable(vector_col, dims)), centres, vector_col))
    probes = _probes(rows, x[:: max(1, len(x) // ASKED)][:ASKED], centres, recall, k, vector_col)
    told = _cell_table(store, rows, centres, {}, probes, id_col, vector_col)
    store = create_keyed(store, f"{name}.ids", rows.select(id_col, "cell"), [id_col])
    dealt = rows.withColumn("_cell", F.col("cell")).hint("rebalance", F.col("_cell"))
    return store.commit({name: store.stage(dealt, "_cell"), f"{name}.cells": store.stage(told.withColumn("part", F.lit("all")), "part")}, whole=[name, f"{name}.cells"])


CELLS = "cell int, centre array<double>, probes int, id_col string, vector_col string, reach double"


def _cell_table(store: Store, rows: DataFrame, centres: np.ndarray, known: dict[int, float], probes: int, id_col: str, vector_col: str) -> DataFrame:
    """A row a cell; reach: the largest angle between its centre and one of its rows, from `rows` where `known` lacks it (-1 for an empty cell)."""

    def far(batches):
        least: dict[int, float] = {}
        for batch in batches:
            x = _unit(np.asarray(batch.column(vector_col).flatten(), float).reshape(-1, centres.shape[1]))
            cell = np.asarray(batch.column("cell"))
            cosines = (x * centres[cell]).sum(1)
            for c in np.unique(cell).tolist():
                least[c] = min(least.get(c, 1.0), float(cosines[cell == c].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], ["cell", "least"])

    seen = rows.select(vector_col, "cell").mapInArrow(far, "cell int, least double").groupBy("cell").agg(F.min("least").alias("least")).collect()  # a row a cell
    reach = known | {r["cell"]: float(np.arccos(min(1.0, max(-1.0, r["least"])))) for r in seen}
    return store.spark.createDataFrame([(i, c.tolist(), probes, id_col, vector_col, reach.get(i, -1.0)) for i, c in enumerate(centres)], CELLS)


def _probes(rows: DataFrame, asked: np.ndarray, centres: np.ndarray, recall: float, k: int, vector_col: str) -> int:
    """How many nearest cells hold `recall` of the k best rows of sampled vectors: one pass, k rows a task and vector."""

    def best(batches):
        top = [(np.full(0, -np.inf), np.full(0, 0))] * len(asked)
        for batch in batches:
            x = _unit(np.asarray(batch.column(vector_col).flatten(), float).reshape(-1, centres.shape[1]))
            score, cell = asked @ x.T, np.asarray(batch.column("cell"))
            for i in range(len(asked)):
                s, c = np.concatenate([top[i][0], score[i]]), np.concatenate([top[i][1], cell])
                keep = np.argsort(-s, kind="stable")[:k]
                top[i] = s[keep], c[keep]
        out = [(i, float(s), int(c)) for i, (a, b) in enumerate(top) for s, c in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int32(), pa.float64(), pa.int32()))], ["asked", "score", "cell"])

    kept = rows.select(vector_col, "cell").mapInArrow(best, "asked int, score double, cell int")
    kept = kept.groupBy("asked").agg(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("score", "cell")))), 1, k).alias("best")).collect()
    rank = np.argsort(np.argsort(-(asked @ centres.T), 1), 1)
    needs = np.sort([rank[r["asked"], b["cell"]] for r in kept for b in r["best"]])
    return int(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)]) + 1 if len(needs) else 1


def _settings(store: Store, name: str) -> tuple[np.ndarray, list]:
    rows = sorted(store.read(f"{name}.cells").collect(), key=lambda r: r["cell"])
    return np.array([r["centre"] for r in rows]), rows


def nearest_cells(store: Store, name: str, query: list[float], probes: int | None = None) -> list[str]:
    """The cells that a search reads, nearest first."""
    centres, rows = _settings(store, name)
    order = np.argsort(-(_unit(np.array([query])) @ centres.T)[0], kind="stable")
    return [str(c) for c in order[: probes or rows[0]["probes"]]]


def search(store: Store, name: str, query: list[float], k: int = 20, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(score, and the rows' columns) of the k nearest rows of the cells nearest to the query, by exact cosine, ties to the smaller id.

    With `exact` further cells are read as long as one of their rows may be among the k: those whose centre is no farther from the query
    than the k-th row's angle and the cell's reach together.
    """
    centres, cells = _settings(store, name)
    id_col, vector_col = cells[0]["id_col"], cells[0]["vector_col"]
    asked = F.array(*[F.lit(float(v)) for v in query])

    def best(own: list[str]) -> DataFrame:
        rows = store.read(name, own).drop("cell")
        return rows.withColumn("score", cosine(F.col(vector_col), asked)).where("score is not null").orderBy(F.desc("score"), id_col).limit(max(1, k))

    own = nearest_cells(store, name, query, probes)
    if exact:
        found = [r["score"] for r in best(own).select("score").collect()]  # at most k numbers
        angle = np.arccos(np.clip((_unit(np.array([query])) @ centres.T)[0], -1, 1))
        limit = np.arccos(np.clip(min(found), -1, 1)) if len(found) >= max(1, k) else np.pi
        near = [str(r["cell"]) for r in cells if r["reach"] >= 0 and angle[r["cell"]] - r["reach"] <= limit + 1e-6]
        own = own + [c for c in near if c not in own]
    return best(own)


def upsert(store: Store, name: str, new: DataFrame, newest_first: list | None = None) -> Store:
    """The index with new rows in place of those of their ids: it reads the ids' cells, and rewrites those and the cells that the rows go to.

    Of rows of one id the first by newest_first holds, or one of them.  A vector that can't be indexed takes its id out of the index.
    """
    centres, cells = _settings(store, name)
    id_col, vector_col, probes = cells[0]["id_col"], cells[0]["vector_col"], cells[0]["probes"]
    once = latest_per_key(new, [id_col], newest_first or [F.col(id_col)])
    rows = cut(_celled(once.where(_usable(vector_col, centres.shape[1])), centres, vector_col))
    ids = cut(once.select(id_col))
    before = cut(read_keys(store, f"{name}.ids", ids, id_col))
    touched = sorted(str(r[0]) for r in rows.select("cell").unionByName(before.select("cell")).distinct().collect())  # at most one a cell
    old = store.read(name, touched)
    left = cut(old.join(ids, id_col, "left_anti").select(*old.columns).unionByName(rows.select(*old.columns)))
    known = {r["cell"]: r["reach"] for r in cells if str(r["cell"]) not in touched}
    told = _cell_table(store, left, centres, known, probes, id_col, vector_col).withColumn("part", F.lit("all"))
    parts, schema = store.stage(left.withColumn("_cell", F.col("cell")).hint("rebalance", F.col("_cell")), "_cell")
    changes = {name: ({p: parts.get(p) for p in touched}, schema), f"{name}.ids": merged_parts(store, f"{name}.ids", rows.select(id_col, "cell"), [id_col], drop=ids), f"{name}.cells": store.stage(told, "part")}
    return store.commit(changes)

