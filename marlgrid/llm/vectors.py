"""Vectors: exact top-k search by segment statistics (operator 1) and near-dedup by an inverted multi-index (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.llm.common import connected_components, parallelism, ship, table


def usable(column: str):
    """True for vectors without null or non-finite components ; false for null and empty ones."""
    big = float("inf")
    fine = (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (x.cast("double") != F.lit(big)) & (x.cast("double") != F.lit(-big)))
    return F.coalesce(F.col(column).isNotNull() & fine, F.lit(False))


# --- operator 1 -------------------------------------------------------------------------------------------------------

#: Queries and rows that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 1024, 16_384
LONG = 1 << 63
#: Segments at each resolution, coarse to fine.
LEVELS = (1, 4, 16)


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(m)-weighted means and norms of the deviations of its segments, so that products of two rows' statistics bound the segments' inner products."""
    cuts = np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        s = x[:, a:b]
        mean = s.mean(1) if b > a else np.zeros(len(x))
        out += [mean * math.sqrt(b - a), np.sqrt(np.maximum(((s - mean[:, None]) ** 2).sum(1), 0.0))]
    return np.stack(out, 1)


def block_top_k(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best rows of a block for each query, by score and then smaller id, never of the query's own id: places in q, ids, scores.

    A squared distance is |q|^2 + |r|^2 - 2 score, so a lower bound on it is an upper bound on the score:
    score <= sum over segments of m*mean*mean + deviation*deviation.  Rows whose bound at a resolution is below the k-th
    exact score so far are dropped there; the rest go to the next resolution, the last survivors to the exact product.
    """
    dims = q.shape[1]
    order = np.argsort(rid, kind="stable")
    rid, r = rid[order], r[order]
    levels = [s for s in LEVELS if s <= max(1, dims)]
    rs, qs = [segment_stats(r.astype(float), s) for s in levels], [segment_stats(q.astype(float), s) for s in levels]
    slack = 1.0 + 1e-9 * (np.abs(q.astype(float)).sum(1).max(initial=0.0) * np.abs(r).max(initial=0))
    ids, found, scores = [], [], []
    first = qs[0] @ rs[0].T
    for i in range(len(q)):
        alive = np.argsort(-first[i], kind="stable")
        alive = alive[rid[alive] != qid[i]]
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add(own, i=i):
            nonlocal best_id, best
            s = r[own] @ q[i]
            best_id, best = np.concatenate([best_id, rid[own]]), np.concatenate([best.astype(s.dtype), s])
            top = np.lexsort([best_id, -best])[:k] if s.dtype != object else np.array(sorted(range(len(best)), key=lambda j: (-best[j], best_id[j]))[:k], int)
            best_id, best = best_id[top], best[top]

        seed, alive = alive[: 4 * k], alive[4 * k :]
        add(seed)
        for level in range(len(levels)):
            if not len(alive) or len(best) < k:
                break
            bound = first[i][alive] if not level else rs[level][alive] @ qs[level][i]
            alive = alive[bound + slack >= best[-1]]
            if level + 1 < len(levels) and len(alive) > 4 * k:  # the likeliest raise the k-th score early
                add(alive[: 2 * k])
                alive = alive[2 * k :]
        if len(alive):
            add(alive)
        ids += [i] * len(best)
        found += best_id.tolist()
        scores += best.tolist()
    return ids, found, scores


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that `is_query` holds for, the k other rows with the highest inner product of floor(scale * component).

    Ties go to the smaller id; fewer than k rows come back where there are fewer.  Rows without an id, with a null vector or
    with null or non-finite components take no part.  Of rows that share an id each counts as a candidate, and each query row
    is answered; a query's own id is no candidate.  Vectors of another length than the query's take no part for it.  An empty table
    gives no rows; extra columns are dropped, whatever their names.  Components and scores beyond the range of a long are taken as its ends.

    Rows and queries meet in a grid of blocks of bounded size (a stated query set against all rows); each block keeps k rows for
    a query, which a ranked window, limited before its shuffle, merges.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), whole.alias("v"))
    rows = table(rows.withColumn("dims", F.size("v")), "whole-vectors")
    sizes = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_rows, n_queries = int(sizes[0]), int(sizes[1] or 0)
    row_blocks, query_blocks = max(1, math.ceil(n_rows / row_block), min(parallelism(spark), math.ceil(n_rows / 512))), max(1, math.ceil(n_queries / query_block))
    schema = "query_id long, query_row long, vec_id long, score long"
    side = lambda own, blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(own)
    every = lambda own, blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(own)
    left = rows.select("id", "dims", "v", side("rb", row_blocks), every("qb", query_blocks))
    asked = rows.where("asks").select("id", "dims", "v").withColumn("row", F.monotonically_increasing_id())
    asked = table(asked, "queries")
    right = asked.select("id", "dims", "v", "row", side("qb", query_blocks), every("rb", row_blocks))

    def meet(_, r: pa.Table, q: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if len(r) and len(q):
            for dims in set(q.column("dims").to_pylist()):
                a, b = (t.filter(pc.equal(t.column("dims"), dims)) for t in (q, r))
                if not len(b):
                    continue
                x, y = (np.array(t.column("v").combine_chunks().flatten(), np.int64).reshape(-1, dims) for t in (a, b))
                if dims * float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(y.astype(float)).max(initial=0)) >= LONG:
                    x, y = x.astype(object), y.astype(object)  # exact integers of any size
                qid, number = (np.array(a.column(c), np.int64) for c in ("id", "row"))
                at, got, score = block_top_k(qid, x, np.array(b.column("id"), np.int64), y, k)
                score = [max(-LONG, min(LONG - 1, int(v))) for v in score]
                for c, v in zip(out, (qid[at].tolist(), number[at].tolist(), got, score), strict=True):
                    c += v
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "query_row", "vec_id", "score"])

    met = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# --- operator 3 -------------------------------------------------------------------------------------------------------

#: So many distinct vectors are sampled (by a hash of their number) to fit the codebooks; with large tables, so many for each centroid of a half.
SAMPLE, FOR_EACH = 20_000, 8
#: Sampled vectors whose links to all others set the margin.
ASKED = 256
#: Members and visitors of a cell that meet in one task.
CELL_BLOCK = 2048
#: Steps in which the margin is set, in squared distance.
STEPS, STEP = 1024, 1 / 256


#: Numbers in a table of distances at a time: 32 MB.
TABLE = 1 << 22


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest row of c for each row of x, some rows at a time, so that memory doesn't grow with both."""
    square, out, step = (c * c).sum(1), np.zeros(len(x), np.int64), max(1, TABLE // max(1, len(c)))
    for at in range(0, len(x), step):
        out[at : at + step] = np.argmin(square - 2 * (x[at : at + step] @ c.T), 1)
    return out


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means; empty clusters keep their centre.  Besides x and the centres it holds TABLE numbers."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each row's result depends on that row alone.  Rows are brought near 1 by a power of two first, which rounds nothing, so that
    no square under- or overflows."""
    x = np.ascontiguousarray(x, float)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


class Grid:
    """The product grid of two codebooks for vectors of one length: cell (i, j) is number i * width + j."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books, self.width, self.half = (first, second), len(second), first.shape[1]

    def _sides(self, x: np.ndarray):
        for part, c in ((x[:, : self.half], self.books[0]), (x[:, self.half :], self.books[1])):
            yield np.maximum((part * part).sum(1)[:, None] + (c * c).sum(1) - 2 * (part @ c.T), 0)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The nearest cell of each vector."""
        out, step = np.zeros(len(x), np.int64), max(1, TABLE // max(len(c) for c in self.books))
        for at in range(0, len(x), step):
            i, j = (d.argmin(1) for d in self._sides(x[at : at + step]))
            out[at : at + step] = i * self.width + j
        return out

    def distance(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to cells, row by row; each depends on its row alone, so that every task agrees."""
        return ((x[:, : self.half] - self.books[0][cell // self.width]) ** 2).sum(1) + ((x[:, self.half :] - self.books[1][cell % self.width]) ** 2).sum(1)

    def visits(self, x: np.ndarray, home: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """(place in x, cell) of every cell that is at most `margin` farther than the nearest one: the multi-sequence traversal of each vector.

        Both halves' centroids are sorted by distance; of the ranks (i, j) those are walked whose sum of distances stays within the margin.
        """
        owners, cells = [], []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            sides = []
            for d in self._sides(part):
                d -= d.min(1, keepdims=True)
                most = max(1, int((d <= margin + 1e-9).sum(1).max(initial=1)))
                near = np.argpartition(d, most - 1, 1)[:, :most] if most < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                o = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), 1, kind="stable"), 1)
                sides.append((o, np.take_along_axis(d, o, 1)))
            (o1, d1), (o2, d2) = sides
            for lo in range(0, o1.shape[1], 64):  # a bounded number of ranks of the first half at a time
                k, i, j = np.nonzero(d1[:, lo : lo + 64, None] + d2[:, None, :] <= margin + 1e-9)
                owners.append(k + at)
                cells.append(o1[k, lo + i] * self.width + o2[k, j])
        owner, cell = np.concatenate(owners), np.concatenate(cells)
        own = x[owner]
        keep = (self.distance(own, cell) - self.distance(own, home[owner]) <= margin) | (cell == home[owner])
        return owner[keep], cell[keep]

    def apart(self, x: np.ndarray, home_x: np.ndarray, y: np.ndarray, home_y: np.ndarray) -> np.ndarray:
        """The margin that pairs of vectors need: how much farther than its own the other's home is, for the nearer side."""
        return np.minimum(self.distance(x, home_y) - self.distance(x, home_x), self.distance(y, home_x) - self.distance(y, home_y))


def hard_margin(x: np.ndarray, grid: Grid, threshold: float, target: float, pairs: int = 4000) -> float:
    """The margin that finds `target` of pairs at the threshold itself, the hardest ones, around rows of x, in random directions."""
    rng = np.random.default_rng(2)
    p = x[rng.integers(0, len(x), pairs)]
    turn = rng.normal(size=p.shape)
    turn -= (turn * p).sum(1, keepdims=True) * p
    turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
    q = unit(threshold * p + math.sqrt(1 - threshold**2) * turn)
    need = grid.apart(p, grid.home(p), q, grid.home(q))
    return float(max(0.0, np.quantile(need, target, method="higher")))


def recall_curve(counts: np.ndarray) -> np.ndarray:
    """counts: queries x steps of the margin.  The recall at each step: each query counts alike, the smaller one of queries with few
    links and with many."""
    total = counts.sum(1)
    shares = [np.cumsum(counts[own], 1) / total[own, None] for own in ((total > 0) & (total <= 16), total > 16)]
    means = [s.mean(0) for s in shares if len(s)]
    return np.min(means, 0) if means else np.ones(counts.shape[1])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For linked numbers a, b: every number and the smallest one that links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == label).all():
            return nodes, nodes[label]
        label = least


def _clear(members: DataFrame) -> bool:
    """Whether no two different vectors share a digest."""
    return not members.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").limit(1).take(1)


def _plain(batch, column: str, dims: int) -> np.ndarray:
    return np.asarray(batch.column(column).combine_chunks().flatten() if isinstance(batch, pa.Table) else batch.column(column).flatten(), float).reshape(-1, dims)


def near_vectors(vectors: DataFrame, threshold: float = 0.95, target: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, asked: int = ASKED) -> DataFrame:
    """One row a row of vectors: id, n_links (other rows at cosine >= threshold that were found), component_id (the smallest id that links reach), kept (id = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do rows without an id
    (their component_id is null, and they are kept).  Equal vectors are linked; rows that share an id are vectors of their
    own.  Vectors of different lengths don't link.  Components of any size a double holds count, the smallest and the largest too.  An empty
    table gives an empty one; extra columns are dropped, whatever their names.

    Equal vectors become one member with their number.  The codebooks are fitted on a sample, their number of cells grows with
    the table: k = sqrt(members / 8) centroids a half, and 8 sampled vectors for each.  The driver holds that sample, the two codebooks and 32 MB (at
    10^9 members of 64 components about 100 MB), a task a batch of vectors and 64 MB.  Every member is indexed and visits all cells that are at most a margin farther than its nearest one.  The margin
    is the smallest one at which `target` of the links are found: of those between `asked` sampled vectors and all members, each
    vector counted alike, and of pairs at the threshold itself.  Members and visitors of a cell meet in
    blocks of bounded size; a block returns a count for each member and a spanning forest, never its pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = next(f.dataType.elementType for f in vectors.schema if f.name == vector_col)
    kind = "float" if kind.simpleString() == "float" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector_col), F.transform(vector_col, lambda x: (x.cast(kind) + F.lit(0.0)).cast(kind))).alias("v"))
    good = rows.where("id is not null and v is not null and exists(v, x -> x != 0)")
    seed = 0
    while True:  # once, unless two different vectors share 128 bits
        digests = [F.xxhash64(F.lit(seed), "v").alias("h1"), F.xxhash64(F.lit(seed + 1), "v").alias("h2")]
        members = good.groupBy(*digests, "v").agg(F.count("*").alias("n"), F.min("id").alias("least"))
        members = table(members.select(F.monotonically_increasing_id().alias("key"), "h1", "h2", "n", "least", F.size("v").alias("dims"), "v"), "distinct-vectors")
        if _clear(members):
            break
        seed += 2
    n_members = members.count()
    k = int(2 ** round(math.log2(max(math.sqrt(n_members / 8), 1))))
    size = max(sample, FOR_EACH * k)
    # a share of all rows by a hash of their number, so that nothing is sorted for it
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, size / max(1, n_members)) * (1 << 30))
    picked = members.where(share).select("key", "v").limit(2 * size).toPandas().sort_values("key") if n_members else None
    grids: dict[int, Grid] = {}
    margins: dict[int, float] = {}
    queries: dict[int, tuple] = {}
    by_dims: dict[int, list] = {}
    for key, v in zip(picked["key"], picked["v"], strict=True) if n_members else ():
        by_dims.setdefault(len(v), []).append((key, v))
    for dims, own in by_dims.items():
        x = unit(np.stack([v for _, v in own]))
        half = max(1, dims // 2)
        # a fourth of the sample stays out of the fit: centroids lie nearer to the rows that they were fitted on
        fresh = np.arange(3, len(x), 4)
        fit = np.delete(x, fresh, 0)
        grids[dims] = grid = Grid(centroids(fit[:, :half], k), centroids(fit[:, half:], k))
        rest = fresh if len(fresh) else np.arange(len(x))
        margins[dims] = hard_margin(x[rest], grid, threshold, target)
        at = rest[:: max(1, len(rest) // asked)][:asked]
        queries[dims] = (np.array([own[i][0] for i in at]), x[at], grid.home(x[at]))

    def needs(batches):
        """How many links of each sampled vector need which margin."""
        for batch in batches:
            dims, keys, out = np.array(batch.column("dims")), np.array(batch.column("key")), ([], [], [], [])
            for d in np.unique(dims).tolist():
                if d not in grids:
                    continue
                own = np.flatnonzero(dims == d)
                q_key, q, q_home = queries[d]
                x = unit(np.asarray(batch.column("v").take(pa.array(own)).flatten(), float).reshape(-1, d))
                i, j = np.nonzero((x @ q.T >= threshold) & (keys[own][:, None] != q_key))
                if not len(i):
                    continue
                home = grids[d].home(x)
                need = grids[d].apart(x[i], home[i], q[j], q_home[j])
                step = np.clip(np.ceil(need / STEP), 0, STEPS - 1).astype(np.int64)
                code, n = np.unique(j * STEPS + step, return_counts=True)
                for c, v in zip(out, ([d] * len(code), code // STEPS, code % STEPS, n), strict=True):
                    c += list(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["dims", "asked", "step", "n"])

    # at most `asked` * STEPS rows a length of vectors
    told = members.select("key", "dims", "v").mapInArrow(needs, "dims long, asked long, step long, n long").groupBy("dims", "asked", "step").agg(F.sum("n").alias("n")).collect() if grids else []
    for dims in grids:
        counts = np.zeros((len(queries[dims][0]), STEPS))
        for r in told:
            if r.dims == dims:
                counts[r.asked, r.step] = r.n
        # where the sample has links, the first step at which enough of them are found
        enough = np.flatnonzero(recall_curve(counts) >= target)
        margins[dims] = max(margins[dims], STEP * (int(enough[0]) if len(enough) else STEPS))

    def index(batches):
        for batch in batches:
            dims, values = np.array(batch.column("dims")), batch.column("v")
            cells = [None] * len(dims)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d in grids:
                    x = unit(np.asarray(values.take(pa.array(own)).flatten(), float).reshape(-1, d))
                    home = grids[d].home(x)
                    owner, cell = grids[d].visits(x, home, margins[d])
                    # home first
                    order = np.lexsort([cell != home[owner], owner])
                    owner, cell = owner[order], cell[order] + (d << 40)
                    edges = np.searchsorted(owner, np.arange(len(own) + 1)).tolist()
                    for i, a, b in zip(own.tolist(), edges[:-1], edges[1:], strict=True):
                        cells[i] = cell[a:b]
                else:  # a length that the sample lacks has one cell
                    for i in own.tolist():
                        cells[i] = np.array([d << 40])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), batch.column("dims"), values, pa.array(cells, pa.list_(pa.int64()))], ["key", "n", "dims", "v", "cells"])

    indexed = table(members.select("key", "n", "dims", "v").mapInArrow(index, f"key long, n long, dims int, v array<{kind}>, cells array<long>"), "indexed-vectors")
    homes = indexed.select("key", "n", "dims", "v", F.col("cells")[0].alias("cell"))
    guests = indexed.select(F.col("key").alias("g_key"), F.col("n").alias("g_n"), F.col("v").alias("g_v"), F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    # one row a cell, at most one for each member
    grid_rows = homes.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("mb")).join(guests.groupBy("cell").agg(F.ceil(F.count("*") / CELL_BLOCK).cast("int").alias("gb")), "cell")
    blocks = table(grid_rows, "cell-blocks", tidy=False)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = homes.join(blocks, "cell").select("cell", part("key", "mb").alias("m"), each("gb").alias("g"), "key", "n", "dims", "v")
    right = guests.join(blocks, "cell").select("cell", each("mb").alias("m"), part("g_key", "gb").alias("g"), "g_key", "g_n", "g_v", "home")

    def meet(cell, m: pa.Table, g: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(m) and len(g):
            dims = m.column("dims")[0].as_py()
            mk, gk = np.array(m.column("key"), np.int64), np.array(g.column("g_key"), np.int64)
            x, y = unit(_plain(m, "v", dims)), unit(_plain(g, "g_v", dims))
            i, j = np.nonzero(x @ y.T >= threshold)
            # a pair that also meets in the other's cell counts in one of the two
            counts = mk[i] != gk[j]
            if dims in grids:
                home = np.array(g.column("home"), np.int64) - (dims << 40)
                own = np.full(len(x), cell[0].as_py() - (dims << 40))
                late = np.flatnonzero(counts & (gk[j] > mk[i]))
                for at in range(0, len(late), 100_000):
                    p, q = i[late[at : at + 100_000]], home[j[late[at : at + 100_000]]]
                    visits = (grids[dims].distance(x[p], q) - grids[dims].distance(x[p], own[p]) <= margins[dims]) | (q == own[p])
                    counts[late[at : at + 100_000]] = ~visits
            else:
                counts &= gk[j] < mk[i]
            i, j = i[counts], j[counts]
            if len(i):
                keys = np.concatenate([mk, gk])
                total = np.concatenate([np.bincount(i, np.array(g.column("g_n"), float)[j], len(mk)), np.bincount(j, np.array(m.column("n"), float)[i], len(gk))])
                nodes, low = _forest(mk[i], gk[j])
                own, at = np.unique(keys, return_inverse=True)
                summed = np.bincount(at, total)
                place = np.searchsorted(own, nodes)
                out = (nodes.tolist(), summed[place].astype(np.int64).tolist(), low.tolist())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "links", "low"])

    met = table(left.groupBy("cell", "m", "g").cogroup(right.groupBy("cell", "m", "g")).applyInArrow(meet, "key long, links long, low long"), "cell-links")
    counts = met.groupBy("key").agg(F.sum("links").alias("links"))
    label = connected_components(met.select(F.col("key").alias("a"), F.col("low").alias("b")).where("a != b"))
    told = members.select("key", "n", "least", "h1", "h2").join(counts, "key", "left").join(label, F.col("key") == F.col("node"), "left").withColumn("class", F.coalesce("component", "key"))
    told = table(told.select("h1", "h2", "class", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "vector-links", tidy=False)
    smallest = table(told.groupBy("class").agg(F.min("least").alias("component_id")), "smallest", tidy=False)
    classes = table(told.join(smallest, "class").select("h1", "h2", "n_links", "component_id"), "vector-classes")
    linked = good.select("id", *digests).join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    rest = rows.where("id is null or v is null or not exists(v, x -> x != 0)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.unionByName(rest)
    return every.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
