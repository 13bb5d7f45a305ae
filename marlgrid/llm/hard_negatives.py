"""Hard-negative mining (operator 11): a multiway hyperplane tree with distance ranges between siblings.

Rows are points on a sphere: one more component, the root of M^2 - |x|^2 for the largest length M, makes a row's squared distance
from an anchor |a|^2 + M^2 - 2 * score.  A window of scores is then a ring of distances around the anchor.  A node of the tree
has split points; a row belongs to the nearest one.  For each split point and each sibling subtree the node stores the
smallest and largest distance between them.  With D the distance from anchor to split point, a row at a distance in [r1, r2] from the anchor is at a
distance in [max(D - r2, r1 - D), D + r2] from the point, so a subtree goes if any split point's range for it misses that interval.

The upper levels are fitted on a sample and deal all rows into cells; each block of a cell has levels of its own down to leaves, in which scores are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlgrid.llm.common import ship, table
from marlgrid.llm.vectors import LONG, usable

#: Rows sampled to fit the upper levels and to give each window a first bound.
SAMPLE = 2048
#: Split points of an upper node and of a node within a block; rows of a leaf.
UPPER, INNER, LEAF = 16, 8, 256
#: Levels within a block; what is larger than a leaf below them is one leaf, which is worked through LEAF rows at a time.
DEPTH = 12
#: Rows and windows that meet in one task.
ROW_BLOCK, ANCHOR_BLOCK = 8192, 2048
#: Components are kept within this range.
MOST = 9.0e18


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that puts them on the sphere of squared radius `most`."""
    x = np.asarray(x, float)
    return np.column_stack([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))])


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a and b."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0.0))


def split_points(x: np.ndarray, m: int, rng: np.random.Generator) -> np.ndarray:
    """Up to m rows of x, each the farthest from those before, of three times as many at random; fewer if the rest are alike."""
    some = x[rng.choice(len(x), min(3 * m, len(x)), replace=False)]
    chosen, near = [0], between(some, some[:1])[:, 0]
    scale = 1e-6 * float(np.abs(some).max(initial=0))
    while len(chosen) < min(m, len(some)) and near.max() > scale:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, between(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


@dataclass
class Node:
    """points: m x dims; least and most: m x m, the distances from point i to the rows of subtree j; below: a Node or a leaf for each point."""

    points: np.ndarray
    below: list = field(default_factory=list)
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    number: int = 0

    def alive(self, far: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """queries x subtrees: which subtrees can hold rows at distances in [inner, outer].  far: queries x points."""
        low = np.maximum(far - outer[:, None], inner[:, None] - far) - slack[:, None]
        high = far + outer[:, None] + slack[:, None]
        out = np.ones((len(far), len(self.below)), bool)
        for i in range(len(self.points)):
            out &= (self.most[i] >= low[:, i, None]) & (self.least[i] <= high[:, i, None])
        return out


def upper_tree(x: np.ndarray, levels: int, rng: np.random.Generator, nodes: list[Node], cells: list[int]) -> Node | int:
    """A tree over sampled points, whose leaves are cells numbered in order; ranges come later, from all rows."""
    points = split_points(x, UPPER, rng) if levels and len(x) >= 4 * UPPER else x[:0]
    if len(points) < 2:
        cells.append(len(cells))
        return cells[-1]
    node = Node(points, number=len(nodes))
    nodes.append(node)
    own = between(x, points).argmin(1)
    node.below = [upper_tree(x[own == j], levels - 1, rng, nodes, cells) for j in range(len(points))]
    node.least, node.most = np.full((len(points),) * 2, np.inf), np.full((len(points),) * 2, -np.inf)
    return node


def descend(root: Node | int, x: np.ndarray, seen=None) -> np.ndarray:
    """The cell of each row; seen(node, far, own) is told each node's rows, with their distances from its points and their subtrees."""
    out = np.zeros(len(x), np.int64)
    stack = [(root, np.arange(len(x)))]
    while stack:
        at, rows = stack.pop()
        if isinstance(at, int):
            out[rows] = at
        elif len(rows):
            far = between(x[rows], at.points)
            own = far.argmin(1)
            if seen:
                seen(at, far, own)
            stack += [(at.below[j], rows[own == j]) for j in np.unique(own)]
    return out


def ranges(far: np.ndarray, own: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """m x m: the least and most distance from point i to rows of subtree j."""
    least, most = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    for j in np.unique(own):
        rows = far[own == j]
        least[:, j], most[:, j] = rows.min(0), rows.max(0)
    return least, most


def block_tree(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> Node | np.ndarray:
    """A tree over rows of a block, down to leaves of row numbers in ascending order; rows that are all alike are one leaf."""
    if len(rows) <= LEAF or not depth:
        return rows
    points = split_points(x[rows], INNER, rng)
    if len(points) < 2:
        return rows
    far = between(x[rows], points)
    own = far.argmin(1)
    if (own == own[0]).all():
        return rows
    node = Node(points)
    node.least, node.most = ranges(far, own, len(points))
    node.below = [block_tree(x, rows[own == j], rng, depth - 1) for j in range(len(points))]
    return node


@dataclass
class Windows:
    """Windows of scores [low, high], each around one row of a (its number is `of`)."""

    a: np.ndarray
    of: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def rings(self, most: float, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inner and outer distance of some windows, and what rounding may take."""
        square = (np.asarray(self.a, float) ** 2).sum(1)[self.of[own]] + most
        inner = np.sqrt(np.maximum(square - 2 * self.high[own].astype(float), 0.0))
        outer = np.sqrt(np.maximum(square - 2 * self.low[own].astype(float), 0.0))
        return inner, outer, 4e-6 * np.sqrt(square) + 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: through doubles or longs where these hold them, else through Python's integers; as longs, or the ends of their range."""
    most = a.shape[1] * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if most < 1 << 52:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < LONG:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG - 1).astype(np.int64)


def best_in_block(w: Windows, a_id: np.ndarray, a_label: np.ndarray, x: np.ndarray, x_id: np.ndarray, x_label: np.ndarray, same: bool, k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row of x, score): for each window the k best rows of the anchor's label and another id (same) or of other labels, by score and then smaller id.

    x is in order of ids.  A window's lower end rises to the k-th best score found in it, so its ring shrinks from leaf to leaf.
    """
    high_x, high_a = lifted(x, most), np.column_stack([np.asarray(w.a, float), np.zeros(len(w.a))])
    low = w.low.copy()
    best = np.full((len(w.of), k), -LONG, np.int64)
    found = ([], [], [])

    def leaf(rows: np.ndarray, asked: np.ndarray) -> None:
        for at in range(0, len(rows), LEAF):
            own = rows[at : at + LEAF]
            anchors, place = np.unique(w.of[asked], return_inverse=True)
            score = products(w.a[anchors], x[own])[place]
            who = w.of[asked]
            match = (a_label[who][:, None] == x_label[own]) == same
            if same:
                match &= a_id[who][:, None] != x_id[own]
            match &= (score >= low[asked][:, None]) & (score <= w.high[asked][:, None])
            hit = np.flatnonzero(match.any(1))
            if not len(hit):
                continue
            score = np.where(match[hit], score[hit], -LONG)
            first = np.argsort(-score.astype(float) if np.abs(score[match[hit]]).max() < 1 << 52 else ~score, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(score, first, 1)
            i, j = np.nonzero(np.take_along_axis(match[hit], first, 1))
            for c, v in zip(found, (asked[hit[i]], own[first[i, j]], top[i, j]), strict=True):
                c.append(v)
            q = asked[hit]
            best[q] = -np.sort(~np.concatenate([best[q], top], 1), 1)[:, :k] - 1
            low[q] = np.maximum(low[q], best[q][:, -1])

    def walk(at: Node | np.ndarray, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(at, np.ndarray):
            return leaf(at, asked)
        far = between(high_a, at.points)
        for j in np.argsort(far[w.of[asked]].mean(0)):
            inner, outer, slack = Windows(w.a, w.of, low, w.high).rings(most, asked)
            walk(at.below[j], asked[at.alive(far[w.of[asked]], inner, outer, slack)[:, j] & (low[asked] <= w.high[asked])])

    walk(block_tree(high_x, np.arange(len(x)), np.random.default_rng(3)), np.arange(len(w.of)))
    if not found[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    of, row, score = (np.concatenate(c) for c in found)
    order = np.lexsort([row, ~score, of])
    of, row, score = of[order], row[order], score[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    keep = place < k
    return of[keep], row[keep], score[keep]


def _lists(column, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64), np.repeat(np.arange(count), np.asarray(column.value_lengths()))


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


class Forest:
    """An upper tree and a sample for each length of vectors that the sample has; other lengths have one cell each."""

    def __init__(self, indexed_from: DataFrame, n: int, most: dict[int, float]):
        share = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, 2 * SAMPLE / max(1, n)) * (1 << 30))
        picked = indexed_from.where(share).select("row", "id", "label", "v").limit(4 * SAMPLE).toArrow()
        order = np.argsort(np.array(picked.column("row"), np.int64))
        picked = picked.take(pa.array(order))
        sizes = np.asarray(pc.list_value_length(picked.column("v")))
        levels = 1 if n <= UPPER * ROW_BLOCK else 2 if n <= UPPER**2 * ROW_BLOCK else 3
        self.most, self.trees, self.nodes, self.samples = most, {}, {}, {}
        for d in np.unique(sizes).tolist():
            part = picked.filter(pa.array(sizes == d))[:SAMPLE]
            x = _matrix(part.column("v"), d)
            by_id = np.argsort(np.array(part.column("id"), np.int64), kind="stable")
            self.samples[d] = (x[by_id], np.array(part.column("id"), np.int64)[by_id], np.array(part.column("label"), np.int64)[by_id])
            self.nodes[d] = []
            self.trees[d] = upper_tree(lifted(x, most[d]), levels, np.random.default_rng(1), self.nodes[d], [])

    def cells(self, d: int, x: np.ndarray, seen=None) -> np.ndarray:
        return (descend(self.trees[d], lifted(x, self.most[d]), seen) if d in self.trees else np.zeros(len(x), np.int64)) + (d << 20)

    def measure(self, indexed: DataFrame) -> None:
        """The ranges of all upper nodes, from all rows: least and most by node and pair, taken in each task first."""
        if not any(self.nodes.values()):
            return

        def part(batches):
            told: dict = {}

            def seen(d, node, far, own):
                least, most = ranges(far, own, len(node.points))
                if (d, node.number) in told:
                    a, b = told[d, node.number]
                    least, most = np.minimum(a, least), np.maximum(b, most)
                told[d, node.number] = (least, most)

            for batch in batches:
                dims = np.asarray(batch.column("dims"))
                for d in np.unique(dims).tolist():
                    if self.nodes.get(d):
                        self.cells(d, _matrix(batch.column("v").take(pa.array(np.flatnonzero(dims == d))), d), lambda *t, d=d: seen(d, *t))
            for (d, number), (least, most) in told.items():
                i, j = np.nonzero(np.isfinite(least))
                if len(i):
                    same = lambda v: pa.array(np.full(len(i), v, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(d), same(number), pa.array(i), pa.array(j), pa.array(least[i, j]), pa.array(most[i, j])], ["d", "node", "i", "j", "least", "most"])

        # at most UPPER ** 2 rows a node, and UPPER ** 2 + UPPER + 1 nodes
        told = indexed.select("dims", "v").mapInArrow(part, "d long, node long, i long, j long, least double, most double").groupBy("d", "node", "i", "j").agg(F.min("least").alias("least"), F.max("most").alias("most")).toArrow()
        d, node, i, j, least, most = (np.asarray(told.column(c)) for c in range(6))
        for a, b in {(int(a), int(b)) for a, b in zip(d, node, strict=True)}:
            own = (d == a) & (node == b)
            self.nodes[a][b].least[i[own], j[own]] = least[own]
            self.nodes[a][b].most[i[own], j[own]] = most[own]

    def raised(self, d: int, w: Windows, a_id: np.ndarray, a_label: np.ndarray, same: bool, k: int) -> np.ndarray:
        """The windows' lower ends, raised to the k-th best score among sampled rows in the window."""
        x, x_id, x_label = self.samples[d]
        low = w.low.copy()
        if len(x) < k:
            return low
        for at in range(0, len(w.of), 512):
            own = slice(at, at + 512)
            who = w.of[own]
            anchors, place = np.unique(who, return_inverse=True)
            score = products(w.a[anchors], x)[place]
            match = (a_label[who][:, None] == x_label) == same
            match &= (a_id[who][:, None] != x_id) & (score >= low[own][:, None]) & (score <= w.high[own][:, None])
            kth = np.sort(np.where(match, score, -LONG), 1)[:, -k]
            low[own] = np.maximum(low[own], kth)
        return low

    def visits(self, d: int, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, cell) of all cells that a window's ring can reach."""
        if d not in self.trees:
            return np.arange(len(w.of)), np.full(len(w.of), d << 20)
        high_a = np.column_stack([np.asarray(w.a, float), np.zeros(len(w.a))])
        out = ([], [])
        stack = [(self.trees[d], np.flatnonzero(w.low <= w.high))]
        while stack:
            at, asked = stack.pop()
            if isinstance(at, int):
                out[0].append(asked)
                out[1].append(np.full(len(asked), at + (d << 20)))
            elif len(asked):
                alive = at.alive(between(high_a, at.points)[w.of[asked]], *w.rings(self.most[d], asked))
                stack += [(at.below[j], asked[alive[:, j]]) for j in range(len(at.below))]
        return np.concatenate(out[0]), np.concatenate(out[1])


ASKED = "row long, id long, label long, dims int, v array<long>, tags array<long>, lows array<long>, highs array<long>"


def _search(indexed: DataFrame, blocks: DataFrame, asked: DataFrame, forest: Forest, same: bool, k: int, name: str) -> DataFrame:
    """(row, id, tag, found, score, rank): for each window of asked the k best rows of the anchor's label (same) or of others."""

    def spread(batches):
        """One row for an anchor and a cell that some of its windows reach, with those windows."""
        for batch in batches:
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                tag, of = _lists(part.column("tags"), len(part))
                low, high = (_lists(part.column(c), len(part))[0] for c in ("lows", "highs"))
                w = Windows(_matrix(part.column("v"), d), of, low, high)
                if d in forest.samples:
                    w.low = forest.raised(d, w, *(np.asarray(part.column(c), np.int64) for c in ("id", "label")), same, k)
                window, cell = forest.visits(d, w)
                if not len(window):
                    continue
                order = np.lexsort([window, cell, of[window]])
                window, cell = window[order], cell[order]
                starts = np.flatnonzero(np.r_[True, (np.diff(of[window]) != 0) | (np.diff(cell) != 0)])
                ends = pa.array(np.r_[starts, len(window)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(c[window])) for c in (tag, w.low, high)]
                rows = part.take(pa.array(of[window[starts]]))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("row", "id", "label", "dims", "v")), *lists, pa.array(cell[starts])], ["row", "id", "label", "dims", "v", "tags", "lows", "highs", "cell"])

    visits = table(asked.mapInArrow(spread, f"{ASKED}, cell long"), f"{name}-visits")
    # one row a cell, and at most one for each row
    met = visits.groupBy("cell").agg(F.ceil(F.sum(F.size("tags")) / ANCHOR_BLOCK).cast("int").alias("ab")).join(blocks, "cell")
    met = table(met, f"{name}-cells", tidy=False)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = indexed.join(met, "cell").select("cell", part("rb").alias("r"), each("ab").alias("a"), "id", "label", "dims", "v")
    right = visits.join(met, "cell").select("cell", each("rb").alias("r"), part("ab").alias("a"), "row", "id", "label", "v", "tags", "lows", "highs")
    limits = forest.most

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 5
        if len(x) and len(q):
            d = x.column("dims")[0].as_py()
            x = x.sort_by("id")
            tag, of = _lists(q.column("tags"), len(q))
            low, high = (_lists(q.column(c), len(q))[0] for c in ("lows", "highs"))
            a_row, a_id, a_label = (np.array(q.column(c), np.int64) for c in ("row", "id", "label"))
            x_id, x_label = (np.array(x.column(c), np.int64) for c in ("id", "label"))
            window, place, score = best_in_block(Windows(_matrix(q.column("v"), d), of, low, high), a_id, a_label, _matrix(x.column("v"), d), x_id, x_label, same, k, limits[d])
            out = [a_row[of[window]], a_id[of[window]], tag[window], x_id[place], score]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "id", "tag", "found", "score"])

    got = left.groupBy("cell", "r", "a").cogroup(right.groupBy("cell", "r", "a")).applyInArrow(meet, "row long, id long, tag long, found long, score long")
    order = Window.partitionBy("row", "tag").orderBy(F.desc("score"), "found")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for every row that `is_anchor` holds for, and each of its positives (the
    best other rows of its label), the best rows of other labels whose score is from `low` to `high` per cent of the positive's.

    A score is the integer inner product of floor(scale * component); higher scores come first, ties go to the smaller id.  Windows
    around a negative positive score are empty; one around 0 holds the score 0.  Fewer rows come back where there are fewer.

    Rows without an id or a label, with a null or empty vector or with null or non-finite components take no part.  Of rows that share an id
    each counts, and each anchor row is answered; rows with the anchor's own id are no positives.  Vectors of another length than the anchor's
    take no part for it.  An empty table gives no rows; extra columns are dropped, whatever their names.  Components beyond 9e18 and
    scores beyond the range of a long are taken as its ends.

    The stated anchors meet all rows of the cells that their windows reach, in blocks of bounded size.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = F.transform(vector_col, lambda c: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * scale))).cast("long"))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"), whole.alias("v"))
    rows = table(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "asks", F.size("v").alias("dims"), "v"), "labelled-vectors")
    # one row a length
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c)).alias("most")).collect()
    forest = Forest(rows, sum(r["n"] for r in sizes), {r["dims"]: r["most"] * (1 + 1e-12) for r in sizes})

    def deal(batches):
        for batch in batches:
            dims, cells = np.asarray(batch.column("dims")), np.zeros(len(batch), np.int64)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                cells[own] = forest.cells(d, _matrix(batch.column("v").take(pa.array(own)), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], [*batch.schema.names, "cell"])

    indexed = table(rows.mapInArrow(deal, "row long, id long, label long, asks boolean, dims int, v array<long>, cell long"), "dealt-vectors")
    forest.measure(indexed)
    blocks = table(indexed.groupBy("cell").agg(F.ceil(F.count("*") / ROW_BLOCK).cast("int").alias("rb")), "row-blocks", tidy=False)
    one = lambda v: F.array(F.lit(v).cast("long"))
    anchors = indexed.where("asks").select("row", "id", "label", "dims", "v")
    near = _search(indexed, blocks, anchors.withColumns({"tags": one(0), "lows": one(1 - LONG), "highs": one(LONG - 1)}), forest, True, positives, "positives")
    near = table(near.select("row", F.col("rank").cast("long").alias("tag"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # whole hundreds and the rest apart, so that nothing leaves the range of a long
    ends = near.where("positive_score >= 0").selectExpr("row", "tag", f"(positive_score div 100) * {low} + ((positive_score % 100) * {low} + 99) div 100 as low", f"(positive_score div 100) * {high} + ((positive_score % 100) * {high}) div 100 as high")
    rings = ends.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("tag", "low", "high"))).alias("w")).select(F.col("row").alias("of"), F.col("w.tag").alias("tags"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    asked = table(anchors.join(rings, F.col("row") == F.col("of")).drop("of"), "windows")
    far = _search(indexed, blocks, asked, forest, False, negatives, "negatives")
    out = far.join(near.withColumnsRenamed({"row": "near_row", "tag": "near_tag"}), (F.col("row") == F.col("near_row")) & (F.col("tag") == F.col("near_tag")))
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
