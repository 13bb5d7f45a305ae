"""Operator 11 against every pair."""

import math

import numpy as np
import pytest

from marlgrid.llm import hard_negatives as hn
from marlgrid.llm.hard_negatives import F

ROWS = "vec_id long, embedding array<double>, label int, id string, cell string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, c, "x", "y", "z") for i, v, c in rows], ROWS)


def brute(rows, is_anchor, positives=5, negatives=10, scale=256):
    fit = [(i, c, [max(-(9 * 10**18), min(9 * 10**18, math.floor(scale * x))) for x in v]) for i, v, c in rows if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    for i, c, a in fit:
        if not is_anchor(i):
            continue
        scored = [(clip(sum(x * y for x, y in zip(a, v))), j, k) for j, k, v in fit if len(v) == len(a)]
        near = sorted((-s, j) for s, j, k in scored if k == c and j != i)[:positives]
        for p, j in near:
            far = sorted((-s, n) for s, n, k in scored if k != c and 30 * -p <= 100 * s <= 90 * -p)[:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(far)]
    return sorted(out)


def told(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(seed, n=900, dims=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(25, dims))
    own = rng.integers(0, 25, n)
    x = base[own] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.1, 0.4, 1.0], (n, 1))
    x[rng.integers(0, n, n // 6)] = x[0]
    return [(i, [float(np.float32(c)) for c in v], int(k)) for i, (v, k) in enumerate(zip(x, (own + rng.integers(0, 2, n)) % 5))]


ODD = [(5000, None, 1), (5001, [1.0, None] + [0.0] * 10, 1), (5002, [float("nan")] * 12, 1), (5003, [float("inf")] * 12, 1), (5004, [], 2), (5020, [1.0] * 12, None), (None, [1.0] * 12, 1), (5040, [0.0] * 12, 1), (5060, [1.0] * 3, 1), (5061, [2.0, 1.0, 0.0], 1), (5062, [0.9, 0.5, 0.1], 2), (40, [0.5] * 12, 3), (40, [0.5] * 12, 3)]


@pytest.mark.parametrize("sizes", [(8192, 2048, 256), (64, 7, 8)])
def test_by_brute_force(spark, monkeypatch, sizes):
    for name, v in zip(("ROW_BLOCK", "ANCHOR_BLOCK", "LEAF"), sizes):
        monkeypatch.setattr(hn, name, v)
    rows = clustered(1) + ODD
    got = hn.hard_negatives(frame(spark, rows).repartition(4), F.col("vec_id") % 20 == 0)
    assert told(got) == brute(rows, lambda i: i % 20 == 0)


def test_ties_and_few_rows(spark):
    same = [(i, [1.0, 0.5], i % 3) for i in range(60)] + [(100 + i, [0.5, 0.4], i % 3) for i in range(60)]
    assert told(hn.hard_negatives(frame(spark, same), F.col("vec_id") % 20 == 0)) == brute(same, lambda i: i % 20 == 0)
    few = [(0, [1.0, 1.0], 1), (1, [1.0, 2.0], 1), (2, [0.8, 0.4], 2), (20, [-1.0, 1.0], 7)]
    assert told(hn.hard_negatives(frame(spark, few), F.col("vec_id") % 20 == 0)) == brute(few, lambda i: i % 20 == 0)
    assert hn.hard_negatives(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert hn.hard_negatives(frame(spark, few), F.col("vec_id") == 77).count() == 0


def test_large_components(spark):
    rows = [(0, [1e9, 3.0], 0), (1, [2e9, 1.0], 0), (2, [1e9, 5.0], 1), (3, [1e30, 0.0], 1), (4, [5e8, 0.0], 1), (5, [1e-300, 1e-300], 0), (6, [1e300, 1.0], 0)]
    assert told(hn.hard_negatives(frame(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)


def test_elimination_is_right_and_happens():
    """Subtrees that a ring misses hold no row of the ring; with rows in clusters most go."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(30, 8)) * 300)[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8)) * 5
    x = np.floor(x).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(1).max())
    tree = hn.block_tree(hn.lifted(x, most), np.arange(len(x)), rng)
    a = x[:50]
    score = hn.products(a, x)
    top = np.sort(score, 1)[:, -20]
    w = hn.Windows(a, np.arange(50), top, np.full(50, hn.LONG - 1))
    seen = np.zeros(50, int)

    def walk(at, asked):
        if isinstance(at, np.ndarray):
            seen[asked] += len(at)
            return
        alive = at.alive(hn.between(np.column_stack([a.astype(float), np.zeros(50)]), at.points)[asked], *w.rings(most, asked))
        for j, below in enumerate(at.below):
            rows = below if isinstance(below, np.ndarray) else np.concatenate(list(leaves(below)))
            lost = asked[~alive[:, j]]
            assert not (score[lost][:, rows] >= top[lost, None]).any()
            walk(below, asked[alive[:, j]])

    def leaves(at):
        if isinstance(at, np.ndarray):
            yield at
        else:
            for b in at.below:
                yield from leaves(b)

    walk(tree, np.arange(50))
    assert seen.mean() < 0.5 * len(x)


def test_upper_ranges_hold_all_rows(spark):
    rows = frame(spark, clustered(4, 600)).selectExpr("vec_id as row", "vec_id as id", "cast(label as long) as label", "transform(embedding, c -> cast(floor(256 * c) as long)) as v", "size(embedding) as dims")
    x = np.array([r.v for r in rows.orderBy("id").collect()])
    most = float((x.astype(float) ** 2).sum(1).max())
    forest = hn.Forest(rows, 600, {12: most})
    forest.measure(rows)
    assert forest.nodes[12]

    def seen(node, far, own):
        least, largest = hn.ranges(far, own, len(node.points))
        assert np.allclose(least, node.least) and np.allclose(largest, node.most)

    forest.cells(12, x, seen)
