"""Operators 1 and 3 against every pair."""

import math
import tracemalloc

import numpy as np

from marlgrid.llm import vectors
from marlgrid.llm.vectors import F

ROWS = "vec_id long, embedding array<float>, label int, score string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], ROWS)


def odd(n):
    return [(n, None), (n + 1, [1.0, None] + [0.0] * 14), (n + 2, [float("nan")] * 16), (n + 3, [float("inf")] + [0.0] * 15), (n + 4, []), (n + 5, [0.0] * 16), (None, [1.0] * 16), (n + 6, [1.0] * 3)]


def clustered(seed, n=400, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dims))
    x = base[rng.integers(0, 40, n)] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.03, 0.2, 1.0], (n, 1))
    x[rng.integers(0, n, n // 8)] = x[0]
    x[rng.integers(0, n, n // 20)] = -x[1]
    return [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]


def test_top_k_by_brute_force(spark):
    rows = clustered(1) + odd(1000) + [(100, [0.5] * 16), (100, [0.25] * 16)]
    df = frame(spark, rows).repartition(4)
    got = vectors.exact_top_k(df, F.col("vec_id") % 100 == 0, 10, query_block=3, row_block=64).collect()
    fit = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in fit:
        if i % 100 == 0:
            score = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fit if j != i and len(v) == len(q))
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score[:10])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    few = vectors.exact_top_k(frame(spark, rows[:4]), F.col("vec_id") % 100 == 0, 10).collect()
    assert len(few) == 3
    assert vectors.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_beyond_a_long(spark):
    big = [(0, [1e30, 1.0]), (1, [1e30, -2.0]), (2, [-1e30, 5.0]), (3, [3e9, 7.0]), (4, [2e9, 7.0]), (5, [1.0, 1.0])]
    got = {(r.vec_id): r.score for r in vectors.exact_top_k(frame(spark, big), F.col("vec_id") == 0, 10).collect()}
    whole = lambda v: [max(-vectors.LONG, min(vectors.LONG - 1, math.floor(1024 * float(np.float32(x))))) for x in v]
    q = whole(big[0][1])
    assert got == {i: max(-vectors.LONG, min(vectors.LONG - 1, sum(a * b for a, b in zip(q, whole(v))))) for i, v in big[1:]}


def test_bound_holds():
    rng = np.random.default_rng(2)
    q, r = rng.integers(-900, 900, (20, 30)), rng.integers(-900, 900, (50, 30))
    for s in vectors.LEVELS:
        assert (vectors.segment_stats(q.astype(float), s) @ vectors.segment_stats(r.astype(float), s).T >= q @ r.T - 1e-6).all()


def link_truth(rows, threshold=0.95):
    fit = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (k, _, x) in enumerate(fit):
        for m, _, y in fit[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[k] += 1
                n[m] += 1
                p, q = sorted((find(k), find(m)))
                parent[q] = p
    least = {}
    for k, i, _ in fit:
        least[find(k)] = min(least.get(find(k), i), i)
    own = {k for k, _, _ in fit}
    return sorted(((i if i is not None else -1), n[k], (least[find(k)] if k in own else i) if i is not None else -1) for k, (i, _) in enumerate(rows))


def test_links_by_brute_force(spark):
    rows = clustered(3) + odd(1000) + [(50, [0.5] * 16), (50, [0.5] * 16)]
    got = vectors.near_vectors(frame(spark, rows).repartition(3), 0.95, target=1.0).collect()
    told = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got)
    assert told == link_truth(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(frame(spark, []), 0.95).count() == 0


def test_tiny_and_huge_components(spark):
    """Squares that under- or overflow a double: the cosine counts, and no vector loses its cell."""
    rows = [(0, [1e-200, 1e-200]), (1, [1.0, 0.0]), (2, [1e200, 1e200]), (3, [2e200, 2e200]), (4, [5e-324, 0.0]), (5, [0.0, -1e308]), (6, [-1.7e308, 1.7e308]), (7, [1e-310, 1e-310]), (8, [1e300, 1e-300])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df, 0.95).collect()}
    assert got == {0: (3, 0), 2: (3, 0), 3: (3, 0), 7: (3, 0), 1: (2, 1), 4: (2, 1), 8: (2, 1), 5: (0, 5), 6: (0, 6)}


def test_unit_rounds_nothing_more():
    x = np.random.default_rng(8).normal(size=(200, 64)).astype(np.float32).astype(float)
    assert (vectors.unit(x) == x / np.sqrt((x * x).sum(1))[:, None]).all()


def test_memory_of_the_codebooks():
    """At 8192 centroids (a table of 500 million distinct vectors) the fit holds its rows, its centres and a table of bounded size."""
    x = np.random.default_rng(9).normal(size=(49_152, 8))
    tracemalloc.start()
    c = vectors.centroids(x, 8192, rounds=1)
    grid = vectors.Grid(c, c)
    home = grid.home(np.column_stack([x[:10_000], x[:10_000]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6 and (home // 8192 == vectors.nearest(x[:10_000], c)).all()


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_BLOCK", 16)
    rows = clustered(4, 600)
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame(spark, rows), 0.95).collect()}
    want = {i: n for i, n, _ in link_truth(rows)}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_visits_are_all_cells_within_the_margin():
    rng = np.random.default_rng(5)
    grid = vectors.Grid(rng.normal(size=(70, 4)), rng.normal(size=(9, 4)))
    x = rng.normal(size=(300, 8))
    d = (((x[:, None, :4] - grid.books[0]) ** 2).sum(2)[:, :, None] + ((x[:, None, 4:] - grid.books[1]) ** 2).sum(2)[:, None, :]).reshape(300, -1)
    home = grid.home(x)
    assert (home == d.argmin(1)).all()
    for margin in (0.0, 0.5, 3.0):
        owner, cell = grid.visits(x, home, margin)
        assert sorted(zip(owner.tolist(), cell.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(d - d.min(1, keepdims=True) <= margin))))


def grouped(rng, groups, size, noise, dims=64):
    """Unit vectors in groups; two of a group have a cosine of about 1 / (1 + noise**2)."""
    x = np.repeat(rng.normal(size=(groups, dims)), size, 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x + rng.normal(size=x.shape) * np.repeat(rng.uniform(*noise, groups), size)[:, None] / math.sqrt(dims)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_recall_of_large_and_small_groups(spark):
    """Groups of 2, 4 and 16 near the threshold, tight ones of 200, and vectors on their own: against every pair."""
    rng = np.random.default_rng(6)
    sizes = {2: 700, 4: 400, 16: 80, 200: 8, 1: 1500}
    x = np.concatenate([grouped(rng, n, size, (0.03, 0.1) if size == 200 else (0.14, 0.23)) for size, n in sizes.items()]).astype(np.float32)
    of = np.concatenate([np.full(n * size, size) for size, n in sizes.items()])
    order = rng.permutation(len(x))
    x, of = x[order], of[order]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[a : a + 500] @ u.T >= 0.95).sum(1) - 1 for a in range(0, len(u), 500)])
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]).repartition(4), 0.95).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all()
    for size in sizes:
        own = of == size
        share = found[own].sum() / max(1, want[own].sum())
        print(f"groups of {size}: recall {share:.4f} of {want[own].sum()} links")
        assert not want[own].sum() or share >= 0.95


def test_codebooks_grow_with_the_table(spark, monkeypatch):
    """A sample of at least so many rows for each centroid; 3000 distinct vectors have 16 centroids a half, more than a sample of 40 allows."""
    rng = np.random.default_rng(7)
    seen = []
    fit = vectors.centroids
    monkeypatch.setattr(vectors, "centroids", lambda x, k: seen.append((len(x), k)) or fit(x, k))
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    assert vectors.near_vectors(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), sample=40).count() == 3000
    assert seen and all(k == 16 and 50 < n < 200 for n, k in seen)
