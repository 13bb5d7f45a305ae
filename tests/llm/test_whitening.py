"""Operator 13 against a dense eigendecomposition."""

import math

import numpy as np

from marlgrid.llm import whitening

ROWS = "vec_id long, embedding array<double>, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], ROWS)


def dense(vectors, components=32):
    """Rows x components, explained, deviations; components whose deviation is nothing are left out."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, total = len(x), x.sum(0)
    dev = n * x - total
    centred = dev.astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    keep = min(components, int((e > 1e-12 * e[0]).sum()))
    return centred @ v[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum(), [sum(int(c) ** 2 for c in r) for r in dev]


def check(got, ids, vectors, components=32, close=1e-7):
    y, explained, dev = dense(vectors, components)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append((r.vec_id, r.deviation, r.whitened, r.explained))
        assert r.n == len(vectors) and r.identity_error <= 1e-6
    assert sorted(by) == list(range(1, y.shape[1] + 1))
    for k, rows in by.items():
        rows.sort()
        order = np.argsort(ids, kind="stable")
        mine, want = np.array([r[2] for r in rows]), y[order, k - 1]
        assert [r[0] for r in rows] == [ids[i] for i in order]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < close
        assert abs(rows[0][3] / explained[k - 1] - 1) < 1e-9
        assert [r[1] for r in rows] == [dev[i] for i in order]


def test_by_a_dense_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 40)) * np.geomspace(5, 0.05, 40) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [float("nan")] * 40), (1003, [float("inf")] + [0.0] * 39), (1004, [None] + [0.0] * 39), (1005, [1.0] * 7)]
    got = whitening.whiten(frame(spark, rows + odd).repartition(5)).collect()
    check(got, [i for i, _ in rows], [v for _, v in rows])


def test_blocks_of_one_row_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(50)]
    rows += [(50 + i, rows[0][1]) for i in range(30)]
    check(whitening.whiten(frame(spark, rows).repartition(7)).collect(), [i for i, _ in rows], [v for _, v in rows])
    twice = rows + [(3, rows[3][1])]
    got = whitening.whiten(frame(spark, twice)).collect()
    assert len(got) == 5 * len(twice) and {r.n for r in got} == {len(twice)}


def test_rank_and_equal_deviations(spark):
    """Fewer rows than dimensions, columns that never vary, and axes of one deviation: the components found span the rows, and no more are given."""
    few = [(i, [float(v) for v in np.eye(6)[i] * 10]) for i in range(4)]
    got = whitening.whiten(frame(spark, few)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(r.identity_error < 1e-9 for r in got)
    cross = [(i, [float(s * v) for v in np.eye(5)[a] * 8]) for i, (a, s) in enumerate((a, s) for a in range(5) for s in (1, -1))]
    got = whitening.whiten(frame(spark, cross)).collect()
    assert {r.component for r in got} == set(range(1, 6)) and all(r.identity_error < 1e-9 and abs(r.explained - 0.2) < 1e-12 for r in got)


def test_nothing_to_whiten(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    null = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (2, [3.0, 1.0])])).collect()
    assert sorted(str(r.vec_id) for r in null) == ["2", "None"]


def test_large_components(spark):
    """Sums and squares beyond a long: the deviation ends at its range, and the whitened values stay right."""
    rows = [(0, [1e15, 0.0]), (1, [-1e15, 3.0]), (2, [2e15, 1.0]), (3, [1e300, -1e300])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert all(r.deviation == whitening.LONG - 1 and math.isfinite(r.whitened) for r in got)
    small = [(i, [float(v), float(v * v % 7)]) for i, v in enumerate(range(-6, 7))]
    check(whitening.whiten(frame(spark, small)).collect(), list(range(13)), [v for _, v in small])
