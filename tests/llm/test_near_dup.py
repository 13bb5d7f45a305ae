"""Operator 2 against all pairs."""

import random

import numpy as np

from marlgrid.llm import near_dup
from marlgrid.llm.common import connected_components

DOCS = "doc_id long, text string, kept string, component_id string"


def shingles(text):
    w = near_dup.normal(text or "").split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


def truth(rows, threshold=0.8):
    ids = [d for d, t in rows if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sh = [(d, shingles(t)) for d, t in rows if d is not None]
    for i, (d, a) in enumerate(sh):
        for e, b in sh[:i]:
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                n = lcs(a, b)
                if n / (len(a) + len(b) - n) >= threshold:
                    x, y = sorted((find(d), find(e)))
                    parent[y] = x
    return {d: find(d) for d in ids}


def documents(rng, n=60):
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8)))
    passage = [word() for _ in range(15)]
    rows = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randint(0, 2)] = [word()] * rng.randint(0, 2)
        else:
            w = [word() for _ in range(rng.randint(1, 120))]
            if kind > 0.7:
                w[len(w) // 2 : 0] = passage
        rows.append((len(rows), " ".join(w)))
    return rows


def test_classes_by_all_pairs(spark):
    rows = documents(random.Random(11))
    rows += [(1000, None), (1001, ""), (1002, " .,! "), (1003, "two words"), (1004, "Two, words!"), (1005, "one " * 900), (1006, "one " * 900), (1006, "one " * 900)]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in [*rows, (None, "nameless text"), (None, None)]], DOCS).repartition(3)
    got = near_dup.near_duplicates(df).collect()
    want = truth(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert len(got) == len(want) + 2 and all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert all(r.group_size == sum(c == r.component_id for c in want.values()) for r in got if r.doc_id is not None)
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(300):
        w = base[:]
        w[rng.randrange(200)] = f"e{i}"
        rows.append((i, " ".join(w), "", ""))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_banded_alignment():
    rng = random.Random(13)
    for _ in range(300):
        a = np.array([rng.randrange(6) for _ in range(rng.randint(1, 40))], np.uint32)
        b = np.array([x for x in a.tolist() if rng.random() > 0.15] + [rng.randrange(6) for _ in range(rng.randint(0, 4))], np.uint32)
        n = lcs(a.tolist(), b.tolist())
        assert near_dup.aligned(a, b, 60) == n
        s = n / (len(a) + len(b) - n)
        got = near_dup.similarity(a, b, 0.8)
        assert (got >= 0.8) == (s >= 0.8) and (s < 0.8 or abs(got - s) < 1e-12)


def test_components(spark):
    rng = random.Random(14)
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in linked}


def test_scripts_without_spaces(spark):
    """One letter of 3000 changed in Chinese, Japanese and Thai texts; unrelated texts of the same letters stay apart."""
    rng = random.Random(17)
    rows, n = [], 0
    for first, last in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x0E01, 0x0E2E)):
        letters = [chr(c) for c in range(first, last)]
        for size in (12, 300, 3000):
            text = "".join(rng.choices(letters, k=size))
            at = size // 2
            rows += [(n, text), (n + 1, text[:at] + rng.choice(letters) + text[at + 1 :] if size > 100 else text), (n + 2, "".join(rng.choices(letters, k=size)))]
            n += 3
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)).collect()}
    assert got == {i: i - 1 if i % 3 == 1 else i for i, _ in rows}
    assert near_dup.normal("Ein 東京 x　タกิ") == "ein 東 京 x タ ก"
