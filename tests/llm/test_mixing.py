"""Operator 12 against queues that are served one document at a time."""

import hashlib
import re
from fractions import Fraction

import pytest

from marlgrid.llm import mixing
from marlgrid.llm.mixing import F

ROWS = "doc_id long, text string, source string, size string, place long, taken string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7, "y") for i, t, s in rows], ROWS)


def filled(sizes, weights=(1, 2, 3), most=3, budget=None):
    """source: target, by giving each its share again and again until none is over its cap."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values()) if budget is None else budget), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def brute(rows, most=3, budget=None):
    """(doc_id, size, source_size, taken) of each row."""
    docs = []
    for i, t, s in rows:
        key = hashlib.md5(f"mix-1:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        docs.append([s, key, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), i])
    sizes = {}
    for s, _, n, _ in docs:
        sizes[s] = sizes.get(s, 0) + n
    out = []
    for s, target in filled(sizes, most=most, budget=budget).items():
        own = sorted((d for d in docs if d[0] == s), key=lambda d: d[1])
        left, taken = int(target), [0] * len(own)
        for _ in range(most):
            for k, d in enumerate(own):
                n = min(left, d[2])
                taken[k] += n
                left -= n
        out += [(d[3], d[2], sizes[s], float(target), n) for d, n in zip(own, taken)]
    return out


def told(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix_digests(df).collect()), key=str)


def plain(rows, **more):
    return sorted(((i, n, s, round(t, 6), k) for i, n, s, t, k in brute(rows, **more)), key=str)


WORD = "w \t x y\n"


def cases():
    rows = [(i, WORD * (i % 7 + 1), f"s{i % 4}") for i in range(120)]
    rows += [(200 + i, "one", "tiny") for i in range(2)] + [(300, "long " * 40_000, "z")] + [(301, None, "z"), (302, "", None), (303, "a b c", None), (None, "q r", "s1"), (None, "q r", "s1"), (5, "q r", "")]
    rows += [(400, "twice told tale", "s2")] * 40 + [(500, "", "none"), (501, None, "none")] + [(600 + i, "big source here", "\U0001f600") for i in range(100)] + [(700, "x", "￮")]
    return rows


def test_by_brute_force(spark):
    rows = cases()
    got = mixing.mix(frame(spark, rows).repartition(5))
    assert told(got) == plain(rows)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(2))
    assert told(again) == plain(rows)


def test_sources_come_near_their_targets_and_the_mix_is_in_order(spark):
    rows = cases()
    items = [r for r in mixing.mix(frame(spark, rows)).collect() if r.taken]
    by = {}
    for r in items:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(0 <= target - n < 1 for target, n in by.values())
    order = sorted(items, key=lambda r: r["at"])
    at = 0
    for a, b in zip(order, order[1:]):
        assert a["at"] == at and a.finish <= b.finish
        at += a.taken
    assert all(r.taken <= r["size"] and r["pass"] < 3 for r in items)


@pytest.mark.parametrize("budget", [0, 1, 17, 10**7])
def test_other_budgets(spark, budget):
    rows = cases()[:60] + [(900, "a b c d", "zz")]
    assert told(mixing.mix(frame(spark, rows), budget=budget)) == plain(rows, budget=budget)


def test_texts_of_the_mix(spark):
    rows = [(1, "a b  c", "x"), (2, "d", "x"), (3, "e f", "y"), (3, "e f", "y"), (None, "g", "y")]
    items = mixing.mix(frame(spark, rows)).cache()
    texts = mixing.mixed_texts(frame(spark, rows), items).orderBy("at").collect()
    assert sum(len(r.text.split()) for r in texts) == sum(r.taken for r in items.collect())
    assert [r["at"] for r in texts] == [0, *[sum(len(t.text.split()) for t in texts[:k]) for k in range(1, len(texts))]]
    assert {r.text for r in texts if r.doc_id == 3} <= {"e f", "e"}


def test_empty(spark):
    assert mixing.mix_digests(mixing.mix(frame(spark, []))).count() == 0
    only = mixing.mix_digests(mixing.mix(frame(spark, [(1, None, None), (2, " ", "s")]))).collect()
    assert [(r.taken, r.target) for r in only] == [(0, 0.0)] * 2


def test_no_python_on_the_path(spark):
    plan = mixing.mix_digests(mixing.mix(frame(spark, cases())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_hot_source_is_dealt_over_all_ranges(spark):
    rows = [(i, "a b", "hot") for i in range(2000)] + [(None, "same words", "hot")] * 2000
    df = mixing.running(frame(spark, rows).select("doc_id", "source", F.lit(2).cast("long").alias("n")).withColumn("row", F.monotonically_increasing_id()), ["source", "doc_id", "row"], ["n"], "t")
    assert {r.before_n - 2 * (r.position - 1) for r in df.collect()} == {0}
