"""Operator 5 against a dictionary of every string."""

import hashlib
import random

import numpy as np
import xxhash

from marlgrid.llm import suffix_dedup

DOCS = "doc_id long, text string, kept string, spans string"


def tie(text):
    return int(np.uint64(xxhash.xxh64_intdigest(text, seed=42)).astype(np.int64))


def brute(rows, length):
    """doc -> (n_bytes, n_removed, n_spans, kept_sha256); rows: (doc_id, text)."""
    docs = sorted({(d if d is not None else suffix_dedup.NULL_DOC, tie((t or "").encode()), (t or "").encode()) for d, t in rows})
    seen, out = set(), {}
    for d, _, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[d, t] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, length, parts=3, **settings):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS).repartition(parts)
    got = suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(df, length, **settings)).collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    expected = sorted((d if d is not None else -1, *want[d if d is not None else suffix_dedup.NULL_DOC, (t or "").encode()]) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected


def test_planted_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(0, 6))]
        t = " ".join(parts)
        if rng.random() < 0.2 and rows:  # a near copy
            base = rng.choice(rows)[1] or ""
            k = rng.randrange(len(base) + 1)
            t = base[:k] + word() + base[k:]
        rows.append((i, t))
    check(spark, rows, 100)


def test_runs_ties_nulls_and_long_texts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("xyz ") for _ in range(30_000))
    rows = [(1, "a" * 500), (2, "ab" * 300), (3, "a" * 99), (4, "a" * 100), (5, None), (6, ""), (None, "ab" * 60), (7, long), (8, long[5000:9000] + "q" + long[100:260]), (9, "é" * 90), (10, "é" * 90 + "x"), (11, long[:4000]), (11, long[:4000]), (12, "one " * 40), (12, "two " * 40), (13, "one " * 40 + "two " * 40)]
    check(spark, rows, 100)
    check(spark, rows, 100, segment=300)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_line_with_many_contexts(spark):
    rng = random.Random(7)
    line = "this very common line of sixty characters stands everywhere."
    rows = [(i, "".join(rng.choice("klmnop") for _ in range(120)) + line + "".join(rng.choice("kl") for _ in range(80))) for i in range(120)]
    rows += [(200 + i, line + line[:50]) for i in range(30)]
    check(spark, rows, 100, parts=5)


def test_small_q_and_other_lengths(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    check(spark, rows, 12)


def test_pointers_against_a_dictionary():
    rng = random.Random(9)
    for _ in range(300):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120)))
        length = rng.randint(1, 40)
        starts = sorted(rng.sample(range(max(1, len(data) - length + 1)), rng.randint(0, max(0, len(data) - length + 1)))) if len(data) >= length else []
        seen, want = set(), []
        for s in starts:
            want.append(data[s : s + length] in seen)
            seen.add(data[s : s + length])
        assert suffix_dedup.later_strings(np.frombuffer(data, np.uint8), np.array(starts, np.int64), length).tolist() == want


def test_many_batches_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH", 2000)  # for the number of groups
    rng = random.Random(11)
    line = "a passage that is more than a hundred bytes long and stands in every second one of these documents, whole or in part"
    rows = [(i, "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 200))) + (line[rng.randint(0, 9) :] if i % 2 else "") + "".join(rng.choice("kl") for _ in range(90))) for i in range(200)]
    rows += [(None, line + str(i % 7)) for i in range(40)]
    check(spark, rows, 100, parts=5, fan_in=2, wide=3)
    check(spark, rows, 100, parts=5, wide=3)


def test_more_parts_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "PARTITIONS", 3)
    rng = random.Random(12)
    line = "a passage that is more than a hundred bytes long and stands in every third one of these documents, whole or in part"
    check(spark, [(i, "".join(rng.choice("klmnop ") for _ in range(rng.randint(0, 300))) + (line if i % 3 else "")) for i in range(120)], 100)
