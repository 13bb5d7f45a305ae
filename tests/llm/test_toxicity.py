"""Operator 8: held-out accuracy on planted words, and odd input."""

import random

import numpy as np

from marlgrid.llm import toxicity

DOCS = "doc_id long, text string, p_toxic string, extra array<int>"


def planted(rng, n, first=0):
    """Neutral words, and in some texts one of a few bad words or of a bad stem's forms."""
    docs, labels = [], []
    for i in range(first, first + n):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        low, bad = rng.random() < 0.2, rng.random() < 0.2
        if low:
            w[rng.randrange(len(w))] = "junk"
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Vile!", "awful", f"grimm{rng.randrange(50)}"])
        docs.append((i, " ".join(w), "clash", [1]))
        labels.append((i, int(not low), int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    rng = random.Random(21)
    docs, labels = planted(rng, 1500)
    more, truth = planted(rng, 500, 10_000)
    odd = [(20_000, None, "x", None), (20_001, "", "x", None), (20_002, "neutral " * 50_000 + "vile", "x", None), (20_003, "vile", "x", None), (20_003, "vile", "x", None), (None, "w1", "x", None)]
    df = spark.createDataFrame([*docs, *more, *odd], DOCS).repartition(3)
    lab = spark.createDataFrame([*labels, (1, None, None), labels[0]], "doc_id long, quality int, toxic int")
    got = toxicity.judged(df, lab).collect()
    assert len(got) == len(docs) + len(more) + len(odd)
    said = {r.doc_id: r for r in got}
    right = np.mean([said[i].toxic == (t == 1) for i, _, t in truth])
    low = np.mean([(said[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in truth])
    assert right >= 0.98 and low >= 0.98
    assert said[20_002].toxic and said[20_003].toxic
    assert not said[20_000].toxic and not said[20_001].toxic and not said[None].toxic
    assert said[5].extra == [1]


def test_fit_in_two_passes_is_the_fit_on_all_features(spark):
    """Counts and bits give the chain that all feature numbers give; very long labelled texts, repeated ids with other texts, null texts."""
    rng = random.Random(22)
    docs, labels = planted(rng, 400)
    docs += [(9000, "neutral words " * 150_000 + "vile", "x", None), (9001, None, "x", None)] + [(9002, t, "x", None) for t in ("zz vile", "aa text", "aa text")] * 3
    labels += [(9000, 1, 1), (9001, 0, 0), (9002, 1, 0), (9002, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, DOCS).repartition(4)
    chain = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.label_categories())
    own = {i: (t or "") for i, t, *_ in docs} | {9002: "aa text"}
    y = {i: [1 - q, int(t == 1 and q == 0), t] for i, q, t in labels if i is not None} | {9002: [0, 0, 1]}
    ids = sorted(y)
    present = [p for part in toxicity._present([own[i] for i in ids]) for p in part]
    want = toxicity.train(present, np.array([y[i] for i in ids]), tuple(toxicity.label_categories()))
    assert chain.n_columns == want.n_columns and (chain.columns == want.columns).all() and chain.thresholds == want.thresholds
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(chain.weights, want.weights))


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", None)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not toxicity.judged(docs, none).first().toxic
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs.limit(0), one).count() == 0


def test_later_links_see_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    present = [np.unique(rng.integers(0, 50, 20)) for _ in range(400)]
    y = np.array([[3 in p, (3 in p) and (4 in p)] for p in present], int)
    chain = toxicity.train(present, y, ("a", "b"), most=30)
    assert [len(w) for w in chain.weights] == [chain.n_columns + 1, chain.n_columns + 2]


def test_scores_by_brute_force(spark):
    """Every probability of the chain against sets of words and prefixes, and sums over them, in plain Python."""
    import math

    rng = random.Random(5)
    docs, labels = planted(rng, 600)
    chain = toxicity.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxicity.label_categories())
    texts = [t for _, t, _, _ in planted(rng, 60, 5000)[0]] + ["", "Vile vile grimm7 grimmer", "ab\tAWFUL junk. " * 50]
    number: dict[str, int] = {}

    def columns(text):
        found = set()
        for word in text.lower().replace("!", " ").replace(".", " ").split():
            for part in {word, *(word[:k] for k in toxicity.PREFIXES if len(word) > k)}:
                # a prefix of so many letters and a word of that length are features of their own
                key = part if part == word else part + "*"
                if key not in number:
                    whole, prefixes = toxicity.features([part if part == word else part + "x"])[1], {}
                    names = [part if part == word else None, *[(part if part == word else part + "x")[:k] for k in toxicity.PREFIXES if len(part if part == word else part + "x") > k]]
                    prefixes = dict(zip(names, whole.tolist()))
                    number[key] = prefixes[part]
                found.add(number[key])
        return {int(chain.columns[f]) for f in found if chain.columns[f] >= 0}

    got = chain.predict(texts)
    for i, text in enumerate(texts):
        own, before = columns(text), []
        for w in chain.weights:
            total = w[0] + sum(w[1 + c] for c in own) + sum(w[1 + chain.n_columns + k] * p for k, p in enumerate(before))
            before.append(1 / (1 + math.exp(-max(-30, min(30, total)))))
        assert np.allclose(got[i], before, atol=1e-9), text
