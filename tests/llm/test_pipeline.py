"""The pipeline's stages one after another, each against a plain version on its own input."""

import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from test_near_dup import truth  # noqa: E402
from test_suffix_dedup import brute  # noqa: E402
from test_text_operators import base_spans  # noqa: E402

from marlgrid.llm.common import table  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string"


def tables(spark, path):
    rng = random.Random(31)
    docs, labels = [], []
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(60))
    for i in range(300):
        w = [f"é{rng.randrange(9999)}" for _ in range(rng.randint(3, 120))]
        bad = rng.random() < 0.2
        if bad:
            w += ["vile", "vile"]
        if rng.random() < 0.2:
            w.insert(0, passage)
        if rng.random() < 0.1:
            w.append("password=hunter2hunter2")
        if docs and rng.random() < 0.2:
            w = docs[rng.randrange(len(docs))][1].split()
            bad = "vile" in w
        docs.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, 1, int(bad)))
    docs += [(900, None, "en", None), (901, "", None, "s"), (901, "", None, "s")]
    rows = [(i, t, lang, s, None if t is None else len(t), "a", "b") for i, t, lang, s in docs]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = table(stage(spark, docs, path), f"test-{name}")
        seen[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
    before, after = seen["toxicity"]
    assert sorted(str(r[:5]) for r in after) == sorted(str(r[:5]) for r in before if "vile" not in (r.text or ""))
    before, after = seen["near_dedup"]
    classes = truth([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if classes[r.doc_id] == r.doc_id)
    before, after = seen["suffix_dedup"]
    want = brute([(r.doc_id, r.text) for r in before], 100)
    lost = {k[0]: v[1] for k, v in want.items()}
    assert len(after) == len(before) and any(lost.values())
    for r in after:
        old = next(x for x in before if x.doc_id == r.doc_id)
        if not lost[r.doc_id]:
            assert r.text == old.text
        else:
            assert len(r.text.encode()) in range(len(old.text.encode()) - lost[r.doc_id] - 6, len(old.text.encode()) - lost[r.doc_id] + 1) and r.n_chars == len(r.text)
    before, after = seen["secrets"]
    assert len(after) == len(before)
    assert any("[assign]" in (r.text or "") for r in after) and not any(base_spans(re.sub(r"\[(assign|access|hex)\]", " ", r.text or "")) for r in after)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}


def test_empty_table_and_null_ids(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("none", []), ("nulls", [(None, "some words of a text", None, None, None, "a", "b")] * 2 + [(None, None, None, None, None, "a", "b"), (3, "", None, None, 0, "a", "b")])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
        labels.write.parquet(f"{path}/labels.parquet")
        got = pipeline.run(spark, path).collect()
        # rows without an id have no copies to be told by, so each stays and is packed
        assert len(got) == len(rows) and sum(r.length for r in got) == sum(r.doc_tokens for r in got)


def test_secrets_of_repeated_rows_and_null_ids(spark, tmp_path):
    """Rows with one id and text, and rows without an id, that hold secrets: each is cleaned, whatever stands beside it."""
    text = "some words password=abcdefgh12345 more words token: 12345678abc then " + "0f" * 16 + " and then the end of it"
    other = "quite another text with secret=zzzzzzzz9999 in it"
    docs = [(1, text), (1, text), (None, text), (None, text), (2, other), (2, other), (3, "clean"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stage = dict(pipeline.STAGES)["secrets"]
    got = stage(spark, df, str(tmp_path)).collect()
    clean = "some words [assign] more words [assign] then [hex] and then the end of it"
    assert sorted(str(r.text) for r in got) == sorted(["clean", "None", *[clean] * 4, *["quite another text with [assign] in it"] * 2])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
