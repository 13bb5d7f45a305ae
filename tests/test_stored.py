"""Stores of parts, keyed tables, snapshots, indexes, ledgers, the catalog source, PageRank's layout and the cycle check."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlgrid.functions import text
from marlgrid.operators import claims, embedding, graph, lexical_index, parts, retrieval, vector_index
from marlgrid.operators.parts import Store
from marlgrid.plans import contracts
from marlgrid.sources import catalog


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def files_of(store, name):
    return {p: sorted((f, os.path.getmtime(f"{d}/{f}")) for f in os.listdir(d) if f.endswith(".parquet")) for p, d in store.parts(name).items()}


# --- keyed tables -----------------------------------------------------------------------------------------------------


def test_binary_search_of_ranges(spark):
    for bounds in ([], [3], [3, 7], [1, 2, 3, 5, 8, 13, 21]):
        df = spark.createDataFrame([(None,)] + [(i,) for i in range(-2, 25)], "k int")
        for r in df.select("k", parts.range_of(F.col("k"), bounds).alias("r")).collect():
            assert r.r == (0 if r.k is None else sum(b <= r.k for b in bounds))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_merge_touches_its_ranges_only(spark, tmp_path, kind):
    key = (lambda i: i) if kind == "long" else (lambda i: f"k{i:05}")
    base = {key(i): f"v{i}" for i in range(3000)}
    df = spark.createDataFrame(list(base.items()), f"k {kind}, v string")
    store = parts.create_keyed(Store(spark, str(tmp_path / "s")), "t", df, ["k"], ranges=12)
    assert len(store.parts("t")) == 12 and rows(store.read("t"), "k", "v") == sorted(base.items(), key=repr)
    before = files_of(store, "t")
    new = {key(i): "new" for i in range(700, 720)} | {key(2_000_000): "last"}
    bounds = parts.keyed_bounds(store, "t")
    touched = {str(sum(b <= k for b in bounds)) for k in [*new, key(705)]}
    merged = parts.merge_keyed(store, "t", spark.createDataFrame(list(new.items()), f"k {kind}, v string"), ["k"], drop=spark.createDataFrame([(key(800),)], f"k {kind}"))
    touched.add(str(sum(b <= key(800) for b in bounds)))
    want = {k: v for k, v in (base | new).items() if k != key(800)}
    assert rows(merged.read("t"), "k", "v") == sorted(want.items(), key=repr)
    after = files_of(merged, "t")
    assert len(touched) < 5 and all(after[p] == before[p] for p in before if p not in touched)
    # the version before is whole
    assert rows(Store(spark, store.root, 2 if store.version == 2 else store.version).read("t"), "k", "v") == sorted(base.items(), key=repr)


def test_merge_of_repeated_and_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k long, v string")
    store = parts.create_keyed(Store(spark, str(tmp_path / "s")), "t", df, ["k"], ranges=2)
    new = spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string")
    assert rows(parts.merge_keyed(store, "t", new, ["k"], [F.desc("v")]).read("t"), "k", "v") == [(1, "y"), (2, "c"), (None, "n")]
    store = Store(spark, store.root)
    assert rows(parts.merge_keyed(store, "t", new.limit(0), ["k"]).read("t"), "k", "v") == [(1, "y"), (2, "c"), (None, "n")]
    gone = parts.merge_keyed(Store(spark, store.root), "t", new.limit(0), ["k"], drop=df.select("k").where("k is not null"))
    assert rows(gone.read("t"), "k", "v") == [(None, "n")]
    empty = parts.create_keyed(Store(spark, str(tmp_path / "e")), "t", df.limit(0), ["k"])
    assert empty.read("t").count() == 0 and rows(parts.merge_keyed(empty, "t", new, ["k"]).read("t"), "v") == [("x",), ("y",)]


def test_two_writers_and_a_crash(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1, "a")], "v int, part string")
    first, second = Store(spark, root), Store(spark, root)
    first = first.commit({"t": first.stage(one, "part")})
    with pytest.raises(Exception, match="already exist"):
        second.commit({"t": second.stage(one, "part")})
    # a writer that died after staging leaves folders that no version names
    first.stage(one.withColumn("v", F.lit(9)), "part")
    os.makedirs(f"{root}/_manifest/next-dead")
    assert rows(Store(spark, root).read("t"), "v") == [(1,)] and Store(spark, root).version == 1
    assert first.vacuum() == 2 and rows(Store(spark, root).read("t"), "v") == [(1,)]


def test_a_snapshot_appears_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "s")
    a = spark.createDataFrame([(1, "s1"), (2, "s2")], "v int, snapshot_id string")
    store, errors = parts.persist_whole({"x": a, "y": a}, root, spark)
    assert errors == {"x": None, "y": None}
    bad = a.withColumn("v", F.when(F.col("v") > 1, F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("v") + 10))
    again, errors = parts.persist_whole({"x": a.withColumn("v", F.col("v") + 10), "z": bad, "y": a.limit(0)}, root, spark)
    assert again.version == store.version and errors["x"] is None and "broken row" in errors["z"]
    assert rows(Store(spark, root).read("x"), "v") == [(1,), (2,)] and Store(spark, root).names() == ["x", "y"]
    new = spark.createDataFrame([(7, "s2"), (8, "s 3/%")], "v int, snapshot_id string")
    store, _ = parts.persist_whole({"x": new}, root, spark)
    assert rows(store.read("x"), "v") == [(1,), (7,), (8,)] and rows(parts.snapshot_rows(store, "x", "s 3/%"), "v", "snapshot_id") == [(8, "s 3/%")]
    assert rows(parts.snapshot_rows(store, "y", "s2"), "v") == [(2,)] and parts.snapshot_rows(store, "y", "none").count() == 0


# --- indexes ----------------------------------------------------------------------------------------------------------


def vectors(spark, n=3000, dims=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, dims))[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, dims))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


def brute(x, q, k, ids=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ (q / np.linalg.norm(q))
    ids = np.arange(len(x)) if ids is None else ids
    return [int(ids[i]) for i in np.lexsort([ids, -s])[:k]]


def test_vector_index_reads_some_cells_and_upserts_rewrite_theirs(spark, tmp_path):
    x, df = vectors(spark)
    odd = spark.createDataFrame([(9001, None), (9002, [0.0] * 24), (9003, [1.0] * 3), (9004, [float("nan")] * 24), (9005, [float("inf")] * 24)], df.schema)
    store = vector_index.build(Store(spark, str(tmp_path / "s")), "v", df.unionByName(odd))
    n_cells, asked = len(store.parts("v")), list(range(0, 3000, 150))
    hits = 0
    for q in asked:
        assert len(vector_index.nearest_cells(store, "v", x[q].tolist())) < n_cells / 3
        got = [r.vec_id for r in vector_index.search(store, "v", x[q].tolist(), 20).collect()]
        hits += len(set(got) & set(brute(x, x[q], 20)))
    assert hits >= 0.9 * 20 * len(asked)
    for q in asked[:3]:
        assert [r.vec_id for r in vector_index.search(store, "v", x[q].tolist(), 20, exact=True).collect()] == brute(x, x[q], 20)
    before = files_of(store, "v")
    new = spark.createDataFrame([(5, x[2000].tolist()), (5000, x[2000].tolist()), (77, None)], df.schema)
    after = vector_index.upsert(store, "v", new)
    changed = {p for p in files_of(after, "v") if files_of(after, "v")[p] != before.get(p)}
    assert 1 <= len(changed) <= 3
    y = np.concatenate([x, x[2000:2001]])
    y[5], ids = x[2000], np.append(np.arange(3000), 5000)
    keep = ids != 77
    assert [r.vec_id for r in vector_index.search(after, "v", x[2000].tolist(), 5, exact=True).collect()] == brute(y[keep], x[2000], 5, ids[keep])
    assert after.read("v").count() == 3000 and after.read("v").where("vec_id in (5, 77)").count() == 1
    # the ids know their cells
    assert rows(after.read("v.ids").join(after.read("v"), ["vec_id", "cell"]).groupBy().count(), "count") == [(3000,)]


WORDS = [f"w{i}" for i in range(60)]


def claim_rows(seed, n=800):
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=k))
    out = [(f"c{i}", f"s{i % 50}", "P", pick(rng.randint(0, 25)), None if i % 3 else pick(2), i) for i in range(n)]
    return out + [(f"d{i}", "s1", "P", "same words here", None, n + i) for i in range(90)]


CLAIMS = "claim_id string, subject string, predicate string, value_json string, metadata_json string, ordinal long"


def test_inverted_index_equals_the_scan(spark, tmp_path):
    df = spark.createDataFrame(claim_rows(3), CLAIMS).repartition(5)
    index = lexical_index.build_index(df, str(tmp_path / "i"))
    rng = random.Random(4)
    assert sorted((r.ordinal, r.score) for r in lexical_index.lexical_indexed("w3 w9 w50", index, None).collect()) == sorted((r.ordinal, r.score) for r in retrieval.lexical("w3 w9 w50", df, None).collect())
    queries = ["", "nothing known", "w0", "same words here unknown1 unknown2", "w59 w58"] + [" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) for _ in range(3)]
    for q in queries:
        for most in (5, 50) if q else (5, 5000, None):
            want = [(r.ordinal, r.score) for r in retrieval.lexical(q, df, most).collect()]
            got = [(r.ordinal, r.score) for r in lexical_index.lexical_indexed(q, index, most).select("ordinal", "score").collect()]
            assert (sorted(got) == sorted(want)) if most is None else got == want, (q, most)
    plan = lexical_index.ranked(index, "w59 w3", None)._jdf.queryExecution().executedPlan().toString()
    assert "In(token, [w3,w59])" in plan or "In(token, [w59,w3])" in plan


def test_common_tokens_make_no_candidates(spark, tmp_path):
    """Three rare tokens and a common one: with a floor from the rare ones, the common one's postings are only counted towards their claims."""
    df = spark.createDataFrame([(f"c{i}", "s", "p", "common" + (" r1 r2 r3" if i % 100 == 0 else f" x{i} y{i}"), None, i) for i in range(2000)], CLAIMS)
    index = lexical_index.build_index(df, str(tmp_path / "i"))
    found = lexical_index.ranked(index, "common r1 r2 r3", 10)
    assert [r.ordinal for r in found.collect()] == [100 * i for i in range(10)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "common" not in plan.split("LeftSemi")[0]


# --- graphs -----------------------------------------------------------------------------------------------------------


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def test_no_exchange_over_edges(spark):
    """The links lie bucketed and sorted: between their scan and the join there is neither an exchange nor a sort, in any round."""
    edges = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 97).alias("src"), F.concat(F.lit("n"), F.col("id") % 89).alias("dst"))
    links, out = graph.laid_out(edges)
    scores = parts_of = out.select(F.col("src").alias("node"), F.lit(0.01).alias("score"), "parts")
    with graph.in_bucket_order(spark):
        plan = graph.spread(scores, links)._jdf.queryExecution().executedPlan()
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    join = next(n for n in nodes(plan) if "Join" in n.nodeName())
    sides = [join.children().apply(i) for i in (0, 1)]
    with_links = [s for s in sides if any("Bucketed: true" in n.toString().split("\n")[0] for n in nodes(s))]
    assert len(with_links) == 1 and not any("Exchange" in n.nodeName() or n.nodeName() == "Sort" for n in nodes(with_links[0]))
    assert parts_of.count() == 97


@pytest.mark.parametrize("part", [1 << 16, 3])
def test_ranks_by_plain_power_iteration(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)
    rng = random.Random(5)
    e = [(f"n{rng.randrange(30)}", f"n{rng.randrange(40)}") for _ in range(150)] + [("hub", f"n{i}") for i in range(40)] + [("n1", "n2")] * 5
    names = sorted({n for p in e for n in p})
    out = {n: [d for s, d in e if s == n] for n in names}
    mass, s = {"hub": 0.7, "n3": 0.3}, {n: 1 / len(names) for n in names}
    for _ in range(6):
        lost = sum(s[n] for n in names if not out[n])
        s = {n: 0.85 * (sum(s[m] * out[m].count(n) / len(out[m]) for m in names if out[m]) + lost / len(names)) + 0.15 * mass.get(n, 0) for n in names}
    got = graph.ppr(spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame(list(mass.items()), "node string, mass double"), rounds=6, fixed=True)
    assert {r.node: pytest.approx(r.score, abs=1e-12) for r in got.collect()} == s


@pytest.mark.parametrize("looped, layers", [(False, 8), (True, 2)])
def test_rounds_move_only_nodes_with_links(spark, monkeypatch, looped, layers):
    """A tree of few steps and many leaves, with and without a loop: the plain iteration's scores after any rounds, from few tables, none of which but the last step's holds a leaf."""
    monkeypatch.setattr(graph, "LAYERS", layers)
    e = [("root", f"a{i}") for i in range(3)] + [(f"a{i}", f"b{i}{j}") for i in range(3) for j in range(4)] + [(f"b{i}{j}", f"leaf{i}{j}{k}") for i in range(3) for j in range(4) for k in range(6)]
    e += [("a1", "root"), ("b00", "a2"), ("b00", "b01"), ("b00", "a0")] if looped else []
    names = sorted({n for p in e for n in p} | {"alone"})
    out, mass = {n: [d for s, d in e if s == n] for n in names}, {"root": 0.5, "b01": 0.3, "alone": 0.2}
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(cut(df)) or made[-1])
    df, p = spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame(list(mass.items()), "node string, mass double")
    s = {n: 1 / len(names) for n in names}
    for t in range(1, 101):
        lost = sum(s[n] for n in names if not out[n])
        new = {n: 0.85 * (sum(s[m] * out[m].count(n) / len(out[m]) for m in names if out[m]) + lost / len(names)) + 0.15 * mass.get(n, 0) for n in names}
        moved, s = sum(abs(new[n] - s[n]) for n in names), new
        if t in (1, 4):
            assert {r.node: pytest.approx(r.score, abs=1e-12) for r in graph.ppr(df, p, rounds=t, fixed=True).collect()} == s
        if moved < 1e-2:
            break
    made.clear()
    assert {r.node: pytest.approx(r.score, abs=1e-2) for r in graph.ppr(df, p, tolerance=1e-2).collect()} == s
    if not looped:
        assert len(made) <= 11
    assert not any("node" in m.columns and m.where("node like 'leaf%'").count() for m in made)


def test_a_search_reads_its_claims_once(spark):
    from marlgrid.operators import retrieval

    read = spark.sparkContext.accumulator(0)
    said = F.udf(lambda v: read.add(1) or v, "string").asNondeterministic()
    claims = spark.createDataFrame([(str(i), f"n{i}", "CONTENT", f"w{i % 5}", None, i) for i in range(20)], "claim_id string, subject string, predicate string, value_json string, metadata_json string, ordinal long").withColumn("value_json", said("value_json"))
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "p", i) for i in range(30)], "src string, dst string, predicate string, ordinal long")
    assert retrieval.search("w1", claims, edges).count() > 4 and read.value <= 40
    read.value = 0
    assert retrieval.dual_search("w1", claims, claims, edges).count() == 4 and read.value <= 80


def test_cycles(spark, monkeypatch):
    def cyclic(e):
        left = set(e)
        while left:
            led = {d for _, d in left}
            keep = {(s, d) for s, d in left if s in led}
            if len(keep) == len(left):
                return True
            left = keep
        return False

    rng = random.Random(6)
    for n in (5, 25):
        for m in (n // 2, 2 * n):
            e = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
            dag = [(a, b) for a, b in e if a < b]
            for g in (e, dag):
                assert graph.has_cycle(spark.createDataFrame(g, "src long, dst long")) == cyclic(g), g
    none = spark.createDataFrame([(None, 1), (1, None), (1, 2)], "src long, dst long")
    assert not graph.has_cycle(none) and not graph.has_cycle(none.limit(0))
    assert graph.has_cycle(spark.createDataFrame([(4, 4)], "src long, dst long"))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, steps = 100_000, []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: steps.append(1) or cut(df))
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert not graph.has_cycle(chain) and len(steps) <= 40
    steps.clear()
    assert graph.has_cycle(chain.unionByName(spark.createDataFrame([(n, 3)], "src long, dst long"))) and len(steps) <= 40


def test_leaves_need_no_pointers(spark, monkeypatch, tmp_path):
    """A wide tree is settled by its few inner edges; an index takes its texts apart once."""
    from marlgrid.operators import lexical_index

    held, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: held.append(cut(df)) or held[-1])
    tree = spark.range(1, 1000).select(F.floor(F.col("id") / 100).alias("src"), F.col("id").alias("dst")).where("src != dst")
    assert not graph.has_cycle(tree)
    assert max(t.count() for t in held[1:]) < 20
    kept, own = [], lexical_index.cut
    monkeypatch.setattr(lexical_index, "cut", lambda df: kept.append(own(df)) or kept[-1])
    claims = spark.createDataFrame([("a", "CONTENT", "x y", None, 1), ("b", "CONTENT", "y z", None, 2)], "subject string, predicate string, value_json string, metadata_json string, ordinal long")
    index = lexical_index.build_index(claims, str(tmp_path / "index"))
    assert len(kept) == 1 and kept[0].count() == index.table("postings").count() == 8


# --- texts, signatures, statements ------------------------------------------------------------------------------------


def test_chunks_grow_with_the_text(spark, tmp_path):
    import time

    took = {}
    for n in (80_000, 160_000):
        path = str(tmp_path / str(n))
        spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("t")).write.parquet(path)
        df = spark.read.parquet(path).select(F.explode(text.fixed_chunks("t")).alias("c"))
        df.write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        for _ in range(3):
            df.write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - began
    assert took[160_000] < 3 * took[80_000]


def test_windows_go_on_with_any_overlap():
    """An overlap of nearly a window: each window begins after the last, and the last one reaches the end."""
    from marlgrid.functions.html import heading_chunks

    text_ = "\n\n".join(" ".join(f"w{i}" for i in range(a, a + 3)) for a in range(0, 60, 3))
    for target, overlap in ((40, 39), (20, 19), (2, 1), (30, 5)):
        got = heading_chunks(text_, [(1, None, "w30")], target, overlap)
        begins = [c[0] for c in got]
        assert begins == sorted(set(begins)) and got[-1][1].endswith("w59") and all((c[3] == ["w30"]) == (c[0] >= 30) for c in got)


def test_a_signature_of_many_rows(spark):
    n = 1_200_000
    df = spark.range(n).select("id", F.col("id").cast("string").alias("h"))
    want = hashlib.sha256("".join(map(str, range(n))).encode()).hexdigest()
    assert claims.ordered_signature(df.repartition(7), "id", "h").first().signature == want


@pytest.mark.parametrize(
    "said, found",
    [
        ("select 1 as drop, `delete` from t -- drop table x", []), ("with a as (select 1 as truncate) select truncate from a", []), ("select * from {orders} where note = 'delete; drop'", []), ("values (1)", []), ("", []),
        ("delete from t", ["DELETE"]), ("drop view if exists v", ["DROP"]), ("alter table t drop partition (a = 1)", ["DROP"]), ("truncate table t", ["TRUNCATE"]), ("from t insert into u select *", ["INSERT"]),
        ("merge into t using s on t.a = s.a when matched then delete", ["MERGE"]), ("update t set a = 1", ["UPDATE"]), ("create table t as select 1", ["CREATE"]), ("select 1; drop table t", ["DROP"]), ("begin drop table t; end", ["syntax"]),
        ("with d as (select 1) delete from t", ["DELETE"]), ("execute immediate 'drop table t'", ["EXECUTE"]), ("selekt 1", ["syntax"]), ("cache table t", ["CACHE"]),
    ],
)
def test_statements_are_judged_as_parsed(spark, said, found):
    got = contracts.sql_findings(said, spark)
    assert got == found or (said.startswith("begin") and got)


# --- ledger and catalog -----------------------------------------------------------------------------------------------


def test_a_task_or_run_that_starts_again_calls_for_no_finished_batch(spark, tmp_path):
    calls, tripped = str(tmp_path / "calls"), str(tmp_path / "tripped")
    os.makedirs(calls)

    def call(texts):
        import os
        import uuid

        if any("odd" in t for t in texts):
            raise RuntimeError("no")
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    class Failing(embedding.BatchLedger):
        """Ends the task once, after a batch is in the ledger."""

        def put(self, *a):
            super().put(*a)
            if not os.path.exists(tripped):
                open(tripped, "w").close()
                raise OSError("the worker is gone")

    r = spark.createDataFrame([(i, f"h{i}", f"text {i}") for i in range(40)], "request_id long, content_hash string, text string")
    none = spark.createDataFrame([], "content_hash string, embedding array<double>")
    book = str(tmp_path / "ledger")
    items = r.groupBy(F.floor(F.col("request_id") / 8).alias("batch_no")).agg(F.sort_array(F.collect_list(F.struct(F.col("request_id").alias("position"), "content_hash", "text"))).alias("items")).select("items").coalesce(1)
    run = embedding._embedded(call, 2, 0, lambda n: None, Failing(book))
    with pytest.raises(Exception, match="the worker is gone"):
        items.mapInArrow(run, embedding.VECTOR).collect()
    assert len(items.mapInArrow(run, embedding.VECTOR).collect()) == 40
    said = [t for f in os.listdir(calls) for t in open(f"{calls}/{f}").read().split("\n")]
    assert len(said) == len(set(said)) == 40
    # another run over more requests, with other batches: only the new ones are called for
    more = r.unionByName(spark.createDataFrame([(-1, "h-1", "text -1"), (50, "h50", "odd")], r.schema))
    vectors, plan = embedding.embed(more, none, call, 2, 1 << 40, batch=1, retries=1, ledger=book)
    assert rows(vectors, "content_hash", "error_kind", "attempts") == [("h-1", None, 1), ("h50", "RuntimeError", 2)]
    assert plan.where("hit").count() == 40
    vectors, _ = embedding.embed(more, none, call, 2, 1 << 40, batch=1, retries=0, ledger=book)
    assert rows(vectors, "content_hash") == [("h50",)] and len(os.listdir(calls)) == 6
    assert embedding.BatchLedger(f"file://{book}").vectors(spark).count() == 41


def test_catalog_source(spark, tmp_path):
    root = tmp_path / "root"
    for schema in ("main/default", "main/information_schema", "other/s"):
        os.makedirs(root / schema)
    spark.sql("select 1 as a, 'x' as b, array(cast(1.5 as float)) as c, named_struct('x', 1L) as d, cast(1 as decimal(9,2)) as e, timestamp_ntz '2020-01-01' as t").write.parquet(str(root / "main/default/t.parquet"))
    (root / "main/default/v.sql").write_text("select 1")
    (root / "main/default/f.py").write_text("def f(): ...")
    (root / "main/default/files").mkdir()
    spark.dataSource.register(catalog.CatalogSource)
    read = lambda **o: spark.read.format("marlgrid_catalog").options(source=str(root), **o).load()
    assert read().rdd.getNumPartitions() == 3
    got = rows(read(catalogs="main", schemas="default"), "kind", "name", "place", "column", "type", "digest")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kinds = ["int", "string", "array<float>", "struct<x:bigint>", "decimal(9,2)", "timestamp_ntz"]
    want = [("column", "t", i, c, k, None) for i, (c, k) in enumerate(zip("abcdet", kinds))] + [("table", "t", None, None, None, None), ("view", "v", None, None, None, sha("select 1")), ("function", "f", None, None, "PYTHON", sha("def f(): ...")), ("volume", "files", None, None, None, None), ("schema", "default", None, None, None, None)]
    assert got == sorted(want, key=repr)
    assert rows(read().where("kind = 'schema'"), "catalog", "schema") == [("main", "default"), ("main", "information_schema"), ("other", "s")]
    assert read(catalogs="none").count() == 0


def test_catalog_beside_what_cannot_be_listed(spark, tmp_path, monkeypatch):
    """Named catalogs and schemas are found though the folders above can't be listed, and tables are found in a store that Python can't open."""
    from marlgrid.plans import stored

    (tmp_path / "main/default").mkdir(parents=True)
    spark.sql("select 1 as a").write.parquet(str(tmp_path / "main/default/region.parquet"))

    def barred(self, path):
        raise PermissionError(path)

    monkeypatch.setattr(catalog.FolderCatalog, "_folders", barred)
    reader = catalog.CatalogReader({"source": str(tmp_path), "catalogs": "main,none", "schemas": "default,none"})
    assert [(p.catalog, p.schema) for p in reader.partitions()] == [("main", "default")]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.catalogtest.link./in", f"file://{tmp_path}/main/default")
    for folder in ("viewfs://catalogtest/in", f"{tmp_path}/main/default/"):
        assert rows(stored.catalog_scan(spark, folder), "table", "column_name", "type") == [("region", "a", "int")]
