"""The graph's assembly, scorers, embedding runs, snapshots, files and training against cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from marlgrid.operators import assemble, claims, embedding, evaluate, observe, relational, retrieval, rules, scorers, snapshot, staging
from marlgrid.plans import training
from marlgrid.sources import code, files

METHOD = "method_id string, module string, class_name string, name string, doc string, effect string, deprecated boolean, paginates_id string, successor_id string, content_hash string, ordinal long"
OPERATION = "operation_id string, raw_id string, method string, path string, summary string, description string, effect string, deprecated boolean, content_hash string, ordinal long"
PAGE = "page_id string, section_root string, title string, url string, content_hash string, chunk_ids array<string>, ordinal long"
CALLABLE = "callable_id string, qualname string, name string, doc string, phase string, is_method boolean, is_command boolean, content_hash string, ordinal long"


def taxonomy(spark):
    metas = spark.createDataFrame([("meta:jobs", "top:run", "Jobs"), ("meta:sql", "top:query", "SQL"), ("meta:move", "top:run", "Move")], "meta_skill_id string, top_order_id string, title string")
    tops = spark.createDataFrame([("top:run", "Run"), ("top:query", "Query"), ("top:empty", "Empty")], "top_order_id string, title string")
    return assemble.Taxonomy(metas, tops, {"jobs": "meta:jobs"}, [("/api/sql/special", "meta:jobs"), ("/api/sql", "meta:sql")], {"sql/": "meta:sql"}, {"transpile": "meta:move"}, "meta:move", [("meta:sql/ext:stub", ("sql/",), ("query",))])


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_no_sources_is_a_valid_graph(spark):
    g = assemble.build(spark, taxonomy(spark), "s", 5, 9)
    assert rows(g.tops, "top_order_id", "n_metas", "n_extensions", "n_exemplars") == [("top:empty", 0, 0, 0), ("top:query", 0, 0, 0), ("top:run", 0, 0, 0)]
    assert not any(getattr(g, t).count() for t in ("metas", "extensions", "edges", "provenance", "unlinked", "broken"))


def test_whole_graph(spark):
    sdk = spark.createDataFrame(
        [
            ("m1", "Jobs", "JobsAPI", "run_now", "Run it.\nMore", "write", False, None, None, "h1", 1),
            ("m2", "Jobs", "JobsAPI", "run_old", "Deprecated", None, True, None, "m1", "h2", 2),
            ("m3", "Jobs", "JobsAPI", "list_iter", None, "read", False, "m4", None, "h3", 3),
            ("m4", "Jobs", "JobsAPI", "list", None, "read", False, None, None, "h4", 4),
            ("m5", "other", "X", "get", None, "read", False, None, None, "h5", 5),
            ("m6", "Jobs", "JobsAPI", "same", None, "read", False, None, "m6", "h6", 6),
        ],
        METHOD,
    )
    pointers = spark.createDataFrame([("k1", "meta:jobs/ext:list"), ("k2", "meta:sql/ext:stub"), ("k3", "meta:none/ext:x"), ("k4", "junk")], "skill_id string, pointer string")
    openapi = spark.createDataFrame([("o1", "Run_Now", "POST", "/api/sql/special/x", "Runs", "d", None, False, "h7", 1), ("p:get_q", None, "GET", "/api/sql/q", None, "Asks.\nmore", None, True, "h8", 2), ("o3", "x", "GET", "/none", None, None, None, False, "h9", 3)], OPERATION)
    docs = spark.createDataFrame([("d1", "sql/", "Query guide", "u1", "c1", ["d1:0", "d1:1"], 1), ("d2", "sql/", "Other", "u2", "c2", ["d2:0"], 2), ("d3", "zzz/", "Lost", "u3", "c3", [], 3), ("d4", "sql/", "Query two", "u4", "c4", ["d4:0"], 4)], PAGE)
    labs = spark.createDataFrame([("c1", "p.f", "to_spark", "Doc", "transpile", False, False, "l1", 1), ("c2", "p.g", "go", None, "unknown", False, True, "l2", 2), ("c3", "p.h", "hid", None, "transpile", True, False, "l3", 3)], CALLABLE)
    posts = spark.createDataFrame([("b1", "ub", None, "hb")], "post_id string, url string, published_at_ms long, content_hash string")
    chunks = spark.createDataFrame([("b1:0", "b1", "hc"), ("b1:1", "b1", "hd"), ("b1:2", "b1", "he")], "chunk_id string, post_id string, content_hash string")
    mentions = spark.createDataFrame([("b1:0", "meta:sql", 0.8), ("b1:1", "meta:sql", 0.5), ("b1:2", "meta:unheard", 0.9)], "chunk_id string, meta_skill_id string, confidence double")
    g = assemble.build(spark, taxonomy(spark), "s", 5, 9, sdk, pointers, openapi, docs, labs, (posts, chunks, mentions), "1.2", "rev")
    ext = {r.extension_id: r for r in g.extensions.collect()}
    assert sorted(ext) == ["meta:jobs/ext:list", "meta:jobs/ext:run-now", "meta:jobs/ext:run-old", "meta:jobs/ext:same", "meta:move/ext:go", "meta:move/ext:to-spark", "meta:sql/ext:get-q", "meta:sql/ext:stub"]
    assert ext["meta:jobs/ext:run-now"].source_kind == "sdk" and ext["meta:jobs/ext:run-now"].synopsis == "Run it." and ext["meta:jobs/ext:run-now"].title == "Run Now"
    assert ext["meta:jobs/ext:run-old"].deprecated_by == "meta:jobs/ext:run-now" and ext["meta:jobs/ext:run-old"].lifecycle == "deprecated" and ext["meta:jobs/ext:same"].deprecated_by is None
    assert ext["meta:jobs/ext:list"].exemplar == "k1"
    stub = ext["meta:sql/ext:stub"]
    assert (stub.exemplar, stub.source_kind, stub.authority, stub.synopsis, stub.tier) == ("k2", "docs", 0.85, "Query guide", "high")
    assert ext["meta:sql/ext:get-q"].synopsis == "Asks." and ext["meta:sql/ext:get-q"].lifecycle == "deprecated"
    assert ext["meta:move/ext:go"].surface == "cli" and ext["meta:move/ext:to-spark"].effect_class == "write"
    edges = {(r.src_id, r.dst_id, r.edge_kind): r.weight for r in g.edges.collect()}
    assert edges["meta:jobs/ext:run-old", "meta:jobs/ext:run-now", "deprecates"] == 1.0
    assert edges["meta:sql/ext:stub", "d4:0", "cites"] == edges["meta:sql", "d2:0", "cites"] == 0.85 and ("meta:sql/ext:stub", "d2:0", "cites") not in edges
    assert edges["meta:sql", "b1:0", "mentions"] == pytest.approx(0.25 * 0.8)
    assert edges["k2", "meta:sql/ext:stub", "exemplifies"] == 1.0
    assert rows(g.unlinked, "entity_id") == [("b1:1",), ("d3",), ("m5",), ("o3",)]
    assert rows(g.broken, "skill_id", "reason") == [("k3", "unknown_meta_skill"), ("k4", "malformed_pointer")]
    assert rows(g.metas, "meta_skill_id", "source_kinds", "authority") == [("meta:jobs", "hand,openapi,sdk", "high"), ("meta:move", "labs", "medium"), ("meta:sql", "blog,docs,hand,openapi", "high")]
    assert rows(g.tops, "top_order_id", "n_metas", "n_extensions", "n_exemplars") == [("top:empty", 0, 0, 0), ("top:query", 1, 2, 1), ("top:run", 2, 6, 1)]
    assert ("labs:p.f", "rev") in rows(g.provenance, "ref", "commit_sha") and ("jobs.JobsAPI.run_now", "1.2") in {(r.ref.replace("Jobs.", "jobs."), r.commit_sha) for r in g.provenance.where("source_kind = 'sdk'").collect()}
    alone = assemble.from_posts(posts, chunks, None, taxonomy(spark), 5, 9)
    assert alone.edges is None and alone.unlinked.count() == 3 and rows(alone.provenance, "entity_id") == [("corpus:blog",)]


def one(df):
    r = df.collect()
    assert len(r) == 1
    return r[0]


def test_scorers(spark):
    cols = spark.createDataFrame([("a", "snapshot_id", 0), ("a", "x", 1), ("b", "y", 0), ("odd", "z", 0)], "table_name string, column_name string, ordinal int")
    want = spark.createDataFrame([("a", "snapshot_id"), ("b", "schema_version"), ("c", None)], "table_name string, first_column string")
    assert one(scorers.schema_integrity(cols, want)).examples == "extra_table:odd,first_column:b,missing_table:c"
    assert one(scorers.schema_integrity(cols.where("table_name = 'a'"), want.where("table_name = 'a'"))).score == 1.0

    base = spark.createDataFrame([("q1", 0.9), ("q2", 0.8)], "query_id string, baseline_rate double")
    rate = lambda x: spark.createDataFrame([(x,)], "hit_rate double")
    gold = base.select("query_id")
    assert one(scorers.smoke_floor(base, rate(0.8), gold)).score == 1.0
    assert one(scorers.smoke_floor(base, rate(0.5), gold)).score == 0.5
    assert one(scorers.smoke_floor(base.where("query_id = 'q1'"), rate(0.95), gold)).examples == "gold_query_missing:q2"
    assert one(scorers.smoke_floor(base.limit(0), rate(0.95), gold.limit(0))).examples == "empty_baseline:"

    ledgers = spark.createDataFrame([("n1", "o", "l1"), ("n2", "o", "l1"), ("n3", "o", "l3"), ("n3", "p", "l4")], "namespace string, owner string, ledger string")
    assert one(scorers.namespace_isolation(ledgers)).examples == "mixed_owner:n3,shared_ledger:l1"
    who = spark.createDataFrame([("indexer", "sp"), ("coordinator", "sp"), ("audit", None)], "role string, principal string")
    assert one(scorers.principal_isolation(who, spark.createDataFrame([("indexer",), ("audit",)], "role string"))).examples == "missing_principal:audit,shared_principal:sp"
    grants = spark.createDataFrame([("e", "a", "query"), ("e", "b", "manage")], "endpoint string, principal string, privilege string")
    assert one(scorers.grants_match(grants, grants.where("principal = 'a'"))).examples == "extra_grant:e/b/manage"
    assert one(scorers.grants_match(grants, grants)).reason == ""

    weights = [("sdk", 1.0), ("openapi", 0.95), ("docs", 0.8), ("labs", 0.75), ("blog", 0.1), ("made-up", 0.3)]
    bad = one(scorers.authority_lock(spark.createDataFrame(weights, "source_kind string, authority_weight double"), spark.createDataFrame([("x", "sdk"), ("y", "odd"), ("z", "")], "entity_id string, source_kind string")))
    assert bad.examples == "missing_kind:hand,unknown_kind:made-up,unknown_provenance:y,weight_drift:docs" and bad.score == 0.0

    at = lambda *ms: spark.createDataFrame([(m,) for m in ms], "promoted_at_ms long")
    day = scorers.DAY_MS
    assert one(scorers.refresh_slo(at(day), 3 * day)).score == 1.0
    assert one(scorers.refresh_slo(at(day), 3 * day + 1)).examples == "snapshot_stale:2"
    assert one(scorers.refresh_slo(at(), 3 * day)).examples.startswith("no_active_snapshot")
    assert one(scorers.refresh_slo(at(day), day, 0)).examples.startswith("invalid_tolerance")

    seen = spark.createDataFrame([("tab", "corpus"), ("tab", "odd"), ("path", "/extra")], "part string, name string")
    assert one(scorers.vocabulary_coverage(seen, spark.createDataFrame([("tab", "corpus"), ("top", "t1")], "part string, name string"))).examples == "extra:tab/odd,missing:top/t1"
    skills = spark.createDataFrame([("s1", "p", ["p"]), ("s2", "p", ["q"]), ("s3", "p", None), ("s4", None, ["q"])], "skill_id string, pointer string, links array<string>")
    assert one(scorers.manifest_audit(skills)).examples == "links_missing:s3,primary_mismatch:s2"
    assert one(scorers.scored(spark.range(100).select(F.lit("k").alias("kind"), F.col("id").alias("subject")), "x", "y")).examples.count(",") == 31


def test_embedding_runs(spark):
    calls = []

    def call(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0] if "short" not in t else [1.0] for t in texts]

    r = spark.createDataFrame([(1, "a", "one"), (2, "a", "one"), (3, "b", "short"), (4, "c", ""), (5, "d", "cached"), (6, "e", "boom"), (7, "f", "x" * 400)], "request_id long, content_hash string, text string")
    cache = spark.createDataFrame([("d", [0.0, 0.0])], "content_hash string, embedding array<double>")
    vectors, plan = embedding.embed(r, cache, call, 2, 10, batch=1)
    got = {v.content_hash: v for v in vectors.collect()}
    assert got["a"].embedding == [1.0, 2.0] and got["b"].error_kind == "DimensionMismatch" and got["e"].error_kind == "RuntimeError" and got["e"].attempts == 4
    assert "f" not in got and not calls
    told = {p.content_hash: (p.hit, p.embedded) for p in plan.collect()}
    assert told == {"a": (False, True), "b": (False, True), "d": (True, False), "e": (False, True), "f": (False, False)}


def test_synthetic_vectors_by_plain_python(spark):
    import hashlib
    import math

    for text in ("", "a", "Käse 🙂"):
        seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") % 1_000_003
        want = [round(math.sin((seed + i) * 0.001 + i * 0.017) * 0.05, 6) for i in range(40)]
        assert spark.range(1).select(embedding.synthetic_vector(F.lit(text), 40).alias("v")).first().v == pytest.approx(want, abs=1e-9)


def test_pointer_versions(spark, tmp_path):
    path = str(tmp_path / "pointer")
    ok = spark.createDataFrame([(s, g, True) for s in ("s1", "s2") for g in ("persist", "vector", "smoke")] + [("s3", "persist", True)], "snapshot_id string, gate string, ok boolean")
    assert snapshot.pointer(spark, path) is None
    held = snapshot.ActiveSnapshot(spark, path, 60_000)
    assert held.get(0) is None
    snapshot.promote(spark, "s1", ok, path, 1)
    assert held.get(59_999) is None and held.get(60_000) == "s1"
    snapshot.promote(spark, "s2", ok, path, 2)
    assert snapshot.pointer(spark, path) == "s2" and snapshot.versions(spark, path) == [1, 2]
    for bad in ("s2", "s3", "none"):
        with pytest.raises(ValueError):
            snapshot.promote(spark, bad, ok, path, 3)
    # a writer that died before its rename leaves a folder that is no version
    spark.createDataFrame([("half", 1)], "snapshot_id string, promoted_at_ms long").write.parquet(f"{path}/next-dead")
    assert snapshot.pointer(spark, path) == "s2"
    with pytest.raises(Exception, match="already exist"):
        snapshot.move(spark, f"{path}/next-dead", f"{path}/v2")
    df = spark.createDataFrame([("s1", 1), ("s2", 2)], "snapshot_id string, v long")
    assert rows(snapshot.active_rows(df, path), "v") == [(2,)]
    for i in range(12):
        snapshot.rollback(spark, "s1" if i % 2 else "s2", spark.createDataFrame([(s, 1, None) for s in ("s1", "s2")], "snapshot_id string, promoted_at_ms long, deactivated_at_ms long"), path, 10 + i)
    assert len(snapshot.versions(spark, path)) == snapshot.KEPT_POINTERS + 1 and snapshot.pointer(spark, path) == "s1"
    marked = snapshot.stamped(spark.createDataFrame([("s1", None), ("s2", 7)], "snapshot_id string, promoted_at_ms long"), "s1", 5)
    assert rows(marked, "snapshot_id", "promoted_at_ms") == [("s1", 5), ("s2", 7)]
    runs = spark.createDataFrame([("a", "pa", 0), ("b", "pb", None), ("c", "pc", 9 * snapshot.DAY_MS)], "run_id string, path string, ended_at_ms long")
    assert rows(snapshot.staging_due(runs, 10 * snapshot.DAY_MS), "run_id") == [("a",)]
    cache = spark.createDataFrame([("x", 0, None), ("y", 0, 95 * snapshot.DAY_MS)], "content_hash string, emitted_at_ms long, last_used_at_ms long")
    assert rows(snapshot.retained_cache(cache, 100 * snapshot.DAY_MS), "content_hash") == [("y",)]
    assert rows(snapshot.plan(spark, "r", ["a", "b"], ["b"]), "source", "planned", "snapshot_id") == [("a", True, "snap_r"), ("b", False, "snap_r")]


def test_persisted_snapshots_replace_only_their_own(spark, tmp_path):
    root = str(tmp_path)
    t = lambda s, v: {"t": spark.createDataFrame([(s, v)], "snapshot_id string, v long")}
    assert snapshot.persist(t("s1", 1), root) == snapshot.persist(t("s2", 2), root) == snapshot.persist(t("s1", 3), root) == {"t": None}
    assert rows(spark.read.parquet(f"{root}/t"), "snapshot_id", "v") == [("s1", 3), ("s2", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps({"a": 1, "b": "x"}) + "\nnot json\n")
    got = files.json_lines(spark, str(tmp_path / "r.jsonl"), "a int, b string").collect()
    assert [(r.a, r._corrupt) for r in got] == [(1, None), (None, "not json")]
    (tmp_path / "d.json").write_text(json.dumps([{"claim_id": "c1"}, {"claim_id": "c2"}], indent=1))
    assert rows(files.json_document(spark, str(tmp_path / "d.json"), "claim_id string"), "claim_id") == [("c1",), ("c2",)]
    (tmp_path / "skills").mkdir()
    (tmp_path / "skills" / "a.yaml").write_text('id: "one"\nexemplar_of: meta:m/ext:e\n')
    (tmp_path / "skills" / "b.yaml").write_text("id: two\n")
    assert rows(files.manifests(spark, str(tmp_path / "skills")).na.fill("-"), "skill_id", "meta", "ext") == [("one", "m", "e"), ("two", "-", "-")]
    path = str(tmp_path / "log")
    files.append(spark.createDataFrame([(1, "a")], "v long, day string"), path, ["day"])
    files.append(spark.createDataFrame([(2, "b")], "v long, day string"), path, ["day"])
    assert rows(spark.read.parquet(path), "v", "day") == [(1, "a"), (2, "b")]
    merged = files.merge_current(spark.createDataFrame([("c1", 1), ("c2", 1)], "claim_id string, v long"), spark.createDataFrame([("c2", 2), ("c3", 2)], "claim_id string, v long"))
    assert rows(merged, "claim_id", "v") == [("c1", 1), ("c2", 2), ("c3", 2)]
    model = str(tmp_path / "model")
    df = spark.createDataFrame([("s1", 1), ("s2", 2), ("s2", 3)], "snapshot_id string, v long")
    assert files.publish(df, model, "s1") == 1 and files.publish(df, model, "s2") == 2
    with pytest.raises(ValueError):
        files.publish(df, model, "none")
    assert rows(files.read_model(spark, model), "v") == [(2,), (3,)]
    columns, views = files.information_schema({"t": df}, {"v": "select 1"})
    assert columns == [("t", "snapshot_id", 0, "string"), ("t", "v", 1, "bigint")] and len(views[0][1]) == 64
    df.write.mode("overwrite").saveAsTable("listed_here")
    assert ("listed_here", "v", 1, "bigint") in rows(observe.catalog_columns(spark, ["default"]), "table_name", "column_name", "ordinal", "data_type")
    spark.sql("drop table listed_here")


def test_deprecation_forms(spark):
    body = '''
class A:
    def new(self): ...
    def other(self): ...
    def a(self):
        """Deprecated. Use ``new`` instead."""
    def b(self):
        """.. deprecated:: 1.0
        Please take
        ``A.new`` now."""
    def c(self):
        """Was deprecated in lower case. Use ``new`` instead."""
    def d(self):
        """DEPRECATED, see :meth:`~A.other`"""
    def e(self):
        """Deprecated. Replaced by ``gone``"""
'''
    found = code.entities(spark.createDataFrame([("m", body)], "module string, source string"))
    assert rows(code.deprecation_successors(found), "name", "successor") == [("a", "new"), ("b", "new"), ("d", "other")]


def test_strict_authority(spark):
    c = lambda kind, v: spark.createDataFrame([("c", "s", "p", "apple", None, 1, v)], f"claim_id string, subject string, predicate string, value_json string, metadata_json string, ordinal long, authority_weight {kind}")
    read = lambda df: df.select(retrieval.numeric(df, "authority_weight").alias("w")).first().w
    assert read(c("double", 0.5)) == 0.5 and read(c("int", 1)) == 1.0
    assert read(c("boolean", True)) is None and read(c("string", "0.5")) is None and read(c("int", 1).drop("authority_weight")) is None
    mixed = spark.sql("select parse_json(j) as authority_weight from values ('0.5'), ('true'), ('\"0.5\"'), ('2') t(j)")
    assert [r.w for r in mixed.select(retrieval.numeric(mixed, "authority_weight").alias("w")).collect()] == [0.5, None, None, 2.0]


def test_signatures(spark):
    import hashlib

    df = spark.createDataFrame([(i, f"h{i}") for i in range(500)], "id long, h string")
    assert one(claims.ordered_signature(df, "id", "h")).signature == hashlib.sha256("".join(f"h{i}" for i in range(500)).encode()).hexdigest()
    other = spark.createDataFrame([(3, "b"), (None, "x"), (1, None), (3, "a"), (2, "c")], "id long, h string")
    assert one(claims.ordered_signature(other.repartition(4), "id", "h")).signature == hashlib.sha256(b"xcab").hexdigest()
    assert one(claims.ordered_signature(df.limit(0), "id", "h")).signature == hashlib.sha256(b"").hexdigest()
    a, b = (one(claims.signature(df.repartition(n), "id", "h", 10)) for n in (1, 7))
    assert a == b and a.n_blocks == 50
    assert one(claims.signature(df.where("id != 77"), "id", "h", 10)).signature != a.signature
    many = spark.createDataFrame([("p", "BELONGS_TO", f"s{i:03}") for i in range(300)], "object_ref string, predicate string, subject string")
    assert one(claims.containment(many)).children.count(",") == 299


def test_training(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("x"), F.col("id").alias("y"))
    spec = training.Spec("a.b.c", "id", "y", ("x",), "rmse", 10.0)
    made = []
    register = lambda name, model, about: made.append((name, about["passed"])) or 3
    run = training.run_training(df, spec, lambda s, fit, hold: (9.0, "m"), register)
    assert run.passed and run.version == 3 and run.train_rows + run.validation_rows == 1000 and 150 < run.validation_rows < 250 and made == [("a.b.c", True)]
    low = training.run_training(df, spec, lambda s, fit, hold: (11.0, "m"), register)
    assert not low.passed and low.version is None and low.findings == ["below the floor"] and len(made) == 1
    bad = training.run_training(df, training.Spec("c", "id", "y", ("y", "z"), "loss", 0.1, transforms=(("sqrt", "x", ""),)), None, register)
    assert bad.findings == ["model name of three parts", "metric loss", "transform sqrt", "column z", "label among the features: y"]


def test_numbering_needs_no_global_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = rows(staging.numbered(df.repartition(5), [F.asc("k"), F.desc("id")]), "position", "k", "id")
    assert [g[0] for g in got] == list(range(1, 1001)) and got[0][1:] == (0, 999) and got[-1][1:] == (2, 2)
    ranked = rules.ranked_candidates(spark.createDataFrame([("ready", 0.5, "b"), ("ready", 0.5, "a"), ("blocked", 0.9, "c"), ("odd", 0.9, "d")], "readiness string, confidence double, title string"))
    assert rows(ranked, "rank", "title") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]


def test_neighbours_out_of_hits(spark):
    hits = spark.createDataFrame([("meta:a/ext:x", "meta:a", "self", 1.0), ("e1", "meta:b", "", 0.9), ("e1", "meta:b", "again", 0.8), ("meta:a/ext:y", "meta:a", "t" * 99, 0.1), (None, "m", "x", 0.5)], "entity_id string, meta_skill_id string, chunk_text string, score double")
    got = {r.entity_id: (r.label, r.relation, r.hop) for r in retrieval.similar_neighbours(hits, "meta:a/ext:x", near=0).collect()}
    assert got == {"e1": (None, "mentions", 2), "meta:a/ext:y": ("t" * 60, "sibling", 1)}
    # more queries than one scan takes: the same answers in blocks
    v = spark.createDataFrame([(i, [float(i % 7) + 0.1, float(i % 5) - 2.0], f"l{i % 11}") for i in range(60)], "vec_id long, embedding array<double>, label string")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    told = rows(retrieval.top_label(v, q, "label"), "query_id", "top_id")
    assert len(told) == 60 and rows(retrieval.top_label(v, q, "label", most=7), "query_id", "top_id") == told
    assert retrieval.top_label(v, q.limit(0), "label").count() == 0


def test_runtime_metrics_without_events(spark):
    r = spark.createDataFrame([("w", 1, ["x"])], "workflow string, subject_id long, expected array<string>")
    e = spark.createDataFrame([], "subject_id long, created_at_ms long, event string, evidence array<string>, completed boolean")
    assert tuple(one(evaluate.runtime_metrics(r, e, ["workflow"]))) == ("w", 1, 0, 0.0, 0.0, 0.0)


def test_versions_as_of(spark):
    v = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 99, "c")], "schema_version int, enacted_at_ms long, rule string")
    assert rows(relational.as_of_version(v, 50), "rule") == [("b",)]
