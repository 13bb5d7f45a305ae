"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from marlgrid.functions import html, text
from marlgrid.operators import build, evaluate, graph, profile, retrieval, snapshot
from marlgrid.operators.relational import as_of_version, latest_per_key
from marlgrid.plans import contracts
from marlgrid.sources import blog, code, openapi, urls
from marlgrid.streaming.events import live_quality

EDGES = "src string, predicate string, dst string, ordinal long"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_jaccard(spark):
    j = lambda a, b: one(spark, text.jaccard(text.token_set(F.lit(a)), text.token_set(F.lit(b))))
    assert j("create a table", "create table now") == 0.5
    assert j("é", "é") == 0.0
    assert j("A_1 a_1", "a_1") == 1.0


def test_tokens_and_hashes(spark):
    assert one(spark, text.word_count(F.lit("a b c  d\n"))) == 4
    assert one(spark, text.token_estimate(F.lit(0))) == 1
    assert [one(spark, text.token_estimate(F.lit(n))) for n in (3, 9, 1125)] == [4, 12, 1500]
    assert [one(spark, text.token_estimate_chars(F.lit(s))) for s in ("", "abcd", "abcde")] == [0, 1, 2]
    import hashlib

    assert one(spark, text.content_hash(F.lit("a"), F.lit(None).cast("string"))) == hashlib.sha256(b"a\0\0").hexdigest()[:16]
    assert one(spark, text.query_hash(F.lit("  "))) == "query_empty"
    assert one(spark, text.query_hash(F.lit("A  b"))) == one(spark, text.query_hash(F.lit(" a B ")))
    import json

    hard = 'x "q" \\ é 🙂\n\t\x01'
    want = json.dumps({"a": hard, "b": None, "c": ""}, sort_keys=True, separators=(",", ":"))
    assert one(spark, text.claim_id({"b": F.lit(None).cast("string"), "a": F.lit(hard), "c": F.lit("")})) == "wkg:" + hashlib.sha256(want.encode()).hexdigest()[:24]


def test_claim_text(spark):
    c = [F.lit("s"), F.lit("p"), F.lit("v"), F.lit(None).cast("string")]
    assert one(spark, text.claim_text(*c)) == "s p v"
    assert one(spark, text.claim_text(*c, null_word="None")) == "s p v None"


def test_card_and_pointer(spark):
    t = {"CONTENT": "{subject} holds {value}"}
    assert one(spark, text.card(F.lit("CONTENT"), F.lit("a"), F.lit("b"), t)) == "a holds b"
    with pytest.raises(Exception, match="unknown predicate"):
        one(spark, text.card(F.lit("NONE"), F.lit("a"), F.lit("b"), t))
    assert one(spark, text.pointer_parts(F.lit("meta:x/ext:y"))).ext == "y"
    assert one(spark, text.pointer_parts(F.lit("meta:x"))) is None


def test_effects(spark):
    assert [one(spark, text.normal_effect(F.lit(x))) for x in ("Read-Only", "mutating", "hitl", "TBD", "odd")] == ["read", "write", "write·hitl", "unclassified", "odd"]


def test_fixed_chunks(spark):
    got = one(spark, text.fixed_chunks(F.lit(" ".join(map(str, range(1000))))))
    assert [(c.start, len(c.text.split())) for c in got] == [(0, 800), (720, 280)]
    assert [len(one(spark, text.fixed_chunks(F.lit(" ".join("x" * n))))) for n in (0, 1, 800, 801)] == [0, 1, 1, 2]


def test_heading_chunks():
    got = html.heading_chunks(" ".join("w" for _ in range(1200)), [])
    assert [(b, len(t.split())) for b, t, _, _ in got] == [(0, 1125), (1013, 187)]
    said = "Top\n\n" + "a " * 10 + "\n\nSub\n\n" + "b " * 10
    got = html.heading_chunks(said, [(1, None, "Top"), (2, None, "Sub")], 16, 4)
    assert got[0][3] == ["Top"] and got[-1][3] == ["Top", "Sub"]
    with pytest.raises(ValueError):
        html.heading_chunks("a", [], 10, 10)


def test_read_html():
    title, said, heads = html.read_html("<title>T  x</title><nav>no</nav><h1 id=a>Big <b>one</b></h1><p>a<script>x</script> b</p><div>c&amp;d</div>")
    assert (title, said, heads) == ("T  x", "Big one\n\na b\n\nc&d", [(1, "a", "Big one")])
    assert html.read_html("x<br>y<br/>z<table><tr><td>1</td><td>2</td></tr></table>w<p>v")[1] == "x\ny\nz12wv"
    assert html.read_html("<p>a</p>\n\n\n<li>b</li><svg><p>no</p></svg>c<nav/>d")[1:] == ("a\n\nb\n\ncd", [])
    assert html.read_html(None) == (None, "", [])


def test_urls(spark):
    docs = [urls.Corpus("docs.site.test", "docs", 2, ("aws", "gcp"))]
    ok = lambda u: one(spark, urls.is_skill_bearing(F.lit(u), docs, ["release-notes"]))
    assert ok("https://docs.site.test/aws/en/delta/x.html")
    assert not any(map(ok, ["https://docs.site.test/aws/en/delta/", "https://docs.site.test/aws/en/delta/index.html", "https://docs.site.test/aws/en/release-notes/x", "https://docs.site.test/azure/en/d/x", "https://other.test/aws/en/d/x", ""]))
    post = lambda u: one(spark, urls.is_post(F.lit(u), "site.test", "blog", ["blog/category/partners"]))
    assert post("https://www.site.test/blog/a-post")
    assert not any(map(post, ["https://site.test/blog", "https://site.test/blog/feed", "https://site.test/blog/category/x", "https://site.test/blog/category/partners/y", "https://x.test/blog/p"]))


def edges(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGES)


def test_walk(spark):
    e = edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("a", "q", "b")])
    got = {(r.node, r.predicate, r.score) for r in graph.bfs(e, spark.createDataFrame([("a",)], "seed string")).collect()}
    assert got == {("b", "p", 1.0), ("c", "p", 0.5)}


def test_ppr_rounds(spark):
    rows = [("a", "p", "b"), ("a", "q", "b"), ("a", "p", "c"), ("c", "p", "a"), ("d", "p", "a")]
    p = spark.createDataFrame([("a", 0.7), ("x", 0.3)], "node string, mass double")
    got = {r.node: r.score for r in graph.ppr(edges(spark, rows), p, rounds=3, fixed=True).collect()}
    assert got == pytest.approx(plain_ppr(rows, {"a": 0.7, "x": 0.3}, 3, -1.0))


def test_ppr(spark):
    p = spark.createDataFrame([("a", 1.0)], "node string, mass double")
    got = {r.node: r.score for r in graph.ppr(edges(spark, [("a", "p", "b")]), p, tolerance=1e-9).collect()}
    assert got["a"] == pytest.approx(0.40351, abs=1e-5) and got["b"] == pytest.approx(0.59649, abs=1e-5)
    got = {r.node: r.score for r in graph.ppr(edges(spark, [("a", "p", "b"), ("a", "q", "b"), ("a", "p", "c")]), p, rounds=1, fixed=True).collect()}
    assert got["b"] - got["c"] == pytest.approx(0.85 / 3 / 3, abs=1e-9)
    assert sum(got.values()) == pytest.approx(1.0)


def plain_ppr(rows, mass, rounds=100, tolerance=1e-6):
    nodes = sorted({x for s, _, o in rows for x in (s, o)} | set(mass))
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        new = {n: 0.15 * mass.get(n, 0) for n in nodes}
        for n in nodes:
            out = [o for s, _, o in rows if s == n]
            for o in out or nodes:
                new[o] += 0.85 * score[n] / len(out or nodes)
        moved = sum(abs(new[n] - score[n]) for n in nodes)
        score = new
        if moved < tolerance:
            break
    return score


def test_search_by_plain_python(spark):
    rows = [("a", "p", "b"), ("b", "p", "c"), ("c", "q", "a"), ("b", "q", "d"), ("d", "p", "e")]
    said = {"1": ("a", "red apple"), "2": ("b", "green apple pie"), "3": ("e", "stone"), "4": ("a", "apple")}
    claims = spark.createDataFrame([(i, s, "CONTENT", v, None, int(i)) for i, (s, v) in said.items()], "claim_id string, subject string, predicate string, value_json string, metadata_json string, ordinal long")
    lex = {}
    for i, (s, v) in said.items():
        words = set(f"{s} content {v}".split())
        if words & {"apple", "pie"}:
            lex[i] = len(words & {"apple", "pie"}) / len(words | {"apple", "pie"})
    top = sorted(lex, key=lambda i: (-lex[i], int(i)))[:5]
    out = {s: [(p, o) for x, p, o in rows if x == s] for s, _, _ in rows}
    struct = []
    for i in top:
        seen, frontier = {said[i][0]}, [said[i][0]]
        for depth in (1, 2):
            nxt = []
            for n in frontier:
                for p, o in out.get(n, []):
                    if o not in seen:
                        seen.add(o)
                        nxt.append(o)
                        struct.append((o, p, 1 / depth))
            frontier = nxt
    bag = {}
    for i, s in lex.items():
        bag[said[i][0]] = bag.get(said[i][0], 0) + 0.4 * s
    for n, _, s in struct:
        bag[n] = bag.get(n, 0) + 0.6 * s
    rank = plain_ppr(rows, {k: v / sum(bag.values()) for k, v in bag.items()})
    got = retrieval.search("apple pie", claims, edges(spark, rows)).collect()
    for r in got:
        if r.via == "lexical":
            assert r.score == pytest.approx(0.4 * lex[r.ref_id] + 0.6 * rank[r.subject], abs=1e-5)
        else:
            first = next(s for n, p, s in struct if (n, p) == (r.subject, r.predicate))
            assert r.score == pytest.approx(0.6 * (first + rank[r.subject]) / 2, abs=1e-5)
    assert {r.ref_id for r in got if r.via == "lexical"} == set(lex)
    assert {(r.subject, r.predicate) for r in got if r.via == "structural"} == {(n, p) for n, p, _ in struct}
    with pytest.raises(ValueError):
        retrieval.search("x", claims, edges(spark, rows), k=0)


def test_dual_substrates(spark):
    schema = "claim_id string, subject string, predicate string, value_json string, metadata_json string, ordinal long, authority_weight double"
    w = spark.createDataFrame([("w1", "a", "P", "red apple", None, 0, None), ("w2", "z", "P", "pear", None, 1, None)], schema)
    c = spark.createDataFrame([("c1", "a", "P", "red apple", None, 0, 1.0), ("c2", "b", "P", "red apple", None, 1, 1.0), ("c3", "d", "P", "red apple", None, 2, None)], schema)
    got = retrieval.dual_search("red apple", w, c, edges(spark, [("a", "p", "b")])).collect()
    owner = {r.subject: r.substrate for r in got}
    assert owner["a"] == "workspace" and owner["b"] == "capability"
    assert {r.subject: r.score for r in got}["d"] < {r.subject: r.score for r in got}["b"]
    assert [r.subject for r in retrieval.mismatches(w, c.withColumn("value_json", F.lit("x"))).collect()] == ["a"]


def test_cycles(spark):
    assert graph.has_cycle(edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "b")]))
    assert not graph.has_cycle(edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("a", "p", "c")]))


def test_build(spark):
    e = spark.createDataFrame([("s", "a", "b", "k", 0.5, 20), ("s", "a", "b", "k", 0.9, 10)], "snapshot_id string, src_id string, dst_id string, edge_kind string, weight double, recorded_at_ms long")
    assert [tuple(r) for r in build.deduped_edges(e).collect()] == [("s", "a", "b", "k", 0.9, 20)]
    assert [one(spark, build.tier(F.lit(x))) for x in (0.85, 0.84, 0.5, 0.49)] == ["high", "medium", "medium", "low"]
    year, now = 365 * 86_400_000, 10**12
    assert [one(spark, build.recency_decayed(F.lit(t).cast("long"), now)) for t in (now, now - year, None, now + year)] == [0.5, 0.25, 0.25, 0.5]
    r = spark.createDataFrame([("e", 0.5, 0, "x"), ("e", 0.95, 1, None), ("e", 0.95, 2, None)], "entity_id string, authority double, ordinal long, exemplar string")
    got = build.upsert_by_authority(r).first()
    assert (got.ordinal, got.exemplar) == (1, "x")
    metas, exts = spark.createDataFrame([("m",)], "meta_skill_id string"), spark.createDataFrame([("e1", "m")], "extension_id string, meta_skill_id string")
    p = spark.createDataFrame([("s1", "meta:m/ext:e1"), ("s2", "meta:m/ext:e2"), ("s3", "meta:q/ext:e"), ("s4", "bad"), ("s5", None)], "skill_id string, pointer string")
    linked, stubs, broken = build.linked_exemplars(p, exts, metas)
    assert [r.skill_id for r in linked.collect()] == ["s1"] and [r.extension_id for r in stubs.collect()] == ["e2"]
    assert {r.skill_id: r.reason for r in broken.collect()} == {"s3": "unknown_meta_skill", "s4": "malformed_pointer", "s5": "malformed_pointer"}


def test_profile(spark):
    p = profile.profile(spark.createDataFrame([(1, "a", [1]), (2, "a", [1]), (3, None, [1])], "id long, email string, tags array<int>"), "t")
    assert {(r.column_name, r.null_count, r.distinct_count) for r in p.collect()} == {("id", 0, 3), ("email", 1, 1)}
    assert profile.candidate_keys(p).first()["keys"] == "id"
    c = spark.createDataFrame([("t", "ROW_COUNT", "9", 1), ("t", "ROW_COUNT", "10", 1)], "subject string, predicate string, value_text string, observed_at_ms long")
    assert profile.pivoted(c).first().row_count == 10


def test_snapshots(spark, tmp_path):
    day, now = 86_400_000, 10**12
    s = spark.createDataFrame([("active", now - 90 * day, None), ("old", now - 90 * day, None), ("new", now - day, None), ("never", None, None)], "snapshot_id string, promoted_at_ms long, deactivated_at_ms long")
    gone = {r.snapshot_id for r in snapshot.retention(s, "active", now).where("deactivated_at_ms is not null").collect()}
    assert gone == {"old"}
    t = spark.createDataFrame([(i, 10) for i in range(6)], "id long, tokens long")
    assert snapshot.budget_cut(t, "tokens", "id", 2, 45).where("embedded").count() == 4
    good = spark.createDataFrame([("s1", g, True) for g in ("persist", "vector", "smoke")] + [("s2", "persist", True)], "snapshot_id string, gate string, ok boolean")
    path = str(tmp_path / "pointer")
    assert snapshot.pointer(spark, path) is None
    snapshot.promote(spark, "s1", good, path, now)
    assert snapshot.pointer(spark, path) == "s1"
    with pytest.raises(ValueError, match="active already"):
        snapshot.promote(spark, "s1", good, path, now)
    with pytest.raises(ValueError, match="vector,smoke"):
        snapshot.promote(spark, "s2", good, path, now)
    snapshot.rollback(spark, "new", s, path, now)
    assert snapshot.pointer(spark, path) == "new"
    with pytest.raises(ValueError):
        snapshot.rollback(spark, "old", s, path, now)
    two = {"edges": spark.createDataFrame([("s1", 1), ("s2", 2)], "snapshot_id string, v int"), "bad": spark.range(1)}
    assert [k for k, v in snapshot.persist(two, str(tmp_path)).items() if v] == ["bad"]
    snapshot.persist({"edges": spark.createDataFrame([("s2", 3)], "snapshot_id string, v int")}, str(tmp_path))
    assert sorted((r.snapshot_id, r.v) for r in spark.read.parquet(str(tmp_path / "edges")).collect()) == [("s1", 1), ("s2", 3)]


def test_smoke(spark):
    base = spark.createDataFrame([(i, "x", 0.8) for i in range(5)], "query_id long, expected_id string, baseline_rate double")
    hits = lambda n: spark.createDataFrame([(i, "x" if i < n else "y") for i in range(5)], "query_id long, top_id string")
    assert snapshot.smoke(hits(4), base).first().passed and not snapshot.smoke(hits(3), base).first().passed
    assert not snapshot.smoke(hits(4), base.limit(0)).first().passed
    assert snapshot.smoke(hits(4), base.limit(0), bootstrap=True).first().passed


def test_steps(spark):
    log = spark.createDataFrame([("a", "succeeded", 1, "x"), ("b", "failed", 2, "y"), ("a", "succeeded", 3, "z")], "step string, status string, position long, detail string")
    steps = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "step string, ordinal int")
    assert snapshot.resume_point(steps, log).first().step == "b"
    assert snapshot.reversal_plan(log).first().detail == "z"


def test_evaluate(spark):
    assert [one(spark, profile.metric_passes(F.lit(m), F.lit(0.4), F.lit(0.5))) for m in ("rmse", "accuracy")] == [True, False]
    assert spark.range(0).agg(evaluate.ratio(F.col("id") > 0).alias("v")).first().v == 0.0
    assert one(spark, evaluate.matched_context(F.lit("abc"), F.array().cast("array<string>"))) is True
    assert one(spark, evaluate.matched_context(F.lit(None).cast("string"), F.array(F.lit("a")))) is False
    v = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "schema_version int, enacted_at_ms long")
    assert as_of_version(v, 25).first().schema_version == 2
    assert latest_per_key(v.withColumn("k", F.lit(1)), ["k"], [F.desc("enacted_at_ms")]).first().schema_version == 3


SOURCE = '''
from dataclasses import dataclass
@dataclass
class Info:
    """x"""
    size: int
class Api:
    def list_things(self) -> "Info":
        "doc"
    def list_things_iter(self): ...
    def get_old(self) -> Info:
        """Deprecated: use :meth:`list_things`."""
@app.command()
def transpile_query(): ...
'''


def test_code(spark):
    found = code.entities(spark.createDataFrame([("m", SOURCE), ("broken", "def ("), ("none", None)], "module string, source string")).cache()
    kinds = {(r.kind, r.name) for r in found.where("module = 'm'").collect()}
    assert {("dataclass", "Info"), ("field", "size"), ("class", "Api"), ("method", "get_old"), ("function", "transpile_query")} <= kinds
    assert found.where("error is not null").count() == 1
    assert {(r.name, r.target) for r in code.resolved_types(found).collect()} == {("list_things", "Info"), ("get_old", "Info")}
    assert [r.peer for r in code.paginated_peers(found).collect()] == ["list_things_iter"]
    assert [r.successor for r in code.deprecation_successors(found).collect()] == ["list_things"]
    assert code.commands(found).where("is_command").first().phase == "transpile"
    assert {r.effect for r in code.public_methods(found).collect()} == {"read"}


def test_openapi(spark):
    body = '{"paths": {"/api/jobs/{id}": {"get": {"x-effect-class": "read-only", "responses": {"200": {"$ref": "#/c/Job"}}}, "x": 1}}, "components": {"schemas": {"Job": {"items": [{"$ref": "#/c/Run"}]}}, "securitySchemes": {"k": {}}}}'
    rows = openapi.described(spark.createDataFrame([("u", body), ("v", "{")], "source_url string, body string")).collect()
    op = next(r for r in rows if r.kind == "operation")
    assert (op.method, op["name"], op.effect, op.refs) == ("GET", "get_api_jobs_id", "read", ["Job"])
    assert sorted(r.kind for r in rows) == ["error", "operation", "schema", "security"]
    o = spark.createDataFrame([("h/workspace/jobs/create", "POST", "/p", "c"), ("h/workspace/jobs_21/create", "POST", "/p", "c")], "source_url string, method string, path string, name string")
    assert openapi.best_documents(o).first().source_url.endswith("jobs_21/create")


def test_posts(spark):
    page = '<meta property="article:published_time" content="2024-01-02T00:00:00+02:00"><meta name="author" content=" B "><meta content="A" property="article:author"><h1>T</h1><p>x y</p>'
    posts, chunks = blog.posts(spark.createDataFrame([(1, "u", page), (2, "v", "<p>z</p>")], "page_id long, url string, html string"))
    got = {r.page_id: r for r in posts.collect()}
    assert got[1].published_at_ms == 1704153600000 and got[1].authors == ["A", "B"]
    assert got[2].published_at_ms is None and chunks.count() == 2


def test_contracts(spark):
    assert contracts.sql_findings("select 'drop' from t -- delete\n") == []
    assert contracts.sql_findings("Delete from t; truncate table x") == ["DELETE", "TRUNCATE"]
    assert contracts.python_findings("import os.path, httpx\nfrom subprocess import run\nimport pickle as p, tempfile") == ["subprocess", "httpx", "pickle", "tempfile"]
    assert contracts.schema_findings(spark.range(1).schema, {"id": "bigint"}) == []
    assert contracts.schema_findings(spark.range(1).schema, {"id": "int"}) == ["id: BIGINT for INT"]
    assert contracts.schema_findings(spark.range(1).schema, {}) == []
    assert contracts.input_names(["a.b.t", "c.t", "u"]) == {"t": "a.b.t", "u": "u"}
    drift = contracts.run_transform(spark, lambda s, i: s.range(1), [], "x", {"id": "int"})
    assert drift.status == "failed" and drift.observed == {"id": "BIGINT"} and drift.questions == ["mend id: BIGINT for INT"]
    assert contracts.run_transform(spark, lambda s, i: s.range(1), ["no.such"], "x", {}).findings == ["missing input no.such"]
    assert contracts.run_transform(spark, lambda s, i: s.range(1), [], "x", {}, "import pickle").findings == ["pickle"]
    assert contracts.run_transform(spark, lambda s, i: 1 / 0, [], "x", {}).status == "failed"
    spark.range(3).createOrReplaceTempView("three")
    assert contracts.run_sql(spark, "drop table x", [], "x", {}).findings == ["DROP"]
    assert contracts.run_sql(spark, " ", [], "x", {}).findings == ["empty"]
    assert contracts.run_sql(spark, "select id from {three} where id > 0", ["three"], "contract_out", {"id": "bigint"}).rows == 2
    spark.sql("drop table contract_out")


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (7200, "b")], "s long, k string").select(F.timestamp_seconds("s").alias("ts"), "k", F.lit(1.0).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = live_quality(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], F.col("k") == "a", F.col("v"))
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.k, r.n, r.n_ok) for r in spark.table("live").collect()) == [("a", 2, 2), ("b", 1, 0)]
