"""Queries of what is stored: keyed tables, snapshots, indexes, ledgers, catalogs, files and transform runs, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.operators import claims, embedding, graph, lexical_index, scorers, snapshot, vector_index
from marlgrid.operators.build import AUTHORITY
from marlgrid.operators.parts import Store, create_keyed, merge_keyed, persist_whole, snapshot_rows
from marlgrid.operators.staging import cut, shared_folder
from marlgrid.plans import contracts
from marlgrid.plans.core import NOW_MS, query
from marlgrid.plans.graph_build import lengths
from marlgrid.plans.text_graph import WHOLE, _edges, claims_of
from marlgrid.sources import catalog, files
from marlgrid.sources.tables import events, load

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
select o_orderkey, o_custkey, case when o_orderkey between 100 and 900 then 'new' else o_orderstatus end as state from orders where o_orderkey not between 1000 and 1100
union all select -1, -1, 'first'""")
def keyed_merge(spark, d):
    """Orders laid out by ranges of their keys; a merge replaces some rows, adds one and takes some away, in the ranges that hold them."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"))
    store = create_keyed(Store(spark, folder(spark, "keyed")), "orders", o, ["o_orderkey"], ranges=32)
    new = o.where("o_orderkey between 100 and 900").withColumn("state", F.lit("new")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(-1).cast("long").alias("o_custkey"), F.lit("first").alias("state")))
    store = merge_keyed(store, "orders", new.select(*[F.col(f.name).cast(f.dataType) for f in o.schema]), ["o_orderkey"], drop=o.where("o_orderkey between 1000 and 1100"))
    return store.read("orders")


@query("""
select 'docs' as "table", lang as snapshot_id, count(*) as n from documents group by 2 union all select 'labels', 'en', count(*) from labels""")
def snapshot_persist(spark, d):
    """Two tables of some snapshots at once; a second try, in which one table fails between others, changes nothing that readers see."""
    root = folder(spark, "snapshots")
    docs, labels = load(spark, d, "documents").withColumn("snapshot_id", F.col("lang")), load(spark, d, "labels").withColumn("snapshot_id", F.lit("en"))
    store, errors = persist_whole({"docs": docs, "labels": labels}, root, spark)
    assert not any(errors.values())
    bad = docs.withColumn("text", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("broken row"))).otherwise(F.col("text")))
    store, errors = persist_whole({"labels": labels.where("toxic = 1"), "docs": bad, "more": docs}, root, spark)
    assert [n for n, e in errors.items() if e] == ["docs"]
    store = Store(spark, root)
    parts = [snapshot_rows(store, t, s).select(F.lit(t).alias("table"), "snapshot_id") for t in store.names() for s in store.parts(t)]
    return reduce(DataFrame.unionByName, parts).groupBy("table", "snapshot_id").agg(F.count("*").alias("n"))


@query("""
with e as (select vec_id, case when vec_id % 10 = 3 then list_transform(embedding::double[], lambda x: -x) else embedding::double[] end as v from embeddings), q as (select v as q from e where vec_id = 17)
select vec_id, round(list_cosine_similarity(v, q), 6) as score from e, q order by list_cosine_similarity(v, q) desc, vec_id limit 20""")
def vector_cells_topk(spark, d):
    """A stored index by cells, an upsert that turns a tenth of the vectors round, and a search that reads cells until no other can hold a nearer row."""
    e = load(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    store = vector_index.build(Store(spark, folder(spark, "cells")), "vectors", e)
    store = vector_index.upsert(store, "vectors", e.where("vec_id % 10 = 3").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    asked = e.where("vec_id = 17").first()["embedding"]
    return vector_index.search(store, "vectors", asked, 20, exact=True).select("vec_id", F.round("score", 6).alias("score"))


@query("""
with q as (select list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as q from benchmark where item_id = 3), c as (select 'documents:' || doc_id as subject, doc_id, list_distinct(regexp_extract_all(lower('documents:' || doc_id || ' CONTENT ' || text), '[a-z0-9_]+')) as t from documents),
s as (select subject, doc_id, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) as score from c, q)
select subject, round(score, 6) as score from s where score > 0 order by s.score desc, doc_id limit 50""")
def lexical_index_topk(spark, d):
    """An inverted index over the documents, asked for a benchmark item's text."""
    index = lexical_index.build_index(claims_of(spark, d, "documents", "doc_id", "text"), folder(spark, "lexical"))
    asked = load(spark, d, "benchmark").where("item_id = 3").first()["text"]
    return lexical_index.lexical_indexed(asked, index, 50).select("subject", F.round("score", 6).alias("score"))


@query("""select sha256(string_agg(substr(sha256(o_orderkey || ':' || o_orderstatus), 1, 16), '' order by o_orderkey)) as signature from orders""")
def ordered_hash(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256), 1, 16).alias("h"))
    return claims.ordered_signature(o, "o_orderkey", "h")


@query("""
with n as (select user_id, count(*) as n from events group by 1)
select 'chains' as graph, false as cyclic union all select 'closed', (select bool_or(n > 1) from n) union all select 'containment', false union all select 'symmetric', true""")
def cycle_check(spark, d):
    """Each user's events in a chain; the chains closed to rings; the graph of keys, with and without its edges turned round."""
    e = events(spark, d).select("user_id", "event_id", "ts_ms")
    w = F.expr("lead(event_id) over (partition by user_id order by ts_ms, event_id)")
    chains = cut(e.select(F.col("event_id").alias("src"), w.alias("dst")).where("dst is not null"))
    ends = e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts_ms", "event_id")).alias("src"), F.min_by("event_id", F.struct("ts_ms", "event_id")).alias("dst")).where("src != dst").select("src", "dst")
    keys = _edges(spark, d, WHOLE).select("src", "dst")
    graphs = {"chains": chains, "closed": chains.unionByName(ends), "containment": keys, "symmetric": keys.unionByName(keys.select(F.col("dst").alias("src"), F.col("src").alias("dst")))}
    return spark.createDataFrame([(n, graph.has_cycle(g)) for n, g in graphs.items()], "graph string, cyclic boolean")


@query("""
select n_nationkey, case n_nationkey % 5 when 1 then 'DELETE' when 2 then 'DROP' when 3 then 'INSERT' when 4 then 'syntax' else '' end as findings from nation""")
def sql_checks(spark, d):
    """A statement for each nation, checked as it is parsed: an alias and a literal may be any word."""
    said = {0: "select n_name as drop, 'delete from t' as `truncate` from nation where n_name = '{n}' -- drop table t", 1: "delete from nation where n_name = '{n}'", 2: "drop table if exists nation_{k}", 3: "with x as (select '{n}' as n) insert into nation_copy select * from x", 4: "selekt '{n}'"}
    rows = load(spark, d, "nation").select("n_nationkey", "n_name").collect()  # a statement each
    told = [(r[0], ",".join(contracts.sql_findings(said[r[0] % 5].format(n=r[1], k=r[0]), spark))) for r in rows]
    return spark.createDataFrame(told, f"n_nationkey {load(spark, d, 'nation').schema['n_nationkey'].dataType.simpleString()}, findings string")


_TYPE = "case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string' when 'DATE' then 'date' when 'FLOAT[]' then 'array<float>' when 'TIMESTAMP' then 'timestamp_ntz' else column_type end"


@query("with c as (" + " union all ".join(f"select '{t}' as \"table\", column_name, {_TYPE} as type from (describe select * from {t})" for t in TABLES) + """) select "table", column_name, type from c""")
def catalog_scan(spark, d):
    """The folder of tables as a schema of a catalog, through the data source."""
    spark.dataSource.register(catalog.CatalogSource)
    told = catalog.told_tables(spark, d, "given", "tables")
    seen = spark.read.format("marlgrid_catalog").option("client", "marlgrid.sources.catalog:ListedCatalog").option("source", told).load()
    return seen.where(F.col("kind") == "column").where(F.col("name").isin(*TABLES)).select(F.col("name").alias("table"), F.col("column").alias("column_name"), "type")


@query("""
with h as (select doc_id, text, substr(sha256(text), 1, 16) as content_hash from documents where length(text) > 0), f as (select content_hash, min(doc_id) as doc_id, any_value(text) as text from h group by 1)
select content_hash, cast(length(text) as double) as first_value, exists (select 1 from h where h.content_hash = f.content_hash and h.doc_id % 2 = 0) as held from f""")
def embedding_ledger(spark, d):
    """A run over half of the documents, then one over all with the same ledger, which calls only for what the first left."""
    r = load(spark, d, "documents").select(F.col("doc_id").alias("request_id"), "text", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    none = spark.createDataFrame([], "content_hash string, embedding array<double>")
    book = folder(spark, "ledger")
    embedding.embed(r.where("request_id % 2 = 0"), none, lengths, 2, 1 << 60, 32, ledger=book)
    held = embedding.BatchLedger(book).vectors(spark).select("content_hash", "embedding", F.lit(True).alias("held"))
    new, _ = embedding.embed(r, none, lengths, 2, 1 << 60, 32, ledger=book)
    return held.unionByName(new.select("content_hash", "embedding", F.lit(False).alias("held"))).select("content_hash", F.col("embedding")[0].alias("first_value"), "held")


def _scorer_sql(name: str, reason: str, violations: str, score: str = "0.0") -> str:
    return f"select '{name}' as scorer, case when count(*) > 0 then {score} else 1.0 end::double as score, case when count(*) > 0 then '{reason}' else '' end as reason, count(*) as n_violations, coalesce(array_to_string(list_sort(list(v))[1:32], ','), '') as examples from ({violations}) t(v)"


_SCORERS = (
    _scorer_sql("schema_integrity", "PERSIST_FAILED", "select 'missing_table:absent' union all select 'extra_table:t3' union all select 'first_column:t' || n_nationkey from nation where n_regionkey = 2 and n_nationkey <> 3"),
    _scorer_sql("smoke_floor", "SMOKE_REGRESSION", "select 'gold_query_missing:' || vec_id from embeddings where label = 9 union all select 'below_floor:0.25'"),
    _scorer_sql("namespace_isolation", "NAMESPACE_NOT_ISOLATED", "select 'shared_ledger:l' || l from (select case when s_suppkey % 97 = 7 then 0 else s_nationkey end as l, count(distinct s_nationkey) as n from supplier group by 1) where n > 1 union all select 'mixed_owner:n' || s_nationkey from supplier group by s_nationkey having bool_or(s_suppkey % 13 = 5) and not bool_and(s_suppkey % 13 = 5)"),
    _scorer_sql("principal_isolation", "PRINCIPAL_NOT_PROVISIONED", "select 'missing_principal:r6' union all select 'shared_principal:shared'"),
    _scorer_sql("grants_match", "GRANTS_MIXED", "select 'missing_grant:e' || s_nationkey || '/' || s_name || '/QUERY' from supplier where s_acctbal < 0 union all select 'extra_grant:e' || s_nationkey || '/' || s_name || '/MANAGE' from supplier where s_acctbal < 0"),
    _scorer_sql("authority_lock", "PERSIST_FAILED", "select 'weight_drift:docs' union all select 'unknown_kind:hearsay' union all select 'missing_kind:hand' union all select 'unknown_provenance:' || doc_id from documents where lang = 'fr'"),
    _scorer_sql("refresh_slo", "SNAPSHOT_STALE", "select 'snapshot_stale:' || (({now} - epoch_ms(max(ts))) // 86400000) from events having {now} - epoch_ms(max(ts)) > 2 * 86400000".replace("{now}", str(NOW_MS + 60 * 86_400_000))),
    _scorer_sql("vocabulary_coverage", "SECTION_ALIAS_MISSING", "select 'missing:tab/NONE' union all select distinct 'extra:tab/' || c_mktsegment from customer where c_mktsegment = 'BUILDING'"),
    _scorer_sql("manifest_audit", "CAPABILITY_LINKS", "select case when doc_id % 5 = 0 then 'links_missing:' else 'primary_mismatch:' end || doc_id from documents where doc_id % 5 = 0 or doc_id % 7 = 0"),
)


@query(" union all ".join(_SCORERS))
def scorer_suite(spark, d):
    """Nine scorers over whole tables, each with violations that are made by changing values."""
    n, s, docs, cust = load(spark, d, "nation"), load(spark, d, "supplier"), load(spark, d, "documents"), load(spark, d, "customer")
    key, of = F.col("n_nationkey"), lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    columns = n.select(of("t", "n_nationkey").alias("table_name"), F.when(F.col("n_regionkey") == 2, "odd").otherwise("id").alias("column_name"), F.lit(0).alias("ordinal"))
    expected = n.select(F.when(key == 3, "absent").otherwise(of("t", "n_nationkey")).alias("table_name"), F.lit("id").alias("first_column"))
    emb = load(spark, d, "embeddings")
    gold = emb.select(F.col("vec_id").alias("query_id"))
    baseline = emb.select(F.when(F.col("label") == 9, -1).otherwise(F.col("vec_id")).alias("query_id"), F.lit(0.5).alias("baseline_rate"))
    rate = emb.agg((F.count("*") * 0 + 0.25).alias("hit_rate"))
    ledgers = s.select(of("n", "s_nationkey").alias("namespace"), F.when(F.col("s_suppkey") % 13 == 5, "other").otherwise("own").alias("owner"), F.when(F.col("s_suppkey") % 97 == 7, "l0").otherwise(of("l", "s_nationkey")).alias("ledger"))
    roles = n.select(of("r", "n_nationkey").alias("role"), F.when(key.isin(4, 5), "shared").when(key != 6, of("p", "n_nationkey")).alias("principal"))
    grant = lambda privilege: s.select(of("e", "s_nationkey").alias("endpoint"), F.col("s_name").alias("principal"), privilege.alias("privilege"))
    weights = spark.createDataFrame([("hearsay" if k == "hand" else k, 0.8 if k == "docs" else w) for k, w in AUTHORITY.items()], "source_kind string, authority_weight double")
    provenance = docs.select(F.col("doc_id").cast("string").alias("entity_id"), F.when(F.col("lang") == "fr", "rumour").when(F.col("lang") == "de", "sdk").otherwise("docs").alias("source_kind"))
    active = events(spark, d).agg(F.max("ts_ms").alias("promoted_at_ms"))
    segment = F.col("c_mktsegment")
    tab = lambda c: cust.select(F.lit("tab").alias("part"), c.alias("name"))
    pointer, i = of("p", "doc_id"), F.col("doc_id")
    skills = docs.select(F.col("doc_id").cast("string").alias("skill_id"), pointer.alias("pointer"), F.when(i % 5 == 0, F.lit(None).cast("array<string>")).when(i % 7 == 0, F.array(F.lit("other"))).otherwise(F.array(pointer)).alias("links"))
    return reduce(DataFrame.unionByName, [
        scorers.schema_integrity(columns, expected), scorers.smoke_floor(baseline, rate, gold), scorers.namespace_isolation(ledgers), scorers.principal_isolation(roles, roles.select("role")),
        scorers.grants_match(grant(F.when(F.col("s_acctbal") < 0, "MANAGE").otherwise("QUERY")), grant(F.lit("QUERY"))), scorers.authority_lock(weights, provenance), scorers.refresh_slo(active, NOW_MS + 60 * 86_400_000),
        scorers.vocabulary_coverage(tab(segment), tab(F.when(segment == "BUILDING", "NONE").otherwise(segment))), scorers.manifest_audit(skills),
    ])


@query("""
select 'sql' as run, 'succeeded' as status, count(distinct o_orderstatus)::bigint as n_rows, '' as findings from orders union all select 'callable', 'succeeded', count(*), '' from nation union all select 'drift', 'failed', null, 'n: BIGINT for STRING'
union all select 'import', 'blocked', null, 'socket' union all select 'drop', 'blocked', null, 'DROP' union all select 'missing', 'blocked', null, 'missing input no_such_table' union all select 'raises', 'failed', null, 'ValueError: no'""")
def contract_runs(spark, d):
    """Transforms over tables under their last names, as SQL and as callables: run, blocked and failed ones."""
    own = f"marlgrid_{uuid.uuid4().hex[:8]}"
    for t in ("orders", "nation"):
        load(spark, d, t).createOrReplaceTempView(f"{own}_{t}")
    o, n = f"{own}_orders", f"{own}_nation"
    counted = f"select o_orderstatus, count(*) as n from {{{o}}} group by 1"
    want = {"o_orderstatus": "string", "n": "bigint"}

    def bad(s, inputs):
        raise ValueError("no")

    runs = {
        "sql": contracts.run_sql(spark, counted, [o], f"{own}_a", want),
        "callable": contracts.run_transform(spark, lambda s, inputs: inputs[n].select("n_name"), [n], f"{own}_b", {"n_name": "string"}, "import math"),
        "drift": contracts.run_sql(spark, counted, [o], f"{own}_c", want | {"n": "string"}),
        "import": contracts.run_transform(spark, lambda s, inputs: inputs[n], [n], f"{own}_d", {}, "import socket"),
        "drop": contracts.run_sql(spark, f"drop table {o}", [o], f"{own}_e", {}),
        "missing": contracts.run_sql(spark, "select 1 as n", ["no_such_table"], f"{own}_f", {}),
        "raises": contracts.run_transform(spark, bad, [n], f"{own}_g", {}),
    }
    rows = [(k, r.status, r.rows, ",".join(r.findings)) for k, r in runs.items()]
    for t in ("a", "b"):
        spark.sql(f"drop table if exists {own}_{t}")
    for v in (o, n):
        spark.catalog.dropTempView(v)
    return spark.createDataFrame(rows, "run string, status string, n_rows long, findings string")


@query("""
select 'records' as source, count(*) filter (where doc_id % 50 > 0) as n, count(*) filter (where doc_id % 50 = 0) as n_bad from documents union all select 'document', count(*), 0 from nation union all select 'manifests', count(*), count(*) filter (where n_regionkey = 3) from nation
union all select 'appended', 2 * count(*), 0 from region union all select 'overwritten', count(*), 0 from region union all select 'published', count(*), 0 from documents where lang = 'de' union all select 'rolled_back', count(*), 0 from documents where lang = 'en'
union all select 'planned', count(*), 5 from region""")
def file_sources(spark, d):
    """Records, a JSON document and manifests as files; appends, an overwritten table, a published read model, a rollback, a run's plan."""
    root = folder(spark, "files")
    docs, nation, region = load(spark, d, "documents"), load(spark, d, "nation"), load(spark, d, "region")
    line = F.when(F.col("doc_id") % 50 == 0, "{not json").otherwise(F.to_json(F.struct("doc_id", "text")))
    docs.select(line.alias("value")).write.text(f"{root}/records")
    read = files.json_lines(spark, f"{root}/records", "doc_id long, text string").select("doc_id", "_corrupt")
    out = [read.select(F.lit("records").alias("source"), (F.col("_corrupt").isNotNull() | F.col("doc_id").isNull()).alias("bad"))]
    nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value")).coalesce(1).write.text(f"{root}/document")
    out.append(files.json_document(spark, f"{root}/document", "n_nationkey long, n_name string").where("n_name is not null").select(F.lit("document").alias("source"), F.lit(False).alias("bad")))
    # a file for each nation
    said = F.concat(F.lit("id: skill"), F.col("n_nationkey").cast("string"), F.lit("\nexemplar_of: "), F.when(F.col("n_regionkey") == 3, "nonsense").otherwise(F.concat(F.lit("meta:m/ext:e"), F.col("n_nationkey").cast("string"))))
    nation.select(said.alias("value"), F.col("n_nationkey").alias("k")).repartition("k").write.partitionBy("k").text(f"{root}/skills")
    out.append(files.manifests(spark, f"{root}/skills/*").select(F.lit("manifests").alias("source"), F.col("meta").isNull().alias("bad")))
    for _ in range(2):
        files.append(region, f"{root}/appended", ["r_regionkey"])
    out.append(spark.read.schema(region.schema).parquet(f"{root}/appended").select(F.lit("appended").alias("source"), F.lit(False).alias("bad")))
    target = f"marlgrid_{uuid.uuid4().hex[:8]}"
    for _ in range(2):
        contracts.write_table(spark, region, target, {})
    spark.table(target).write.parquet(f"{root}/overwritten")
    spark.sql(f"drop table {target}")
    out.append(spark.read.schema(region.schema).parquet(f"{root}/overwritten").select(F.lit("overwritten").alias("source"), F.lit(False).alias("bad")))
    own = docs.select("doc_id", F.col("lang").alias("snapshot_id"))
    for s in ("fr", "de"):
        files.publish(own, f"{root}/model", s)
    out.append(files.read_model(spark, f"{root}/model").select(F.lit("published").alias("source"), F.lit(False).alias("bad")))
    gates = spark.createDataFrame([(s, g, True) for s in ("en", "de") for g in ("persist", "vector", "smoke")], "snapshot_id string, gate string, ok boolean")
    for at, s in enumerate(("en", "de")):
        snapshot.promote(spark, s, gates, f"{root}/pointer", NOW_MS + at)
    snapshot.rollback(spark, "en", spark.createDataFrame([("en", NOW_MS, None), ("de", NOW_MS + 1, None)], "snapshot_id string, promoted_at_ms long, deactivated_at_ms long"), f"{root}/pointer", NOW_MS + 2)
    out.append(snapshot.active_rows(own, f"{root}/pointer").select(F.lit("rolled_back").alias("source"), F.lit(False).alias("bad")))
    names = [r["r_name"] for r in region.select("r_name").collect()]  # a fixed list of sources
    planned = snapshot.plan(spark, "run1", names + [f"{n}-later" for n in names], [f"{n}-later" for n in names])
    out.append(planned.select(F.lit("planned").alias("source"), (~F.col("planned")).alias("bad")))
    by = reduce(DataFrame.unionByName, out).groupBy("source").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("n_bad"))
    return by.select("source", F.when(F.col("source") == "manifests", F.col("good") + F.col("n_bad")).otherwise(F.col("good")).alias("n"), "n_bad")
