"""Queries of the graph's assembly, its scorers, embeddings, observability and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlgrid.functions import html, text
from marlgrid.operators import assemble, embedding, observe, retrieval, rules, scorers, snapshot
from marlgrid.plans import training
from marlgrid.plans.core import MS, NOW_MS, query
from marlgrid.plans.text_graph import CORPORA, DENIED, URL_SQL
from marlgrid.sources import urls
from marlgrid.sources.tables import events, load

AT_MS = NOW_MS - 86_400_000
MODULES = {f"brand{i}": f"meta:m{i % 5}" for i in range(20)}
PREFIXES = (("/api/2.0/n1", "meta:m1"), ("/api/2.0/n2", "meta:m2"))
SECTIONS = {str(i): f"meta:m{i % 5}" for i in range(30)}
PHASES = {"assessment": "meta:m3", "transpile": "meta:m4"}
RULES = (("meta:m1/ext:list-supplier-1", ("1", "11", "21"), ("example",)), ("meta:m2/ext:list-supplier-2", ("2", "12"), ("nothing", "/12")))


def taxonomy(spark) -> assemble.Taxonomy:
    metas = spark.createDataFrame([(f"meta:m{i}", f"top:{i % 3}", f"M{i}") for i in range(6)], "meta_skill_id string, top_order_id string, title string")
    tops = spark.createDataFrame([(f"top:{i}", f"T{i}") for i in range(4)], "top_order_id string, title string")
    return assemble.Taxonomy(metas, tops, MODULES, PREFIXES, SECTIONS, PHASES, "meta:m3", RULES)


def methods(spark, d):
    """Parts as methods of services."""
    key = F.col("p_partkey")
    return load(spark, d, "part").select(
        F.concat(F.lit("m"), key).alias("method_id"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("module"), F.concat("p_type", F.lit("API")).alias("class_name"), F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), key % 50).alias("name"),
        F.concat("p_name", F.lit(" of\nmore")).alias("doc"), F.when(F.col("p_size") < 25, "read").alias("effect"), (F.col("p_size") > 45).alias("deprecated"), F.when(key % 10 == 9, F.concat(F.lit("m"), key - 1)).alias("paginates_id"),
        F.when(F.col("p_size") > 45, F.concat(F.lit("m"), key + 1)).alias("successor_id"), F.concat(F.lit("h"), key).alias("content_hash"), key.alias("ordinal"),
    )


def operations(spark, d):
    """Suppliers as operations of an API."""
    key = F.col("s_suppkey")
    return load(spark, d, "supplier").select(
        F.concat(F.lit("op:Get_"), key).alias("operation_id"), F.when(key % 3 > 0, F.concat(F.lit("List_Supplier_"), key % 40)).alias("raw_id"), F.lit("GET").alias("method"), F.concat(F.lit("/api/2.0/n"), "s_nationkey", F.lit("/items")).alias("path"),
        F.when(key % 4 > 0, F.col("s_name")).alias("summary"), F.lit("What it does").alias("description"), F.lit(None).cast("string").alias("effect"), (F.col("s_acctbal") < 0).alias("deprecated"), F.concat(F.lit("h"), key).alias("content_hash"), key.alias("ordinal"),
    )


def doc_pages(spark, d):
    p = load(spark, d, "pages")
    section = F.rtrim(urls.section_root("url", CORPORA), F.lit("/"))
    ids = F.array(*[F.concat(F.col("page_id").cast("string"), F.lit(f":{i}")) for i in range(2)])
    return p.select("page_id", section.alias("section_root"), F.concat(F.lit("Page "), "page_id").alias("title"), "url", F.substring(F.sha2("html", 256), 1, 16).alias("content_hash"), ids.alias("chunk_ids"), F.col("page_id").alias("ordinal"))


def callables(spark, d):
    """Customers as functions of a labs repository."""
    phase = F.when(F.col("c_mktsegment") == "BUILDING", "assessment").when(F.col("c_mktsegment") == "MACHINERY", "transpile").otherwise("unknown")
    key = F.col("c_custkey")
    return load(spark, d, "customer").select(F.concat(F.lit("c"), key).alias("callable_id"), F.concat(F.lit("pkg.f_"), key).alias("qualname"), F.concat(F.lit("f_"), key % 60).alias("name"), F.col("c_name").alias("doc"), phase.alias("phase"), (key % 2 == 0).alias("is_method"), (key % 7 == 0).alias("is_command"), F.concat(F.lit("h"), key).alias("content_hash"), key.alias("ordinal"))


SDK_SQL = """
m as (select 'm' || p_partkey as method_id, lower(replace(p_brand, '#', '')) as module, replace(p_name, ' ', '_') || '_' || (p_partkey % 50) as name, p_name, p_size, case when p_partkey % 10 = 9 then 'm' || (p_partkey - 1) end as pages, case when p_size > 45 then 'm' || (p_partkey + 1) end as successor, p_partkey as ordinal from part),
r as (select *, case when cast(substr(module, 6) as int) < 20 then 'meta:m' || (cast(substr(module, 6) as int) % 5) end as meta from m),
e as (select *, meta || '/ext:' || regexp_replace(replace(lower(name), '_', '-'), '^-+|-+$', '', 'g') as extension_id from r where meta is not null and (pages is null or pages not in (select method_id from m)))"""


@query(f"""
with {SDK_SQL}, l as (select a.extension_id, arg_max(b.extension_id, a.ordinal) as deprecated_by from e a join e b on a.successor = b.method_id where a.extension_id <> b.extension_id group by 1), f as (select *, row_number() over (partition by extension_id order by ordinal) as n from e)
select f.extension_id, meta as meta_skill_id, array_to_string(list_transform(string_split(replace(name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title, p_name || ' of' as synopsis, case when p_size < 25 then 'read' else 'unclassified' end as effect_class, case when p_size > 45 then 'deprecated' else 'ga' end as lifecycle, deprecated_by
from f left join l on l.extension_id = f.extension_id where n = 1""")
def graph_sdk(spark, d):
    made = assemble.from_sdk(methods(spark, d), taxonomy(spark), AT_MS, "1.0")
    return assemble.merged(made.extensions).select("extension_id", "meta_skill_id", "title", "synopsis", "effect_class", "lifecycle", "deprecated_by")


OPENAPI_SQL = """
o as (select 'op:Get_' || s_suppkey as operation_id, '/api/2.0/n' || s_nationkey || '/items' as path, lower(case when s_suppkey % 3 > 0 then 'List_Supplier_' || (s_suppkey % 40) else 'Get_' || s_suppkey end) as slug, case when s_suppkey % 4 > 0 then s_name end as summary, s_acctbal < 0 as old, s_suppkey as ordinal from supplier),
v as (select *, case when starts_with(path, '/api/2.0/n1') then 'meta:m1' when starts_with(path, '/api/2.0/n2') then 'meta:m2' end as meta from o),
x as (select *, meta || '/ext:' || replace(slug, '_', '-') as extension_id from v where meta is not null)"""


@query(f"""
with {OPENAPI_SQL} select extension_id, operation_id, 'derives' as edge_kind, 0.95::double as weight, 'GET ' || path as ref from x""")
def graph_openapi(spark, d):
    made = assemble.from_openapi(operations(spark, d), taxonomy(spark), AT_MS)
    refs = made.provenance.select("ref", "content_hash")
    edges = made.edges.withColumn("content_hash", F.concat(F.lit("h"), F.substring_index("dst_id", "_", -1)))
    return edges.join(refs, "content_hash").select(F.col("src_id").alias("extension_id"), F.col("dst_id").alias("operation_id"), "edge_kind", "weight", "ref")


@query(f"""
with {OPENAPI_SQL}, s as (select distinct extension_id from x), {URL_SQL.strip().removeprefix('with').rstrip()},
g as (select page_id, url, parts[2] as section, case when try_cast(parts[2] as int) < 30 then 'meta:m' || (try_cast(parts[2] as int) % 5) end as meta from c where section is not null and regexp_matches(parts[2], '^[0-9]+$')),
t as (select page_id, meta as src_id from g where meta is not null union all select page_id, 'meta:m1/ext:list-supplier-1' from g where meta is not null and section in ('1', '11', '21') and 'meta:m1/ext:list-supplier-1' in (select extension_id from s)
 union all select page_id, 'meta:m2/ext:list-supplier-2' from g where meta is not null and section in ('2', '12') and (contains(lower(url), 'nothing') or contains(lower(url), '/12')) and 'meta:m2/ext:list-supplier-2' in (select extension_id from s))
select src_id, page_id || ':' || i as dst_id, 'cites' as edge_kind, 0.85::double as weight from t, (values (0), (1)) k(i)""")
def graph_docs(spark, d):
    """Sections are joined to parents by alias; pages of sections without one are unlinked."""
    tax = taxonomy(spark)
    current = assemble.merged(assemble.from_openapi(operations(spark, d), tax, AT_MS).extensions)
    made = assemble.from_docs(doc_pages(spark, d), current, tax, AT_MS)
    return made.edges.select("src_id", "dst_id", "edge_kind", "weight")


@query("""
with c as (select c_custkey, 'f_' || (c_custkey % 60) as name, case c_mktsegment when 'BUILDING' then 'assessment' when 'MACHINERY' then 'transpile' else 'unknown' end as phase, c_custkey % 2 = 0 as is_method, c_custkey % 7 = 0 as is_command from customer),
k as (select *, case when phase = 'transpile' then 'meta:m4' else 'meta:m3' end || '/ext:' || replace(name, '_', '-') as extension_id, row_number() over (partition by case when phase = 'transpile' then 'meta:m4' else 'meta:m3' end, name order by c_custkey) as n from c where is_command or (not is_method and phase <> 'unknown'))
select extension_id, case when phase = 'transpile' then 'write' else 'read' end as effect_class, case when is_command then 'cli' else 'sdk' end as surface from k where n = 1""")
def graph_labs(spark, d):
    made = assemble.from_labs(callables(spark, d), taxonomy(spark), AT_MS, "rev")
    return assemble.merged(made.extensions).select("extension_id", "effect_class", "surface")


def post_tables(spark, d):
    doc = load(spark, d, "documents")
    posts = doc.select(F.col("doc_id").alias("post_id"), F.concat(F.lit("u"), "doc_id").alias("url"), F.when(F.col("doc_id") % 3 > 0, F.lit(NOW_MS) - F.col("doc_id") * 864000000).alias("published_at_ms"), F.lit("p").alias("content_hash"))
    chunks = doc.select(F.concat(F.lit("k"), "doc_id").alias("chunk_id"), F.col("doc_id").alias("post_id"), F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    mentions = doc.select(F.concat(F.lit("k"), "doc_id").alias("chunk_id"), F.concat(F.lit("meta:m"), F.col("doc_id") % 8).alias("meta_skill_id"), (F.col("n_chars") / 4000).alias("confidence"))
    return posts, chunks, mentions


@query(f"""
with p as (select doc_id, n_chars / 4000.0 as confidence, doc_id % 8 as m, case when doc_id % 3 > 0 then {NOW_MS} - doc_id * 864000000 end as t from documents)
select 'k' || doc_id as chunk_id, confidence >= 0.7 and m < 6 as linked, confidence < 0.7 as unlinked, case when confidence >= 0.7 and m < 6 then round(case when t is null then 0.25 else 0.5 * pow(0.5, ({NOW_MS} - t) / 86400000.0 / 365) end * confidence, 6) end as weight from p""")
def graph_posts(spark, d):
    posts, chunks, mentions = post_tables(spark, d)
    made = assemble.from_posts(posts, chunks, mentions, taxonomy(spark), AT_MS, NOW_MS)
    edges = made.edges.select(F.col("dst_id").alias("chunk_id"), F.round("weight", 6).alias("weight"))
    gone = made.unlinked.select(F.col("entity_id").alias("chunk_id"), F.lit(True).alias("unlinked"))
    return chunks.select("chunk_id").join(edges, "chunk_id", "left").join(gone, "chunk_id", "left").select("chunk_id", F.col("weight").isNotNull().alias("linked"), F.coalesce("unlinked", F.lit(False)).alias("unlinked"), "weight")


@query()
def graph_build(spark, d):
    """The whole graph of all six sources: the rows of each of its tables, and each top order's counts."""
    pointers = load(spark, d, "nation").select(F.concat(F.lit("skill:"), "n_nationkey").alias("skill_id"), F.when(F.col("n_nationkey") % 5 == 4, "odd").otherwise(F.concat(F.lit("meta:m"), F.col("n_nationkey") % 7, F.lit("/ext:n"), "n_nationkey")).alias("pointer"))
    g = assemble.build(spark, taxonomy(spark), "s1", AT_MS, NOW_MS, methods(spark, d), pointers, operations(spark, d), doc_pages(spark, d), callables(spark, d), post_tables(spark, d), "1.0", "rev")
    counts = None
    for name in ("tops", "metas", "extensions", "edges", "provenance", "unlinked", "broken"):
        n = getattr(g, name).agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    tops = g.tops.select(F.explode(F.array(*[F.struct(F.concat_ws(":", "top_order_id", F.lit(c)).alias("what"), F.col(c).alias("n")) for c in ("n_metas", "n_extensions", "n_exemplars")])).alias("x")).select("x.*")
    return counts.unionByName(tops)


@query("""
select item_id, i as place, round(sin((('0x' || substr(sha256(text), 1, 16))::ubigint % 1000003 + i) * 0.001 + i * 0.017) * 0.05, 6) as value from benchmark, range(16) r(i)""")
def synthetic_vectors(spark, d):
    b = load(spark, d, "benchmark").select("item_id", F.posexplode(embedding.synthetic_vector(F.col("text"), 16)).alias("place", "value"))
    return b.select("item_id", F.col("place").cast("long").alias("place"), "value")


def lengths(texts):
    """A stand-in for an embedding service."""
    return [[float(len(t)), 1.0] for t in texts]


@query("""
with h as (select doc_id, text, substr(sha256(text), 1, 16) as content_hash from documents where length(text) > 0), f as (select content_hash, min(doc_id) as doc_id, any_value(text) as text from h group by 1),
m as (select *, greatest(1, cast(ceil(length(text) / 4) as bigint)) as tokens, (row_number() over (order by doc_id) - 1) // 32 as b from f where content_hash not in (select content_hash from h where doc_id % 2 = 0)),
c as (select b, sum(sum(tokens)) over (order by b) as so_far from m group by b)
select content_hash, 2::bigint as dims, cast(length(text) as double) as first_value from m join c on m.b = c.b where so_far <= 100000""")
def embedding_run(spark, d):
    r = load(spark, d, "documents").select(F.col("doc_id").alias("request_id"), "text", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    vectors, _ = embedding.embed(r, r.where("request_id % 2 = 0"), lengths, 2, 100_000, 32)
    return vectors.where("error is null").select("content_hash", F.size("embedding").cast("long").alias("dims"), F.col("embedding")[0].alias("first_value"))


@query("""
with a as (select 'h' || (p_partkey % 500) as h, 'part:' || p_partkey as id, 'extension' as kind, p_name || chr(10) || chr(10) || p_brand || chr(10) || chr(10) || p_type as t, '' as u, 0 as o from part union all select 'h' || item_id, 'item:' || item_id, 'docs_chunk', text, cast(item_id as varchar), 1 from benchmark),
b as (select *, row_number() over (partition by h order by o desc, id desc) as n from a), v as (select 'h' || vec_id as h, vec_id from embeddings), j as (select b.id, b.kind, b.h, length(b.t) as chars, b.u, row_number() over (partition by b.id order by b.h desc) as k from b join v on v.h = b.h where n = 1)
select id as entity_id, kind as entity_kind, h as content_hash, chars, u as source_url from j where k = 1 union all select 'item:-1', 'old', 'h', 0, '' """)
def vector_index(spark, d):
    """Metadata by content hash, joined to the vectors and put into an index that holds one row of another entity."""
    ext = load(spark, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("extension_id"), F.lit("meta:m1").alias("meta_skill_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("synopsis"), F.col("p_type").alias("when_to_use"), F.concat(F.lit("h"), F.col("p_partkey") % 500).alias("content_hash"))
    chunks = load(spark, d, "benchmark").select(F.concat(F.lit("item:"), "item_id").alias("chunk_id"), F.concat(F.lit("h"), "item_id").alias("content_hash"), F.col("text").alias("chunk_text"), F.col("item_id").alias("page_id"))
    vectors = load(spark, d, "embeddings").select(F.concat(F.lit("h"), "vec_id").alias("content_hash"), "embedding")
    new = embedding.index_rows(vectors, embedding.vector_metadata(ext, (chunks, "docs_chunk"))).select("entity_id", "entity_kind", "content_hash", F.length("chunk_text").cast("long").alias("chars"), "source_url")
    index = spark.createDataFrame([("item:-1", "old", "h", 0, ""), ("item:1", "old", "h", 0, "")], "entity_id string, entity_kind string, content_hash string, chars long, source_url string")
    return embedding.upserted(index, new)


@query(f"""
with r as (select event_id as statement_id, event_type as status, {MS} as t, cast(floor(value) as bigint) as ms from events where {MS} between {NOW_MS} - 48 * 3600000 and {NOW_MS} order by {MS} desc, event_id limit 50)
select count(*) as query_count, coalesce(cast(floor(avg(ms)) as bigint), 0) as avg_duration_ms, count(*) filter (where upper(status) not in ('FINISHED', 'SUCCEEDED')) as failure_count from r""")
def query_history(spark, d):
    s = events(spark, d).select(F.col("event_id").alias("statement_id"), F.col("event_type").alias("status"), F.col("ts_ms").alias("started_at_ms"), F.floor("value").cast("long").alias("duration_ms"))
    return observe.query_history(s, NOW_MS, 48)[1]


@query(f"""
select user_id, event_type, count(*) as calls, cast(trunc(avg(cast(floor(value) as bigint))) as bigint) as mean_latency_ms, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as tokens from events where {MS} between {NOW_MS} - 7 * 86400000 and {NOW_MS} group by all order by calls desc, user_id, event_type limit 20""")
def call_attribution(spark, d):
    c = events(spark, d).select("user_id", "event_type", F.col("ts_ms").alias("observed_at_ms"), F.floor("value").cast("long").alias("latency_ms"), F.get_json_object("props", "$.k").cast("long").alias("total_tokens"))
    return observe.attribution(c, ["user_id", "event_type"], NOW_MS)


@query(" union all ".join(f"select '{t}' as table_name, true as present, count(*) as n from {t}" for t in ("region", "nation", "orders")) + " union all select 'absent', false, null")
def table_presence(spark, d):
    return observe.presence(spark, {t: f"{d}/{t}.parquet" for t in ("region", "nation", "orders", "absent")})


@query(f"""
select event_id as run_id, event_type as status, {MS} as started_at_ms, {MS} + 1000 as ended_at_ms, cast(floor(({NOW_MS} - {MS} - 1000) / 86400000.0) as bigint) as freshness_days from events order by {MS} desc, event_id limit 50""")
def refresh_history(spark, d):
    e = events(spark, d).select(F.col("event_id").alias("run_id"), F.col("event_type").alias("status"), F.col("ts_ms").alias("started_at_ms"), F.lit(1000).alias("duration_ms"))
    return observe.refresh_history(e, NOW_MS)


@query("""
with q as (select embedding as q from embeddings where vec_id = 17), s as (select vec_id, label, list_cosine_similarity(embedding::double[], q::double[]) as score from embeddings, q order by score desc, vec_id limit 12),
p as (select 'meta:m' || (vec_id % 3) || '/ext:v' || vec_id as entity_id, 'meta:m' || (vec_id % 3) as parent, label, score from s where vec_id <> 17), r as (select *, row_number() over (order by score desc, entity_id) as n from p)
select entity_id, 'label ' || label as label, case when parent = 'meta:m2' then 'sibling' else 'mentions' end as relation, case when parent = 'meta:m2' or n <= 5 then 1 else 2 end as hop from r""")
def similar_entities(spark, d):
    """Neighbours out of vector hits alone."""
    e = load(spark, d, "embeddings")
    hits = retrieval.vector_top_k(e, e.where("vec_id = 17").select("embedding"), 12).join(e.select("vec_id", "label"), "vec_id")
    parent = F.concat(F.lit("meta:m"), F.col("vec_id") % 3)
    named = hits.select(F.concat(parent, F.lit("/ext:v"), "vec_id").alias("entity_id"), parent.alias("meta_skill_id"), F.concat(F.lit("label "), "label").alias("chunk_text"), "score")
    return retrieval.similar_neighbours(named, "meta:m2/ext:v17")


@query("""
with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders)
select c_custkey as snapshot_id, o_orderkey as plan_id, epoch_us(o_orderdate) // 1000 as planned_at_ms from customer left join r on o_custkey = c_custkey and n = 1""")
def latest_plans(spark, d):
    p = load(spark, d, "orders").select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("plan_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("planned_at_ms"))
    return snapshot.latest_plan(load(spark, d, "customer").select(F.col("c_custkey").alias("snapshot_id")), p)


@query("""
with t as (select 'a.b.' || p_name as table_ref, p_name as table_name, cast(sum(p_size) as bigint) as row_count from part group by p_name), w as (select distinct p_brand as proposal_id, p_name as table_name from part where p_size > 30)
select proposal_id, row_number() over (partition by proposal_id order by row_count desc, t.table_name, table_ref) as place, t.table_name, table_ref, row_count from w join t on t.table_name = w.table_name""")
def proposal_tables(spark, d):
    p = load(spark, d, "part")
    t = p.groupBy("p_name").agg(F.sum("p_size").alias("row_count")).select(F.concat(F.lit("a.b."), "p_name").alias("table_ref"), F.lit(None).cast("string").alias("table_name"), "row_count")
    return rules.evidence_tables(p.where("p_size > 30").groupBy(F.col("p_brand").alias("proposal_id")).agg(F.collect_set("p_name").alias("names")), t)


@query("""
with r as (select p_partkey as id, case p_type when 'ECONOMY' then 'regression' when 'SMALL' then 'segmentation' when 'NOVEL' then 'text_or_genai' else 'no_ml_yet' end as problem, p_size > 10 as p_ok, p_size < 45 as f_ok, case p_partkey % 3 when 0 then null when 1 then 'a.b.c' else 'a.b' end as name from part),
s as (select *, concat_ws(',', case when not p_ok then 'PROBLEM_SELECTION_NOT_READY' end, case when not f_ok then 'FEATURES_NOT_READY' end, case when name = 'a.b' then 'MODEL_NAME_OF_THREE_PARTS_REQUIRED' end, case when problem = 'no_ml_yet' then 'NO_TRAINABLE_STRATEGY' end) as blocking, name is null and problem not in ('no_ml_yet', 'text_or_genai') as unnamed from r)
select id, case when blocking = '' then 'ready_for_approval' else 'blocked' end as status, case problem when 'regression' then 'feature_table_or_training_set,evaluation_metric,split_policy,target_column,primary_key' when 'segmentation' then 'feature_table_or_training_set,cluster_count_or_selection_policy,primary_key' when 'text_or_genai' then 'evaluation_set,retrieval_corpus_or_endpoint,quality_metrics' else '' end || case when unnamed then ',model_full_name' else '' end as bindings,
 concat_ws(',', nullif(blocking, ''), case when unnamed then 'MODEL_NAME_NOT_BOUND' end) as findings from s""")
def strategy_plans(spark, d):
    key = F.col("p_partkey")
    problem = F.when(F.col("p_type") == "ECONOMY", "regression").when(F.col("p_type") == "SMALL", "segmentation").when(F.col("p_type") == "NOVEL", "text_or_genai").otherwise("no_ml_yet")
    r = load(spark, d, "part").select(key.alias("id"), problem.alias("problem"), F.when(F.col("p_size") > 10, "ready_for_strategy").otherwise("blocked").alias("problem_status"), F.when(F.col("p_size") < 45, "feature_ready").otherwise("blocked").alias("feature_status"), F.when(key % 3 == 1, "a.b.c").when(key % 3 == 2, "a.b").alias("model_name"))
    return rules.strategy(r)


@query("""
with r as (select distinct o_custkey as case_id, o_orderpriority as family from orders), s as (select *, case left(family, 1) when '1' then 'available' when '2' then 'covered' when '3' then 'needs_work' else 'missing' end as status from r)
select case_id, count(*) as n_skills, count(*) filter (where status not in ('available', 'covered')) as n_missing, case when count(*) filter (where status not in ('available', 'covered')) > 0 then 'resolved_with_gaps' else 'ready' end as status from s group by 1""")
def skill_resolution(spark, d):
    o = load(spark, d, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    skills = o.select(F.col("o_orderpriority").alias("family"), F.when(level == "1", "available").when(level == "2", "covered").when(level == "3", "blocked").alias("status")).where("status is not null").distinct()
    return rules.resolution(rules.family_statuses(o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderpriority").alias("family")), skills))


@query("""select p_type as category, count(*) as n_skills, count(*) filter (where p_size < 25) as n_ready, count(*) filter (where p_size >= 25) as n_needs_work from part group by 1""")
def readiness_summary(spark, d):
    return rules.readiness_summary(load(spark, d, "part").select(F.col("p_type").alias("category"), F.when(F.col("p_size") < 25, "ready").otherwise("blocked").alias("status")))


@query("""
with g as (select case when o_custkey % 3 > 0 then o_custkey else -1 end as workflow, case o_orderstatus when 'F' then 'passed' when 'O' then 'observed' else 'failed' end as gate from orders),
b as (select workflow, case when count(*) filter (where gate = 'failed') > 0 then 'failed' else 'passed' end as run, count(*) as gates, count(*) filter (where gate = 'passed') as ok, count(*) filter (where gate = 'observed') as seen from g group by 1),
c as (select c_custkey as workflow, case when c_acctbal > 0 then 5 else 0 end as records from customer)
select coalesce(b.workflow, c.workflow) as workflow, case when run is null then case when records > 0 then 'not_scored' else 'warning' end when run = 'passed' and seen > 0 then 'warning' else run end as status, coalesce(ok, 0) as numerator, cast(coalesce(gates, records) as bigint) as denominator from b full join c on b.workflow = c.workflow""")
def scorer_categories(spark, d):
    gate = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "observed").otherwise("failed")
    g = load(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).otherwise(-1).alias("workflow"), gate.alias("gate_status"))
    run = g.groupBy("workflow").agg(F.when(F.count_if(F.col("gate_status") == "failed") > 0, "failed").otherwise("passed").alias("run_status"))
    return scorers.scorer_category(g.join(run, "workflow"), load(spark, d, "customer").select(F.col("c_custkey").alias("workflow"), F.when(F.col("c_acctbal") > 0, 5).otherwise(0).alias("n_records")))


def _scorer_sql(rows: str, scorer: str, reason: str) -> str:
    return f"""{rows}, n as (select kind || ':' || subject as v from viol), t as (select v from n order by v limit 32)
select '{scorer}' as scorer, case when (select count(*) from n) > 0 then 0.0 else 1.0 end::double as score, case when (select count(*) from n) > 0 then '{reason}' else '' end as reason, (select count(*) from n) as n_violations, coalesce((select string_agg(v, ',' order by v) from t), '') as examples"""


@query(_scorer_sql("""
with o as (select doc_id, case when doc_id % 19 = 0 or doc_id % 23 = 0 then null when doc_id % 17 = 0 then 'bad' else 'meta:' || lang || '-x/ext:' || source end as pointer from documents), g as (select case when doc_id % 31 = 0 then -1 - doc_id else doc_id end as doc_id, 'meta:' || lang || '-x/ext:' || case when doc_id % 29 = 0 then 'other' else source end as expected from documents),
b as (select coalesce(o.doc_id, g.doc_id) as doc_id, pointer, expected from (select * from o where pointer is not null) o full join g on o.doc_id = g.doc_id),
viol as (select case when expected is null then case when pointer = 'bad' then 'malformed_extra' else 'unexpected_skill' end when pointer is null then 'missing_pointer' when pointer <> expected then 'pointer_drift' when pointer not like 'meta:en%' then 'not_in_graph' end as kind, cast(doc_id as varchar) as subject from b where expected is null or pointer is null or pointer <> expected or pointer not like 'meta:en%')""", "exemplar_linkage", "SKILL_MISSING_EXEMPLAR"))
def scorer_linkage(spark, d):
    doc = load(spark, d, "documents")
    name = F.concat(F.lit("meta:"), "lang", F.lit("-x/ext:"), "source")
    i = F.col("doc_id")
    o = doc.select(i.alias("skill_id"), F.when((i % 19 == 0) | (i % 23 == 0), None).when(F.col("doc_id") % 17 == 0, "bad").otherwise(name).alias("pointer"))
    g = doc.select(F.when(i % 31 == 0, -1 - i).otherwise(i).alias("skill_id"), F.when(F.col("doc_id") % 29 == 0, F.concat(F.lit("meta:"), "lang", F.lit("-x/ext:other"))).otherwise(name).alias("pointer"))
    there = doc.where("lang = 'en'").select(name.alias("extension_id")).distinct().unionByName(spark.createDataFrame([("meta:en-x/ext:other",)], "extension_id string"))
    return scorers.exemplar_linkage(o, g, there)


@query(_scorer_sql("""
with o as (select o_custkey::varchar as task, list_sort(list_distinct(list(case when o_orderstatus = 'P' then 'later' else left(o_orderpriority, 1) end))) as before from orders group by 1), g as (select case when o_custkey % 13 > 0 then o_custkey::varchar else 'x' || o_custkey end as task, list_sort(list_distinct(list(left(o_orderpriority, 1)))) as before from orders group by 1),
viol as (select case when o.task is null then 'missing_task' when g.task is null then 'extra_task' else 'depends_on' end as kind, cast(coalesce(o.task, g.task) as varchar) as subject from o full join g on o.task = g.task where o.task is null or g.task is null or o.before <> g.before)""", "dag_match", "PROMOTION_FAILED"))
def scorer_dag(spark, d):
    o = load(spark, d, "orders")
    task, first = F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)
    by = lambda name, before: o.groupBy(name.alias("task")).agg(F.collect_set(before).alias("depends_on"))
    return scorers.dag_match(by(task, F.when(F.col("o_orderstatus") == "P", "later").otherwise(first)), by(F.when(F.col("o_custkey") % 13 > 0, task).otherwise(F.concat(F.lit("x"), task)), first))


@query("""
with s as (select doc_id as skill_id, 'e' || (doc_id % 97) as pointer from documents), p as (select case when event_id % 90 < 80 then 'e' || (event_id % 90) else 'spare' end as e, case when user_id % 2 = 0 then 'hand' when event_type = 'click' then 'sdk' else 'hand' end as kind from events),
k as (select e, string_agg(distinct kind, ',' order by kind) as kinds, bool_or(kind <> 'hand') as sourced from p group by 1)
select skill_id, pointer, coalesce(kinds, '') as source_kinds, case when sourced then 'source_grounded' when pointer in ('e81', 'e82') then 'pending_stub' when kinds is not null then 'hand_authored_only' else 'missing_provenance' end as status from s left join k on e = pointer""")
def skill_grounding(spark, d):
    s = load(spark, d, "documents").select(F.col("doc_id").alias("skill_id"), F.concat(F.lit("e"), F.col("doc_id") % 97).alias("pointer"))
    p = load(spark, d, "events").select(F.when(F.col("event_id") % 90 < 80, F.concat(F.lit("e"), F.col("event_id") % 90)).otherwise("spare").alias("entity_id"), F.when(F.col("user_id") % 2 == 0, "hand").when(F.col("event_type") == "click", "sdk").otherwise("hand").alias("source_kind"))
    return scorers.grounding(s, p, spark.createDataFrame([("e81",), ("e82",)], "extension_id string"))


@query(URL_SQL + """select corpus, count(*) filter (where ok) as kept, count(*) filter (where not ok) as skipped, 0::bigint as failed, count(*) as total, round(count(*) filter (where ok) / count(*), 6) as share from (
 select corpus, coalesce(len(parts) > 0 and lower(parts[-1]) not in ('index', 'index.html', 'index.htm') and not path like '%/' and coalesce(parts[2] not in ('7', '42'), true), false) as ok from c where corpus is not null) group by 1""")
def docs_summary(spark, d):
    """Each corpus's pages: kept, passed over, failed; the sites are read one by one and merged."""
    parts = []
    for one in CORPORA:
        p = load(spark, d, "pages").withColumn("corpus", urls.corpus_name("url", [one])).where("corpus is not null")
        own = p.withColumn("bearing", urls.is_skill_bearing("url", [one], DENIED))
        parts.append(html.corpus_counts(own.select("page_id", "corpus", "bearing"), html.parsed_pages(own.where("bearing")).select("page_id", "error")))
    return html.merged_counts(*parts)


@query("""
with w as (select doc_id, substr(sha256('u' || doc_id), 1, 24) as document_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents), s as (select doc_id, document_id, w, unnest(range(0, case when len(w) = 0 then 0 else greatest(1, cast(ceil((len(w) - 80) / 720.0) as bigint)) end)) as i from w),
c as (select document_id, document_id || ':' || i as chunk_id, doc_id, i from s), m as (select chunk_id, 'meta:m' || (doc_id % 8) as target, case when doc_id % 13 = 0 then 1.5 else 0.8 end as confidence from c)
select 'CONTENT' as predicate, document_id as subject, chunk_id, cast(null as double) as confidence from c union all select 'MENTIONS', target, chunk_id, confidence from m where confidence <= 1 and cast(substr(target, 7) as int) < 6 union all select 'QUESTION', target, chunk_id, confidence from m where not (confidence <= 1 and cast(substr(target, 7) as int) < 6)""")
def lookup_claims(spark, d):
    """Documents in chunks as CONTENT claims, and what was found in each chunk as MENTIONS or questions."""
    doc = load(spark, d, "documents")
    chunks = doc.select("doc_id", text.document_id(F.concat(F.lit("u"), "doc_id")).alias("document_id"), F.explode(text.fixed_chunks("text")).alias("c"))
    chunks = chunks.select("doc_id", "document_id", F.concat_ws(":", "document_id", F.col("c.chunk_index").cast("string")).alias("chunk_id"), F.col("c.text").alias("chunk_text"))
    found = chunks.select("chunk_id", F.concat(F.lit("meta:m"), F.col("doc_id") % 8).alias("target"), F.when(F.col("doc_id") % 13 == 0, 1.5).otherwise(0.8).alias("confidence"))
    known = taxonomy(spark).metas.select(F.col("meta_skill_id").alias("target"))
    return retrieval.lookup(chunks, found, known).select("predicate", "subject", "chunk_id", "confidence")


@query("""
with s as (select o_orderkey, o_totalprice, o_orderpriority, ('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::bigint % 100 < 20 as held from orders), m as (select o_orderpriority, avg(o_totalprice) as mean from s where not held group by 1), e as (select sqrt(avg(power(o_totalprice - mean, 2))) as rmse from s join m on m.o_orderpriority = s.o_orderpriority where held)
select 'rmse' as metric, round(rmse, 2) as value, rmse <= 200000 as passed, (select count(*) from s where not held) as train_rows, (select count(*) from s where held) as validation_rows, case when rmse <= 200000 then 1::bigint end as version from e""")
def training_run(spark, d):
    """A mean by priority as the model, judged on the held-out orders."""
    spec = training.Spec("cat.sch.spend", "o_orderkey", "o_totalprice", ("o_orderpriority",), "rmse", 200_000.0, "7")

    def train(spec, fit, hold):
        model = fit.groupBy(*spec.features).agg(F.avg(spec.label).alias("mean"))
        error = hold.join(F.broadcast(model), list(spec.features)).agg(F.sqrt(F.avg(F.pow(F.col(spec.label) - F.col("mean"), 2)))).first()[0]
        return error, model

    run = training.run_training(load(spark, d, "orders"), spec, train, lambda name, model, about: 1)
    return spark.createDataFrame([(run.metric, round(run.value, 2), run.passed, run.train_rows, run.validation_rows, run.version)], "metric string, value double, passed boolean, train_rows long, validation_rows long, version long")
