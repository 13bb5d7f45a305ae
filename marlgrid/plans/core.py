"""Queries of the relational, graph-build and profiling operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.operators import build, evaluate, profile, snapshot
from marlgrid.operators.relational import any_ilike, first_seen, key_difference, latest_per_key, page, replace_by_key, zero_filled
from marlgrid.sources.tables import events, load

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: A moment inside the events table, in place of the wall clock.
NOW_MS = 1_704_412_800_000
MS = "(epoch_us(ts) // 1000)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select user_id, event_id, event_type, value from r where n = 1""")
def latest_event_per_user(spark, d):
    return latest_per_key(load(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""
with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events)
select event_type, count(*) as n_users, count(*) filter (where value > 10) as n_high, round(sum(value), 2) as total from r where n = 1 group by event_type""")
def latest_event_types(spark, d):
    last = latest_event_per_user(spark, d)
    return last.groupBy("event_type").agg(F.count("*").alias("n_users"), F.count_if(F.col("value") > 10).alias("n_high"), F.round(F.sum("value"), 2).alias("total"))


@query("""
with r as (select *, row_number() over (partition by o_custkey, o_orderstatus order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderstatus in ('O', 'F'))
select o_custkey, o_orderstatus, o_orderkey, o_totalprice from r where n = 1""")
def latest_order_per_customer_status(spark, d):
    some = load(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return latest_per_key(some, ["o_custkey", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice")


@query("""
with l as (select * from events order by ts desc, event_id desc limit 100), r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from l)
select user_id, event_id, event_type from r where n = 1""")
def first_seen_after_limit(spark, d):
    return first_seen(load(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 100).select("user_id", "event_id", "event_type")


@query("""
with c as (select * from customer where c_mktsegment = 'BUILDING')
select c_custkey, c_name, c_acctbal, (select count(*) from c) as total from c order by c_acctbal desc, c_custkey limit 25 offset 50""")
def page_customers(spark, d):
    own = load(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    total = own.agg(F.count("*").alias("total"))
    return page(own, [F.desc("c_acctbal"), F.asc("c_custkey")], 25, 50).join(F.broadcast(total)).select("c_custkey", "c_name", "c_acctbal", "total")


@query("""select p_partkey, p_name, p_brand, p_type from part where (p_name ilike '%red%' or p_brand ilike '%red%' or p_type ilike '%red%') and p_size >= 10""")
def search_parts_ilike(spark, d):
    return load(spark, d, "part").where(any_ilike(["p_name", "p_brand", "p_type"], "%red%") & (F.col("p_size") >= 10)).select("p_partkey", "p_name", "p_brand", "p_type")


@query(f"""
with w as (select *, {MS} as ts_ms from events where {MS} between {NOW_MS} - 86400000 and {NOW_MS})
select event_type, count(*) as n, count(*) filter (where event_type <> 'error') as n_ok, round(count(*) filter (where event_type <> 'error') / count(*), 6) as ok_rate,
 round(avg(cast(json_extract_string(props, '$.k') as double)), 4) as mean_metric from w group by event_type""")
def event_quality_window(spark, d):
    return evaluate.live_window(events(spark, d), NOW_MS, 24, ["event_type"], F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("double"))


@query("""
with u as (select user_id, count(*) as n, count(*) filter (where event_type = 'error') as failed, avg(case when json_extract_string(props, '$.k') is not null and value > 2 then 1.0 else 0.0 end) as coverage from events group by user_id)
select user_id, n, case when failed > 12 then 'fail' when n < 60 then 'low_volume' when coverage < 0.8 then 'low_coverage' else 'pass' end as state from u""")
def event_category_status(spark, d):
    u = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.avg(F.when(F.get_json_object("props", "$.k").isNotNull() & (F.col("value") > 2), 1.0).otherwise(0.0)).alias("coverage"))
    return u.select("user_id", "n", evaluate.category_state(F.greatest(F.col("failed") - 12, F.lit(0)), F.col("n"), F.col("coverage"), 60).alias("state"))


@query("""
select o_orderpriority, l_returnflag, count(*) as n_lines, round(coalesce(sum(l_extendedprice), 0), 0) as spend, round(coalesce(avg(l_quantity), 0), 4) as mean_quantity
from lineitem join orders on l_orderkey = o_orderkey where o_orderdate >= timestamp '1996-01-01' group by all""")
def usage_rollup(spark, d):
    own = load(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_orderpriority")
    rows = load(spark, d, "lineitem").join(own, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n_lines"), F.round(F.coalesce(F.sum("l_extendedprice"), F.lit(0.0)), 0).alias("spend"), F.round(F.coalesce(F.avg("l_quantity"), F.lit(0.0)), 4).alias("mean_quantity"))


@query("""
select o_orderkey, o_orderdate, o_totalprice, c_name from orders join customer on o_custkey = c_custkey where c_mktsegment = 'MACHINERY' and o_orderstatus <> 'F'
order by o_orderdate desc, o_orderkey limit 50""")
def job_runs_join(spark, d):
    c = load(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    o = load(spark, d, "orders").where("o_orderstatus <> 'F'")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "o_totalprice", "c_name").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)


@query("""
select n_nationkey, n_name, count(c_custkey) as n_children, count(c_custkey) filter (where c_acctbal > 0) as n_covered,
 round(case when count(c_custkey) = 0 then 0 else count(c_custkey) filter (where c_acctbal > 0) / count(c_custkey) end, 4) as ratio,
 case when count(c_custkey) >= 20 then 'dense' else 'sparse' end as shade from nation left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name""")
def children_per_parent(spark, d):
    c = load(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("covered"))
    joined = load(spark, d, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_children"), F.coalesce("covered", F.lit(0)).cast("long").alias("n_covered"))
    return joined.select("*", F.round(F.when(F.col("n_children") == 0, 0.0).otherwise(F.col("n_covered") / F.col("n_children")), 4).alias("ratio"), F.when(F.col("n_children") >= 20, "dense").otherwise("sparse").alias("shade"))


@query(f"""
with h as (select event_type, max({MS}) as m from events group by event_type), w(kind, weight) as (values ('click', 1.0::double), ('view', 0.85::double), ('error', 0.5::double))
select e.event_type, e.event_id, m as recorded_at_ms, cast(floor(({NOW_MS} - m) / 86400000.0) as bigint) as age_days, coalesce(weight, 0.0) as weight
from h join events e on e.event_type = h.event_type and {MS} = m left join w on kind = e.event_type""")
def latest_health_with_authority(spark, d):
    e = events(spark, d)
    h = e.groupBy(F.col("event_type").alias("h_type")).agg(F.max("ts_ms").alias("m"))
    w = spark.createDataFrame([("click", 1.0), ("view", 0.85), ("error", 0.5)], "kind string, weight double")
    joined = e.join(h, (F.col("event_type") == F.col("h_type")) & (F.col("ts_ms") == F.col("m"))).select("event_type", "event_id", F.col("m").alias("recorded_at_ms"))
    return joined.join(F.broadcast(w), F.col("event_type") == F.col("kind"), "left").select("event_type", "event_id", "recorded_at_ms", F.floor((F.lit(NOW_MS) - F.col("recorded_at_ms")) / 86400000).cast("long").alias("age_days"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query("""select count(*) as n, count(distinct o_custkey) as n_customers, max(o_orderkey) as last_key, max(o_orderpriority) as last_priority from orders""")
def summary_counts(spark, d):
    return load(spark, d, "orders").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"), F.max("o_orderkey").alias("last_key"), F.max("o_orderpriority").alias("last_priority"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by all")
def status_counts(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_partkey is not null and l_quantity > 45)")
def anchors_missing(spark, d):
    used = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return load(spark, d, "part").join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("""
with a as (select 'customer:' || c_custkey as subject, c_mktsegment as v from customer), b as (select 'customer:' || o_custkey as subject, max(o_orderpriority) as v from orders group by o_custkey)
select distinct a.subject from a join b on a.subject = b.subject where a.v is distinct from b.v""")
def substrate_mismatch(spark, d):
    from marlgrid.operators.retrieval import mismatches

    a = load(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("subject"), F.lit("HAS").alias("predicate"), F.col("c_mktsegment").alias("value_json"))
    b = load(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("value_json")).select(F.concat(F.lit("customer:"), "o_custkey").alias("subject"), F.lit("HAS").alias("predicate"), "value_json")
    return mismatches(a, b)


@query("""select 's1' as snapshot_id, 'supplier:' || l_suppkey as src_id, 'part:' || l_partkey as dst_id, l_returnflag as edge_kind, max(l_discount) as weight, max(epoch_us(l_shipdate) // 1000) as recorded_at_ms from lineitem group by all""")
def edge_dedupe(spark, d):
    rows = load(spark, d, "lineitem").select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("supplier:"), "l_suppkey").alias("src_id"), F.concat(F.lit("part:"), "l_partkey").alias("dst_id"), F.col("l_returnflag").alias("edge_kind"), F.col("l_discount").alias("weight"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("recorded_at_ms"))
    return build.deduped_edges(rows)


@query(f"""
with r as (select 's1' as snapshot_id, 'user:' || user_id as entity_id, event_type as source_kind, props as ref, substr(sha256(props), 1, 16) as content_hash, {MS} as parsed_at_ms, cast(event_id as varchar) as commit_sha from events)
select snapshot_id, entity_id, source_kind, ref, content_hash, max(parsed_at_ms) as parsed_at_ms, arg_max(commit_sha, (parsed_at_ms, commit_sha)) as commit_sha from r group by all""")
def provenance_dedupe(spark, d):
    r = events(spark, d).select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("user:"), "user_id").alias("entity_id"), F.col("event_type").alias("source_kind"), F.col("props").alias("ref"), F.substring(F.sha2("props", 256), 1, 16).alias("content_hash"), F.col("ts_ms").alias("parsed_at_ms"), F.col("event_id").cast("string").alias("commit_sha"))
    return build.deduped_provenance(r)


@query("""
with e as (select lang as meta_skill_id, source as source_kind, case when n_chars >= 4000 then 'high' when n_chars >= 1500 then 'medium' else 'low' end as tier, doc_id as recorded_at_ms from documents)
select meta_skill_id, count(*) as n_extensions, array_to_string(list_sort(list_distinct(list(source_kind))), ',') as sources,
 case max(case tier when 'high' then 2 when 'medium' then 1 else 0 end) when 2 then 'high' when 1 then 'medium' else 'low' end as tier, max(recorded_at_ms) as recorded_at_ms from e group by meta_skill_id""")
def source_set_rollup(spark, d):
    e = load(spark, d, "documents").select(F.col("lang").alias("meta_skill_id"), F.col("source").alias("source_kind"), F.when(F.col("n_chars") >= 4000, "high").when(F.col("n_chars") >= 1500, "medium").otherwise("low").alias("tier"), F.col("doc_id").alias("recorded_at_ms"))
    return build.meta_rollup(e)


@query("""
with m as (select c_nationkey, count(*) as n from customer where c_acctbal > 9000 group by c_nationkey)
select r_regionkey as top_order_id, r_name, cast(count(n_nationkey) filter (where n is not null) as bigint) as n_meta_skills, cast(coalesce(sum(n), 0) as bigint) as n_extensions
from region left join nation on n_regionkey = r_regionkey left join m on c_nationkey = n_nationkey group by r_regionkey, r_name""")
def zero_filled_rollup(spark, d):
    n = load(spark, d, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n_extensions"))
    metas = load(spark, d, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_regionkey").alias("top_order_id"), "n_extensions")
    return build.top_rollup(load(spark, d, "region").select(F.col("r_regionkey").alias("top_order_id"), "r_name"), metas)


@query("""
select t.r_name, cast(coalesce(n, 0) as bigint) as n from (values ('AFRICA'), ('ASIA'), ('NOWHERE')) t(r_name) left join (select r_name, count(*) as n from region join nation on n_regionkey = r_regionkey group by r_name) f on f.r_name = t.r_name""")
def health_counts(spark, d):
    kinds = spark.createDataFrame([("AFRICA",), ("ASIA",), ("NOWHERE",)], "r_name string")
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return zero_filled(kinds, n, "r_name", ["n"])


#: All tables, with their columns of plain types.
PROFILED = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "events": "event_id ts user_id event_type value props",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "documents": "doc_id text lang source n_chars",
    "labels": "doc_id quality toxic",
    "embeddings": "vec_id label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
}


def tables(spark, d) -> dict[str, DataFrame]:
    return {t: load(spark, d, t) for t in PROFILED}


def profiles(spark, d) -> DataFrame:
    return profile.profiles(tables(spark, d))


PROFILE_SQL = " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, cast({i} as bigint) as ordinal, count(*) as row_count, count(*) - count({c}) as null_count, count(distinct {c}) as distinct_count from {t}" for t, cs in PROFILED.items() for i, c in enumerate(cs.split()))


@query(PROFILE_SQL)
def profile_table(spark, d):
    return profiles(spark, d).drop("data_type")


KEYS_SQL = f"select table_name, coalesce(string_agg(column_name, ',' order by column_name) filter (where row_count > 0 and null_count = 0 and distinct_count = row_count), '') as keys from ({PROFILE_SQL}) group by table_name"


@query(KEYS_SQL)
def candidate_keys(spark, d):
    return profile.candidate_keys(profiles(spark, d))


@query(f"""select 'main.tpch.' || p.table_name as subject, max(row_count) as row_count, count(*) as n_columns, max(keys) as grain from ({PROFILE_SQL}) p join ({KEYS_SQL}) k on p.table_name = k.table_name group by 1""")
def claims_pivot(spark, d):
    made = profile.claims(profiles(spark, d), "main", "tpch", NOW_MS)
    return profile.pivoted(made)


@query(f"""
with t as (select p.table_name, max(row_count) as n, count(*) as c, max(keys) as k from ({PROFILE_SQL}) p join ({KEYS_SQL}) k on p.table_name = k.table_name group by 1)
select table_name, n > 0 and c > 0 as ready, cast(least(0.92, round(0.72 + case when n > 100 then 0.08 else 0 end + case when k <> '' then 0.05 else 0 end + case when c >= 5 then 0.05 else 0 end + case when n > 5000 then 0.03 else 0 end, 2)) as double) as confidence from t""")
def profile_readiness(spark, d):
    p = profiles(spark, d)
    t = p.groupBy("table_name").agg(F.max("row_count").alias("n"), F.count("*").alias("c")).join(profile.candidate_keys(p), "table_name")
    return t.select("table_name", ((F.col("n") > 0) & (F.col("c") > 0)).alias("ready"), profile.suggestion_confidence(F.col("n") > 100, F.col("keys") != "", F.col("c") >= 5, F.col("n") > 5000).alias("confidence"))


@query(f"""
with t as (select p.table_name, max(row_count) as n, count(*) as c, max(keys) as k from ({PROFILE_SQL}) p join ({KEYS_SQL}) k on p.table_name = k.table_name group by 1)
select case when table_name in ('region', 'nation') then 'dimension' else 'fact' end as family, count(*) as n_tables, cast(sum(n) as bigint) as n_rows, cast(sum(c) as bigint) as n_columns, string_agg(table_name, ',' order by table_name) as tables from t group by 1""")
def schema_profile(spark, d):
    return profile.schema_rollup(profiles(spark, d), F.when(F.col("table_name").isin("region", "nation"), "dimension").otherwise("fact"))


@query("""select o_orderkey, case when ('0x' || substr(sha256('7:' || o_orderkey), 1, 8))::bigint % 100 < 20 then 'validation' else 'train' end as split from orders""")
def deterministic_split(spark, d):
    return load(spark, d, "orders").select("o_orderkey", profile.validation_bucket("7", F.col("o_orderkey")).alias("split"))


METRICS = ("rmse", "accuracy", "false_positive_rate", "loss", "mape", "f1")


@query(f"""
with m as (select o_orderkey, {list(METRICS)}[o_orderkey % 6 + 1] as metric, o_totalprice / 1000 as value from orders)
select o_orderkey, metric, case when metric in ('rmse', 'mae', 'mape', 'log_loss', 'false_positive_rate') then value <= 150 else value >= 150 end as passed from m""")
def metric_gate(spark, d):
    m = load(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(n) for n in METRICS]), (F.col("o_orderkey") % 6 + 1).cast("int")).alias("metric"), (F.col("o_totalprice") / 1000).alias("value"))
    return m.select("o_orderkey", "metric", profile.metric_passes(F.col("metric"), F.col("value"), F.lit(150.0)).alias("passed"))


@query("""
with e as (select p_brand as system, p_type as phase, case when p_retailprice > 1000 then 'supported' else 'partial' end as status, p_name as ref from part)
select system, coalesce(max(status) filter (where phase = 'ECONOMY'), 'not_observed') as "ECONOMY", coalesce(max(status) filter (where phase = 'SMALL'), 'not_observed') as "SMALL", coalesce(max(status) filter (where phase = 'NOVEL'), 'not_observed') as "NOVEL",
 case count(distinct phase) filter (where phase in ('ECONOMY', 'SMALL', 'NOVEL')) when 3 then 'high' when 0 then 'low' else 'medium' end as confidence, array_to_string(list_sort(list_distinct(list(ref)))[1:8], ',') as evidence from e group by system""")
def support_matrix(spark, d):
    e = load(spark, d, "part").select(F.col("p_brand").alias("system"), F.col("p_type").alias("phase"), F.when(F.col("p_retailprice") > 1000, "supported").otherwise("partial").alias("status"), F.col("p_name").alias("ref"))
    return profile.support_matrix(e, ["ECONOMY", "SMALL", "NOVEL"])


@query(f"""
with r as (select distinct substr(sha256(text), 1, 16) as content_hash, min(doc_id) over (partition by substr(sha256(text), 1, 16)) as request_id from documents where length(text) > 0), c as (select distinct substr(sha256(text), 1, 16) as content_hash from documents where doc_id % 2 = 0)
select r.content_hash, request_id, c.content_hash is not null as hit from r left join c on r.content_hash = c.content_hash""")
def embedding_cache_plan(spark, d):
    r = load(spark, d, "documents").select(F.col("doc_id").alias("request_id"), "text", F.substring(F.sha2("text", 256), 1, 16).alias("content_hash"))
    return snapshot.cache_plan(r, r.where("request_id % 2 = 0"))


@query("""
with t as (select doc_id, greatest(1, cast(ceil(length(text) / 4) as bigint)) as tokens, (row_number() over (order by doc_id) - 1) // 16 as batch_no from documents),
b as (select batch_no, sum(tokens) as s from t group by batch_no), c as (select batch_no, sum(s) over (order by batch_no) as so_far from b)
select doc_id, cast(t.batch_no as bigint) as batch_no, so_far <= 200000 as embedded from t join c on t.batch_no = c.batch_no""")
def budget_cutoff(spark, d):
    from marlgrid.functions.text import token_estimate_chars

    t = load(spark, d, "documents").select("doc_id", F.greatest(F.lit(1), token_estimate_chars("text")).alias("tokens"))
    return snapshot.budget_cut(t, "tokens", "doc_id", 16, 200_000).select("doc_id", "batch_no", "embedded")


@query(f"""
with s as (select event_type || ':' || user_id as snapshot_id, case when count(*) > 10 then max({MS}) end as promoted_at_ms, cast(case when max(value) > 60 then 1 end as bigint) as deactivated_at_ms from events group by 1)
select snapshot_id, coalesce(promoted_at_ms, -1) as promoted_at_ms, coalesce(case when promoted_at_ms is not null and deactivated_at_ms is null and snapshot_id <> 'click:5' and promoted_at_ms < {NOW_MS} + 10 * 86400000 - 86400000 then {NOW_MS} + 10 * 86400000 else deactivated_at_ms end, -1) as deactivated_at_ms from s""")
def retention_sweep(spark, d):
    s = events(spark, d).groupBy(F.concat_ws(":", "event_type", "user_id").alias("snapshot_id")).agg(F.when(F.count("*") > 10, F.max("ts_ms")).alias("promoted_at_ms"), F.when(F.max("value") > 60, 1).cast("long").alias("deactivated_at_ms"))
    swept = snapshot.retention(s, "click:5", NOW_MS + 10 * 86_400_000, 1)
    return swept.select("snapshot_id", F.coalesce("promoted_at_ms", F.lit(-1)).alias("promoted_at_ms"), F.coalesce("deactivated_at_ms", F.lit(-1)).alias("deactivated_at_ms"))


@query("""
with g as (select cast(o_custkey as varchar) as snapshot_id, case o_orderstatus when 'O' then 'persist' when 'F' then 'vector' else 'smoke' end as gate, o_totalprice > 150000 as ok from orders),
w as (select snapshot_id, coalesce(bool_or(ok) filter (where gate = 'persist'), false) as p, coalesce(bool_or(ok) filter (where gate = 'vector'), false) as v, coalesce(bool_or(ok) filter (where gate = 'smoke'), false) as s from g group by 1)
select snapshot_id, p and v and s as passed, concat_ws(',', case when not p then 'persist' end, case when not v then 'vector' end, case when not s then 'smoke' end) as failed_gates from w""")
def promotion_gate(spark, d):
    g = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("snapshot_id"), F.when(F.col("o_orderstatus") == "O", "persist").when(F.col("o_orderstatus") == "F", "vector").otherwise("smoke").alias("gate"), (F.col("o_totalprice") > 150000).alias("ok"))
    return snapshot.gates(g)


@query("""
with n as (select o_orderkey, o_custkey, 'replaced' as state from orders where o_custkey % 7 = 0 and o_orderstatus = 'F')
select o_orderkey, o_custkey, o_orderstatus as state from orders where o_custkey not in (select o_custkey from n) union all select * from n""")
def replace_keys(spark, d):
    o = load(spark, d, "orders")
    new = o.where("o_custkey % 7 = 0 and o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.lit("replaced").alias("state"))
    return replace_by_key(o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state")), new, ["o_custkey"])


@query("""
with r as (select source as entity_id, doc_id as ordinal, case lang when 'en' then 1.0 when 'de' then 0.95 when 'fr' then 0.85 else 0.5 end::double as authority, case when n_chars > 3000 then 'ex' || doc_id end as exemplar, lang from documents),
b as (select *, row_number() over (partition by entity_id order by authority desc, ordinal) as n from r), x as (select entity_id, arg_min(exemplar, ordinal) as first_exemplar from r where exemplar is not null group by 1)
select b.entity_id, ordinal, authority, case when authority >= 0.85 then 'high' when authority >= 0.5 then 'medium' else 'low' end as tier, coalesce(exemplar, first_exemplar) as exemplar from b left join x on x.entity_id = b.entity_id where n = 1""")
def authority_upsert(spark, d):
    kind = F.when(F.col("lang") == "en", "sdk").when(F.col("lang") == "de", "openapi").when(F.col("lang") == "fr", "docs").otherwise("blog")
    r = load(spark, d, "documents").select(F.col("source").alias("entity_id"), F.col("doc_id").alias("ordinal"), build.authority(kind).alias("authority"), F.when(F.col("n_chars") > 3000, F.concat(F.lit("ex"), "doc_id")).alias("exemplar"))
    return build.upsert_by_authority(r).select("entity_id", "ordinal", "authority", build.tier(F.col("authority")).alias("tier"), "exemplar")


@query(f"""
select event_id, round(case when value < 5 then 0.25 else 0.5 * pow(0.5, greatest(0, {NOW_MS} - {MS}) / 86400000.0 / 365) end, 6) as weight from events""")
def recency_decay(spark, d):
    e = events(spark, d).withColumn("published", F.when(F.col("value") >= 5, F.col("ts_ms")))
    return e.select("event_id", F.round(build.recency_decayed(F.col("published"), NOW_MS), 6).alias("weight"))


def side_sql(key: str) -> str:
    return f"(('0x' || substr(sha256('side:' || {key}), 1, 8))::bigint % 100)"


def side(key: str):
    """0 to 99 by a hash of a key, so that shares of a table grow with it: below 60 is before, from 40 on after."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("side:"), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("long") % 100


@query(f"""
with a as (select distinct lang, source from documents where {side_sql('doc_id')} < 60), b as (select distinct lang, source from documents where {side_sql('doc_id')} >= 40)
select lang, source, 'before' as side from (select * from a except select * from b) union all select lang, source, 'after' from (select * from b except select * from a)""")
def idempotence_diff(spark, d):
    doc = load(spark, d, "documents")
    return key_difference(doc.where(side("doc_id") < 60), doc.where(side("doc_id") >= 40), ["lang", "source"])


@query(f"""
with a as (select user_id, max({MS}) as t from events where {side_sql('event_id')} < 60 group by 1), b as (select user_id, max({MS}) as t from events where {side_sql('event_id')} >= 40 group by 1)
select count(*) as n_keys, count(*) filter (where b.t < a.t) as n_backwards from a join b on a.user_id = b.user_id""")
def freshness_monotonic(spark, d):
    e = events(spark, d)
    a = e.where(side("event_id") < 60).groupBy("user_id").agg(F.max("ts_ms").alias("before"))
    b = e.where(side("event_id") >= 40).groupBy("user_id").agg(F.max("ts_ms").alias("after"))
    return a.join(b, "user_id").agg(F.count("*").alias("n_keys"), F.count_if(F.col("after") < F.col("before")).alias("n_backwards"))


@query("""
with r as (select d.lang, avg(case when l.doc_id is not null then 1.0 else 0.0 end) as labelled, avg(case when l.quality = 1 then 1.0 else 0.0 end) as good, count(*) as n from documents d left join labels l on l.doc_id = d.doc_id group by 1),
c as (select lang, n, round_even(labelled, 4) as labelled, round_even(good, 4) as good, concat_ws(',', case when not labelled >= 0.41 then 'COVERAGE_LOW' end, case when not good >= 0.35 then 'QUALITY_LOW' end) as codes from r)
select *, case when codes <> '' then 'failed' when n < 150 then 'observed' else 'passed' end as state from c""")
def quality_gates(spark, d):
    doc = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id", "left")
    r = doc.groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("quality").isNotNull().cast("double")).alias("a"), F.avg(F.coalesce((F.col("quality") == 1).cast("double"), F.lit(0.0))).alias("b"))
    c = r.select("lang", "n", F.bround("a", 4).alias("labelled"), F.bround("b", 4).alias("good"), evaluate.reason_codes((F.col("a") >= 0.41, "COVERAGE_LOW"), (F.col("b") >= 0.35, "QUALITY_LOW")).alias("codes"))
    return c.select("*", evaluate.status(F.col("codes"), scored=F.col("n") >= 150).alias("state"))


@query("""
with e as (select conv_id, text, row_number() over (partition by conv_id order by turn desc) as n from conversations where role = 'assistant'), r as (select distinct conv_id from conversations)
select r.conv_id, text is not null as scored, coalesce(contains(text, 'the') or contains(text, 'und'), false) as matched from r left join e on e.conv_id = r.conv_id and n = 1""")
def expected_context(spark, d):
    c = load(spark, d, "conversations")
    last = evaluate.joined_latest(c.select("conv_id").distinct(), c.where("role = 'assistant'").select("conv_id", "turn", "text"), "conv_id", [F.desc("turn")])
    return last.select("conv_id", F.col("text").isNotNull().alias("scored"), evaluate.matched_context(F.col("text"), F.array(F.lit("the"), F.lit("und"))).alias("matched"))


@query("""
with p as (select distinct doc_id from labels), b as (select doc_id from documents where doc_id not in (select doc_id from p))
select count(*) as violations, (select count(*) from documents) as n_entities, round_even(1 - count(*) / (select count(*) from documents), 4) as share,
 (select string_agg(k, ',' order by k) from (select cast(doc_id as varchar) as k from b order by doc_id limit 32)) as examples from b""")
def provenance_linkage(spark, d):
    return evaluate.linkage(load(spark, d, "documents"), load(spark, d, "labels"), "doc_id").select("violations", "n_entities", "share", "examples")


@query("""
with d(name, type) as (values ('doc_id', 'BIGINT'), ('text', 'VARCHAR'), ('lang', 'BIGINT'), ('title', 'VARCHAR'))
select name, type as declared, cast(case name when 'lang' then 'STRING' end as varchar) as observed, case name when 'lang' then 'changed' else 'missing' end as problem from d where name in ('lang', 'title')""")
def schema_drift(spark, d):
    seen = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in load(spark, d, "documents").schema], "name string, type string")
    declared = spark.createDataFrame([("doc_id", "bigint"), ("text", "string"), ("lang", "bigint"), ("title", "varchar")], "name string, type string")
    return evaluate.schema_drift(declared, seen)


@query("""
select user_id % 10 as step, min(event_id) as first_at, arg_max(props, event_id) as detail from events where event_type = 'click' group by 1""")
def reversal_plan(spark, d):
    log = load(spark, d, "events").select((F.col("user_id") % 10).alias("step"), F.when(F.col("event_type") == "click", "succeeded").otherwise("failed").alias("status"), F.col("event_id").alias("position"), F.col("props").alias("detail"))
    return snapshot.reversal_plan(log)
