"""Queries of the claim, rule and observability operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlgrid.operators import claims, profile, rules, snapshot
from marlgrid.operators.build import linked_exemplars, mention_edges
from marlgrid.plans.core import KEYS_SQL, MS, NOW_MS, PROFILE_SQL, PROFILED, profiles, query, tables
from marlgrid.sources.tables import events, load


@query(f"""
select 'main.tpch.' || table_name as "table", max(row_count) as row_count, string_agg('main.tpch.' || table_name || '.' || column_name, ',' order by 'main.tpch.' || table_name || '.' || column_name) as columns, count(*) filter (where null_count > 0) as n_with_nulls from ({PROFILE_SQL}) group by table_name""")
def claim_table_profiles(spark, d):
    return claims.table_profiles(profile.claims(profiles(spark, d), "main", "tpch", NOW_MS))


@query(f"""
select 2 * count(*) + count(*) + 4 * count(distinct table_name) as n_claims, count(distinct table_name) + count(*) as n_subjects, count(distinct table_name) as n_without_value, count(*) as n_unanchored from ({PROFILE_SQL})""")
def claim_quality(spark, d):
    made = profile.claims(profiles(spark, d), "main", "tpch", NOW_MS)
    return claims.quality(made, made.where("predicate = 'EXISTS'"))


@query(f"""select 'main.tpch' as parent, count(distinct table_name) as n_children, string_agg(distinct 'main.tpch.' || table_name, ',' order by 'main.tpch.' || table_name) as children from ({PROFILE_SQL})""")
def containment_tree(spark, d):
    return claims.containment(profile.structure_claims(profile.described(tables(spark, d)), "main", "tpch", NOW_MS))


@query("""
with m as (select doc_id, case when doc_id % 11 = 0 then '' else lang end as target, case when doc_id % 13 = 0 then 1.5 else n_chars / 40000.0 end as confidence from documents)
select case when target = '' then 'empty_target' when confidence > 1 then 'bad_confidence' when target = 'es' then 'unknown_target' else 'valid' end as outcome, count(*) as n from m group by 1""")
def mention_validation(spark, d):
    m = load(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("lang")).alias("target"), F.when(F.col("doc_id") % 13 == 0, 1.5).otherwise(F.col("n_chars") / 40000).alias("confidence"))
    good, questions = claims.mentions(m, spark.createDataFrame([("en",), ("de",), ("fr",)], "target string"))
    return good.select(F.lit("valid").alias("outcome")).unionByName(questions.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""
with m as (select 'doc:' || doc_id as src_id, lang as dst_id, n_chars / 4000.0 as confidence, case when doc_id % 3 > 0 then {NOW_MS} - doc_id * 864000000 end as p from documents)
select src_id, dst_id, 'mentions' as edge_kind, round(case when p is null then 0.25 else 0.5 * pow(0.5, ({NOW_MS} - p) / 86400000.0 / 365) end * confidence, 6) as weight from m where confidence >= 0.7 and dst_id in ('en', 'de')""")
def mention_graph(spark, d):
    m = load(spark, d, "documents").select(F.concat(F.lit("doc:"), "doc_id").alias("src_id"), F.col("lang").alias("dst_id"), (F.col("n_chars") / 4000).alias("confidence"), F.when(F.col("doc_id") % 3 > 0, F.lit(NOW_MS) - F.col("doc_id") * 864000000).alias("published_at_ms"))
    return mention_edges(m, spark.createDataFrame([("en",), ("de",)], "meta_skill_id string"), NOW_MS).withColumn("weight", F.round("weight", 6))


@query("""
with p as (select doc_id, case when doc_id % 17 = 0 then 'bad' else 'meta:' || lang || '/ext:' || source end as pointer, lang, source from documents),
k as (select *, pointer = 'bad' as bad, lang in ('en', 'de') as known, lang = 'en' and source in ('src1', 'src2') as has from p)
select case when bad then 'malformed_pointer' when has then 'linked' when known then 'stub' else 'unknown_meta_skill' end as outcome, count(distinct case when not bad and known and not has then lang || source else cast(doc_id as varchar) end) as n from k group by 1""")
def exemplar_links(spark, d):
    p = load(spark, d, "documents").select(F.col("doc_id").alias("skill_id"), F.when(F.col("doc_id") % 17 == 0, "bad").otherwise(F.concat(F.lit("meta:"), "lang", F.lit("/ext:"), "source")).alias("pointer"))
    linked, stubs, broken = linked_exemplars(p, spark.createDataFrame([("src1", "en"), ("src2", "en")], "extension_id string, meta_skill_id string"), spark.createDataFrame([("en",), ("de",)], "meta_skill_id string"))
    rows = linked.select(F.lit("linked").alias("outcome")).unionByName(stubs.select(F.lit("stub").alias("outcome"))).unionByName(broken.select(F.col("reason").alias("outcome")))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


_COLUMNS = " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, {i} as ordinal" for t, cs in PROFILED.items() for i, c in enumerate(cs.split()))


@query(f"""
with c as ({_COLUMNS}), r as (select table_name, arg_min(column_name, ordinal) filter (where regexp_matches(column_name, '{rules.KEY_HINTS}')) as key, arg_min(column_name, ordinal) filter (where regexp_matches(column_name, '{rules.LABEL_HINTS}') and not regexp_matches(column_name, '{rules.KEY_HINTS}')) as label, count(*) as n, bool_or(regexp_matches(column_name, '{rules.TIME_HINTS}')) as timed from c group by 1)
select table_name, coalesce(key, '') as key, coalesce(label, '') as label, n - case when key is null then 0 else 1 end - case when label is null then 0 else 1 end as n_features, concat_ws(',', case when key is null then 'NO_KEY' end, case when label is null then 'NO_LABEL' end, case when not timed then 'NO_TIME' end) as findings from r""")
def feature_readiness(spark, d):
    return rules.feature_readiness(profile.described(tables(spark, d)))


@query(f"""
with p as ({PROFILE_SQL}), t as (select table_name, max(row_count) as n, arg_min(column_name, ordinal) filter (where h) as target, arg_min(distinct_count, ordinal) filter (where h) as k, bool_or(timed) as timed
 from (select *, regexp_matches(lower(column_name), '{rules.LABEL_HINTS}') and not regexp_matches(lower(column_name), '{rules.KEY_HINTS}') as h, regexp_matches(lower(column_name), '{rules.TIME_HINTS}') as timed from p) group by 1),
c as (select *, case when target is null then 'clustering' when k <= 20 then 'classification' when timed then 'forecasting' else 'regression' end as problem from t)
select table_name, problem, coalesce(target, '') as target, case when target is not null and n >= 100 then 'ready' else 'needs_input' end as status, concat_ws(',', case when target is null then 'NO_TARGET' end, case when n < 100 then 'FEW_ROWS' end) as findings,
 case problem when 'clustering' then 'centroid' when 'forecasting' then 'time_series' else 'tree_ensemble' end as family from c""")
def problem_choice(spark, d):
    return rules.problem(profiles(spark, d)).withColumn("family", rules.family(F.col("problem")))


@query(f"""
with t as (select p.table_name, max(row_count) as n, max(keys) as k from ({PROFILE_SQL}) p join ({KEYS_SQL}) q on p.table_name = q.table_name group by 1),
c as (select table_name as title, case when n >= 1000 then 'ready' when n >= 30 then 'needs_input' else 'blocked' end as readiness, cast(round(least(greatest(0.8 - 0.12 + case when n >= 1000 then 0.06 else 0 end + case when k <> '' then 0.04 else 0 end, 0.1), 0.86), 2) as double) as confidence from t)
select title, readiness, confidence, row_number() over (order by case readiness when 'ready' then 0 when 'needs_input' then 1 else 2 end, confidence desc, title) as rank from c""")
def candidate_ranking(spark, d):
    p = profiles(spark, d)
    t = p.groupBy("table_name").agg(F.max("row_count").alias("n")).join(profile.candidate_keys(p), "table_name")
    c = t.select(F.col("table_name").alias("title"), F.when(F.col("n") >= 1000, "ready").when(F.col("n") >= 30, "needs_input").otherwise("blocked").alias("readiness"), rules.candidate_confidence(F.lit(0.8), F.col("n") >= 1000, F.col("keys") != "", F.lit(False)).alias("confidence"))
    return rules.ranked_candidates(c)


@query("""
with o as (select o_custkey, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_totalprice > 400000) as big from orders group by 1),
b as (select o_custkey, concat_ws(',', case when not f >= 2 then 'TOO_FEW_DONE' end, case when not big = 0 then 'TOO_LARGE' end) as blockers, big, f from o)
select o_custkey, blockers, case when blockers = '' then 'go' else 'no_go' end as decision, case when f < 2 then 'rejected' when big > 0 then 'needs_approval' else 'assigned' end as alias_state from b""")
def go_no_go(spark, d):
    from marlgrid.operators.evaluate import reason_codes

    o = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_totalprice") > 400000).alias("big"))
    b = o.withColumn("blockers", reason_codes((F.col("f") >= 2, "TOO_FEW_DONE"), (F.col("big") == 0, "TOO_LARGE")))
    return b.select("o_custkey", "blockers", rules.go_no_go(F.col("blockers")).alias("decision"), rules.alias_gate(F.col("f") >= 2, F.col("big") > 0, F.lit(False)).alias("alias_state"))


@query("""
with r as (select p_brand, p_partkey as ordinal, p_name as "option", case when p_size < 25 then 'small' end as reason from part),
b as (select p_brand, ordinal // 1024 as block, count(*) as n_rejected, sha256(string_agg(ordinal || ':' || "option" || ':' || reason, ',' order by ordinal)) as rejected_sha256 from r where reason is not null group by all),
c as (select p_brand, coalesce(arg_min("option", ordinal) filter (where reason is null), '') as chosen from r group by 1)
select c.p_brand, chosen, block, n_rejected, rejected_sha256 from c left join b on b.p_brand = c.p_brand""")
def backend_choice(spark, d):
    """Every part's option: the chosen one of each brand, and its rejected ones counted and digested in blocks of 1024 keys."""
    r = load(spark, d, "part").select("p_brand", F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("option"), F.when(F.col("p_size") < 25, "small").alias("reason"))
    chosen = rules.first_supported(r, "p_brand").select("p_brand", F.coalesce("chosen", F.lit("")).alias("chosen"))
    blocks = rules.rejected_blocks(r, "p_brand", 1024).withColumn("rejected_sha256", F.sha2("rejected", 256)).drop("rejected")
    return chosen.join(blocks, "p_brand", "left")


@query("""
with h as (select user_id % 3 as query_no, 'u' || user_id as entity_id, value as score, 'GET /api/' || event_type || ' ok' as ref, event_type from events),
f as (select *, row_number() over (partition by entity_id order by query_no, score desc, ref) as n from h), k as (select entity_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') as source_kinds from h group by 1)
select f.entity_id, query_no, score, 'GET /api/' || event_type as operation, source_kinds from f join k on k.entity_id = f.entity_id where n = 1""")
def evidence_queries(spark, d):
    h = load(spark, d, "events").select((F.col("user_id") % 3).alias("query_no"), F.concat(F.lit("u"), "user_id").alias("entity_id"), F.col("value").alias("score"), F.concat(F.lit("GET /api/"), "event_type", F.lit(" ok")).alias("ref"), F.col("event_type").alias("source_kind"))
    return claims.multi_query_evidence(h, h).select("entity_id", "query_no", "score", "operation", "source_kinds")


@query(f"""
select event_type, cast(floor({MS} / 86400000.0) as bigint) as day, count(*) as calls, count(*) filter (where value > 20) as failures, round(coalesce(sum(value), 0), 2) as tokens, round(coalesce(avg(value), 0), 4) as mean_tokens from events where {MS} >= {NOW_MS} and {MS} < {NOW_MS} + 7 * 86400000 group by all""")
def model_attribution(spark, d):
    e = events(spark, d).where((F.col("ts_ms") >= NOW_MS) & (F.col("ts_ms") < NOW_MS + 7 * 86_400_000))
    return e.groupBy("event_type", F.floor(F.col("ts_ms") / 86_400_000).cast("long").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("value") > 20).alias("failures"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("tokens"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean_tokens"))


@query("""
select event_id, event_type, value from events where event_type = 'error' order by ts desc, event_id desc limit 40""")
def live_trace_sample(spark, d):
    return load(spark, d, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "event_type", "value")


@query("""
with r as (select conv_id, count(*) filter (where role = 'user' and length(trim(text)) > 0) as inputs, count(distinct role) as kinds from conversations group by 1)
select conv_id, concat_ws(',', case when not inputs > 0 then 'EMPTY_INPUTS' end, case when not kinds <= 2 then 'MANY_SOURCES' end) as codes from r""")
def eval_records(spark, d):
    from marlgrid.operators.evaluate import reason_codes

    r = load(spark, d, "conversations").groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & (F.length(F.trim("text")) > 0)).alias("inputs"), F.countDistinct("role").alias("kinds"))
    return r.select("conv_id", reason_codes((F.col("inputs") > 0, "EMPTY_INPUTS"), (F.col("kinds") <= 2, "MANY_SOURCES")).alias("codes"))


@query("""
with b as (select doc_id // 1000 as block, sha256(string_agg(substr(sha256(text), 1, 16), '' order by doc_id)) as d from documents group by 1)
select count(*) as n_blocks, sha256(string_agg(d, '' order by block)) as signature from b""")
def corpus_signature(spark, d):
    doc = load(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("h"))
    return claims.signature(doc, "doc_id", "h", 1000)


@query("""
select step, ordinal from (values ('plan', 0), ('parse', 1), ('build', 2), ('embed', 3)) s(step, ordinal) where step not in (select case event_type when 'click' then 'plan' when 'view' then 'parse' else 'other' end from events) order by ordinal limit 1""")
def resume_step(spark, d):
    log = load(spark, d, "events").select(F.when(F.col("event_type") == "click", "plan").when(F.col("event_type") == "view", "parse").otherwise("other").alias("step"), F.lit("succeeded").alias("status"))
    return snapshot.resume_point(spark.createDataFrame([("plan", 0), ("parse", 1), ("build", 2), ("embed", 3)], "step string, ordinal int"), log).select("step", "ordinal")


@query("""
with t as (select n_name, n_regionkey from nation), v as (select n_name from t where n_name not in ('NATION_3') and n_name not like 'NATION_1%')
select n_name, n_regionkey in (0, 1) and n_name like 'NATION%' as grounded from t where n_name in (select n_name from v)""")
def visible_objects(spark, d):
    n = load(spark, d, "nation").where(claims.visible(F.col("n_name"), [], ["NATION_3"], ["NATION_1"]))
    return n.select("n_name", claims.is_grounded(F.array(F.col("n_regionkey").cast("string")), ["0", "1"], F.array("n_name"), ["NATION", "REGION"]).alias("grounded"))
