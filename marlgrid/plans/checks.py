"""Queries of evaluation and validation operators over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlgrid.functions import text
from marlgrid.operators import evaluate, rules
from marlgrid.operators.relational import optional, within_days
from marlgrid.operators.staging import dealt
from marlgrid.plans.core import MS, NOW_MS, query
from marlgrid.sources import urls
from marlgrid.sources.tables import events, load


@query("""
with r as (select doc_id, lang, doc_id % 700 as subject_id, case doc_id % 5 when 0 then null when 1 then [] else ['click', '"k": 4'] end as expected from documents),
e as (select user_id as subject_id, event_type || ' ' || props as event, props as first, event_type <> 'error' as done, row_number() over (partition by user_id order by ts desc, event_type || ' ' || props desc) as n from events),
j as (select lang, event is not null as scored, event is not null and expected is not null and (len(expected) = 0 or contains(event, 'click') or contains(event, '"k": 4')) as hit, event is not null and expected is not null and (len(expected) = 0 or contains(first, 'click') or contains(first, '"k": 4')) as top, event is not null and coalesce(done, false) as done from r left join e on e.subject_id = r.subject_id and n = 1)
select lang, count(*) as n, count(*) filter (where scored) as scored, round_even(count(*) filter (where hit) / count(*) filter (where scored), 4) as hit_rate, round_even(count(*) filter (where top) / count(*) filter (where scored), 4) as top1_rate, round_even(count(*) filter (where done) / count(*) filter (where scored), 4) as completion_rate from j group by 1""")
def runtime_metrics(spark, d):
    key = F.col("doc_id") % 5
    strings = F.array().cast("array<string>")
    r = load(spark, d, "documents").select("lang", (F.col("doc_id") % 700).alias("subject_id"), F.when(key == 1, strings).when(key > 1, F.array(F.lit("click"), F.lit('"k": 4'))).alias("expected"))
    e = events(spark, d).select(F.col("user_id").alias("subject_id"), F.col("ts_ms").alias("created_at_ms"), F.concat_ws(" ", "event_type", "props").alias("event"), F.array("props", "event_type").alias("evidence"), (F.col("event_type") != "error").alias("completed"))
    return evaluate.runtime_metrics(r, e, ["lang"])


@query(f"""
select 'live-' || event_id as record_id, props as inputs, event_id % 3 = 0 as traced, event_type as runtime_status, {MS} as created_at_ms from events where {MS} between {NOW_MS} - 12 * 3600000 and {NOW_MS} and event_id % 3 > 0 order by {MS} desc, event_id desc limit 60""")
def trace_records(spark, d):
    e = events(spark, d).select("event_id", F.col("user_id").alias("subject_id"), "user_id", F.col("event_type").alias("status"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("t"), "event_id")).otherwise("").alias("trace_id"), F.col("props").alias("inputs"), F.lit("").alias("outputs"), F.array("event_type").alias("evidence"), F.col("ts_ms").alias("created_at_ms"))
    s = evaluate.sampled_traces(e, NOW_MS, 12, 60, require_trace=True)
    return s.select("record_id", "inputs", (F.col("source.trace_id") == "").alias("traced"), F.col("tags")["runtime_status"].alias("runtime_status"), "source.created_at_ms")


@query("""
with c as (select count(*) as n, count(*) filter (where p_size < 3 or p_name like 'cold%') as bad from part)
select 'count' as "check", case when n >= 1000000 then 1.0 else 0.0 end::double as score, case when n >= 1000000 then '' else 'CLAIM_COUNT_BELOW_MIN' end as code, n from c union all select 'shape', case when bad = 0 then 1.0 else round_even(1 - bad / n, 4) end, case when bad = 0 then '' else 'CLAIM_SHAPE_INVALID' end, bad from c""")
def claim_checks(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("predicate"), F.when(F.col("p_size") >= 3, "v").alias("value_json"), F.lit("me").alias("emitted_by"), F.when(F.col("p_name").startswith("cold"), "").otherwise("s").alias("signature_hex"))
    return evaluate.claim_checks(p, 1_000_000)


@query("""
select doc_id, concat_ws(',', case when doc_id % 7 = 0 then 'EMPTY_INPUTS' end, case when doc_id % 5 = 0 then 'EMPTY_EXPECTATION' end, case when lang = 'fr' or doc_id % 11 = 0 then 'BAD_SOURCE' end) as codes from documents""")
def record_validation(spark, d):
    i = F.col("doc_id")
    m = F.create_map
    none = F.lit(None).cast("map<string,string>")
    r = load(spark, d, "documents").select(
        "doc_id", F.when(i % 7 > 0, m(F.lit("q"), F.lit("x"))).alias("inputs"), m(F.lit("guidelines"), F.when(i % 5 > 0, "g").otherwise(""), F.lit("other"), F.lit("")).alias("expectations"),
        F.when(F.col("lang") == "fr", m(F.lit("robot"), F.lit("x"))).when(i % 11 == 0, m(F.lit("human"), F.lit("x"), F.lit("trace"), F.lit("y"))).when(i % 2 == 0, m(F.lit("trace"), F.lit("y"))).otherwise(none).alias("source"),
    )
    good, bad = evaluate.validated_records(r)
    return good.select("doc_id", F.lit("").alias("codes")).unionByName(bad.select("doc_id", "codes"))


@query("""
with d as (select p_partkey, 'i' || p_partkey as name from part)
select name, case when p_partkey % 4 = 0 then 'missing' else 'mismatch' end as problem, case when p_partkey % 4 = 0 then '' else concat_ws(';', case when p_partkey % 3 = 0 then 'endpoint=e:f' end, case when p_partkey % 5 = 0 then 'dimension=8:16' end, case when p_partkey % 7 = 0 then 'text=string:-' end) end as detail from d where p_partkey % 4 = 0 or p_partkey % 3 = 0 or p_partkey % 5 = 0 or p_partkey % 7 = 0""")
def index_drift(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("i"), k).alias("name")
    part = load(spark, d, "part")
    declared = part.select(name, F.lit("e").alias("endpoint"), F.lit(8).alias("dimension"), F.lit("id").alias("primary_key"), F.create_map(F.lit("id"), F.lit("string"), F.lit("text"), F.lit("string")).alias("columns"))
    columns = F.when(k % 7 == 0, F.create_map(F.lit("id"), F.lit("string"))).otherwise(F.create_map(F.lit("id"), F.lit("string"), F.lit("text"), F.lit("string"), F.lit("more"), F.lit("int")))
    observed = part.where(k % 4 > 0).select(name, F.when(k % 3 == 0, "f").otherwise("e").alias("endpoint"), F.when(k % 5 == 0, 16).otherwise(8).alias("dimension"), F.lit("id").alias("primary_key"), columns.alias("columns"))
    return evaluate.index_drift(declared, observed)


@query("""
with o as (select o_orderkey as step_id, o_custkey as plan_id, o_custkey % 4 as s, case o_orderstatus when 'F' then 'table' when 'O' then 'model_serving_endpoint' else 'odd' end as artifact, o_orderkey % 6 = 0 as unskilled, o_orderkey % 9 = 0 as empty from orders),
f as (select plan_id, step_id, 'STEP_SKILL_ID_MISSING' as code from o where unskilled union all select plan_id, step_id, 'ARTIFACT_KIND_NOT_ALLOWED' from o where s = 3 or artifact = 'odd' or (s = 2 and artifact <> 'table') union all select plan_id, step_id, 'STEP_INPUTS_MISSING' from o where empty
 union all select plan_id, step_id, 'DEPLOY_INPUT_MISSING:' || k from o, (values ('endpoint_name'), ('model_full_name'), ('alias')) n(k) where artifact = 'model_serving_endpoint' and (empty or k <> 'alias'))
select plan_id, cast(step_id as varchar) as step_id, code from f union all select distinct plan_id, null, 'STRATEGY_REQUIRES_SKILL_BUILDER' from o where s = 3 union all select c_custkey, null, 'ARTIFACT_STEPS_MISSING' from customer where c_custkey not in (select plan_id from o)""")
def artifact_findings(spark, d):
    o = load(spark, d, "orders")
    key = F.col("o_orderkey")
    artifact = F.when(F.col("o_orderstatus") == "F", "table").when(F.col("o_orderstatus") == "O", "model_serving_endpoint").otherwise("odd")
    inputs = F.when(key % 9 > 0, F.create_map(F.lit("alias"), F.lit("champion")))
    step = F.struct(key.cast("string").alias("step_id"), F.when(key % 6 > 0, "s").otherwise("").alias("skill_id"), artifact.alias("artifact"), inputs.alias("inputs"))
    steps = o.groupBy(F.col("o_custkey").alias("plan_id")).agg(F.collect_list(step).alias("steps"))
    plans = load(spark, d, "customer").select(F.col("c_custkey").alias("plan_id"), (F.col("c_custkey") % 4).alias("strategy")).join(steps, "plan_id", "left")
    allowed = spark.createDataFrame([(s, a) for s in (0, 1) for a in ("table", "model_serving_endpoint")] + [(2, "table")], "strategy int, artifact string")
    return rules.validated_steps(plans, allowed)


@query("""
with t as (select item_id, item_id % 3 as k, text from benchmark)
select item_id, trim(case k when 0 then regexp_replace(text, '\\s+', ' ', 'g') when 1 then regexp_replace(text, '\\s+', ' ', 'g') else regexp_replace(text, '\\s+', ' ', 'g') end) as answer, case k when 0 then 'x = ' || item_id when 1 then 'y = 1' || chr(10) || chr(10) || 'z = 2' else '' end as code from t""")
def answer_parts(spark, d):
    said = F.trim(F.regexp_replace("text", r"\s+", " "))
    k = F.col("item_id") % 3
    headed = F.concat(F.lit("## Explanation\n\n"), said, F.lit("\n\n## Code\n```python\nx = "), F.col("item_id").cast("string"), F.lit("\n```\n"))
    fenced = F.concat(said, F.lit("\n```py\ny = 1\n```\n```\nz = 2\n```"))
    t = load(spark, d, "benchmark").select("item_id", text.answer_parts(F.when(k == 0, headed).when(k == 1, fenced).otherwise(said)).alias("p"))
    return t.select("item_id", "p.answer", "p.code")


@query("""
select o_orderstatus, count(*) as n, min(o_orderkey) as first_key from orders where o_orderdate >= timestamp '1998-06-01' - interval 90 days and o_orderdate <= timestamp '1998-06-01' group by 1""")
def recent_orders(spark, d):
    """An interval window with two conditions that are given and one that isn't."""
    today = F.lit("1998-06-01").cast("timestamp_ntz")
    o = optional(load(spark, d, "orders"), within_days("o_orderdate", 90, today), None)
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""
with a as (select conv_id, list(role order by turn, role) as r from conversations group by 1) select conv_id, array_to_string(list_filter(['user', 'assistant', 'system', 'tool'], lambda x: list_contains(r, x)), ',') as roles, len(list_distinct(r)) as n from a""")
def role_sets(spark, d):
    """Each conversation's roles in order of first appearance, told in a fixed order."""
    r = load(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("r"))
    once = text.ordered_unique("r")
    known = F.filter(F.array(*[F.lit(x) for x in ("user", "assistant", "system", "tool")]), lambda x: F.array_contains(once, x))
    return r.select("conv_id", F.array_join(known, ",").alias("roles"), F.size(once).cast("long").alias("n"))


@query("""
with r as (select user_id as run_id, bool_or(event_type = 'error') as failed from events group by 1), q as (select distinct user_id as run_id from events where value > 150)
select r.run_id, case when failed and q.run_id is null then 0.0 else 1.0 end::double as score, case when failed and q.run_id is null then 'SILENT_FAILURE_DETECTED' else '' end as code from r left join q on q.run_id = r.run_id""")
def silent_failures(spark, d):
    e = load(spark, d, "events")
    runs = e.groupBy(F.col("user_id").alias("run_id")).agg(F.bool_or(F.col("event_type") == "error").alias("failed"))
    return evaluate.silent_failures(runs, e.where("value > 150").select(F.col("user_id").alias("run_id")))


@query("""
with u as (select page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+', '') as bare from pages)
select page_id, coalesce(host in ('example.com', 'www.example.com') and len(parts) > 1 and parts[1] = 'en' and lower(parts[-1]) not in ('sitemap.xml', 'rss.xml', 'feed.xml', 'atom.xml', 'feed', 'rss') and not (len(parts) = 3 and parts[2] = 'category') and not (starts_with(bare, 'en/1/') or bare = 'en/1'), false) as post from u""")
def blog_posts(spark, d):
    return load(spark, d, "pages").select("page_id", urls.is_post("url", "example.com", "en", ["en/1"]).alias("post"))


@query(r"""
with p as (select p_partkey, 'part:' || p_partkey as subject, p_brand as predicate, p_name || ' "' || p_type || '"' as value, case when p_size > 25 then 'o' || p_size else '' end as object_ref from part)
select p_partkey, 'wkg:' || substr(sha256('{"object_ref":"' || object_ref || '","predicate":"' || predicate || '","subject":"' || subject || '","value_json":"' || replace(value, '"', '\"') || '"}'), 1, 24) as claim_id, subject || ' ' || predicate || ' ' || value || ' None' as claim_text from p""")
def claim_ids(spark, d):
    p = dealt(load(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey")
    value = F.concat("p_name", F.lit(' "'), "p_type", F.lit('"'))
    subject = F.concat(F.lit("part:"), "p_partkey")
    fields = {"subject": subject, "predicate": F.col("p_brand"), "value_json": value, "object_ref": F.when(F.col("p_size") > 25, F.concat(F.lit("o"), "p_size")).otherwise("")}
    return p.select("p_partkey", text.claim_id(fields).alias("claim_id"), text.claim_text(subject, F.col("p_brand"), value, F.lit(None).cast("string"), "None").alias("claim_text"))


@query("""
select s_suppkey, case when s_suppkey % 2 = 0 then 'Supplier ' || s_name || ' exists.' else s_name || ' owes ' || s_nationkey || '.' end as card, regexp_replace(replace(lower('_' || replace(s_name, '#', '_X_') || '_'), '_', '-'), '^-+|-+$', '', 'g') as minted,
 case s_suppkey % 5 when 0 then 'read' when 1 then 'write' when 2 then 'unclassified' else 'odd' || s_suppkey end as effect, sha256('m' || '|' || s_name || '|' || s_nationkey || '|') as feature_hash, concat_ws(',', case when s_suppkey % 3 = 0 then 'target' end, 'split') as missing from supplier""")
def card_fields(spark, d):
    """Cards, minted ids, spellings of effects, feature hashes and missing inputs of suppliers."""
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey")
    card = text.card(F.when(k % 2 == 0, "EXISTS").otherwise("OWES"), F.col("s_name"), F.col("s_nationkey").cast("string"), {"EXISTS": "Supplier {subject} exists.", "OWES": "{subject} owes {value}."})
    minted = text.minted_id(F.concat(F.lit("_"), F.replace("s_name", F.lit("#"), F.lit("_X_")), F.lit("_")))
    effect = text.normal_effect(F.when(k % 5 == 0, "Read-Only").when(k % 5 == 1, "mutating").when(k % 5 == 2, "TBD").otherwise(F.concat(F.lit("odd"), k)))
    missing = rules.missing_inputs(("target", "key", "split"), {"target": F.when(k % 3 > 0, "t").otherwise(" "), "key": F.col("s_name")})
    return s.select("s_suppkey", card.alias("card"), minted.alias("minted"), effect.alias("effect"), rules.feature_hash(F.lit("m"), F.col("s_name"), F.col("s_nationkey").cast("string"), F.lit(None).cast("string")).alias("feature_hash"), missing.alias("missing"))


@query("""
select o_orderkey as claim_id, o_orderstatus as value from orders where o_orderkey % 5 > 0 union all select o_orderkey, 'new' from orders where o_orderkey % 5 = 0""")
def claim_merge(spark, d):
    from marlgrid.sources.files import merge_current

    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderstatus").alias("value"))
    return merge_current(o, o.where("claim_id % 5 = 0").withColumn("value", F.lit("new")))


@query("""select doc_id, lang as snapshot_id from documents where lang = 'de'""")
def active_snapshot(spark, d):
    """Rows of the promoted snapshot: its pointer is written, then read by the filter."""
    from marlgrid.operators import snapshot
    from marlgrid.operators.staging import shared_folder

    path = f"{shared_folder(spark)}/pointer-{uuid.uuid4().hex}"
    gates = spark.createDataFrame([("de", g, True) for g in ("persist", "vector", "smoke")], "snapshot_id string, gate string, ok boolean")
    snapshot.promote(spark, "de", gates, path, NOW_MS)
    return snapshot.active_rows(load(spark, d, "documents").select("doc_id", F.col("lang").alias("snapshot_id")), path)


@query("""
with r as (select o_orderkey % 97 as name, o_custkey % 3 as version, o_orderkey, 'https://x/workspace/' || case when o_custkey % 2 = 0 then 'jobs_21' else 'jobs' end || '/' || o_orderkey as url, o_custkey % 2 = 0 as versioned from orders),
k as (select *, row_number() over (partition by version, name order by versioned desc, url desc) as n from r)
select version as api_version, name, url as source_url from k where n = 1""")
def best_documents(spark, d):
    from marlgrid.sources import openapi

    o = load(spark, d, "orders")
    url = F.concat(F.lit("https://x/workspace/"), F.when(F.col("o_custkey") % 2 == 0, "jobs_21").otherwise("jobs"), F.lit("/"), "o_orderkey")
    ops = o.select((F.col("o_custkey") % 3).alias("api_version"), F.lit("GET").alias("method"), F.lit("/p").alias("path"), (F.col("o_orderkey") % 97).alias("name"), url.alias("source_url"))
    return openapi.best_documents(ops, ("current",)).select("api_version", "name", "source_url")
