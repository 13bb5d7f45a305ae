"""Queries of the text, routing, graph and retrieval operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlgrid.functions import html, text
from marlgrid.operators import graph, retrieval, snapshot
from marlgrid.operators.staging import dealt
from marlgrid.plans.core import SQL
from marlgrid.plans.core import query as _query
from marlgrid.sources import urls
from marlgrid.sources.tables import derived_edges, edges_sql, load

query = _query
#: The sites of the pages table.
CORPORA = (urls.Corpus("example.com", "com", 1, ("en", "de", "fr", "es")), urls.Corpus("example.net", "net", 1), urls.Corpus("example.org", "org", 1))
DENIED = ("7", "42")
#: Every kind of edge, the orders too.
WHOLE = ("nation_of", "customer_of", "supplier_of", "order_of")


@query("""
select doc_id, substr(sha256('wanted' || chr(0) || text || chr(0)), 1, 16) as content_hash, substr(sha256(concat_ws(chr(10), cast(doc_id as varchar), text)), 1, 16) as extension_hash,
 substr(sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 1, 16) as query_hash, substr(sha256('u' || doc_id), 1, 24) as document_id from documents""")
def content_hashes(spark, d):
    b = load(spark, d, "documents")
    return b.select("doc_id", text.content_hash(F.lit("wanted"), "text").alias("content_hash"), text.joined_hash(F.col("doc_id").cast("string"), "text").alias("extension_hash"), text.query_hash("text").alias("query_hash"), text.document_id(F.concat(F.lit("u"), "doc_id")).alias("document_id"))


@query("""
with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents), s as (select doc_id, w, unnest(range(0, case when len(w) = 0 then 0 else greatest(1, cast(ceil((len(w) - 80) / 720.0) as bigint)) end)) as i from w)
select doc_id, i as chunk_index, i * 720 as start, sha256(array_to_string(w[i * 720 + 1 : i * 720 + 800], ' ')) as text_sha256 from s""")
def fixed_chunks(spark, d):
    c = load(spark, d, "documents").select("doc_id", F.explode(text.fixed_chunks("text")).alias("c"))
    return c.select("doc_id", "c.chunk_index", "c.start", F.sha2("c.text", 256).alias("text_sha256"))


@query("""
with w as (select doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) as n from documents)
select doc_id, cast(n as bigint) as n_words, greatest(1, cast(round_even(n / 0.75, 0) as bigint)) as by_words, cast(ceil(length(text) / 4) as bigint) as by_chars from w""")
def token_estimates(spark, d):
    w = load(spark, d, "documents").withColumn("n", text.word_count("text"))
    return w.select("doc_id", F.col("n").alias("n_words"), text.token_estimate("n").alias("by_words"), text.token_estimate_chars("text").alias("by_chars"))


@query("""
with q as (select list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as q from benchmark where item_id = 3),
t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as t, q from documents, q),
s as (select doc_id, round(case when len(t) = 0 or len(q) = 0 then 0 else len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) end, 6) as score from t)
select doc_id, cast(score as double) as score from s where score > 0 order by score desc, doc_id limit 50""")
def jaccard_topk(spark, d):
    q = load(spark, d, "benchmark").where("item_id = 3").select(text.token_set("text").alias("q"))
    s = load(spark, d, "documents").select("doc_id", text.token_set("text").alias("t")).join(F.broadcast(q))
    return s.select("doc_id", F.round(text.jaccard(F.col("t"), F.col("q")), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(50)


#: Names that parts are given, with what their leading verbs say.
NAMES = (("get_or_create", "read", "unknown"), ("import_", "write", "unknown"), ("list_{k}", "read", "unknown"), ("frobnicate_{k}", "unclassified", "unknown"), ("Delete_all_{k}", "write", "unknown"), ("assess_source", "unclassified", "assessment"), ("compare_{k}", "unclassified", "validation"), ("Application{k}", "unclassified", "unknown"), ("transpile__{k}", "unclassified", "transpile"), ("parse_", "unclassified", "analysis"), ("", "unclassified", "unknown"))


@query("with n(i, form, effect, phase) as (values " + ", ".join(f"({i}, '{f}', '{e}', '{p}')" for i, (f, e, p) in enumerate(NAMES)) + """)
select p_partkey, replace(form, '{k}', p_partkey::varchar) as name, effect, phase from part join n on i = p_partkey % 11""")
def verb_classes(spark, d):
    k = F.col("p_partkey")
    form = F.element_at(F.array(*[F.lit(f) for f, _, _ in NAMES]), (k % len(NAMES) + 1).cast("int"))
    n = load(spark, d, "part").select("p_partkey", F.replace(form, F.lit("{k}"), k.cast("string")).alias("name"))
    return n.select("p_partkey", "name", text.effect_class("name").alias("effect"), text.phase("name").alias("phase"))


URL_SQL = """
with u as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) as host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path from pages),
p as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from u),
c as (select *, case when host = 'example.com' or host like '%.example.com' then case when parts[1] in ('en', 'de', 'fr', 'es') then parts[1] end when host = 'example.net' or host like '%.example.net' then 'net' when host = 'example.org' or host like '%.example.org' then 'org' end as corpus,
 case when host similar to '(.*\\.)?example\\.(com|net|org)' then parts[2] || '/' end as section from p)
"""


@query(URL_SQL + """select page_id, corpus, section, coalesce(corpus is not null and len(parts) > 0 and lower(parts[-1]) not in ('index', 'index.html', 'index.htm') and not path like '%/' and coalesce(parts[2] not in ('7', '42'), true), false) as skill_bearing,
 case when path like '/en/%' then 'english' when path like '/de/1%' then 'german-one' when path like '/de/%' then 'german' else 'other' end as routed from c""")
def url_routing(spark, d):
    p = load(spark, d, "pages")
    routed = urls.routed(urls.path("url"), [("/en/", "english"), ("/de/1", "german-one"), ("/de/", "german")], "other")
    return p.select("page_id", urls.corpus_name("url", CORPORA).alias("corpus"), urls.section_root("url", CORPORA).alias("section"), urls.is_skill_bearing("url", CORPORA, DENIED).alias("skill_bearing"), routed.alias("routed"))


@query("""
with o as (select o_orderkey, o_orderkey % 8 as k, epoch_us(date_trunc('day', o_orderdate)) // 1000 as day from orders)
select o_orderkey, cast(case k when 0 then day when 1 then day + 11045000 when 2 then day + 11040000 when 3 then day + 11045000 when 4 then day else -1 end as bigint) as ms from o""")
def iso_dates(spark, d):
    """Each order's day in one of eight forms, three of which are no moment."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 8
    forms = F.when(k == 0, day)
    for i, end in enumerate(("T03:04:05Z", " 03:04+05:00", "T03:04:05.678-0800")):
        forms = forms.when(k == i + 1, F.concat(day, F.lit(end)))
    forms = forms.when(k == 4, F.concat(F.lit(" "), day, F.lit(" "))).when(k == 5, F.concat(F.substring(day, 1, 4), F.lit("-02-30"))).when(k == 6, F.concat(day, F.lit("T25:00"))).otherwise("nonsense")
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(text.iso_millis(forms), F.lit(-1)).alias("ms"))


@query()
def html_text(spark, d):
    p = html.parsed_pages(load(spark, d, "pages"))
    return p.select("page_id", "title", "text", F.size("headings").cast("long").alias("n_headings"), "error")


@query()
def heading_chunks(spark, d):
    return html.page_chunks(html.parsed_pages(load(spark, d, "pages")), target_tokens=200, overlap_tokens=20)


MADE = "<html><head><title> T{k} </title><style>no</style></head><body><nav>no</nav><h1 id='a'>Top {k}</h1><p>{a}</p><script>no()</script><h2>Sub  {k}</h2><p>{b} &amp; {n}</p><footer>no</footer></body></html>"
_RANGE = "array_to_string(list_transform(range({0}, {1}), lambda i: 'w' || i), ' ')"


def made_pages(spark, d) -> DataFrame:
    """A page of known words for each customer."""
    said = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    html_ = F.replace(F.lit(MADE.replace("{a}", said(1, 71)).replace("{b}", said(71, 151))), F.lit("{k}"), F.col("c_custkey").cast("string"))
    return dealt(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select(F.col("c_custkey").alias("page_id"), F.replace(html_, F.lit("{n}"), F.col("c_mktsegment")).alias("html"))


@query(f"""
select c_custkey as page_id, 'T' || c_custkey as title, 'Top ' || c_custkey || chr(10) || chr(10) || {_RANGE.format(1, 71)} || chr(10) || chr(10) || 'Sub ' || c_custkey || chr(10) || chr(10) || {_RANGE.format(71, 151)} || ' & ' || c_mktsegment as text, 2::bigint as n_headings, null::varchar as error from customer""")
def made_html_text(spark, d):
    p = html.parsed_pages(made_pages(spark, d))
    return p.select("page_id", "title", "text", F.size("headings").cast("long").alias("n_headings"), "error")


@query(f"""
with w as (select c_custkey as k, list_concat(list_concat(['Top', c_custkey::varchar], list_transform(range(1, 71), lambda i: 'w' || i)), list_concat(['Sub', c_custkey::varchar], list_concat(list_transform(range(71, 151), lambda i: 'w' || i), ['&', c_mktsegment]))) as w from customer)
select k as page_id, i as chunk_index, i * 60 as starts_at_word, case i when 2 then 48 else 100 end::bigint as token_count, 'Top ' || k || case i when 2 then '|Sub  ' || k else '' end as headings_path, array_to_string(w[i * 60 + 1 : i * 60 + 75], ' ') as chunk_text from w, range(3) r(i)""")
def made_heading_chunks(spark, d):
    c = html.page_chunks(html.parsed_pages(made_pages(spark, d)), target_tokens=100, overlap_tokens=20)
    return c.withColumn("headings_path", F.array_join("headings_path", "|"))


@query()
def docs_index(spark, d):
    """Skill-bearing pages, parsed and chunked, with counts by section."""
    p = load(spark, d, "pages").where(urls.is_skill_bearing("url", CORPORA, DENIED))
    section = p.select("page_id", urls.corpus_name("url", CORPORA).alias("corpus"))
    chunks = html.page_chunks(html.parsed_pages(p))
    return chunks.join(section, "page_id").groupBy("corpus").agg(F.countDistinct("page_id").alias("n_pages"), F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))


def _edges(spark, d, kinds=WHOLE) -> DataFrame:
    return derived_edges(spark, d, kinds).select("src", "dst", F.col("kind").alias("predicate"), "kind", "weight", F.xxhash64("src", "kind", "dst").alias("ordinal"))


@query(f"""
with e as ({edges_sql(WHOLE)}), h1 as (select dst as node, 1::bigint as depth, kind as predicate, 1.0::double as score from e where src = 'nation:3' and dst <> 'nation:3'),
h2 as (select e.dst as node, 2::bigint as depth, e.kind as predicate, 0.5::double as score from h1 join e on e.src = h1.node where e.dst not in (select node from h1))
select * from h1 union all select distinct * from h2""")
def bfs_two_hops(spark, d):
    seeds = spark.createDataFrame([("nation:3",)], "seed string")
    return graph.bfs(_edges(spark, d), seeds).select("node", "depth", "predicate", "score")


@query(f"""
with recursive e as (select src, dst, kind from ({edges_sql(WHOLE)})), b as (select src, dst, kind from e union all select dst, src, kind from e),
w(node, depth, kind) as (select 'supplier:7', 0, '' union select b.dst, w.depth + 1, b.kind from w join b on b.src = w.node where w.depth < 4),
r as (select node, depth, kind, row_number() over (partition by node order by depth, kind) as n from w where node <> 'supplier:7')
select node, cast(depth as bigint) as depth, kind as relation from r where n = 1 order by depth, node limit 200""")
def neighbours_4(spark, d):
    return graph.neighbours(_edges(spark, d), "supplier:7")


@query(f"""
with e as (select src, dst, weight from ({edges_sql(WHOLE)})), b as (select * from e union all select dst, src, weight from e),
h0 as (select unnest(['nation:3', 'supplier:7']) as node, 1.0::double as s),
h1 as (select b.dst as node, max(s * 0.85 * weight) as s from h0 join b on b.src = node group by 1), h2 as (select b.dst as node, max(s * 0.85 * weight) as s from h1 join b on b.src = node group by 1),
h3 as (select b.dst as node, max(s * 0.85 * weight) as s from h2 join b on b.src = node group by 1), h4 as (select b.dst as node, max(s * 0.85 * weight) as s from h3 join b on b.src = node group by 1),
a as (select * from h1 union all select * from h2 union all select * from h3 union all select * from h4)
select node, round(max(s), 9) as score from a where node not in (select node from h0) group by node order by max(s) desc, node limit 20""")
def decayed_walk(spark, d):
    seeds = spark.createDataFrame([("nation:3",), ("supplier:7",)], "node string")
    return graph.decayed_walk(_edges(spark, d), seeds).select("node", F.round("score", 9).alias("score"))


def _ppr_sql(rounds: int) -> str:
    parts = [f"e as materialized (select src, dst from ({edges_sql(WHOLE)}))", "n as materialized (select distinct node from (select src as node from e union all select dst from e))", "c as (select count(*) as n from n)", "o as materialized (select src, count(*) as k from e group by 1)", "r0 as (select node, 1.0 / c.n as s from n, c)"]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(f"r{i} as materialized (select n.node, 0.85 * (coalesce(g.s, 0) + (select coalesce(sum(x.s), 0) from {p} x where x.node not in (select src from o)) / c.n) + case when n.node = 'region:1' then 0.15 else 0 end as s from n cross join c left join (select e.dst as node, sum({p}.s / o.k) as s from {p} join o on o.src = {p}.node join e on e.src = {p}.node group by 1) g on g.node = n.node)")
    return f"with {', '.join(parts)} select node, round(s, 8) as score from r{rounds}"


@query(_ppr_sql(4))
def ppr_scores(spark, d):
    p = spark.createDataFrame([("region:1", 1.0)], "node string, mass double")
    return graph.ppr(_edges(spark, d), p, rounds=4, fixed=True).select("node", F.round("score", 8).alias("score"))


def claims_of(spark, d, table: str, key: str, value: str) -> DataFrame:
    """A table's rows as claims about its keys."""
    t = load(spark, d, table)
    return t.select(F.concat(F.lit(f"{table}:c"), key).alias("claim_id"), F.concat(F.lit(f"{table}:"), key).alias("subject"), F.lit("CONTENT").alias("predicate"), F.col(value).alias("value_json"), F.lit(None).cast("string").alias("metadata_json"), F.col(key).cast("long").alias("ordinal"))


def in_order(*parts: DataFrame) -> DataFrame:
    """Claims of several tables as one, by ordinal and then by part, so that no two share a place; at most 8 parts."""
    return reduce(DataFrame.unionByName, [c.withColumn("ordinal", F.col("ordinal") * 8 + i) for i, c in enumerate(parts)])


def named_claims(spark, d) -> list[DataFrame]:
    """The names of the graph's nations, suppliers and customers, and of parts."""
    names = (("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))
    return [claims_of(spark, d, *n) for n in names]


def page_claims(spark, d) -> DataFrame:
    """The parsed text of every page."""
    p = html.parsed_pages(load(spark, d, "pages")).withColumn("subject", F.concat(F.lit("pages:"), "page_id"))
    return p.select(F.concat(F.lit("pages:c"), "page_id").alias("claim_id"), "subject", F.lit("CONTENT").alias("predicate"), F.col("text").alias("value_json"), F.lit(None).cast("string").alias("metadata_json"), F.col("page_id").cast("long").alias("ordinal"))


def _search_sql(rounds: int) -> str:
    """Lexical refs, walks from the best five, and personalised ranks in so many unrolled rounds."""
    names = (("documents", "doc_id", "text"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))
    claims = " union all ".join(f"select '{t}:c' || {k} as claim_id, '{t}:' || {k} as subject, {v} as value, {k} * 8 + {i} as ordinal from {t}" for i, (t, k, v) in enumerate(names))
    parts = [
        f"cl as ({claims})",
        "tk as (select *, list_distinct(regexp_extract_all(lower(subject || ' CONTENT' || coalesce(' ' || value, '')), '[a-z0-9_]+')) as t, ['nation', 'nation_3', 'content', 'supplier', '7'] as q from cl)",
        "lx as materialized (select claim_id, subject, ordinal, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) as score from tk where len(list_intersect(t, q)) > 0 order by score desc, ordinal limit 50)",
        "tp as (select subject as seed, row_number() over (order by score desc, ordinal) as seed_rank from lx order by score desc, ordinal limit 5)",
        f"e as materialized (select src, dst, kind from ({edges_sql(WHOLE)}))",
        "h1 as (select distinct seed, dst as node, kind, 1.0::double as score from tp join e on src = seed where dst <> seed)",
        "h2 as (select seed, e.dst as node, e.kind, 0.5::double as score from h1 join e on e.src = h1.node where e.dst <> seed)",
        "st as materialized (select seed_rank, w.node as subject, w.kind as predicate, w.score from (select * from h1 union all select * from h2) w join tp on tp.seed = w.seed)",
        "bag as (select subject, 0.4 * score as m from lx union all select subject, 0.6 * score from st)",
        "ms as materialized (select subject as node, sum(m) / (select sum(m) from bag) as mass from bag group by 1)",
        "n as materialized (select node, coalesce(mass, 0) as mass from (select distinct node from (select src as node from e union all select dst from e union all select node from ms)) left join ms using (node))",
        "c as (select count(*) as n from n)",
        "o as materialized (select src, count(*) as k from e group by 1)",
        "r0 as materialized (select node, mass, 1.0 / c.n as s from n, c)",
    ]
    for i in range(1, rounds + 1):
        p = f"r{i - 1}"
        parts.append(f"r{i} as materialized (select {p}.node, mass, 0.85 * (coalesce(g.s, 0) + (select coalesce(sum(x.s), 0) from {p} x anti join o on o.src = x.node) / c.n) + 0.15 * mass as s from {p} cross join c left join (select e.dst as node, sum({p}.s / o.k) as s from {p} join o on o.src = {p}.node join e on e.src = {p}.node group by 1) g on g.node = {p}.node)")
    parts += [
        f"a as (select claim_id as ref_id, lx.subject, 'CONTENT' as predicate, 0.4 * score + 0.6 * coalesce(s, 0) as score, 'lexical' as via from lx left join r{rounds} r on r.node = lx.subject)",
        "oc as (select subject, predicate, arg_min(score, seed_rank) as score from st group by all)",
        f"b as (select 'walk:' || predicate || ':' || subject as ref_id, subject, predicate, 0.6 * (score + coalesce(s, 0)) / 2 as score, 'structural' as via from oc left join r{rounds} r on r.node = oc.subject)",
    ]
    return f"with {', '.join(parts)} select ref_id, subject, predicate, round(score, 5) as score, via from (select * from a union all select * from b where ref_id not in (select ref_id from a)) order by (select 1), score desc limit 20".replace(" order by (select 1), score desc limit 20", " u order by u.score desc, ref_id limit 20")


@query(_search_sql(70))
def kg_search(spark, d):
    """Documents, and the nations, suppliers, customers and parts of the graph, by words, ranked with their neighbourhood over every kind of edge."""
    c = in_order(claims_of(spark, d, "documents", "doc_id", "text"), *named_claims(spark, d))
    return retrieval.search("nation nation_3 content supplier 7", c, _edges(spark, d)).select("ref_id", "subject", "predicate", F.round("score", 5).alias("score"), "via")


@query()
def dual_substrate(spark, d):
    """Documents against pages, both with the names of the graph."""
    names = named_claims(spark, d)
    a = in_order(claims_of(spark, d, "documents", "doc_id", "text"), *names)
    b = in_order(*[c.withColumn("authority_weight", F.when(F.col("ordinal") % 2 == 0, 0.95)) for c in (page_claims(spark, d), *names)])
    return retrieval.dual_search("nation nation_3 content supplier", a, b, _edges(spark, d)).select("subject", "substrate", F.round("score", 6).alias("score"))


def _dual_sql(rounds: int) -> str:
    """Two substrates' lexical refs with their weights, ranked together; the walks and ranks are those of the search."""
    names = (("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"))
    side = lambda first: " union all ".join(f"select '{t}:' || {k} as subject, {v} as value, {k} * 8 + {i} as ordinal from {t}" for i, (t, k, v) in enumerate((first, *names)))
    one = lambda first, name, weight: f"select * from (select subject, ordinal, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) * {weight} as score, '{name}' as substrate, len(list_intersect(t, q)) / (len(t) + len(q) - len(list_intersect(t, q))) as plain from (select *, list_distinct(regexp_extract_all(lower(subject || ' CONTENT' || coalesce(' ' || value, '')), '[a-z0-9_]+')) as t, ['nation', 'nation_3', 'content', 'supplier'] as q from ({side(first)})) where len(list_intersect(t, q)) > 0 order by plain desc, ordinal limit 50)"
    whole = _search_sql(rounds)
    after = whole.index("tp as (")
    end = whole.index(", a as (select claim_id as ref_id")
    lx = f"lx as materialized (select * from ({one(('documents', 'doc_id', 'text'), 'workspace', '1.0')}) union all select * from ({one(('benchmark', 'item_id', 'text'), 'capability', '(case when ordinal % 2 = 0 then 0.95 else 0.85 end)')}))"
    return f"""with {lx}, {whole[after:end]}, bt as (select subject, max(score) filter (where substrate = 'workspace') as w, max(score) filter (where substrate = 'capability') as c from lx group by 1)
select subject, case when w is null then 'capability' when c is null or w >= c then 'workspace' else 'capability' end as substrate, round(0.4 * greatest(w, c) + 0.6 * coalesce(s, 0), 6) as score from bt left join r{rounds} r on r.node = bt.subject order by 0.4 * greatest(w, c) + 0.6 * coalesce(s, 0) desc, subject limit 20"""


@query(_dual_sql(70))
def dual_substrate_tables(spark, d):
    """Documents against benchmark items, both with the names of the graph."""
    names = named_claims(spark, d)
    a = in_order(claims_of(spark, d, "documents", "doc_id", "text"), *names)
    b = in_order(claims_of(spark, d, "benchmark", "item_id", "text"), *names).withColumn("authority_weight", F.when(F.col("ordinal") % 2 == 0, 0.95))
    return retrieval.dual_search("nation nation_3 content supplier", a, b, _edges(spark, d)).select("subject", "substrate", F.round("score", 6).alias("score"))


COSINE_SQL = """
with q as (select embedding as q from embeddings where vec_id = 17)
select vec_id, round(list_cosine_similarity(embedding::double[], q::double[]), 6) as score from embeddings, q order by list_cosine_similarity(embedding::double[], q::double[]) desc, vec_id limit 20"""


@query(COSINE_SQL)
def vector_topk(spark, d):
    e = load(spark, d, "embeddings")
    return retrieval.vector_top_k(e, e.where("vec_id = 17").select("embedding")).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
with q as (select embedding as q from embeddings where vec_id = 17), v as (select vec_id, list_cosine_similarity(embedding::double[], q::double[]) as score from embeddings, q order by score desc, vec_id limit 8),
h as (select 'nation:' || (vec_id % 25) as node, max(score) as score from v group by 1), h0 as (select node, 1.0::double as s from h order by score desc, node limit 5),
e as (select src, dst, weight from ({edges_sql(WHOLE)})), b as (select * from e union all select dst, src, weight from e),
h1 as (select b.dst as node, max(s * 0.85 * weight) as s from h0 join b on b.src = node group by 1), h2 as (select b.dst as node, max(s * 0.85 * weight) as s from h1 join b on b.src = node group by 1),
h3 as (select b.dst as node, max(s * 0.85 * weight) as s from h2 join b on b.src = node group by 1), h4 as (select b.dst as node, max(s * 0.85 * weight) as s from h3 join b on b.src = node group by 1),
w as (select node, max(s) as score from (select * from h1 union all select * from h2 union all select * from h3 union all select * from h4) where node not in (select node from h0) group by 1 order by score desc, node limit 15),
u as (select node, score, 0 as tier, 'hit' as source from h union all select node, score, 1, 'neighbour' from w), f as (select *, row_number() over (partition by node order by tier, score desc) as n from u),
t as (select 'nation:' || n_nationkey as node, n_name as text from nation union all select 'supplier:' || s_suppkey, s_name from supplier union all select 'customer:' || c_custkey, c_name from customer union all select 'part:' || p_partkey, p_name from part union all select 'region:' || r_regionkey, r_name from region)
select f.node, round(score, 6) as score, source, text from f left join t on t.node = f.node where n = 1 order by tier, f.score desc, f.node limit 12""")
def ask_context(spark, d):
    e = load(spark, d, "embeddings")
    hits = retrieval.vector_top_k(e, e.where("vec_id = 17").select("embedding"), 8).select(F.concat(F.lit("nation:"), F.col("vec_id") % 25).alias("node"), "score").groupBy("node").agg(F.max("score").alias("score"))
    regions = claims_of(spark, d, "region", "r_regionkey", "r_name")
    texts = in_order(*named_claims(spark, d), regions).select(F.col("subject").alias("node"), F.col("value_json").alias("text"))
    return retrieval.ask_context(hits, _edges(spark, d), texts).select("node", F.round("score", 6).alias("score"), "source", "text")


#: The baseline's queries: a fixed list, whatever the table's size.
BASELINE = (0, 17, 23, 42, 101)


@query(f"""
with b as (select vec_id as query_id, label as expected_id, 0.8::double as rate from embeddings where vec_id in {BASELINE}),
s as (select b.query_id, e.label as top_id, row_number() over (partition by b.query_id order by list_cosine_similarity(e.embedding::double[], q.embedding::double[]) desc, e.vec_id) as n from b join embeddings q on q.vec_id = b.query_id join embeddings e on e.vec_id <> b.query_id)
select count(*) as n, round(avg(case when top_id = expected_id then 1.0 else 0.0 end), 6) as hit_rate, min(rate) as threshold, avg(case when top_id = expected_id then 1.0 else 0.0 end) >= min(rate) as passed from b join s on s.query_id = b.query_id and s.n = 1""")
def smoke_hit_rate(spark, d):
    e = load(spark, d, "embeddings")
    base = e.where(F.col("vec_id").isin(*BASELINE)).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected_id"), F.lit(0.8).alias("baseline_rate"), F.col("embedding").alias("q"))
    top = retrieval.top_label(e, base.select("query_id", "q"), "label")
    return snapshot.smoke(top, base.drop("q")).select("n", F.round("hit_rate", 6).alias("hit_rate"), "threshold", "passed")


@query("""
with t as (select doc_id, text from documents), p as (select doc_id, 'meta:' || lang || '/ext:' || source as pointer from documents)
select p.doc_id, lang as meta, source as ext, regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
 lower('GET') || '_' || lower(regexp_replace(regexp_replace('/api/' || lang || '/{id}/' || source, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) as path_slug, source like 'src1%' as internal from p join documents d on d.doc_id = p.doc_id""")
def identifiers(spark, d):
    doc = load(spark, d, "documents")
    p = text.pointer_parts(F.concat(F.lit("meta:"), "lang", F.lit("/ext:"), "source"))
    return doc.select("doc_id", p["meta"].alias("meta"), p["ext"].alias("ext"), text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), text.path_slug(F.concat(F.lit("/api/"), "lang", F.lit("/{id}/"), "source"), F.lit("GET")).alias("path_slug"), text.is_internal(F.concat(F.lit("a.b."), "source"), ("src1",)).alias("internal"))


@query("""
with t as (select item_id, 'Answer: ' || text || chr(10) || '```sql' || chr(10) || 'select ' || item_id || chr(10) || '```' as t from benchmark)
select item_id, 'select ' || item_id || chr(10) as code, trim(split_part(t, '```', 1), chr(10)) as answer from t""")
def answer_code_split(spark, d):
    t = load(spark, d, "benchmark").select("item_id", F.concat(F.lit("Answer: "), "text", F.lit("\n```sql\nselect "), F.col("item_id").cast("string"), F.lit("\n```")).alias("t"))
    return t.select("item_id", F.array_join(text.code_blocks("t"), "\n").alias("code"), F.trim(text.without_code("t"), F.lit("\n")).alias("answer"))
