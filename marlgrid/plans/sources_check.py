"""Queries of the parsing sources over files that are made of the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlgrid.operators.staging import dealt
from marlgrid.plans.core import query
from marlgrid.sources import blog, code, openapi
from marlgrid.sources.tables import load

#: A module for each supplier: {k} is its key.
MODULE = '''"""Module {k}."""
from dataclasses import dataclass
import click

@dataclass
class Thing{k}:
    """Some thing."""
    size: int

class S{k}API:
    peer: Thing{k}
    def get_{k}(self) -> Thing{k}:
        """Reads."""
    def list_{k}(self): ...
    def list_{k}_iter(self): ...
    def create_{k}(self):
        """Deprecated. Use ``S{k}API.get_{k}`` instead."""
    def _hidden(self): ...

@click.command("go")
def transpile_{k}(): ...
'''


def modules(spark, d):
    """Every seventh file can't be parsed."""
    k = F.col("s_suppkey").cast("string")
    source = F.when(F.col("s_suppkey") % 7 == 6, F.lit("def (")).otherwise(F.replace(F.lit(MODULE), F.lit("{k}"), k))
    return dealt(load(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(F.concat(F.lit("m"), k).alias("module"), source.alias("source"))


@query("""
with m as (select s_suppkey as k, 'm' || s_suppkey as module from supplier where s_suppkey % 7 <> 6)
select 'module' as kind, 'm' || s_suppkey as module, null as class_name, 'm' || s_suppkey as name, null as effect, null as phase, s_suppkey % 7 = 6 as failed from supplier
union all select 'dataclass', module, null, 'Thing' || k, null, null, false from m union all select 'field', module, 'Thing' || k, 'size', null, null, false from m union all select 'class', module, null, 'S' || k || 'API', null, null, false from m union all select 'field', module, 'S' || k || 'API', 'peer', null, null, false from m
union all select 'method', module, 'S' || k || 'API', n || k || s, e, 'unknown', false from m, (values ('get_', '', 'read'), ('list_', '', 'read'), ('list_', '_iter', 'read'), ('create_', '', 'write')) t(n, s, e)
union all select 'method', module, 'S' || k || 'API', '_hidden', 'unclassified', 'unknown', false from m union all select 'function', module, null, 'transpile_' || k, 'unclassified', 'transpile', false from m""")
def code_entities(spark, d):
    e = code.entities(modules(spark, d))
    return e.select("kind", "module", "class_name", "name", "effect", "phase", F.col("error").isNotNull().alias("failed"))


@query("""
with m as (select s_suppkey as k, 'm' || s_suppkey as module, 'S' || s_suppkey || 'API' as class_name from supplier where s_suppkey % 7 <> 6)
select 'type' as link, module, class_name, 'peer' as name, 'Thing' || k as target from m union all select 'type', module, class_name, 'get_' || k, 'Thing' || k from m union all select 'pages', module, class_name, 'list_' || k, 'list_' || k || '_iter' from m
union all select 'successor', module, class_name, 'create_' || k, 'get_' || k from m union all select 'command', module, null, 'transpile_' || k, 'transpile' from m union all select 'public', module, class_name, n || k || s, null from m, (values ('get_', ''), ('list_', ''), ('list_', '_iter'), ('create_', '')) t(n, s)""")
def code_links(spark, d):
    """Types, paging twins, successors, commands and public methods of the same module and class."""
    from marlgrid.operators.staging import cut

    e = cut(code.entities(modules(spark, d)))
    row = lambda df, link, target: df.select(F.lit(link).alias("link"), "module", "class_name", "name", target.alias("target"))
    out = row(code.resolved_types(e), "type", F.col("target")).unionByName(row(code.paginated_peers(e), "pages", F.col("peer")))
    out = out.unionByName(row(code.deprecation_successors(e), "successor", F.col("successor"))).unionByName(row(code.commands(e), "command", F.col("phase")))
    return out.unionByName(row(code.public_methods(e), "public", F.lit(None).cast("string")))


#: An API description for each nation; {k} is its key.
API = """{"paths": {"/api/2.0/n{k}/list": {"get": {"operationId": "List{k}", "x-effect-class": "read-only", "responses": {"200": {"schema": {"$ref": "#/components/schemas/Page{k}"}, "also": [{"$ref": "#/components/schemas/Item"}, {"$ref": "#/components/schemas/Item"}]}}}, "summary": "x"},
 "/api/n{k}/{id}": {"post": {"x-effect-class": "mutating"}}}, "components": {"schemas": {"Page{k}": {"items": {"$ref": "#/components/schemas/Item"}}, "Item": {}}, "securitySchemes": {"oauth{k}": {}}}}"""


@query("""
with n as (select n_nationkey as k, 'https://x/workspace/n/' || n_nationkey as source_url from nation), g as (select * from n where k % 6 <> 5)
select 'error' as kind, source_url, null as method, null as path, null as name, null as effect, '' as refs from n where k % 6 = 5 union all select 'operation', source_url, 'GET', '/api/2.0/n' || k || '/list', 'List' || k, 'read', 'Page' || k || ',Item' from g
union all select 'operation', source_url, 'POST', '/api/n' || k || '/{id}', 'post_api_n' || k || '_id', 'write', '' from g union all select 'schema', source_url, null, null, 'Page' || k, null, 'Item' from g union all select 'schema', source_url, null, null, 'Item', null, '' from g union all select 'security', source_url, null, null, 'oauth' || k, null, '' from g""")
def api_descriptions(spark, d):
    k = F.col("n_nationkey").cast("string")
    docs = load(spark, d, "nation").select(F.concat(F.lit("https://x/workspace/n/"), k).alias("source_url"), F.when(F.col("n_nationkey") % 6 == 5, "{not json").otherwise(F.replace(F.lit(API), F.lit("{k}"), k)).alias("body"))
    return openapi.described(docs).select("kind", "source_url", "method", "path", "name", "effect", F.array_join("refs", ",").alias("refs"))


@query("""
select o_orderkey as page_id, case when o_orderkey % 4 = 0 then null else epoch_us(date_trunc('day', o_orderdate)) // 1000 + case o_orderkey % 4 when 1 then 0 else 3600000 end end as published_at_ms, case when o_orderkey % 3 = 0 then '' when o_orderkey % 3 = 1 then 'A ' || o_custkey else 'B,A ' || o_custkey end as authors, 'T' || o_orderkey as title, 1::bigint as n_chunks from orders""")
def post_facts(spark, d):
    """The pages of a made-up blog, one for each order: dates, authors, titles, chunks."""
    o = dealt(load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey")
    date = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit('<meta content="'), day, F.lit('" property="article:published_time">'))).otherwise(F.concat(F.lit('<time datetime="'), day, F.lit('T01:00:00+05:00">x</time>')))
    a = F.concat(F.lit('<meta name="author" content=" A '), "o_custkey", F.lit(' ">'))
    who = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(a, a)).otherwise(F.concat(F.lit('<meta property="article:author" content="B">'), a))
    page = F.concat(F.lit("<html><head><title>T"), k, F.lit("</title>"), date, who, F.lit("</head><body><nav>no</nav><p>some words</p></body></html>"))
    posts, chunks = blog.posts(o.select(k.alias("page_id"), F.lit("u").alias("url"), page.alias("html")))
    n = chunks.groupBy("page_id").agg(F.count("*").alias("n_chunks"))
    return posts.join(n, "page_id").select("page_id", "published_at_ms", F.array_join("authors", ",").alias("authors"), "title", "n_chunks")
