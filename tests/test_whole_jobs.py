"""Queries reach every table and kind of edge that they are planned over."""

import os

import pytest
from pyspark.sql import functions as F

from marlgrid.plans import text_graph


def write(spark, folder, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.fixture
def graph_tables(spark, tmp_path):
    write(
        spark,
        tmp_path,
        region=("r_regionkey long, r_name string", [(1, "ASIA")]),
        nation=("n_nationkey long, n_name string, n_regionkey long", [(i, f"N{i}", 1) for i in (3, 11, 17)]),
        customer=("c_custkey long, c_name string, c_nationkey long", [(4, "nation nation_3 supplier 7", 3), (5, "other", 3)]),
        supplier=("s_suppkey long, s_name string, s_nationkey long", [(7, "maker", 3)]),
        part=("p_partkey long, p_name string", [(2, "nation nation_3")]),
        orders=("o_orderkey long, o_custkey long", [(9, 4), (10, 5)]),
        documents=("doc_id long, text string", [(6, "Nation nation_3 supplier"), (8, None)]),
        pages=("page_id long, html string", [(3, "<html><body><p>nation nation_3 supplier</p></body></html>"), (4, None)]),
        embeddings=("vec_id long, embedding array<float>", [(17, [1.0, 0.0]), (28, [1.0, 0.1])]),
    )
    return str(tmp_path)


def test_graph_queries_reach_all(spark, graph_tables):
    found = {r.subject: r.via for r in text_graph.kg_search(spark, graph_tables).collect()}
    assert found["documents:6"] == found["part:2"] == "lexical" and found["order:9"] == "structural"
    sides = {r.subject: r.substrate for r in text_graph.dual_substrate(spark, graph_tables).collect()}
    assert sides["documents:6"] == "workspace" and sides["pages:3"] == "capability"
    said = {r.node: (r.source, r.text) for r in text_graph.ask_context(spark, graph_tables).collect()}
    assert said["customer:4"] == ("neighbour", "nation nation_3 supplier 7") and "order:9" in said
    walked = {r.node: r.depth for r in text_graph.bfs_two_hops(spark, graph_tables).collect()}
    assert walked == {"customer:4": 1, "customer:5": 1, "supplier:7": 1, "order:9": 2, "order:10": 2}


def test_profiles_cover_all_tables(spark):
    from marlgrid.plans import core

    folder = "/root/testdata/sf0.001"
    held = {p.removesuffix(".parquet") for p in os.listdir(folder) if p.endswith(".parquet")}
    assert set(core.PROFILED) == held
    for t, columns in core.PROFILED.items():
        plain = [f.name for f in core.load(spark, folder, t).schema if not isinstance(f.dataType, core.profile.SKIPPED)]
        assert plain == columns.split()


def test_choices_and_sides_grow_with_the_table(spark, tmp_path):
    from marlgrid.plans import core, more

    write(spark, tmp_path, part=("p_partkey long, p_brand string, p_name string, p_size int", [(i, "B", f"n{i}", 10 if i < 2500 else 30) for i in range(1, 3001)]))
    got = more.backend_choice(spark, str(tmp_path)).collect()
    assert {r.chosen for r in got} == {"n2500"} and {r.block: r.n_rejected for r in got} == {0: 1023, 1: 1024, 2: 452}
    ids = spark.range(10_000).select(core.side("id").alias("s"))
    before, after = (ids.where(c).count() for c in ("s < 60", "s >= 40"))
    assert 5700 < before < 6300 and 5700 < after < 6300


def test_small_files_are_worked_on_by_all_tasks(spark):
    """Rows from one small file are dealt before they are parsed or hashed."""
    from marlgrid.plans import checks, sources_check

    folder = "/root/testdata/sf0.001"
    for df in (text_graph.made_html_text(spark, folder), text_graph.made_heading_chunks(spark, folder), checks.claim_ids(spark, folder), sources_check.modules(spark, folder)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan and df.rdd.getNumPartitions() == 4


def test_pages_are_parsed_in_small_batches(spark):
    """What a worker holds is bounded by bytes, and not by a number of pages; whatever is kept beside a page comes along."""
    import pyarrow as pa

    from marlgrid.functions import html

    page = "<h1>Top</h1><p>" + "word " * 40_000 + "</p>"
    pages = spark.range(0, 60, 1, 1).select(F.col("id").alias("page_id"), F.lit(page).alias("html"), F.concat(F.lit("u"), "id").alias("url"))
    parsed = html.parsed_pages(pages, keep=("url",))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pylist([{"rows": b.num_rows, "bytes": b.nbytes}])

    for df in (parsed.select("page_id", "text"), html.page_chunks(parsed)):
        seen = df.mapInArrow(sizes, "rows long, bytes long").collect()
        assert len(seen) > 1 and max(r.bytes for r in seen) < 6 << 20
    assert {(r.page_id, r.url, r.n) for r in parsed.select("page_id", "url", F.length("text").alias("n")).collect()} == {(i, f"u{i}", 5 + 40_000 * 5 - 1) for i in range(60)}


def test_posts_are_parsed_once(spark):
    from marlgrid.sources import blog

    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<title>T</title><p>x y</p>").alias("html"))
    posts, chunks = blog.posts(pages)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (posts, chunks)]
    assert "Join" not in plans[0] and plans[0].count("MapInArrow") == 0 and plans[1].count("MapInArrow") == 1
    assert posts.count() == chunks.count() == 3
