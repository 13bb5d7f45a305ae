"""Components against plain union-find, and hot keys in the joins that they use."""

import random

from pyspark.sql import functions as F

from marlgrid.llm.common import connected_components, table, with_least


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(3)
    star = [(500, i) for i in range(501, 900)]
    line = [(i, i + 1) for i in range(1000, 1200)]
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + star + line + [(7, 7), (899, 1200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_s_rows_are_split(spark):
    """The plan that ran has a skewed join: with the minima as a table the hub's rows go to several tasks."""
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.files.maxPartitionBytes": "64k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        rows = table(spark.range(60_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("v"), F.xxhash64("id").alias("w")).repartition(6), "hub")
        least = table(rows.groupBy("v").agg(F.min("w").alias("m")), "least")
        joined = with_least(rows, least, "v")
        assert joined.agg(F.count("*")).first()[0] == 60_000
        whole = joined.select("v", "w", "m")
        whole.write.format("noop").mode("overwrite").save()
        n = len(whole.collect())
        assert n == 60_000 and "skew=true" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
