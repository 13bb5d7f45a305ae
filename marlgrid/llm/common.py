"""What the operators share: the shared folder, tables that cut lineage, the code shipped to executors."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_ROOT = Path(__file__).resolve().parents[2]


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one under /tmp/checkpoints."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not context.master.startswith(("local[", "local,")) and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that every machine can reach")
        base = f"/tmp/checkpoints/{os.getpid()}"
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/marlgrid-{context.applicationId}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone already; the folder is then the cluster's to clean
        pass


def table(df: DataFrame, name: str, tidy: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage and survives the loss of executors.

    tidy lets Spark drop the shuffle files behind it at once, which is worth it for tables that took a large shuffle."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if folder not in _SHIPPED:
        _SHIPPED.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if tidy:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark drops the shuffle files of plans that nothing refers to
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker at once; Spark's own default is 64 MB on each side of the pipe.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once for each application, and has this session send texts in batches of BATCH_BYTES at most."""
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="marlgrid")
    path = f"{folder}/marlgrid_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((_ROOT / "marlgrid").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    context.addPyFile(path)
    atexit.register(shutil.rmtree, folder, True)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_least(rows: DataFrame, least: DataFrame, key: str) -> DataFrame:
    """rows joined to their key's row of least, which is a table of its own: both sides are plain shuffles, so that adaptive
    execution can split the rows of a hot key (it can't beside an aggregate on that key)."""
    return rows.join(least, key)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node that links reach.

    Alternating large-star and small-star steps until nothing changes, about log(n) ** 2 rounds at worst.  Each step groups on
    one endpoint, with minima taken before the shuffle, and joins the minimum back.  No neighbour list is ever collected: the
    minima are a table of their own, so that both sides of the join are plain shuffles and a hub's rows can be split.
    """
    links = table(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), name)
    while True:
        # large star: every neighbour above a node is linked to the smallest node of its neighbourhood
        both = links.select(F.col("hi").alias("v"), F.col("lo").alias("w")).unionByName(links.select(F.col("lo").alias("v"), F.col("hi").alias("w")))
        least = table(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m")), name, tidy=False)
        large = with_least(both.where("w > v"), least, "v").select(F.col("m").alias("lo"), F.col("w").alias("hi")).where("lo < hi")
        large = table(large.distinct(), name, tidy=False)
        # small star: the neighbours below a node, and the node, are linked to the smallest of them
        below = table(large.groupBy("hi").agg(F.min("lo").alias("m")), name, tidy=False)
        small = with_least(large, below, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where("lo < hi")
        links = table(small.distinct(), name)
        # done once every node above has one neighbour below, which is nobody's node above
        bad = links.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1").select("hi").unionByName(links.select("hi").join(links.select(F.col("lo").alias("hi")), "hi", "left_semi")).limit(1)
        if not bad.take(1):
            break
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
