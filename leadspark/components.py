"""Connected components of an edge table, as a DataFrame loop."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this machine serves
    only if Spark runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder, and reads from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `settle`, in compressed columns: later steps read only the columns they need. The
    collection lets Spark's cleaner drop the shuffle files that the table replaces."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all cores. A compressed file of many rows, or one of few row groups, is
    read by few tasks; costly expressions on such rows come after this."""
    n = max(rows.rdd.getNumPartitions(), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(n, key)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 80) -> DataFrame:
    """(node, label) of every node that has an edge; label is the smallest node of its component.

    Each round, every node with a smaller neighbour hooks on to its smallest one (a minimum
    that is summed on the map side, so a hub is one row for each task), hooks are followed
    twice, and the edges are drawn between what their ends hooked on to. At least half of
    the nodes leave in a round, so rounds grow with the logarithm of the nodes, and the
    edges of a round are fewer than those before.
    """
    u, v = F.col(a), F.col(b)
    left = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    left = settle(left.select(F.when(u > v, u).otherwise(v).alias("u"), F.when(u > v, v).otherwise(u).alias("v")).distinct())
    all_low = left.select(F.col("v").alias("node"))
    labels: DataFrame | None = None
    for _ in range(most_rounds):
        if not left.limit(1).count():
            break
        hook = left.groupBy("u").agg(F.min("v").alias("to"))
        for _ in range(2):
            up = hook.select(F.col("u").alias("to"), F.col("to").alias("above"))
            hook = hook.join(up, "to", "left").select("u", F.coalesce("above", "to").alias("to"))
        hook = settle(hook)
        new = hook.select(F.col("u").alias("node"), F.col("to").alias("label"))
        if labels is None:
            labels = new
        else:
            # A node that hooks on now was nobody's inner node before: it is a label, and itself one row.
            step = labels.join(hook.withColumnRenamed("u", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = settle(step.unionByName(new.join(labels.select("node"), "node", "left_anti")))
        high = left.join(hook, "u").select(F.col("to").alias("x"), "v")
        both = high.join(hook.select(F.col("u").alias("v"), F.col("to").alias("y")), "v", "left").select("x", F.coalesce("y", "v").alias("y"))
        both = both.where("x <> y").select(F.when(F.col("x") > F.col("y"), F.col("x")).otherwise(F.col("y")).alias("u"), F.when(F.col("x") > F.col("y"), F.col("y")).otherwise(F.col("x")).alias("v"))
        left = settle(both.distinct())
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return all_low.select("node", F.col("node").alias("label"))
    roots = all_low.distinct().join(labels.select("node"), "node", "left_anti")
    return labels.unionByName(roots.select("node", F.col("node").alias("label")))
