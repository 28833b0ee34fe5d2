"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bibloom-"))
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read again: cuts lineage, survives lost executors, is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def linked(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (x, y): the least id that can be reached.

    Every round a label takes the least label of its neighbours and then that label's own label, so that rounds grow with
    the logarithm of the longest chain; both steps aggregate before they shuffle, each round is written.
    """
    both = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "links")
    label = written(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        # hook: the label of an id, and of the id it stands for, falls to the least label next to it
        near = both.join(label.select(F.col("id").alias("y"), F.col("component").alias("c")), "y").groupBy(F.col("x").alias("id")).agg(F.min("c").alias("c"))
        told = label.join(near, "id").select("id", "component", F.least("component", "c").alias("c"))
        roots = told.groupBy(F.col("component").alias("id")).agg(F.min("c").alias("r"))
        told = told.select("id", "component", "c").join(roots, "id", "left").select("id", "component", F.least("c", F.coalesce("r", "c")).alias("c"))
        # jump: to the label of the label
        over = told.select(F.col("id").alias("c"), F.col("c").alias("up"))
        now = written(told.join(over, "c", "left").select("id", F.least("c", F.coalesce("up", "c")).alias("component"), (F.least("c", F.coalesce("up", "c")) < F.col("component")).alias("moved")), "labels")
        label = now.drop("moved")
        if now.where("moved").isEmpty():
            return label
