"""Connected components of an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(frame: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names; in local mode without one, in a temporary folder."""
    spark = frame.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="components-"))
    return frame.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node of ``nodes`` (id) can reach by edges (a, b).

    Each round a node takes the least label of itself and its neighbours, then the label of that label,
    so the rounds grow with the logarithm of the longest path; labels that changed are counted, no row
    comes to the driver."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = kept(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        step = kept(step)
        jump = step.select(F.col("id").alias("t"), F.col("component").alias("c"))
        following = kept(step.join(jump, step["component"] == jump["t"], "left").select("id", "old", F.least("component", F.coalesce("c", "component")).alias("component")))
        if following.filter("old <> component").isEmpty():
            return following.select("id", "component")
        labels = following.select("id", "component")
