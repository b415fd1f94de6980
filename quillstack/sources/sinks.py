"""Writers: snapshots, logs, map files and rows for pages that others draw."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A new place below spark.checkpoint.dir, which driver and executors share; in local mode without one, below
    a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillstack-")
    return f"{root.rstrip('/')}/files/{what}-{uuid.uuid4().hex}"


def text_file(row: DataFrame, path: str) -> None:
    """One file of one row's text, for settings and lists as small as a form's."""
    row.coalesce(1).write.text(path)


def snapshot(rows: DataFrame, path: str, *partition: str) -> None:
    """A new snapshot of a table, partitioned for pruning; never over the one being read."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def map_json(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row with the JSON object of all keys, for a file as small as a form's settings."""
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))), by_key)
    return rows.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)
