"""Running values over a whole table, or a whole key, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import kept

_EARLIER = (Window.unboundedPreceding, -1)


def _ranged(rows: DataFrame, *order: str) -> DataFrame:
    """Rows dealt into ranges of an order, written down so that a lost executor cannot change them."""
    return kept(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """A column of row numbers, from 1, in an order.

    Ranges of rows are counted, and each starts where those before it end.  Only one count a range is
    handled together."""
    ranged = _ranged(rows, *order)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(*_EARLIER)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__within", within).join(starts, "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def summed_so_far(rows: DataFrame, name: str, value: str, *order: str) -> DataFrame:
    """A column with the sum of a column up to each row, in an order, the same way."""
    ranged = _ranged(rows, *order)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    starts = sums.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(*_EARLIER)), F.lit(0)).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__within", within).join(starts, "__range").withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")


def highest_so_far(rows: DataFrame, name: str, key: str, value: str, *order: str) -> DataFrame:
    """A column with the largest value of a key's rows up to each one, in an order, whatever the size of a key:
    ranges of rows take over the largest value of the key's earlier ranges."""
    ranged = _ranged(rows, key, *order)
    ends = ranged.groupBy(key, "__range").agg(F.max(value).alias("__most"))
    before = ends.select(key, "__range", F.max("__most").over(Window.partitionBy(key).orderBy("__range").rowsBetween(*_EARLIER)).alias("__before"))
    within = F.max(value).over(Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__within", within).join(before, [key, "__range"]).withColumn(name, F.greatest("__within", "__before")).drop("__range", "__within", "__before")
