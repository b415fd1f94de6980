"""Tables in the order in which they are paged, with an index of counts by range.

Rows are dealt into ranges of a total order and written range by range; the index has a row for each
range and value of the ``by`` columns: the rows there, and those before.  A page by number is looked up in
the index, which names the one or two ranges that hold it, and only their files are read, however far
in the page lies.  A page after a row (seek) needs no index: the row's order values are filters that reach
the scan, and files and row groups outside them are skipped by their statistics.

Equal values of the first order column are told apart by the others, so no range grows with a hot value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class RangedTable:
    """``order``: column names that are a total order, with a minus sign before those that descend."""

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str], by: Sequence[str] = ()):
        self.spark, self.path, self.by = spark, path.rstrip("/"), list(by)
        self.order = [(c.removeprefix("-"), c.startswith("-")) for c in order]

    def _sorted(self) -> list[Column]:
        return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in self.order]

    def write(self, rows: DataFrame, a_range: int = 100_000) -> None:
        ranges = max(1, -(-rows.count() // a_range))
        keys = [*(F.col(c) for c in self.by), *self._sorted()]
        dealt = rows.repartitionByRange(ranges, *keys).withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions(*keys).write.partitionBy("range").parquet(f"{self.path}/rows")
        rows.limit(0).write.parquet(f"{self.path}/columns")  # an empty table has no other file that names them
        counts = self._rows().groupBy("range", *self.by).agg(F.count("*").alias("rows"))
        before = Window.partitionBy(*self.by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        # a row for each range, so the running sum is over rows / a_range numbers
        counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{self.path}/index")

    def _rows(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("range", "integer")).parquet(f"{self.path}/rows")

    def rows(self, **by) -> DataFrame:
        found = self._rows()
        for c, v in by.items():
            found = found.filter(F.col(c).eqNullSafe(F.lit(v)))
        return found

    def _index(self, **by) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/index")
        for c in self.by:
            found = found.filter(F.col(c).eqNullSafe(F.lit(by[c])))
        return found

    def page(self, number: int, size: int, **by) -> DataFrame:
        """Page ``number``, from 0, of the rows with the given ``by`` values, with position, from 1, and pages."""
        index = self._index(**by)
        first, last = number * size, (number + 1) * size
        total = index.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        held = index.filter((F.col("before") < last) & (F.col("before") + F.col("rows") > first)).select("range", "before")
        starts = {r["range"]: r["before"] for r in held.collect()}  # at most ``size``, as each holds a row of the page
        rows = self.rows(**by).filter(F.col("range").isin(list(starts)))
        before = F.coalesce(*(F.when(F.col("range") == r, F.lit(n)) for r, n in starts.items()), F.lit(0))
        position = before + F.row_number().over(Window.partitionBy("range").orderBy(*self._sorted()))
        placed = rows.withColumn("position", position.cast("long")).withColumn("pages", F.lit(-(-total // size)).cast("long"))
        return placed.filter(F.col("position").between(first + 1, last)).drop("range")

    def after(self, row: dict | None, size: int, **by) -> DataFrame:
        """The next ``size`` rows behind one that is given by its values in the order (None: from the start)."""
        rows = self.rows(**by).drop("range")
        if row is not None:
            behind, equal = F.lit(False), F.lit(True)
            for c, down in self.order:
                v = F.lit(row[c])
                behind = behind | (equal & (F.col(c) < v if down else F.col(c) > v))
                equal = equal & (F.col(c) == v)
            c, down = self.order[0]
            reach = F.col(c) <= F.lit(row[c]) if down else F.col(c) >= F.lit(row[c])
            rows = rows.filter(reach).filter(behind)
        return rows.orderBy(*self._sorted()).limit(size)
