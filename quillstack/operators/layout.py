"""Sizes of things side by side: shared heights, shrink factors, clamped rectangles, chosen assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_height(cells: DataFrame, key: str, target: float) -> DataFrame:
    """The largest height, up to a target, at which every cell fits its width. cells: width at that height, most."""
    fit = F.when(F.col("width") > 0, F.least(F.lit(target), F.lit(target) * F.col("most") / F.col("width"))).otherwise(F.lit(target))
    return cells.groupBy(key).agg(F.min(fit).alias("height"))


def shrink(items: DataFrame, key: str, room: float, gap: float) -> DataFrame:
    """The factor, at most 1, that lets a row of items with fixed gaps between them fit."""
    total, n = F.sum("width"), F.count("*")
    free = F.greatest(F.lit(room) - F.lit(gap) * (n - 1), F.lit(0.0))
    return items.groupBy(key).agg(F.when(total <= free, 1.0).otherwise(free / total).alias("factor"))


def scaled(items: DataFrame, key: str, room: float, gap: float) -> DataFrame:
    """Items with their own scale applied and shrunk together where they don't fit."""
    w = Window.partitionBy(key)
    own = F.col("width") * F.col("scale")
    free = F.greatest(F.lit(room) - F.lit(gap) * (F.count("*").over(w) - 1), F.lit(0.0))
    total = F.sum(own).over(w)
    return items.withColumn("shown", own * F.when(total <= free, 1.0).otherwise(free / total))


def chosen_asset(assets: DataFrame, key: str, preferred: Column, fallback: Column) -> DataFrame:
    """Per key the first preferred asset, else the first fallback one. assets: ordinal."""
    tier = F.when(preferred, 0).when(fallback, 1)
    at = F.row_number().over(Window.partitionBy(key).orderBy("tier", "ordinal"))
    return assets.withColumn("tier", tier).filter("tier is not null").withColumn("__n", at).filter("__n = 1").drop("__n")


def clamped_box(left: Column, top: Column, width: Column, height: Column, least: float = 0.05) -> Column:
    """A rectangle of the unit square, of a least size, moved inside it."""
    w, h = F.least(F.greatest(width, F.lit(least)), F.lit(1.0)), F.least(F.greatest(height, F.lit(least)), F.lit(1.0))
    return F.struct(F.greatest(F.lit(0.0), F.least(left, 1 - w)).alias("left"), F.greatest(F.lit(0.0), F.least(top, 1 - h)).alias("top"), w.alias("width"), h.alias("height"))
