"""Choosing among processed versions of an image: gates, grades, lessons, first accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import colour_distance


def keeps_colours(needed: Column, present: Column, most: int = 56) -> Column:
    """Whether each needed colour has a present one near it. Both: array<struct<r, g, b>>."""
    return F.forall(needed, lambda n: F.exists(present, lambda p: colour_distance(n["r"], n["g"], n["b"], p["r"], p["g"], p["b"]) <= most))


def faithful(iou: Column, error: Column, drift: Column, colours: Column, matte: Column) -> Column:
    """A restored image that shows the same mark."""
    return ~matte & (drift <= 0.32) & (iou >= 0.90) & (error <= 22) & colours


def acceptable(iou: Column, error: Column, drift: Column, colours: Column, matte: Column, grown: Column) -> Column:
    """The wider gate of enlarged images: near the mark, or 1.8 times as high with its colours."""
    return ~matte & (drift <= 0.40) & colours & (((iou >= 0.72) & (error <= 42)) | (grown >= 1.8))


def grade(height: Column, plate: Column, drift: Column, opaque: Column, corner_mark: Column, made: Column) -> Column:
    fine = (height >= 3000) & (plate < 0.02) & (drift < 0.28) & ~corner_mark & (opaque < 0.88)
    return F.when(~made | (height < 2000) | (plate > 0.18), "fail").when(fine, "pristine").when((plate < 0.12) & (drift < 0.40), "favourable").otherwise("fail")


def lessons(plate: Column, drift: Column, corner_mark: Column, grade_: Column) -> Column:
    """Short notes on what to do better next time."""
    return F.array_compact(F.array(F.when(plate >= 0.02, "clear the plate"), F.when(drift >= 0.20, "keep the aspect"), F.when(corner_mark, "add no marks"), F.when(grade_.isin("pristine", "favourable"), "repair, don't restyle")))


def technique_record(runs: DataFrame) -> DataFrame:
    """uses, wins and fails per technique from graded runs. runs: used (array), grade."""
    rows = runs.select(F.explode("used").alias("technique"), "grade")
    return rows.groupBy("technique").agg(F.count("*").alias("uses"), F.count_if(F.col("grade").isin("pristine", "favourable")).alias("wins"), F.count_if(F.col("grade") == "fail").alias("fails"))


def cascade(attempts: DataFrame, key: str, order: tuple[str, ...], accepted: Column) -> DataFrame:
    """Per key the first accepted attempt in an order of engines; the last engine is taken as it is."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("engine"))
    rows = attempts.withColumn("place", place).filter((F.col("place") > 0) & (accepted | (F.col("place") == len(order))))
    first = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def keep_score(name: Column, ink: Column, width: Column, height: Column, preferred: Column) -> Column:
    """How much a file is worth keeping among those that show one mark."""
    lower = F.lower(name)
    clutter = name.rlike(r"(?i)(\(\d+\)|_\d+_|- copy|history_|_restored)")
    points = [(preferred, 80), (~clutter, 24), (name.rlike("[A-Z]") & F.contains(name, F.lit(" ")), 6), (F.contains(lower, F.lit("history_")), -40), (F.contains(lower, F.lit("copy")), -18), (name.rlike(r"\(\d+\)|_\d+_"), -12), (F.contains(lower, F.lit("restored")) & (width * height > 2_000_000), -30)]
    out = F.log(F.greatest(ink, F.lit(16)).cast("double")) * 10 + F.log(F.greatest(width * height, F.lit(16)).cast("double")) * 4
    for condition, value in points:
        out = out + F.when(condition, value).otherwise(0)
    return out


def parity(pairs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Ratios of two measurements of each column, and whether all are within their limits."""
    rows = pairs
    for c in limits:
        rows = rows.withColumn(f"{c}_ratio", F.when(F.greatest(f"{c}_a", f"{c}_b") == 0, 1.0).otherwise(F.least(f"{c}_a", f"{c}_b") / F.greatest(f"{c}_a", f"{c}_b")))
    good = F.lit(True)
    for c, least in limits.items():
        good = good & (F.col(f"{c}_ratio") >= least)
    return rows.withColumn("holds", good)


def rule_lookup(name: Column, rules: dict[str, str]) -> Column:
    """The id of the first rule, a regular expression on compact names, that matches; else null."""
    compact = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules.items()):
        out = F.when(compact.rlike(pattern), value).otherwise(out)
    return out


def stored_logos(wanted: Column, existing: Column, keep: int = 2) -> Column:
    """The first ``keep`` names of a list that exist."""
    return F.slice(F.array_intersect(wanted, existing), 1, keep)


def with_snapshots(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Records beside their form fields, with a count of fields: what a saved form can be restored from."""
    return records.join(snapshots.select("id", "fields"), "id").withColumn("n_fields", F.size("fields"))
