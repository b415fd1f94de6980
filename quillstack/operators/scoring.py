"""Summaries of scores: means, gates, best and worst, counters, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp
from ..plans.numbering import summed_so_far


def band_score(value: Column, low: float, high: float, slack: float) -> Column:
    """1 inside a band, falling to 0 at ``slack`` outside it."""
    return F.when(value < low, clamp(1 - (low - value) / slack, 0.0, 1.0)).when(value > high, clamp(1 - (value - high) / slack, 0.0, 1.0)).otherwise(1.0)


def speed_score(duration: Column, budget: Column) -> Column:
    """1 within the budget, then the budget's share of the time."""
    return F.when(budget <= 0, 0.0).when(duration <= budget, 1.0).otherwise(clamp(budget / duration, 0.0, 1.0))


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts.values())
    out = F.lit(0.0)
    for value, weight in parts.values():
        out = out + value * (weight / total)
    return out


def map_mean(metrics: Column) -> Column:
    """The mean of a map's values, 0 for an empty one."""
    values = F.map_values(metrics)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)).otherwise(0.0)


def gates_hold(gates: Column) -> Column:
    """Whether no known gate has failed."""
    return F.forall(F.map_values(gates), lambda g: F.coalesce(g, F.lit(True)))


def summary(cases: DataFrame, key: str) -> DataFrame:
    """mean, cases and failures of each key. cases: composite, ok."""
    return cases.groupBy(key).agg(F.round(F.avg("composite"), 4).alias("mean_composite"), F.count("*").alias("cases"), F.count_if(~F.col("ok")).alias("failures"))


def failed_cases(cases: DataFrame, key: str) -> DataFrame:
    """The cases that failed, a row each. cases: case_id, ok."""
    return cases.filter(~F.col("ok")).select(key, "case_id").distinct()


def extremes(cases: DataFrame, k: int, value: str = "composite", tie: str = "case_id") -> DataFrame:
    """The k best and k worst rows, with side and place."""
    side = lambda name, order: cases.orderBy(order, tie).limit(k).withColumn("side", F.lit(name)).withColumn("place", F.row_number().over(Window.orderBy(order, tie)))
    return side("best", F.desc(value)).unionByName(side("worst", F.asc(value)))


def technique_counts(runs: DataFrame) -> DataFrame:
    """uses, wins, fails and win rate of each technique. runs: used (array), won."""
    rows = runs.select(F.explode(F.array_distinct("used")).alias("technique"), "won")
    return rows.groupBy("technique").agg(F.count("*").alias("uses"), F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("fails")).withColumn("win_rate", F.round(F.col("wins") / F.col("uses"), 4))


def longest_run(rows: DataFrame, key: str, position: str, above: Column) -> DataFrame:
    """First position and length of the longest run of consecutive positions where ``above`` holds; ties to the first."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(key).orderBy(position))
    runs = rows.filter(above).withColumn("__i", island).groupBy(key, "__i").agg(F.min(position).alias("first"), F.count("*").alias("length"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("length"), "first"))
    return runs.withColumn("__n", best).filter("__n = 1").select(key, "first", "length")


def upper_middles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at n div 2, from 0, of the sorted values of each group, from value counts: no list is built, and running
    counts go over ranges of all groups, so a group of many values isn't one task."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    upto = summed_so_far(counts, "__u", "__c", *keys, value)
    whole = upto.groupBy(*keys).agg(F.min(F.col("__u") - F.col("__c")).alias("__start"), F.sum("__c").alias("__n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    behind = upto.alias("a").join(whole.alias("b"), same & (F.col("__u") - F.col("__start") > F.floor(F.col("__n") / 2)))
    return behind.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.min(f"a.{value}").alias("middle"))


def capped_tail(log: DataFrame, key: str, when: str, keep: int = 40, tie: str | None = None) -> DataFrame:
    order = [F.desc(when), *([F.desc(tie)] if tie else [])]
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("__n", at).filter(F.col("__n") <= keep).drop("__n")


def grade(score: Column, cuts: dict[str, float]) -> Column:
    """The first grade, from the highest, whose cut the score reaches; null below all."""
    out = None
    for name, cut in sorted(cuts.items(), key=lambda x: -x[1]):
        out = F.when(score >= cut, name) if out is None else out.when(score >= cut, name)
    return out
