"""Pages, search and retention over document records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.numbering import numbered

RETENTION_DAYS = 90


def cutoff(now: Column, days: int = RETENTION_DAYS) -> Column:
    """``days`` before now; fewer than one day means the default."""
    return now - F.make_dt_interval(F.lit(days if days >= 1 else RETENTION_DAYS))


def in_window(rows: DataFrame, now: Column, created: str = "created_at", days: int = RETENTION_DAYS) -> DataFrame:
    return rows.filter(F.col(created) >= cutoff(now, days))


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows with the text, in any case, in one of the columns or across their joint; all for a blank query."""
    q = query.strip().lower()
    return rows if not q else rows.filter(F.lower(F.concat_ws(" ", *columns)).contains(q))


#: pages up to this position come from the least rows of each task, deeper ones from row numbers over ranges
NEAR = 10_000


def page(rows: DataFrame, number: int, size: int, *order: Column, most: int | None = None) -> DataFrame:
    """Page ``number``, from 0, with the columns position, from 1, and pages. ``most``: rows after so many in the
    order aren't there. For many pages of one table see ``sources.ranged``, which reads a page's own files only."""
    kept = rows if most is None else rows.orderBy(*order).limit(most)
    last = (number + 1) * size
    if last <= NEAR:
        ranked = kept.orderBy(*order).limit(last).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    else:
        ranked = numbered(kept, "position", *order)
    pages = F.ceil(kept.agg(F.count("*")).scalar() / size)
    return ranked.withColumn("position", F.col("position").cast("int")).filter(F.col("position").between(number * size + 1, last)).withColumn("pages", pages.cast("long"))


def expired(rows: DataFrame, now: Column, created: str = "created_at", days: int = RETENTION_DAYS) -> DataFrame:
    return rows.filter(F.col(created) < cutoff(now, days))


def purge(records: DataFrame, objects: DataFrame, now: Column, days: int = RETENTION_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records kept, objects kept, one row with the number purged). An object belongs to a record by
    the first two folders of its name, kind/id/..., compared whole."""
    gone = expired(records, now, days=days).select("kind", "id")
    return records.join(gone, ["kind", "id"], "left_anti"), drop_objects(objects, gone), gone.agg(F.count("*").alias("purged"))


def drop_objects(objects: DataFrame, gone: DataFrame) -> DataFrame:
    owner = objects.withColumn("__kind", F.split_part("name", F.lit("/"), F.lit(1))).withColumn("__id", F.split_part("name", F.lit("/"), F.lit(2)))
    return owner.join(gone.select(F.col("kind").alias("__kind"), F.col("id").alias("__id")).distinct(), ["__kind", "__id"], "left_anti").select(objects.columns)


def prune_without(records: DataFrame, probes: DataFrame) -> DataFrame:
    """Records to keep: those with a snapshot, and those of which it isn't known. probes: id, found."""
    missing = probes.groupBy("id").agg(F.bool_or("found").alias("f")).filter("not f").select("id")
    return records.join(missing, "id", "left_anti")


def says_missing(status: Column, body: Column) -> Column:
    """Whether a store's answer means that the object isn't there."""
    code = F.coalesce(F.get_json_object(body, "$.statusCode"), F.get_json_object(body, "$.error"), F.lit(""))
    return (status == 404) | ((status == 400) & F.lower(code).isin("404", "not_found", "nosuchkey"))
