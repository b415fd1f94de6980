"""Rows from quantities: stickers, pages, per-order jobs; and the totals of those rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ITEM_PLURALS, item_plural, number_or_zero, trim_ws

SHEET, SHEET_COLUMNS = 10, 2


def labels(lines: DataFrame) -> DataFrame:
    """A row per sticker of each line, with its number from 0 and its reference.

    lines: quantity, print_mode (single or per unit), cpo_numbers, cpo_display.  With as many
    numbers as stickers each gets its own; otherwise all show the whole reference."""
    single = F.col("print_mode") == "single"
    count = F.when(F.col("quantity") <= 0, 0).when(single, 1).otherwise(F.col("quantity"))
    own = (~single) & (F.size("cpo_numbers") == F.col("quantity"))
    rows = lines.withColumn("__n", count.cast("int")).filter("__n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("sticker"))
    return rows.withColumn("cpo", F.when(own, F.get("cpo_numbers", F.col("sticker")).cast("string")).otherwise(F.col("cpo_display"))).drop("__n")


def tiled(rows: DataFrame, partition: list[str], *order: str) -> DataFrame:
    """Place on sheets of ten in two columns: index, sheet, row, column, all from 0."""
    i = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1
    return rows.withColumn("index", i).withColumn("sheet", F.floor(F.col("index") / SHEET).cast("int")).withColumn("row", F.floor(F.col("index") % SHEET / SHEET_COLUMNS).cast("int")).withColumn("column", (F.col("index") % SHEET_COLUMNS).cast("int"))


def sheets(count: Column) -> Column:
    return F.floor((count + SHEET - 1) / SHEET)


def piece_pages(plans: DataFrame) -> DataFrame:
    """Pages "n of N" of each plan, pallets and crates before boxes; a plan without pieces, or with an
    unknown number, has one page without a number. plans: pallet_crates, boxes, is_undetermined."""
    pallets, boxes = F.greatest(F.coalesce("pallet_crates", F.lit(0)), F.lit(0)), F.greatest(F.coalesce("boxes", F.lit(0)), F.lit(0))
    total = F.when(F.coalesce("is_undetermined", F.lit(False)), 0).otherwise(pallets + boxes)
    rows = plans.withColumn("__pallets", pallets).withColumn("pages", total.cast("int")).select("*", F.explode(F.when(F.col("pages") > 0, F.sequence(F.lit(1), F.col("pages"))).otherwise(F.array(F.lit(0)))).alias("page"))
    return rows.withColumn("unit", F.when(F.col("page") == 0, "").when(F.col("page") <= F.col("__pallets"), "pallet").otherwise("box")).drop("__pallets")


def jobs(documents: DataFrame, orders: str = "orders", overrides: str = "overrides", fields: str = "fields") -> DataFrame:
    """A row per order of a document, with field values that the order overrides.

    orders: array<string>; overrides: map<field, map<order, value>>; fields: map<field, value>."""
    rows = documents.select("*", F.posexplode(orders).alias("job", "order"))
    own = F.map_filter(F.transform_values(overrides, lambda k, v: F.element_at(v, F.col("order"))), lambda k, v: v.isNotNull())
    return rows.withColumn(fields, F.map_zip_with(fields, own, lambda k, a, b: F.coalesce(b, a))).drop(orders, overrides)


def plan_checks(plans: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Sums of the plans of each key beside what is declared, and whether they agree."""
    sums = plans.groupBy(key).agg(F.sum("pallet_crates").alias("pallet_crates"), F.sum("boxes").alias("boxes"))
    d = declared.select(key, F.col("pallet_crates").alias("declared_pallet_crates"), F.col("boxes").alias("declared_boxes"))
    return sums.join(d, key).withColumn("agrees", (F.col("pallet_crates") == F.col("declared_pallet_crates")) & (F.col("boxes") == F.col("declared_boxes")))


def goods_totals(lines: DataFrame, key: str) -> DataFrame:
    """Pieces and weight per document, and a column of pieces per category; unknown categories count
    in the pieces only, and a category without pieces is null. lines: pieces, weight, item_type."""
    lines = lines.select(key, number_or_zero("pieces").alias("pieces"), number_or_zero("weight").alias("weight"), item_plural("item_type").alias("kind"))
    pieces, weight, kind = F.col("pieces"), F.col("weight"), F.col("kind")
    each = [F.nullif(F.sum(F.when(kind == p, pieces).otherwise(F.lit(0.0))), F.lit(0.0)).alias(p.lower()) for p in ITEM_PLURALS.values()]
    return lines.groupBy(key).agg(F.sum(pieces).alias("total_pieces"), F.sum(weight).alias("total_weight"), *each)


def category_totals(lines: DataFrame, key: str, category: str, value: str) -> DataFrame:
    return lines.groupBy(key, category).agg(F.sum(value).alias("total"))


def merged_documents(rows: DataFrame, key: str, ordinal: str, texts: list[str], flags: list[str]) -> DataFrame:
    """One row per key: distinct texts of each column in order, joined, and whether any flag is set."""
    def joined(c: str) -> Column:
        items = F.array_sort(F.collect_list(F.when(F.trim(c) != "", F.struct(ordinal, F.trim(c).alias("v")))))
        return F.array_join(F.array_distinct(F.transform(items, lambda x: x["v"])), " / ").alias(c)

    return rows.groupBy(key).agg(*[joined(c) for c in texts], *[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags])


def hints(sep: str, *cs: Column) -> Column:
    """The texts that aren't blank, trimmed and joined."""
    return F.array_join(F.filter(F.array(*[trim_ws(c) for c in cs]), lambda x: x != ""), sep)
