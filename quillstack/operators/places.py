"""Geocoder and place answers: queries split, hits ranked, components picked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import POSTAL_CODE, ZIP_CODE
from ..functions.text import name_key, trim_ws


def civic_query(c: Column) -> Column:
    """struct(house_number, street, locality) of a typed address."""
    raw = trim_ws(c)
    head = trim_ws(F.split_part(raw, F.lit(","), F.lit(1)))
    locality = F.when(F.instr(raw, ",") > 0, trim_ws(F.regexp_replace(raw, r"^[^,]*,", ""))).otherwise("")
    number = F.regexp_extract(head, r"(?i)^(\d+[a-z]?(?:-\d+)?)\s+(\S.*)$", 1)
    street = F.when(number == "", head).otherwise(F.regexp_extract(head, r"(?i)^(\d+[a-z]?(?:-\d+)?)\s+(\S.*)$", 2))
    return F.struct(number.alias("house_number"), trim_ws(street).alias("street"), locality.alias("locality"))


def biased_to_canada(c: Column) -> Column:
    """Unless the text names another country, or has a ZIP code and no Canadian one."""
    q = F.lower(c)
    other = q.rlike(r"\b(usa|united states|mexico|uk|united kingdom|australia|germany|france)\b")
    return ~(other | (q.rlike(ZIP_CODE) & ~q.rlike(POSTAL_CODE)))


def ranked_hits(hits: DataFrame, query_key: str, house_number: str, keep: int = 8) -> DataFrame:
    """Hits of each query without repeats: those at the house number first, then by text.

    If one is at the number, streets without a number go.  hits: display_address, house_number."""
    text, wanted, own = name_key("display_address"), F.lower(trim_ws(house_number)), F.lower(trim_ws("hit_number"))
    tier = F.when(wanted == "", 1).when(own == wanted, 0).when(own == "", 2).otherwise(1)
    first = F.row_number().over(Window.partitionBy(query_key, "__t").orderBy("ordinal"))
    one = hits.withColumn("__t", text).filter("__t <> ''").withColumn("__f", first).filter("__f = 1").withColumn("tier", tier)
    some = F.min("tier").over(Window.partitionBy(query_key)) == 0
    pool = one.withColumn("__s", some).filter(~(F.col("__s") & (F.col("tier") == 2)))
    at = F.row_number().over(Window.partitionBy(query_key).orderBy("tier", "display_address"))
    return pool.withColumn("position", at).filter(F.col("position") <= keep).drop("__t", "__f", "__s")


def component(parts: Column, *kinds: str, short: bool = False) -> Column:
    """The name of the first component of one of the kinds; earlier kinds count more.

    parts: array<struct<long_name, short_name, types: array<string>>>."""
    name = "short_name" if short else "long_name"
    of_kind = lambda kind: F.try_element_at(F.filter(parts, lambda p: F.array_contains(p["types"], kind)), F.lit(1))
    found = [of_kind(k)[name] for k in kinds]
    return F.coalesce(*found, F.lit(""))


def place_address(parts: Column) -> Column:
    """struct(street, city, province, postal) of a place's components."""
    street = trim_ws(F.concat_ws(" ", component(parts, "street_number"), component(parts, "route")))
    return F.struct(street.alias("street"), component(parts, "locality", "postal_town", "sublocality").alias("city"), component(parts, "administrative_area_level_1", short=True).alias("province"), component(parts, "postal_code").alias("postal"))


def locality_line(city: Column, province: Column, postal: Column) -> Column:
    region = trim_ws(F.concat_ws(" ", province, postal))
    return F.array_join(F.filter(F.array(F.coalesce(city, F.lit("")), region), lambda x: x != ""), ", ")
