"""Readers with fixed schemas, and normalising projections for records that others write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import json_in_text, name_key, preset_key_parts, trim_ws

SCHEMAS = {
    "presets": "kind string, name string, fields map<string,string>, logo_refs array<string>, updated_at timestamp",
    "preset_tombstones": "kind string, name string, deleted_at timestamp",
    "contacts": "name_key string, name string, last_used_at timestamp, updated_at timestamp",
    "contact_tombstones": "name_key string, deleted_at timestamp",
    "addresses": "address_key string, ship_to_name string, address string, carrier string, account_numbers string, last_used_at timestamp",
    "documents": "id string, kind string, title string, customer string, sales_order string, file_name string, storage_path string, byte_size int, created_at timestamp",
    "signatures": "id string, name string, storage_path string, updated_at timestamp",
    "roster": "roster_type string, value string",
}
KINDS = ("shipping", "receiving", "bol", "bulk")


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def kind_of(c: Column | str) -> Column:
    """A known kind; anything else is shipping."""
    k = name_key(c)
    return F.when(k.isin(*KINDS), k).otherwise("shipping")


def epoch_if_null(*cs: str) -> Column:
    return F.coalesce(*[F.col(c).cast("timestamp") for c in cs], F.timestamp_seconds(F.lit(0)))


def contacts(rows: DataFrame, *fallbacks: str) -> DataFrame:
    """Contact rows: trimmed names, blank keys dropped, unknown times at the epoch."""
    out = rows.select(name_key("name_key").alias("name_key"), trim_ws("name").alias("name"), epoch_if_null("last_used_at", *fallbacks).alias("last_used_at"))
    return out.filter("name_key <> ''")


def roster(rows: DataFrame, roster_type: str = "person_by") -> DataFrame:
    """Distinct names of one roster, in order of their lower case."""
    return rows.filter(F.col("roster_type") == roster_type).select(trim_ws("value").alias("name")).filter("name <> ''").distinct().orderBy(F.lower("name"), "name")


def map_file(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) rows of a JSON file that holds one object of objects."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias("key", "value"))


def list_file(spark: SparkSession, path: str, keep: int = 60) -> DataFrame:
    """Names of a JSON array: the first of each key, in order, at most ``keep``: ordinal, name."""
    from ..operators.sync import first_per_key

    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ordinal", "name")).withColumn("name", trim_ws("name")).filter("name <> ''")
    return first_per_key(rows.withColumn("name_key", name_key("name")), "name_key", F.col("ordinal")).drop("name_key").orderBy("ordinal").limit(keep)


def presets_file(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, fields, logos of a presets file; older keys and fields are brought up to date."""
    rows = map_file(spark, path, "struct<fields:map<string,string>,logos:array<string>,logo:string>")
    key = preset_key_parts("key")
    logos = F.when(F.size("value.logos") > 0, F.col("value.logos")).otherwise(F.array_compact(F.array("value.logo")))
    return rows.select(kind_of(key["kind"]).alias("kind"), key["name"].alias("name"), F.col("value.fields").alias("fields"), logos.alias("logos"))


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,webp,gif}") -> DataFrame:
    """Files of a folder and those below it by ending: path, length, content is read only if used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def stored_objects(spark: SparkSession, path: str) -> DataFrame:
    """Objects kept as kind/id/file, or kind=.../id=.../file, below a folder: kind, id, file, length."""
    parts = F.split("path", "/")
    at = lambda i: F.regexp_replace(F.element_at(parts, i), "^(?:kind|id)=", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(at(-3).alias("kind"), at(-2).alias("id"), at(-1).alias("file"), "length")


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """An append-only log of JSON lines, one case a row."""
    return spark.read.schema("run_id string, ts timestamp, case_id string, ok boolean, metrics map<string,double>, gates map<string,boolean>, composite double").json(path)


def release_assets(payload: Column) -> Column:
    """struct(tag, name, url) rows of a release feed."""
    feed = F.from_json(payload, "struct<tag_name:string,assets:array<struct<name:string,browser_download_url:string>>>")
    return F.transform(feed["assets"], lambda a: F.struct(feed["tag_name"].alias("tag"), a["name"].alias("name"), a["browser_download_url"].alias("url"), asset_kind(a["name"]).alias("kind")))


def asset_kind(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".apk"), "android").when(n.endswith(".exe"), F.when(F.contains(n, F.lit("setup")), "installer").otherwise("windows")).when(n.endswith(".zip"), "archive").otherwise("other")


def geocoder_hits(payload: Column) -> Column:
    """Places of a geocoder's answer: struct(ordinal, street, city, province, postal, text)."""
    hit = "struct<display_name:string,address:struct<house_number:string,road:string,city:string,town:string,village:string,state:string,postcode:string>>"
    a = lambda h: h["address"]
    street = lambda h: trim_ws(F.concat_ws(" ", a(h)["house_number"], a(h)["road"]))
    return F.transform(F.from_json(payload, f"array<{hit}>"), lambda h, i: F.struct(i.alias("ordinal"), street(h).alias("street"), F.coalesce(a(h)["city"], a(h)["town"], a(h)["village"], F.lit("")).alias("city"), F.coalesce(a(h)["state"], F.lit("")).alias("province"), F.coalesce(a(h)["postcode"], F.lit("")).alias("postal"), h["display_name"].alias("text")))


def links(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """Links and image addresses in HTML, first of each without its query: keys, ordinal, link."""
    h = F.col(html)
    found = F.flatten(F.array(*[F.regexp_extract_all(h, F.lit(p), F.lit(1)) for p in (r'(?i)href="([^"#]+)"', r'(?i)src="([^"]+)"', r"(?i)content=\"(https?://[^\"]+)\"")]))
    rows = pages.select(*keys, F.posexplode(found).alias("ordinal", "link")).withColumn("bare", F.substring_index("link", "?", 1))
    return rows.groupBy(*keys, "bare").agg(F.min("ordinal").alias("ordinal"), F.min_by("link", "ordinal").alias("link")).drop("bare")


def image_search_hits(answers: DataFrame, key: str, column: str) -> DataFrame:
    """key, ordinal, url of the images of a search service's JSON answer; entries without an address go."""
    hits = F.from_json(column, "struct<images:array<struct<imageUrl:string,title:string>>>")["images"]
    rows = answers.select(key, F.posexplode(F.transform(hits, lambda h: trim_ws(h["imageUrl"]))).alias("ordinal", "url"))
    return rows.filter("url <> ''")


def answered_lines(answers: DataFrame, key: str, column: str) -> DataFrame:
    """key, ordinal, cpo, id_kind, id_value, quantity, confidence, reasoning: the rows of a JSON array inside a
    model's answer, which may be fenced or have text around it; rows without a reference go."""
    item = "struct<cpo:string,id_kind:string,id_value:string,quantity:string,confidence:string,reasoning:string>"
    rows = answers.select(key, F.posexplode(F.from_json(json_in_text(column), f"array<{item}>")).alias("ordinal", "r"))
    blank = lambda c: F.coalesce(trim_ws(f"r.{c}"), F.lit(""))
    out = rows.select(key, "ordinal", blank("cpo").alias("cpo"), F.lower(blank("id_kind")).alias("id_kind"), blank("id_value").alias("id_value"), blank("quantity").alias("quantity"), blank("confidence").alias("confidence"), blank("reasoning").alias("reasoning"))
    return out.filter("cpo <> ''")
