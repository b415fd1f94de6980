"""Candidates from several sources: scored, deduplicated and cut to the best."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_tokens, compact_key, let, url_host, url_key
from ..plans.numbering import numbered

# What a URL says about being a company's mark.
URL_POINTS = (
    ((".png",), 12), ((".webp",), 8), ((".jpg", ".jpeg"), 5), ((".gif",), 1), (("logo",), 10), (("brand",), 4), (("vector", "svg"), 3),
    (("thumb", "icon", "sprite", "avatar", "profile"), -22),
    (("gstatic.com", "googleusercontent.com/imgres", "bing.com/th", "=s16", "=s32", "w=16", "h=16"), -18),
)
SOURCE_POINTS = {"Brands of the World": 6, "Serper": 14, "Bing Images": 14, "Google Images": 10, "Wikipedia": -8, "Site scrape": 14, "DuckDuckGo": 2, "DuckDuckGo Images": 5}
#: More for sources whose links say what they show.
NAMED_POINTS = {"Serper": 6, "Bing Images": 6, "Google Images": 4}
JUNK_HOSTS = (
    "shutterstock", "gettyimages", "istockphoto", "alamy", "dreamstime", "depositphotos", "123rf", "stock.adobe", "adobestock",
    "freepik", "pngtree", "pngwing", "cleanpng", "pinimg", "pinterest", "facebook", "twitter", "instagram", "tiktok", "reddit",
    "youtube", "linkedin", "cnn.com", "bbc.", "forbes", "people.com", "celebrity", "news.", "blog.", "wordpress.com", "medium.com",
    "ebay.", "amazon.", "walmart.",
)
JUNK_PATHS = ("stock-photo", "stockphoto", "headshot", "portrait", "news/", "/article/", "/articles/", "press-release", "thumbnail", "apple-touch-icon", "/favicon/", "favicon.ico")
NOT_CORPORATE = (
    "wikipedia.org", "wikidata.org", "wikimedia.org", "facebook.com", "linkedin.com", "twitter.com", "x.com", "instagram.com",
    "youtube.com", "bloomberg.com", "reuters.com", "crunchbase.com", "glassdoor.", "indeed.com",
)
DOMAIN_ENDINGS = (".com", ".ca", ".com.au", ".co.uk", ".net", ".org", ".co", ".io", ".energy", ".oil")
IMAGE_ENDINGS = r"\.(png|webp|jpe?g|gif|svg)(\?|$)"


def _any(text: Column, words: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _points_of(source: Column, points: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in points.items() for x in kv]), source), F.lit(0))


def domain_points(host: Column, domains: Column) -> Column:
    """Points for the company's domains, in order: the first that the host holds ends the search."""
    none = F.struct(F.lit(0).alias("points"), F.lit(False).alias("met"))

    def step(acc: Column, d: Column) -> Column:
        stem = F.split_part(d, F.lit("."), F.lit(1))
        near = F.when((F.length(stem) >= 4) & F.contains(host, stem), 16).otherwise(0)
        return F.when(acc["met"], acc).when(F.contains(host, d), F.struct((acc["points"] + 28).alias("points"), F.lit(True).alias("met"))).otherwise(F.struct((acc["points"] + near).alias("points"), F.lit(False).alias("met")))

    return F.aggregate(F.filter(domains, lambda d: d != ""), none, step, lambda acc: acc["points"])


def url_score(url: Column, source: Column, domains: Column, tokens: Column) -> Column:
    """Points for a URL: its own words, the company's tokens and domains, where it was found, less what marks junk."""
    lower, host = F.lower(url), url_host(url)
    own = reduce(lambda a, b: a + b, [F.when(_any(lower, words), points).otherwise(0) for words, points in URL_POINTS])
    cdn = F.when(_any(lower, ("cloudfront.net",)) & (_any(lower, ("logo",)) | (source == "Brands of the World")), 8).otherwise(0)
    named = F.when(_any(lower, ("logo", "wordmark")), _points_of(source, NAMED_POINTS)).otherwise(0)
    score = own + token_points(lower, tokens) + domain_points(host, domains) - junk_points(url) + cdn + _points_of(source, SOURCE_POINTS) + named
    return let(score, lambda s: F.when((source == "TinEye") & (s < 32), s - 6).otherwise(s))


def candidates(found: DataFrame, companies: DataFrame, group: str, least: int = 18, keep: int = 30) -> DataFrame:
    """The candidate flow: usable images, scored for their company, one of each URL, the best ``keep`` a company.

    found: group, ordinal, url, source; companies: group, name, domains (array)."""
    known = companies.select(group, company_tokens("name").alias("__tokens"), F.col("domains").alias("__domains"))
    rows = found.filter(usable_image(F.col("url"))).join(known, group)
    scored = rows.withColumn("score", url_score(F.col("url"), F.col("source"), F.col("__domains"), F.col("__tokens")))
    return picked(scored.drop("__tokens", "__domains"), group, least, keep)


def token_points(text: Column, tokens: Column) -> Column:
    """Points for company tokens in a text: more for long ones and for two or more, a loss for none."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    met = F.filter(tokens, lambda t: (F.length(t) >= 3) & F.contains(plain, t))
    each = F.aggregate(met, F.lit(0), lambda a, t: a + F.when(F.length(t) >= 6, 16).otherwise(12))
    some = F.when(F.size(met) >= 2, 10).when(F.size(met) == 0, -6).otherwise(0)
    return F.when((F.size(tokens) == 0) | (plain == ""), 0).otherwise(each + some)


def junk_points(url: Column) -> Column:
    """Points lost by stock, news and social hosts, and by paths of portraits, articles and icons."""
    lower = F.lower(url)
    icon = lower.rlike("apple-touch-icon|/favicon/|favicon.ico")
    path = F.when(_any(lower, JUNK_PATHS), F.when(icon, 80).otherwise(20)).otherwise(0)
    return F.when(_any(lower, JUNK_HOSTS), 35).otherwise(0) + path


def is_corporate(domain: Column, tokens: Column) -> Column:
    """A domain that isn't a public site and shares a token with the company, if it has any."""
    host, stem = F.lower(domain), F.split_part(F.lower(domain), F.lit("."), F.lit(1))
    shares = F.exists(tokens, lambda t: (F.length(t) >= 4) & (F.contains(stem, t) | F.contains(t, stem)))
    return ~_any(host, NOT_CORPORATE) & (shares | (F.size(tokens) == 0))


def guessed_domains(name: Column) -> Column:
    """Domains that a company of this name may have, the likeliest first."""
    words = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(inc|incorporated|ltd|limited|llc|corp|corporation|co|company|plc|lp|partnership|the)\b", ""), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    joined, dashed = F.array_join(words, ""), F.array_join(words, "-")
    spread = F.flatten(F.transform(F.array(*map(F.lit, DOMAIN_ENDINGS)), lambda e: F.array(F.concat(joined, e), F.concat(dashed, e))))
    pair = F.concat(F.get(words, F.lit(0)), F.coalesce(F.get(words, F.lit(1)), F.lit("")))
    short = F.array(F.concat(pair, F.lit(".com")), F.concat(F.get(words, F.lit(0)), F.lit(".com")), F.concat(pair, F.lit(".ca")), F.concat(F.get(words, F.lit(0)), F.lit(".ca")))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(spread, short)))


def usable_image(url: Column) -> Column:
    lower = F.lower(url)
    return lower.startswith("http") & lower.rlike(f"{IMAGE_ENDINGS}|/image|logo") & ~_any(lower, ("data:", "javascript:", ".html", ".pdf"))


def united(*sources: DataFrame) -> DataFrame:
    """Sources one after the other, with the rank of each."""
    return reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)])


def ordered_distinct(rows: DataFrame, key: Column, *order: str, keep: int | None = None) -> DataFrame:
    """The first row of each key, in an order, and the first ``keep`` of those."""
    at = F.row_number().over(Window.partitionBy("__k").orderBy(*order))
    out = rows.withColumn("__k", key).withColumn("__i", at).filter("__i = 1").drop("__i", "__k")
    return out if keep is None else out.orderBy(*order).limit(keep)


def best_per_key(rows: DataFrame, key: str, score: str = "score", ordinal: str = "ordinal") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), ordinal))
    return rows.withColumn("__i", at).filter("__i = 1").drop("__i")


def picked(rows: DataFrame, group: str, least: int = 18, keep: int = 30) -> DataFrame:
    """Per group the best ``keep`` URLs with at least ``least`` points, or of all if none has: position from 1."""
    usable = F.col("score") >= least
    some = F.max(usable).over(Window.partitionBy(group))
    pool = rows.withColumn("key", url_key("url")).filter("key <> ''").withColumn("__some", some).filter(~F.col("__some") | usable).drop("__some")
    one = best_per_key(pool.withColumn("__gk", F.struct(group, "key")), "__gk").drop("__gk")
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "ordinal"))
    return one.withColumn("position", at).filter(F.col("position") <= keep)


def until_enough(rows: DataFrame, group: str, strong: Column, enough: int, batch: int, order: str) -> DataFrame:
    """Rows of the batches that would be fetched before ``enough`` strong ones are there."""
    n = F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / batch)
    of_batch = rows.withColumn("batch", n.cast("int"))
    before = F.sum(strong.cast("int")).over(Window.partitionBy(group).orderBy("batch").rangeBetween(Window.unboundedPreceding, -1))
    return of_batch.withColumn("__b", F.coalesce(before, F.lit(0))).filter(F.col("__b") < enough).drop("__b")


def reranked(rows: DataFrame, group: str, opinion: DataFrame, first: int = 18, step: int = 3) -> DataFrame:
    """Scores with points for the order that an outside opinion (group, order: array of ordinals) gives."""
    boost = opinion.select(group, F.posexplode("order").alias("i", "ordinal")).withColumn("boost", F.greatest(F.lit(0), first - step * F.col("i")))
    return rows.join(boost.drop("i"), [group, "ordinal"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0))).drop("boost")


def hits_first(rows: DataFrame, column: str, query: str, keep: int = 24, ordinal: str = "ordinal") -> DataFrame:
    """Names that start with the text before those that contain it, each in input order; scanning stops
    once twice ``keep`` were met, so what comes later in the input is not seen."""
    q = query.strip().lower()
    name = F.lower(column)
    tier = F.when(name.startswith(q), 0).when(name.contains(q), 1)
    met = rows.withColumn("tier", tier).filter("tier is not null").orderBy(ordinal).limit(2 * keep)
    return met.orderBy("tier", ordinal).limit(keep)


def longest_first(rows: DataFrame, column: str, tie: str) -> DataFrame:
    """Rows with the compact key of a name and their place, longest keys first, over the whole table."""
    keyed = rows.withColumn("key", compact_key(column)).withColumn("__shortness", -F.length("key"))
    return numbered(keyed, "place", "__shortness", tie).drop("__shortness")
