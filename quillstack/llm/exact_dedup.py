"""Exact deduplication by progressive refinement.

Rows are told apart by ever more costly keys: the length of the normalised text, then a hash
of its first characters, then the SHA-256 of all of it.  Only rows whose cheaper keys meet
another row's go on to the next one.

Edge cases: a null text counts as empty; empty texts equal each other; of equal texts the
smallest id stays (null ids count as largest); of repeated rows with one id one row stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_names, stored, whole_text


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(whole_text(text), SPACES, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256, all_digests: bool = True) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``all_digests``: the digest of every row is wanted, so it is taken in the one scan; without
    it, a second scan hashes whole texts of surviving groups only and leaves the others null.
    """
    return _refined(docs, id_col, text_col, prefix, all_digests).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _cheap(t: Column, prefix: int) -> list[Column]:
    return [F.length(t).alias("n"), F.xxhash64(F.substring(t, 1, prefix)).alias("p")]


def _refined(docs: DataFrame, id_col: str, text_col: str, prefix: int, all_digests: bool) -> DataFrame:
    """``exact_groups`` with the cheap keys n and p; a row without a digest is alone with its n and p."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("t"))
    cheap = ["doc_id", *_cheap(F.col("t"), prefix)]
    digest = F.sha2("t", 256).alias("text_sha256")
    columns = ["doc_id", "n", "p", "text_sha256"]
    rows = text.select(*cheap, digest if all_digests else F.lit(None).cast("string").alias("text_sha256"))
    rows = stored(rows.groupBy(*columns).agg(F.count("*").alias("times")), "dedup-keys")

    def meeting(frame: DataFrame, *keys: str) -> DataFrame:
        """Keys of two rows or more; counted before the shuffle, so a hot key is one row a task."""
        return stored(frame.groupBy(*keys).agg(F.sum("times").alias("c")).filter("c > 1").select(*keys), "dedup-meet")

    by_length = rows.join(meeting(rows, "n"), "n", "left_semi")
    met = meeting(by_length, "n", "p")
    by_prefix = rows.join(met, ["n", "p"], "left_semi")
    if not all_digests:
        full = text.select(*cheap, "t").join(met, ["n", "p"], "left_semi").select("doc_id", "n", "p", digest)
        by_prefix = stored(full.groupBy(*columns).agg(F.count("*").alias("times")), "dedup-full")
        rows = by_prefix.unionByName(rows.join(met, ["n", "p"], "left_anti"))
    groups = by_prefix.groupBy("n", "p", "text_sha256").agg(F.min("doc_id").alias("keep"), F.sum("times").alias("size"))
    groups = stored(groups.filter("size > 1"), "dedup-groups")
    found = rows.join(groups, ["n", "p", "text_sha256"], "left").select("doc_id", F.coalesce("keep", "doc_id").alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), "text_sha256", "n", "p", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """The documents, all columns, without the rows that an equal text replaces.

    Whole texts are hashed in surviving groups only. Rows leave by the ids to be dropped, a set as
    large as the copies; an id that stands both on rows that go and on rows that stay is told apart
    by its rows' keys.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    of_row = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    its_id, id_, n, p, sha, own_id, own_n, own_p, own_sha = free_names(docs, "gone_id", "stay_id", "stay_n", "stay_p", "stay_sha", "row_id", "row_n", "row_p", "row_sha")
    found = stored(_refined(docs, id_col, text_col, prefix, False).select(of_row.alias("id"), "n", "p", "text_sha256", "kept"), "dedup-rows")
    gone = stored(found.filter("not kept").select("id").distinct(), "dedup-gone")
    stay = found.filter("kept").join(gone, "id", "left_semi")
    stay = stored(stay.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("p").alias(p), F.col("text_sha256").alias(sha)), "dedup-stay")
    gone = gone.withColumnRenamed("id", its_id)
    clear = docs.join(gone, key == F.col(its_id), "left_anti")
    if stay.isEmpty():
        return clear
    t = normalised(text_col)
    keyed = docs.join(stay.select(id_).distinct(), key == F.col(id_), "left_semi")
    keyed = keyed.withColumns({own_id: key, own_n: _cheap(t, prefix)[0], own_p: _cheap(t, prefix)[1], own_sha: F.sha2(t, 256)})
    same = (F.col(own_id) == F.col(id_)) & (F.col(own_n) == F.col(n)) & (F.col(own_p) == F.col(p)) & (F.col(sha).isNull() | (F.col(own_sha) == F.col(sha)))
    return clear.unionByName(keyed.join(stay, same, "left_semi").dropDuplicates([own_id, own_sha]).select(docs.columns))
