"""Substring search by an index of trigrams.

Texts are lower-cased joints of columns.  The index has, in folders that it owns:

* ``texts``: id and text in the order of ids, in pages of few rows, so that a scan for given ids skips the rest;
* ``postings``: (gram, n, ids) for each distinct run of three characters of a few megabytes of texts, the n ids of those
  that have it in one list, dealt into folders by a hash of the gram and in the order of grams there, so that a scan for
  given grams reads their pages;
* ``counts``: how many texts have each gram.

A search looks up the counts of the query's grams, reads the postings of the rarest few only, keeps the ids
that have all of those, and verifies their texts, so that no hit is wrong and none is lost.  Common grams are
never read: a gram that every text has is as long as the table, but stands beside rarer ones in any query that
is worth an index.  A query of fewer than three characters has no gram: it scans the texts, and so does one
whose rarest gram is in more than ``scan_share`` of them, where an index would read more than a scan.

Grams are found and gathered in the tasks that read the texts, some megabytes at a time, so no row a gram and text is made
or shuffled, and a hot gram is written by all tasks.  Edge cases: null columns count as absent; blank queries match all;
repeated ids are texts of their own; empty tables give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3
_PAGES = {"parquet.page.row.count.limit": "500", "parquet.block.size": str(16 << 20)}


_LISTS = _PAGES | {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}  # lists of ids are written as differences
_AT_ONCE = 4 << 20  # characters


def _gathered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams of the texts, places where the texts of each begin and end, texts by number)."""
    n, points = len(texts), np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    letters, rank = np.flatnonzero(np.bincount(points)), np.zeros(int(points.max()) + 1, dtype=np.int64)
    rank[letters] = np.arange(k := len(letters))
    number, c = np.repeat(np.arange(n), [len(t) for t in texts]), rank[points]
    within = number[: 1 - GRAM] == number[GRAM - 1 :]
    code, number, known = ((c[:-2] * k + c[1:-1]) * k + c[2:])[within], number[: 1 - GRAM][within], None
    if k**GRAM * n >= 1 << 62:  # of very many letters
        known, code = np.unique(code, return_inverse=True)
    found = code * n + number
    found.sort()
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    gram, number = np.divmod(found, n)
    starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    g = gram[starts] if known is None else known[gram[starts]]
    names = np.stack([letters[g // (k * k)], letters[g // k % k], letters[g % k]], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [names[i : i + GRAM] for i in range(0, len(names), GRAM)], np.concatenate((starts, [len(gram)])), number


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, ids) of (id, text), some megabytes of texts at a time."""
    for batch in batches:
        texts = [t.decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        keep = [i for i, t in enumerate(texts) if len(t) >= GRAM]
        ids, texts = batch.column("id").take(pa.array(keep, pa.int64())), [texts[i] for i in keep]
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= _AT_ONCE):
                size, end = size + len(texts[end]), end + 1
            grams, ends, numbers = _gathered(texts[at:end])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.take(pa.array(numbers + at)))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.diff(ends), pa.int64()), lists], ["gram", "n", "ids"])
            at = end


class TrigramIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, salts: int = 8, rarest: int = 3, scan_share: float = 0.25, few: int = 2_000):
        """``few``: up to so many candidates their ids are pushed into the scan of texts; with more all texts are scanned, as a
        join with them would read all and shuffle them too. ``salts`` has no effect since postings aren't shuffled."""
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets, self.salts, self.rarest, self.scan_share, self.few = buckets, salts, rarest, scan_share, few

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, rows: DataFrame, id_col: str, *columns: str) -> None:
        texts = rows.select(F.col(id_col).alias("id"), F.lower(F.concat_ws(" ", *columns)).alias("text"))
        texts.sort("id").write.options(**_PAGES).parquet(f"{self.path}/texts")
        kind = self.texts().schema["id"].dataType.simpleString()
        posted = self.texts().mapInArrow(_posted, f"gram string, n long, ids array<{kind}>").withColumn("bucket", self._bucket(F.col("gram")))
        posted.sortWithinPartitions("bucket", "gram").write.options(**_LISTS).partitionBy("bucket").parquet(f"{self.path}/postings")
        counts = self._postings().groupBy("gram").agg(F.sum("n").alias("texts"))
        counts.sort("gram").write.options(**_PAGES).parquet(f"{self.path}/counts")

    def texts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/texts")

    def _postings(self) -> DataFrame:
        kind = self.texts().schema["id"].dataType.simpleString()
        return self.spark.read.schema(f"gram string, n long, ids array<{kind}>, bucket int").parquet(f"{self.path}/postings")

    def _rare(self, query: str) -> list[str] | None:
        """The rarest grams of the query; None for a scan, an empty list where one of them is in no text."""
        grams = sorted({query[i : i + GRAM] for i in range(len(query) - GRAM + 1)})
        if not grams:
            return None
        known = {r["gram"]: r["texts"] for r in self.spark.read.parquet(f"{self.path}/counts").filter(F.col("gram").isin(grams)).collect()}  # at most the query's
        if len(known) < len(grams):
            return []
        chosen = sorted(grams, key=lambda g: (known[g], g))[: self.rarest]
        return None if known[chosen[0]] > self.scan_share * self.texts().count() else chosen

    def candidates(self, query: str) -> DataFrame | None:
        """Ids of the texts that have the query's rarest grams; None where a scan is to be had."""
        query = query.strip().lower()
        chosen = self._rare(query)
        if chosen is None:
            return None
        gram = F.col("gram")
        # literal buckets prune folders, literal grams reach the scan
        buckets = [r[0] for r in self.spark.createDataFrame([(g,) for g in chosen], "gram string").select(self._bucket(gram)).distinct().collect()]
        posted = self._postings().filter(F.col("bucket").isin(buckets) & gram.isin(chosen)).select("gram", F.explode("ids").alias("id"))
        return posted.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") >= max(len(chosen), 1)).select("id")

    def search(self, query: str) -> DataFrame:
        """id and text of the texts that contain the query, in any case."""
        q = query.strip().lower()
        hit = F.contains("text", F.lit(q))
        found = self.candidates(q)
        if found is None:
            return self.texts().filter(hit) if q else self.texts()
        ids = [r["id"] for r in found.limit(self.few + 1).collect()]
        if len(ids) <= self.few:
            return self.texts().filter(F.col("id").isin(ids)).filter(hit)
        return self.texts().filter(hit)
