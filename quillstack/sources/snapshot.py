"""Keyed snapshots that upserts change bucket by bucket.

A snapshot is a folder of Parquet files dealt into buckets by a hash of the key, and of manifests, one a
version: JSON of where each bucket lies and how many rows it has.  An upsert reads the buckets of its
keys, finds the rows that change anything, and writes the buckets of those anew, beside the old ones; then
it commits a manifest in which all other buckets stay where they are.  So a batch costs what its buckets
cost, not what the table does, readers see one version or the next, and a failed or lost writer leaves the
last version as it was.  The manifest's rename fails if that version exists; of two writers one starts
anew on the other's version.

Keys are single after the merge, so buckets are of one size whatever the batches hold; a hot key of a
batch is one row a task before it is shuffled.  A large bucket is written by several tasks.

Which row stays for a key: of a batch the newest by the columns ``newer``, ties by the other columns; it
replaces the stored row if it is newer, and with no ``newer`` if it differs in any column.  Null keys are
keys like others, and a row with nulls in ``newer`` is the oldest. A batch without rows, or one that
changes nothing, makes no version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.sync import _free, first_per_key


class KeyedSnapshot:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], newer: Sequence[str] = (), buckets: int = 64, rows_a_file: int = 1_000_000):
        """``buckets`` counts when the first version is written: a few times the number of executors' cores at least,
        as an upsert's least cost is one bucket."""
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.newer, self.buckets, self.rows_a_file = list(keys), list(newer), buckets, rows_a_file
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(self.conf)

    # manifests

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        names = [s.getPath().getName() for s in self.files.listStatus(folder)] if self.files.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The last version's, or a given one's; that of no rows if there is none."""
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "buckets": self.buckets, "schema": None, "places": {}, "batches": {}}
        text = self.spark.read.text(f"{self.root}/manifest/v{version or known[-1]:012d}.json", wholetext=True).first()
        return json.loads(text[0])

    def _commit(self, found: dict) -> bool:
        temporary = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = self.files.create(temporary, False)
        out.write(json.dumps(found).encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kind, 1)
        never[0] = kind.NONE
        try:
            context.rename(temporary, self._path(f"manifest/v{found['version']:012d}.json"), never)
        except Exception as e:
            self.files.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    # rows

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _read(self, found: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(found["schema"]) if found["schema"] else StructType()
        places = [p for b, (p, _) in sorted(found["places"].items()) if buckets is None or int(b) in buckets]
        if not places:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in places))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of keys, from the keys' buckets only."""
        found = self.manifest()
        rows = self._read(found, self._touched(wanted, found["buckets"]))
        return rows.join(wanted.select(*self.keys).distinct(), self.keys, "left_semi") if rows.columns else rows

    def _touched(self, rows: DataFrame, buckets: int) -> list[int]:
        return [r[0] for r in rows.select(self.bucket_of(buckets)).distinct().collect()]  # at most as many as buckets

    def _same_key(self, a: str, b: str) -> Column:
        same = F.lit(True)
        for k in self.keys:
            same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
        return same

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Folds rows in and returns the version; ``batch``: a stream's name and the number of its batch, once only."""
        while True:
            found = self.manifest()
            if batch and found["batches"].get(batch[0], -1) >= batch[1]:
                return found["version"]
            made = self._upserted(found, rows, batch)
            if made is found or self._commit(made):
                return made["version"]

    def _upserted(self, found: dict, rows: DataFrame, batch: tuple[str, int] | None) -> dict:
        columns = StructType.fromJson(found["schema"]).names if found["schema"] else rows.columns
        own = [c for c in columns if c not in self.keys]
        order = [F.col(c).desc_nulls_last() for c in [*self.newer, *(c for c in own if c not in self.newer)]]
        fresh = first_per_key(rows.select(*columns), self.keys, *order) if order else rows.select(*columns).distinct()
        bucket, is_new = _free(fresh, "bucket", "is_new")
        fresh = fresh.withColumn(bucket, self.bucket_of(found["buckets"]))
        work = f"data/v{found['version'] + 1:012d}-{uuid.uuid4().hex}"
        if found["places"]:
            before = self._read(found, self._touched(rows, found["buckets"]))
            a, b = fresh.alias("a"), before.withColumn(is_new, F.lit(False)).alias("b")
            stands = F.col(f"b.{is_new}").isNotNull()
            later = lambda s: F.struct(*(F.col(f"{s}.{c}") for c in self.newer)) if self.newer else F.struct(*(F.col(f"{s}.{c}") for c in own))
            wins = later("a") > later("b") if self.newer else ~later("a").eqNullSafe(later("b"))
            joined = a.join(b, self._same_key("a", "b"), "left").filter(~stands | F.coalesce(wins, F.lit(False)))
            changed = joined.select(*(F.col(f"a.{c}") for c in columns), F.col(f"a.{bucket}").alias(bucket), (~stands).alias(is_new))
        else:
            changed = fresh.withColumn(is_new, F.lit(True))
        changed.write.parquet(f"{self.root}/{work}/changed")  # read twice below, and again if a task is lost
        changed = self.spark.read.parquet(f"{self.root}/{work}/changed")
        added = {r[0]: r[1] for r in changed.groupBy(bucket).agg(F.sum(F.col(is_new).cast("long"))).collect()}  # at most as many as buckets
        if not added:
            self.files.delete(self._path(work), True)
            return found
        kept = self._read(found, list(added)) if found["places"] else None
        after = changed.drop(is_new)
        if kept is not None and kept.columns:
            stays = kept.alias("a").join(after.alias("b"), self._same_key("a", "b"), "left_anti").withColumn(bucket, self.bucket_of(found["buckets"]))
            after = after.unionByName(stays)
        places = {b: found["places"].get(str(b), (None, 0))[1] + n for b, n in added.items()}
        self._written(after, bucket, max(places.values()), len(places), f"{work}/rows")
        self.files.delete(self._path(f"{work}/changed"), True)
        schema = found["schema"] or rows.select(*columns).schema.jsonValue()
        batches = found["batches"] | ({batch[0]: batch[1]} if batch else {})
        return found | {"version": found["version"] + 1, "schema": schema, "batches": batches, "places": found["places"] | {str(b): (f"{work}/rows/{bucket}={b}", n) for b, n in places.items()}}

    def _written(self, rows: DataFrame, bucket: str, largest: int, buckets: int, where: str) -> None:
        """Each bucket by as many tasks as give files of ``rows_a_file``."""
        salts = -(-largest // self.rows_a_file)
        salt = F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(salts))
        dealt = rows.repartition(buckets * salts, F.col(bucket), salt)
        dealt.write.partitionBy(bucket).parquet(f"{self.root}/{where}")

    def delete(self, gone: DataFrame) -> int:
        """Takes rows of keys out; buckets without any of them stay as they are."""
        while True:
            found = self.manifest()
            if not found["places"]:
                return found["version"]
            rows = self._read(found, self._touched(gone, found["buckets"]))
            if not rows.columns:
                return found["version"]
            (bucket,) = _free(rows, "bucket")
            rows = rows.withColumn(bucket, self.bucket_of(found["buckets"]))
            a, b = rows.alias("a"), gone.select(*self.keys).distinct().alias("b")
            hit = {r[0]: r[1] for r in a.join(b, self._same_key("a", "b"), "left_semi").groupBy(bucket).count().collect()}
            if not hit:
                return found["version"]
            left = {b: found["places"][str(b)][1] - n for b, n in hit.items()}
            work = f"data/v{found['version'] + 1:012d}-{uuid.uuid4().hex}"
            stays = a.filter(F.col(bucket).isin(list(hit))).join(b, self._same_key("a", "b"), "left_anti")
            if any(left.values()):
                self._written(stays, bucket, max(left.values()), len(left), f"{work}/rows")
            places = {b: p for b, p in found["places"].items() if int(b) not in left} | {str(b): (f"{work}/rows/{bucket}={b}", n) for b, n in left.items() if n}
            if self._commit(found | {"version": found["version"] + 1, "places": places}):
                return found["version"] + 1

    def vacuum(self, retain: int = 1) -> None:
        """Drops all versions but the last ``retain``, and the buckets that only those have. Not beside a writer:
        what it is about to commit isn't listed yet."""
        known = self.versions()
        stay = {p for v in known[-retain:] for p, _ in self.manifest(v)["places"].values()}
        for v in known[:-retain]:
            for p, _ in self.manifest(v)["places"].values():
                if p not in stay:
                    self.files.delete(self._path(p), True)
        for v in known[:-retain]:
            self.files.delete(self._path(f"manifest/v{v:012d}.json"), False)

    def follow(self, stream: DataFrame, name: str, checkpoint: str):
        """Folds a stream in, batch by batch; a batch that is run again after a failure changes nothing."""
        fold = lambda rows, number: self.upsert(rows, (name, number)) and None
        return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
