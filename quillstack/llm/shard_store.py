"""Size-tiered shards with versioned manifests, by Spark's own readers and writers.

Arrivals are appended as small immutable Parquet shards.  A run is the folder of shards that one
append or merge has written; it is listed whole or not at all.  Runs of similar size form a tier;
once a tier holds ``fan_in`` runs they are merged into shards of about the target size, one tier
up.  What exists is what a manifest lists: a JSON file of the runs, of which there are fewer
than ``fan_in`` a tier however many rows there are, written under a temporary name and renamed to
the next version number.  The rename fails if that version exists, so of two writers one starts
anew from the other's manifest, and a reader sees a whole version or none.  The shards of a run,
with sizes and rows from their footers, are a table of their own that tasks write.

Nothing is deleted by a merge, so frames read before it and versions before it stay readable;
``vacuum`` drops the versions that are no longer wanted, with the files that only they list and
those that none does (from a lost task or a merge that failed).

Rows move in narrow reads and writes without a shuffle, so a hot key or source has no bearing on
the work of a task.

Edge cases: null and empty texts, null and repeated ids are kept as they are; an empty arrival
adds no run but a version; columns go through unchanged whatever their names; columns that only some
arrivals have are null in the others, and one that changes its type is refused; a store without
manifests has version 0 without runs or columns.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import free_names

SHARD = "shard string, run string, bytes long, rows long"


@dataclass(frozen=True)
class Run:
    name: str
    folder: str  # of its shards, below the store
    listing: str  # of the table with its shards, below the store
    tier: int
    shards: int
    bytes: int
    rows: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, small_bytes: int = 4 << 20, fan_in: int = 4):
        """Tier 0 are runs of up to ``small_bytes``; each next tier is ``fan_in`` times larger."""
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.small_bytes, self.fan_in = target_bytes, small_bytes, fan_in
        self.jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if self._path("").toUri().getScheme() else self.fs.getUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    # manifests

    def versions(self) -> list[int]:
        """Those that can be read, oldest first."""
        return [int(n[1:-5]) for n in self._names("manifest") if n.startswith("v") and n.endswith(".json")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {"schema": None, "runs": []}
        path = self._path(f"manifest/v{version:012d}.json")
        if not self.fs.exists(path):
            raise ValueError(f"version {version} isn't in the store")
        stream = self.fs.open(path)
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**x) for x in self._manifest(self.version() if version is None else version)["runs"]]

    def shards(self, version: int | None = None) -> DataFrame:
        """shard (its path below the store), run, bytes, rows and tier of a version's shards."""
        runs = self.runs(version)
        if not runs:
            return self.spark.createDataFrame([], f"{SHARD}, tier int")
        known = self.spark.read.schema(SHARD).parquet(*[f"{self.root}/{x}" for x in sorted({r.listing for r in runs})])
        tiers = self.spark.createDataFrame([(r.name, r.tier) for r in runs], "run string, tier int")
        return known.join(tiers, "run").select("shard", "run", "bytes", "rows", "tier")

    def commit(self, base: int, runs: list[Run], schema: StructType | None = None) -> bool:
        """Makes ``runs`` the version after ``base``; False if another writer has made one. The schema
        stays that of the version before unless one is given."""
        temporary = self._path(f"manifest/.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temporary, False)
        try:
            known = schema.jsonValue() if schema else self._manifest(base)["schema"]
            stream.write(bytearray(json.dumps({"version": base + 1, "schema": known, "runs": [asdict(r) for r in sorted(runs, key=lambda r: r.name)]}).encode()))
        finally:
            stream.close()
        gateway = self.spark.sparkContext._gateway
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        choice = gateway.new_array(kind, 1)
        choice[0] = kind.NONE
        try:
            self.context.rename(temporary, self._path(f"manifest/v{base + 1:012d}.json"), choice)
        except Exception as e:
            self.fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _schema(self, version: int) -> StructType:
        known = self._manifest(version)["schema"]
        return StructType.fromJson(known) if known else StructType()

    def _add(self, fresh: Iterable[Run], gone: frozenset[str] = frozenset(), schema: StructType | None = None) -> int | None:
        """The new version, or None if another writer has merged the runs that should go."""
        while True:
            base = self.version()
            now = self.runs(base)
            if gone - {r.name for r in now}:
                return None
            if self.commit(base, [r for r in now if r.name not in gone] + list(fresh), _widened(self._schema(base), schema)):
                return base + 1

    # arrivals

    def _described(self, batch: str, folders: dict[str, str], schema: StructType) -> list[Run]:
        """Runs of the shards in folders (by run); rows and sizes come from footers, and only sums, one
        row a run, reach the driver. A folder without rows is no run."""
        listing = f"shards/{batch}"
        of_run = [self._files(folder, schema).withColumn("run", F.lit(run)) for run, folder in folders.items()]
        reduce(DataFrame.unionByName, of_run).select("shard", "run", "bytes", "rows").write.parquet(f"{self.root}/{listing}")
        known = self.spark.read.schema(SHARD).parquet(f"{self.root}/{listing}")
        sums = known.groupBy("run").agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
        return [Run(r["run"], folders[r["run"]], listing, self._tier(r["bytes"]), r["shards"], r["bytes"], r["rows"]) for r in sums]

    def _files(self, folder: str, schema: StructType) -> DataFrame:
        """shard, bytes and rows of a folder's files that aren't empty; no column is read."""
        path, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        files = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(path.alias("p"), size.alias("bytes"))
        files = files.groupBy("p", "bytes").agg(F.count("*").alias("rows"))
        return files.select(F.concat(F.lit(f"{folder}/"), F.substring_index("p", "/", -1)).alias("shard"), "bytes", "rows")

    def _tier(self, size: int) -> int:
        return max(0, math.ceil(math.log(max(size, 1) / self.small_bytes, self.fan_in)))

    def append(self, arrival: DataFrame) -> int:
        """Adds an arrival as it is partitioned; returns the new version."""
        _widened(self._schema(self.version()), arrival.schema)
        run = uuid.uuid4().hex[:12]
        arrival.write.parquet(f"{self.root}/data/{run}")
        return self._add(self._described(run, {run: f"data/{run}"}, arrival.schema), schema=arrival.schema)

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> int:
        """Adds the rows of each value of ``arrival`` as an arrival of its own, all written in one
        pass, each committed and followed by the merges it calls for."""
        _widened(self._schema(self.version()), rows.schema)
        batch = uuid.uuid4().hex[:12]
        (value,) = free_names(rows, "arrival")
        rows.withColumn(value, arrival).write.partitionBy(value).parquet(f"{self.root}/data/{batch}")
        folders = {f"{batch}-{n.split('=', 1)[1]}": f"data/{batch}/{n}" for n in self._names(f"data/{batch}") if "=" in n}
        if not folders:
            return self._add([], schema=rows.schema)
        for run in sorted(self._described(batch, folders, rows.schema), key=lambda r: r.name):
            self._add([run], schema=rows.schema)
            self.compact()
        return self.version()

    # merges

    def compact(self) -> int:
        """Merges tiers until none holds ``fan_in`` runs; returns the version."""
        while True:
            tiers: dict[int, list[Run]] = {}
            for r in self.runs():
                tiers.setdefault(r.tier, []).append(r)
            full = [t for t, runs in tiers.items() if len(runs) >= self.fan_in]
            if not full:
                return self.version()
            tier = min(full)
            self._merge(sorted(tiers[tier], key=lambda r: (r.bytes, r.name))[: self.fan_in], tier + 1)

    def _merge(self, runs: list[Run], tier: int) -> None:
        name, schema = uuid.uuid4().hex[:12], self._schema(self.version())
        files = max(1, round(sum(r.bytes for r in runs) / self.target_bytes))
        self._read(runs, schema).coalesce(files).write.parquet(f"{self.root}/data/{name}")
        fresh = [Run(**asdict(r) | {"tier": max(tier, r.tier)}) for r in self._described(name, {name: f"data/{name}"}, schema)]
        self._add(fresh, frozenset(r.name for r in runs))

    def vacuum(self, retain: int = 1, older_than_seconds: float = 86_400) -> int:
        """Drops all but the newest ``retain`` versions, and data files as old as given that the others
        don't list; younger ones may belong to a writer that hasn't committed. Returns the number of files."""
        old = self.versions()[: -max(retain, 1)]
        for v in old:
            self.fs.delete(self._path(f"manifest/v{v:012d}.json"), False)
        listed = {x for v in self.versions() for r in self.runs(v) for x in (r.folder, r.listing)}
        before, gone = (time.time() - older_than_seconds) * 1000, 0
        for top in ("data", "shards"):
            if not self.fs.exists(self._path(top)):
                continue
            walk = self.fs.listFiles(self._path(top), True)
            while walk.hasNext():
                s = walk.next()
                folder = s.getPath().getParent().toString().split(f"/{top}/")[-1]
                if f"{top}/{folder}" not in listed and s.getModificationTime() <= before:
                    gone += s.getPath().getName().endswith(".parquet")
                    self.fs.delete(s.getPath(), False)
        return gone

    # reading

    def _read(self, runs: list[Run], schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.folder}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their own columns only."""
        version = self.version() if version is None else version
        runs, schema = self.runs(version), self._schema(version)
        return self._read(runs, schema) if runs else self.spark.createDataFrame([], schema)

    def located(self, version: int | None = None) -> DataFrame:
        """row (a struct of the row's own columns), shard, tier and version."""
        version = self.version() if version is None else version
        runs, schema = self.runs(version), self._schema(version)
        if not runs:
            return self.spark.createDataFrame([], StructType().add("row", schema).add("shard", "string").add("tier", "integer").add("version", "integer"))
        shard = F.concat(F.lit("data/"), F.substring_index("_metadata.file_path", "/data/", -1))
        of_tier = [self._read([r for r in runs if r.tier == t], schema).select(F.struct("*").alias("row"), shard.alias("shard"), F.lit(t).alias("tier"), F.lit(version).alias("version")) for t in sorted({r.tier for r in runs})]
        return reduce(DataFrame.unionByName, of_tier)


def _widened(known: StructType, fresh: StructType | None) -> StructType | None:
    """The columns of both; the same name must have the same type."""
    if fresh is None:
        return None
    types = {f.name: f.dataType for f in known}
    for f in fresh:
        if types.setdefault(f.name, f.dataType).simpleString() != f.dataType.simpleString():
            raise ValueError(f"column {f.name} was {types[f.name].simpleString()}")
    return StructType([*known, *(f for f in fresh if f.name not in known.names)])
