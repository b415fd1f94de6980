import pytest
from pyspark.sql import functions as F

from quillstack.llm.common import shared_path
from quillstack.llm.shard_store import ShardStore


@pytest.fixture
def store(spark):
    return ShardStore(spark, shared_path(spark, "test-shards"), target_bytes=30_000, small_bytes=4_000, fan_in=3)


def rows_of(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_arrivals_are_kept_whole(store, docs, odd):
    frame = docs(*odd, *[(i, f"text {i}") for i in range(100, 160)])
    store.append_arrivals(frame, F.pmod(F.xxhash64("doc_id"), F.lit(7)))
    assert rows_of(store.read()) == rows_of(frame) and store.read().columns == frame.columns
    got, runs = store.located(), store.runs()
    assert rows_of(got.select("row.*")) == rows_of(frame)
    listed = {(r.shard, r.rows, r.tier) for r in store.shards().collect()}
    assert listed == {(r.shard, r["count"], r.tier) for r in got.groupBy("shard", "tier").count().collect()}
    assert sum(r.rows for r in runs) == frame.count() and sum(r.shards for r in runs) == len(listed)
    tiers = [r.tier for r in runs]
    assert all(tiers.count(t) < 3 for t in tiers) and max(tiers) >= 1


def test_empty_arrivals(spark, docs):
    store = ShardStore(spark, shared_path(spark, "test-empty"))
    assert store.read().count() == store.located().count() == store.shards().count() == 0
    assert store.append_arrivals(docs(), F.pmod(F.xxhash64("doc_id"), F.lit(7))) == 1
    assert store.read().count() == store.located().count() == 0 and store.read().columns == docs().columns


def test_versions_merges_and_conflicts(store, docs):
    assert (store.version(), store.runs()) == (0, [])
    one = docs((1, "a"), (2, "b"))
    for v in (1, 2):
        assert store.append(one.coalesce(1)) == v
    before = store.runs()
    assert not store.commit(0, []) and store.version() == 2
    assert store.append(docs().coalesce(1)) == 3 and len(store.runs()) == len(before)
    store.append(one.coalesce(1))
    last = store.compact()
    assert last == 5 and [(r.tier, r.rows) for r in store.runs()] == [(1, 6)]
    assert store.read().count() == 6
    assert store._add([], frozenset(r.name for r in before)) is None
    one.write.parquet(f"{store.root}/data/stray")
    assert store.read().count() == 6 and store.vacuum() == 0


def test_old_versions_stay_until_vacuum(store, docs):
    for i in range(3):
        store.append(docs((i, f"text {i}")).coalesce(1))
    held, two = store.read(), store.version() - 1
    want = rows_of(held)
    assert store.compact() == 4 and len(store.runs()) == 1
    assert rows_of(held) == rows_of(store.read()) == want  # a reader from before the merge
    assert rows_of(store.read(two)) == want[:2] and store.versions() == [1, 2, 3, 4]
    assert store.vacuum(retain=2, older_than_seconds=0) == 0  # version 3 lists what was merged
    assert store.versions() == [3, 4] and rows_of(store.read(3)) == want
    assert store.vacuum(older_than_seconds=0) > 0 and rows_of(store.read()) == want
    with pytest.raises(ValueError):
        store.read(two)


def test_writers_at_once(store, docs, spark):
    """A merge whose runs another writer has merged is dropped, and no row is lost or doubled."""
    for i in range(3):
        store.append(docs((i, "x")).coalesce(1))
    runs = store.runs()
    store.compact()
    store._merge(runs, 1)
    assert store.version() == 4 and store.read().count() == 3


def test_columns_that_clash_or_change(store, spark):
    names = "shard string, tier string, version string, run string, arrival int, rows int, `a b` int"
    frame = spark.createDataFrame([("s", "t", "v", "r", i % 2, i, i) for i in range(6)], names)
    store.append_arrivals(frame, F.col("arrival"))
    assert rows_of(store.read()) == rows_of(frame) == rows_of(store.located().select("row.*"))
    store.append(frame.select("shard", F.lit(1.5).alias("more")))
    wide = store.read()
    assert wide.columns == [*frame.columns, "more"] and wide.filter("more is null").count() == 6 == wide.filter("tier is null").count()
    with pytest.raises(ValueError):
        store.append(frame.select(F.lit(1).alias("shard")))
