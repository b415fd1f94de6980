"""Replicated tables: keyed upserts, tombstones, last-writer-wins merges.

A sync is a pure function of snapshots.  Time is a parameter; nothing here reads a clock.
Keys decide the partitioning: each function shuffles its inputs by the key once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_key, trim_ws
from ..plans.numbering import highest_so_far, numbered

Keys = str | Sequence[str]


def _list(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_per_key(rows: DataFrame, keys: Keys, *order: Column) -> DataFrame:
    """The first row of each key in an order; give a total order for a repeatable result.

    A window with a limit of one row: Spark keeps the first of each key and partition before the shuffle,
    so a hot key is a few rows. Any order goes, descending and nulls last too."""
    (at,) = _free(rows, "at")
    number = F.row_number().over(Window.partitionBy(*_list(keys)).orderBy(*order))
    return rows.withColumn(at, number).filter(F.col(at) == 1).drop(at)


def _free(rows: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the rows don't have."""
    return [next(n for n in (f"{'_' * i}{name}" for i in range(1, 99)) if n not in rows.columns) for name in names]


def latest_per_key(rows: DataFrame, keys: Keys, when: str, tie: str) -> DataFrame:
    return first_per_key(rows, keys, F.col(when).desc_nulls_last(), F.col(tie))


def named(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows with a key of their name; blank names go."""
    return rows.withColumn("name_key", name_key(name)).withColumn(name, trim_ws(name)).filter("name_key <> ''")


def without(rows: DataFrame, tombstones: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key has no tombstone; when it was set doesn't matter."""
    return rows.join(tombstones.select(*_list(keys)).distinct(), _list(keys), "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: Keys) -> DataFrame:
    """The new snapshot: rows by key replace or join what is there; columns they lack are kept."""
    keys = _list(keys)
    own = [c for c in table.columns if c not in keys]
    fresh = rows.select(*keys, *[F.col(c).alias(f"__{c}") for c in own if c in rows.columns], F.lit(True).alias("__new"))
    joined = table.join(fresh, keys, "full")
    return joined.select(*keys, *[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in rows.columns else F.col(c) for c in own])


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    return without(table, gone, keys)


def delete_all(table: DataFrame) -> DataFrame:
    return table.limit(0)


def set_tombstones(tombstones: DataFrame, keys_gone: DataFrame, keys: Keys, when: Column) -> DataFrame:
    return upsert(tombstones, keys_gone.select(*_list(keys)).distinct().withColumn("deleted_at", when), keys)


def clear_tombstones(tombstones: DataFrame, saved: DataFrame, keys: Keys) -> DataFrame:
    return without(tombstones, saved, keys)


def touched(before: DataFrame, after: DataFrame, keys: Keys, now: Column, stamp: str = "updated_at") -> DataFrame:
    """``after`` with the time of change set on rows that differ from ``before``."""
    keys = _list(keys)
    own = [c for c in after.columns if c not in [*keys, stamp]]
    old = before.select(*keys, F.struct(*own).alias("__old"), F.col(stamp).alias("__stamp"))
    joined = after.join(old, keys, "left")
    return joined.withColumn(stamp, F.when(F.struct(*own).eqNullSafe(F.col("__old")), F.col("__stamp")).otherwise(now)).drop("__old", "__stamp")


def names_to_push(local: DataFrame, remote: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Local names that the shared table lacks and nobody has forgotten."""
    return without(without(local, remote, "name_key"), tombstones, "name_key")


def sync_names(local: DataFrame, remote: DataFrame, tombstones: DataFrame, now: Column, keep: int = 60) -> DataFrame:
    """position, name_key, name, last_used_at: the names in use after a sync, last used first.

    local: name; remote: name, last_used_at; tombstones: name_key."""
    local = first_per_key(named(local), "name_key", F.col("name"))
    remote = named(remote)
    pushed = names_to_push(local, remote, tombstones).select("name_key", "name", now.alias("last_used_at"))
    both = without(remote.select("name_key", "name", "last_used_at").unionByName(pushed), tombstones, "name_key")
    kept = latest_per_key(both, "name_key", "last_used_at", "name").orderBy(F.desc_nulls_last("last_used_at"), "name_key").limit(keep)
    return kept.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("last_used_at"), "name_key")))


def most_recent(uses: DataFrame, name: str, when: str, keep: int = 60) -> DataFrame:
    """name, its last use, and position from 1: what a list with move-to-front holds after all uses."""
    last = uses.groupBy(name).agg(F.max(when).alias(when)).orderBy(F.desc(when), name).limit(keep)
    return last.withColumn("position", F.row_number().over(Window.orderBy(F.desc(when), name)))


def last_writer(local: DataFrame, remote: DataFrame, keys: Keys, when: str = "updated_at", fill: Sequence[str] = ()) -> DataFrame:
    """Merged rows with ``origin`` (local, remote) and ``push`` (the shared table lacks it or is older).

    The local row wins if it is strictly newer; a tie goes to the remote one, whose null values in
    the columns of ``fill`` come from the local row, else empty."""
    keys = _list(keys)
    own = [c for c in remote.columns if c not in keys]
    a = local.select(*keys, F.struct(*own).alias("l"))
    b = remote.select(*keys, F.struct(*own).alias("r"))
    joined = a.join(b, keys, "full")
    wins = F.col("r").isNull() | (F.col("l").isNotNull() & F.coalesce(F.col(f"l.{when}") > F.col(f"r.{when}"), F.lit(False)))
    value = lambda c: F.when(wins, F.col(f"l.{c}")).otherwise(F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}"), F.lit("")) if c in fill else F.col(f"r.{c}")).alias(c)
    return joined.select(*keys, *[value(c) for c in own], F.when(wins, "local").otherwise("remote").alias("origin"), wins.alias("push"))


def sync_presets(local: DataFrame, remote: DataFrame, tombstones: DataFrame, keys: Sequence[str] = ("kind", "name"), fill: Sequence[str] = ()) -> DataFrame:
    """``last_writer`` without what has a tombstone on either side; an empty remote pushes all."""
    return last_writer(without(local, tombstones, keys), without(remote, tombstones, keys), keys, fill=fill)


def remap_values(rows: DataFrame, column: str, mapping: DataFrame, keys: Keys) -> DataFrame:
    """An array column with values replaced by a table (old, new), first occurrences kept in order."""
    keys = _list(keys)
    exploded = rows.select(*keys, F.posexplode_outer(column).alias("i", "v")).join(mapping.select(F.col("old").alias("v"), "new"), "v", "left")
    grouped = exploded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "v").alias("v")))).alias("x"))
    return rows.drop(column).join(grouped.select(*keys, F.array_compact(F.array_distinct(F.transform("x", lambda x: x["v"]))).alias(column)), keys, "left")


def remove_value(rows: DataFrame, column: str, value: Column) -> DataFrame:
    return rows.withColumn(column, F.array_remove(column, value))


def assign_serials(rows: DataFrame, last: int, *order: str) -> DataFrame:
    """Serial numbers after ``last`` in an order."""
    return numbered(rows, "serial", *order).withColumn("serial", (F.col("serial") + last).cast("int"))


def free_names(wanted: DataFrame, taken: DataFrame, *order: str) -> DataFrame:
    """(stem, n) pairs that no existing one holds: wanted rows of a stem get the lowest free numbers.

    wanted: stem; taken: stem, n (from 1).  Numbers that are taken part those that are free into runs; the
    i-th wanted row takes the i-th free number, which lies in the run that holds place i. Wanted rows are
    numbered over ranges of the whole table, so a stem that all of them want isn't one task."""
    in_all = numbered(wanted, "__all", "stem", *order)
    first = in_all.groupBy("stem").agg((F.min("__all") - 1).alias("__before"))
    rows = in_all.join(first, "stem").withColumn("__i", F.col("__all") - F.col("__before"))
    # the k-th smallest taken number t of a stem has t - k free numbers below it
    used = numbered(taken.filter("n > 0").select("stem", F.col("n").cast("long").alias("n")).distinct(), "__all", "stem", "n")
    start = used.groupBy("stem").agg((F.min("__all") - 1).alias("__before"))
    below = used.join(start, "stem").withColumn("__k", F.col("__all") - F.col("__before")).select("stem", (F.col("n") - F.col("__k")).alias("__free"), "__k")
    runs = below.groupBy("stem", "__free").agg(F.max("__k").alias("__k"))
    # row i lies behind all taken numbers with fewer than i free ones below: the last such run
    both = rows.select("stem", F.col("__i").alias("__p"), F.lit(1).alias("__row"), F.lit(0).cast("long").alias("__k")).distinct().unionByName(runs.select("stem", (F.col("__free") + 1).alias("__p"), F.lit(0).alias("__row"), "__k"))
    shift = highest_so_far(both, "__s", "stem", "__k", "__p", "__row").filter("__row = 1").select("stem", F.col("__p").alias("__i"), "__s")
    return rows.join(shift, ["stem", "__i"]).withColumn("n", (F.col("__i") + F.col("__s")).cast("int")).drop("__all", "__before", "__i", "__s")


def chunks(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Rows with the number, from 0, of the chunk of at most ``size`` that they go in."""
    return numbered(rows, "chunk", *order).withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("int"))
