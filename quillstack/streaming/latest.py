"""Streams over the same tables: latest record per key, bursts of typing, scheduled purges."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, when: str = "ts", gap: str = "350 milliseconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst of a key: its last time, size and last value; a gap ends a burst.

    Works on a stream and on a table."""
    rows = events.withWatermark(when, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(when, gap).alias("w"), key).agg(F.max(when).alias("last"), F.count("*").alias("events"), F.max_by("value", when).alias("value")).select(key, "last", "events", "value")


def latest_into(stream: DataFrame, keys: list[str], when: str, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Keeps a table at the newest row of each key of a stream: each batch is folded into the last
    snapshot, written under the batch's number, so a repeated batch gives the same table."""
    order = F.struct(when, *[c for c in stream.columns if c != when])

    def fold(batch: DataFrame, number: int) -> None:
        before = read()
        rows = batch if before is None else before.unionByName(batch)
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        write(newest, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_daily(now: Column, last_run: Column, hour: int = 15, zone: str = "America/Denver") -> Column:
    """Whether a job that runs once a local day, after an hour, is due. Both times are UTC."""
    local, last = F.from_utc_timestamp(now, zone), F.from_utc_timestamp(last_run, zone)
    return (F.hour(local) >= hour) & (last_run.isNull() | (F.to_date(last) < F.to_date(local)))


def snoozed(now: Column, asked: Column, days: int = 3) -> Column:
    return asked.isNotNull() & (now < asked + F.make_dt_interval(F.lit(days)))


ANSWER = "key string, request long, ts timestamp, value double"


def fresh_answers(rows: DataFrame) -> DataFrame:
    """The answers that are still wanted when they come: those to the last request that their key has made by then.

    rows: key string, request long, ts timestamp, answer boolean, value double; requests of a key count up, and of
    equal times they come in the order of requests, a request before its answer.  On a stream, one number a key is
    kept between batches, so a row has to come in no earlier batch than those before it; late requests are
    requests all the same, as only the largest number counts."""
    if not rows.isStreaming:
        asked = F.max(F.when(~F.col("answer"), F.col("request"))).over(Window.partitionBy("key").orderBy("ts", "request", "answer"))
        return rows.withColumn("__asked", asked).filter(F.col("answer") & (F.col("request") == F.col("__asked"))).select("key", "request", "ts", "value")

    def fold(key: tuple, frames, state):
        asked = state.get[0] if state.exists else None
        every = pd.concat(list(frames)).sort_values(["ts", "request", "answer"], kind="stable")
        wanted = every["request"].where(~every["answer"]).cummax().ffill()
        if asked is not None:
            wanted = wanted.fillna(asked).clip(lower=asked)
        if wanted.notna().any():
            state.update((int(wanted.dropna().iloc[-1]),))
        fresh = every[every["answer"] & (every["request"] == wanted)]
        yield fresh[["key", "request", "ts", "value"]]

    return rows.groupBy("key").applyInPandasWithState(fold, ANSWER, "asked long", "append", "NoTimeout")
