"""Sessions, silences, cursors and windows over events: batch forms and Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "user_id long, beats long, first_ts timestamp, last_ts timestamp, max_gap double, ended boolean"


def session_state(events: DataFrame) -> DataFrame:
    """Per user: events, first and last time, longest gap in seconds, and whether the last event ended it (an error)."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)) / 1e6
    return events.withColumn("_g", gap).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("beats"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.coalesce(F.max("_g"), F.lit(0.0)), 3).alias("max_gap"),
        (F.max_by("event_type", F.struct("ts", "event_id")) == "error").alias("ended"))


def silences(events: DataFrame, seconds: float) -> DataFrame:
    """Users with two or more events who were silent for longer than allowed, and how often."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = F.lead(F.unix_micros(F.col("ts").cast("timestamp"))).over(order)
    gaps = events.withColumn("_g", (nxt - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)
    return gaps.where(F.col("_g") > seconds).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_silences"))


def tail(events: DataFrame, cursor: str, limit: int | None = None) -> DataFrame:
    """Events after a cursor ``time#id``, in order of that key: what a push sends next."""
    key = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    rows = events.withColumn("cursor", key).where(F.col("cursor") > cursor)
    return rows.orderBy("cursor").limit(limit) if limit else rows


def delta(current: DataFrame, pushed: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters less what has been acknowledged, never below zero."""
    return current.join(pushed.select(key, F.col(counter).alias("_p")), key, "left").withColumn(counter, F.greatest(F.lit(0), F.col(counter) - F.coalesce("_p", F.lit(0)))).drop("_p")


def _track(ttl_ms: int | None) -> Callable:
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        beats, first, last, gap, ended, last_id = state.get if state.exists else (0, None, None, 0.0, False, -1)
        f = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ts, kind, event_id in zip(f["ts"], f["event_type"], f["event_id"], strict=True):
            ts = pd.Timestamp(ts)
            now = pd.Timestamp(last) if last is not None else None
            gap = max(gap, (ts - now).total_seconds()) if now is not None and ts >= now else gap
            if now is None or (ts, event_id) >= (now, last_id):
                last, ended, last_id = ts.to_pydatetime(), kind == "error", int(event_id)
            first = ts.to_pydatetime() if first is None or ts < pd.Timestamp(first) else first
            beats += 1
        state.update((beats, first, last, gap, bool(ended), last_id))
        if ttl_ms is not None:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(last).timestamp() * 1000) + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "beats": [beats], "first_ts": [first], "last_ts": [last], "max_gap": [round(gap, 3)], "ended": [bool(ended)]})

    return update


def session_stream(events: DataFrame, ttl_hours: float | None = None, late: str = "1 hour") -> DataFrame:
    """Sessions as keyed state: each batch gives the new state of the users in it. Events that come in after
    later ones of their user count, but open no gap.

    With ``ttl_hours`` the state of a user ends that long after the last event, by event time.
    """
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    rows = rows.withWatermark("ts", late) if ttl_hours is not None else rows
    return rows.groupBy("user_id").applyInPandasWithState(
        _track(None if ttl_hours is None else int(ttl_hours * 3_600_000)), SESSION, "beats long, first timestamp, last timestamp, gap double, ended boolean, last_id long", "update",
        GroupStateTimeout.NoTimeout if ttl_hours is None else GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and values per type and window of event time; later ones than ``late`` are left out in a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, folder: str, key: str | None = None, mode: str = "update", merge: Callable | None = None) -> DataFrame:
    """Run a stream over all that is there now, with its checkpoint in ``folder``, and give back what it wrote.

    Each batch is written under its number, so a batch that is repeated after a failure replaces itself.
    With a ``key`` the latest row of each key counts.
    """
    spark = stream.sparkSession
    out = f"{folder}/out"

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(f"{out}/*")
    if key:
        rest = [c for c in rows.columns if c not in (key, "_batch")]
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(key, "_r.*")
    else:
        rows = rows.drop("_batch")
    return rows


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
