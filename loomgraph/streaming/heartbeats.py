"""Sessions by their heartbeats: start, end and other beats as keyed state, silence by timers, state that expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BEAT = "session string, kind string, ts timestamp, seq long"
SESSION = "session string, beats long, started timestamp, last timestamp, ended boolean"
FLAG = "session string, last_seen timestamp, beats long"
STATE = "beats long, started timestamp, last timestamp, ended boolean"
#: After so long without a beat a session is forgotten.
TTL_HOURS = 12


def sessions(beats: DataFrame) -> DataFrame:
    """``SESSION`` from beats ``(session, kind, ts, seq)``: a start begins anew, an end closes, a beat of an unseen session opens it."""
    order = W.partitionBy("session").orderBy("ts", "seq")
    run = F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).over(order)
    rows = beats.withColumn("_run", run)
    last = F.max("_run").over(W.partitionBy("session"))
    return rows.withColumn("_last", last).where("_run = _last").groupBy("session").agg(
        F.count(F.lit(1)).alias("beats"), F.min("ts").alias("started"), F.max("ts").alias("last"), F.bool_or(F.col("kind") == "end").alias("ended"))


def silent(state: DataFrame, now, seconds: float, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """``FLAG``: sessions still open, of two beats or more, whose last one is longer ago than allowed but not beyond their life."""
    gap = (F.unix_micros(now) - F.unix_micros("last")) / 1e6
    return state.where((~F.col("ended")) & (F.col("beats") >= 2) & (gap > seconds) & (gap <= ttl_hours * 3600)).select("session", F.col("last").alias("last_seen"), "beats")


def _apply(frames: Iterator[pd.DataFrame], state: GroupState) -> tuple:
    beats, started, last, ended = state.get if state.exists else (0, None, None, False)
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
    for ts, kind in zip(rows["ts"], rows["kind"], strict=True):
        ts = pd.Timestamp(ts).to_pydatetime()
        if kind == "start" or started is None:
            beats, started, ended = 0, ts, False
        beats, last, ended = beats + 1, ts, ended or kind == "end"
    state.update((beats, started, last, bool(ended)))
    return beats, started, last, bool(ended)


def session_stream(beats: DataFrame) -> DataFrame:
    """The same as a stream: the new state of each session in a batch; beats of a batch are taken in order of time."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, started, last, ended = _apply(frames, state)
        yield pd.DataFrame({"session": [key[0]], "beats": [n], "started": [started], "last": [last], "ended": [ended]})

    return beats.groupBy("session").applyInPandasWithState(update, SESSION, STATE, "update", GroupStateTimeout.NoTimeout)


def _watch(seconds: float, ttl_hours: float) -> Callable:
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = lambda last, s: max(int((pd.Timestamp(last).timestamp() + s) * 1000) + 1, state.getCurrentWatermarkMs() + 1)
        if state.hasTimedOut:
            n, started, last, ended = state.get
            if ended or n < 2:
                state.remove()
                return
            # Flagged once: the session counts as ended from here, and is forgotten at the end of its life.
            state.update((n, started, last, True))
            state.setTimeoutTimestamp(at(last, ttl_hours * 3600))
            yield pd.DataFrame({"session": [key[0]], "last_seen": [last], "beats": [n]})
            return
        n, _, last, ended = _apply(frames, state)
        state.setTimeoutTimestamp(at(last, ttl_hours * 3600 if ended or n < 2 else seconds))

    return update


def silence_stream(beats: DataFrame, seconds: float, ttl_hours: float = TTL_HOURS, late: str = "0 seconds") -> DataFrame:
    """``FLAG`` as a stream: a timer per open session fires when event time has passed its last beat for too long, once."""
    rows = beats.withWatermark("ts", late)
    return rows.groupBy("session").applyInPandasWithState(_watch(seconds, ttl_hours), FLAG, STATE, "append", GroupStateTimeout.EventTimeTimeout)
