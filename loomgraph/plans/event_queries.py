"""Queries on events: sessions, silences, cursors, windows, as batches and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_dir
from ..sources.tables import table
from ..streaming import heartbeats as H
from ..streaming import progress as PR
from ..streaming import sessions as S

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CURSOR = "2024-01-15T00:00:00.000000#00000000000000000000"


def _shown(rows: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("user_id", "beats", at("first_ts"), at("last_ts"), F.round("max_gap", 3).alias("max_gap"), "ended")


def session_state(spark: SparkSession, d: str) -> DataFrame:
    return _shown(S.session_state(table(spark, d, "events")))


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """The events as a stream: a copy in several files, oldest first, stands for files that come in one after another."""
    events = table(spark, d, "events")
    edges = [None, *events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75]).alias("q")).first()["q"], None]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        part = events if lo is None else events.where(F.col("ts") >= F.lit(lo))
        part = part if hi is None else part.where(F.col("ts") < F.lit(hi))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return S.read_stream(spark, f"{folder}/in", EVENTS, 1)


def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions, kept as state over several batches of a stream."""
    folder = _folder(spark)
    return _shown(S.run_available(S.session_stream(_stream(spark, d, folder)), folder, key="user_id"))


def silence_detection(spark: SparkSession, d: str) -> DataFrame:
    return S.silences(table(spark, d, "events"), 86_400.0)


def cursor_tail(spark: SparkSession, d: str) -> DataFrame:
    return S.tail(table(spark, d, "events"), CURSOR).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def cursor_page(spark: SparkSession, d: str) -> DataFrame:
    """The first 100 events after a cursor: one page of a push."""
    return S.tail(table(spark, d, "events"), CURSOR, 100).select("event_id", "user_id")


def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.windowed_counts(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def windowed_stream(spark: SparkSession, d: str) -> DataFrame:
    """Windowed counts as a stream that gives the complete result."""
    folder = _folder(spark)
    out = S.run_available(S.windowed_counts(_stream(spark, d, folder), late="3650 days").withColumn("k", F.concat_ws("|", "start", "event_type")), folder, key="k", mode="complete")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


def _beats(events: DataFrame) -> DataFrame:
    """Events as heartbeats of their user's session: a signup starts, an error ends."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "end").otherwise("beat")
    return events.select(F.col("user_id").cast("string").alias("session"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def _session(rows: DataFrame) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("session", "beats", at("started"), at("last"), "ended")


def heartbeat_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _session(H.sessions(_beats(table(spark, d, "events"))))


def heartbeat_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions, kept as state over several batches."""
    folder = _folder(spark)
    return _session(S.run_available(H.session_stream(_beats(_stream(spark, d, folder))), folder, key="session"))


def silent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Open sessions of two beats or more that have been silent for an hour, but not for twelve, at the last event."""
    b = _beats(table(spark, d, "events"))
    now = b.agg(F.max("ts").alias("now"))
    rows = H.sessions(b).crossJoin(F.broadcast(now))
    return H.silent(rows, F.col("now"), 3600.0).select("session", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "beats")


def phase_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of each user (the clicks) by the phase they fall in: the last other event at or before them."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    tagged = PR.phase_of_samples(e.where("event_type = 'click'"), e.where("event_type <> 'click'").withColumnRenamed("event_type", "phase"), "user_id")
    return tagged.groupBy(F.coalesce("phase", F.lit("none")).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value"))


def telemetry_delta(spark: SparkSession, d: str) -> DataFrame:
    """Counters since a push: totals minus what was pushed (all before a time), never below zero."""
    e = table(spark, d, "events")
    count = lambda rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return S.delta(count(e), count(e.where("ts < timestamp_ntz'2024-01-15 00:00:00'")), "event_type", "n")


QUERIES = {f.__name__: f for f in (session_state, session_stream, silence_detection, cursor_tail, cursor_page, windowed_counts, windowed_stream, heartbeat_sessions, heartbeat_stream, silent_sessions, phase_samples, telemetry_delta)}

_SESSION = """with g as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6::double g from events)
    select user_id, count(*) beats, strftime(min(ts), '%Y-%m-%d %H:%M:%S') first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_ts, round(coalesce(max(g), 0.0::double), 3) max_gap,
           arg_max(event_type, (ts, event_id)) = 'error' ended from g group by 1"""
_WINDOWS = "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"
_HEART = """b as (select user_id::varchar "session", ts, event_id seq, case event_type when 'signup' then 'start' when 'error' then 'end' else 'beat' end kind from events),
    r as (select *, sum(case when kind = 'start' then 1 else 0 end) over (partition by "session" order by ts, seq) run from b),
    s as (select "session", count(*) beats, min(ts) started, max(ts) last_ts, bool_or(kind = 'end') ended from r join (select "session", max(run) run from r group by 1) using ("session", run) group by 1)"""
_BEATS = f"with {_HEART} select \"session\", beats, strftime(started, '%Y-%m-%d %H:%M:%S') started, strftime(last_ts, '%Y-%m-%d %H:%M:%S') \"last\", ended from s"
SQL = {
    "heartbeat_sessions": _BEATS, "heartbeat_stream": _BEATS,
    "silent_sessions": f"""with {_HEART} select "session", strftime(last_ts, '%Y-%m-%d %H:%M:%S') last_seen, beats from s, (select max(ts) now from events) where not ended and beats >= 2
        and (epoch_us(now) - epoch_us(last_ts)) / 1e6 > 3600 and (epoch_us(now) - epoch_us(last_ts)) / 1e6 <= 43200""",
    "phase_samples": """with c as (select user_id, ts, value from events where event_type = 'click'), m as (select user_id, ts, event_type phase, event_id from events where event_type <> 'click'),
        j as (select c.*, m.phase from c asof left join m on c.user_id = m.user_id and c.ts >= m.ts) select coalesce(phase, 'none') phase, count(*) n, max(value) max_value from j group by 1""",
    "telemetry_delta": "select event_type, greatest(0, count(*) - count(*) filter (ts < timestamp '2024-01-15')) n from events group by 1",
    "session_state": _SESSION, "session_stream": _SESSION, "windowed_counts": _WINDOWS, "windowed_stream": _WINDOWS,
    "silence_detection": """with g as (select user_id, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6::double g from events)
        select user_id, count(*) n_silences from g where g > 86400 group by 1""",
    "cursor_tail": "select event_type, count(*) n, min(event_id) first_id from events where ts > timestamp '2024-01-15' or (ts = timestamp '2024-01-15' and event_id > 0) group by 1",
    "cursor_page": "select event_id, user_id from events where ts > timestamp '2024-01-15' or (ts = timestamp '2024-01-15' and event_id > 0) order by ts, lpad(event_id::varchar, 20, '0') limit 100",
}
