import datetime as dt

from loomgraph.streaming import sessions as S

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_sessions_as_stream_equal_batch(spark, tmp_path):
    rows = [(1, at(0), 1, "view", 1.0), (2, at(50), 1, "view", None), (3, at(60), 2, "error", 2.0), (4, at(500), 1, "error", 1.0)]
    df = spark.createDataFrame(rows, EVENTS)
    for part in (df.where("event_id <= 2"), df.where("event_id > 2")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.read_stream(spark, str(tmp_path / "in"), EVENTS, 1)
    got = S.run_available(S.session_stream(stream), str(tmp_path), key="user_id")
    cols = ["user_id", "beats", "first_ts", "last_ts", "max_gap", "ended"]
    assert sorted(got.select(cols).collect()) == sorted(S.session_state(df).select(cols).collect())


def test_silences_tail_and_delta(spark):
    df = spark.createDataFrame([(1, at(0), 1, "v", 1.0), (2, at(100), 1, "v", 1.0), (3, at(110), 1, "v", 1.0), (4, at(0), 2, "v", 1.0)], EVENTS)
    assert [tuple(r) for r in S.silences(df, 60).collect()] == [(1, 1)]
    assert S.silences(df.limit(0), 60).count() == 0
    seen = S.tail(df, "", 2).collect()
    assert [r["event_id"] for r in seen] == [1, 4] and [r["event_id"] for r in S.tail(df, seen[-1]["cursor"]).collect()] == [2, 3]
    a, b = spark.createDataFrame([("x", 5), ("y", 1)], "k string, n long"), spark.createDataFrame([("x", 7)], "k string, n long")
    assert {r["k"]: r["n"] for r in S.delta(a, b, "k", "n").collect()} == {"x": 0, "y": 1}
