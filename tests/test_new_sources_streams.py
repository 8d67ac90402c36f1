import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import files as S
from loomgraph.sources import generations as G
from loomgraph.streaming import heartbeats as H
from loomgraph.streaming import progress as P
from loomgraph.streaming.sessions import read_stream, run_available


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_session_state_as_stream_and_batch(spark, tmp_path):
    rows = [("a", "start", at(0), 1), ("a", "beat", at(5), 2), ("a", "end", at(9), 3), ("a", "start", at(20), 4), ("b", "beat", at(1), 5), ("c", "end", at(2), 6), ("b", "beat", at(30), 7)]
    df = spark.createDataFrame(rows, H.BEAT)
    want = {("a", 1, False), ("b", 2, False), ("c", 1, True)}
    assert {(r["session"], r["beats"], r["ended"]) for r in H.sessions(df).collect()} == want
    for part in (df.where("seq <= 3"), df.where("seq > 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(H.session_stream(read_stream(spark, str(tmp_path / "in"), H.BEAT, 1)), str(tmp_path), key="session")
    assert {(r["session"], r["beats"], r["ended"]) for r in got.collect()} == want
    assert {r["session"] for r in H.silent(H.sessions(df), F.lit(at(100)), 60).collect()} == {"b"}
    assert H.silent(H.sessions(df), F.lit(at(60 * 60 * 13)), 60).count() == 0


def test_silence_is_flagged_once_by_a_timer(spark, tmp_path):
    parts = [[("a", "start", at(0), 1), ("a", "beat", at(5), 2), ("b", "start", at(0), 3)], [("z", "beat", at(200), 4)], [("z", "beat", at(400), 5)], [("z", "beat", at(600), 6)]]
    for p in parts:
        spark.createDataFrame(p, H.BEAT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_available(H.silence_stream(read_stream(spark, str(tmp_path / "in"), H.BEAT, 1), 60), str(tmp_path), mode="append").collect()
    assert [r["session"] for r in got].count("a") == 1 and "b" not in {r["session"] for r in got}


def test_cursor_advances_only_after_sending(spark, tmp_path):
    ev = spark.createDataFrame([(f"k{i}", i) for i in range(5)], "cursor string, n int")
    sent = []
    folder = str(tmp_path)
    assert P.push(spark, folder, "me", ev, lambda p: sent.extend(r["n"] for r in p.collect()), 3) == 3

    def fail(_):
        raise OSError

    with pytest.raises(OSError):
        P.push(spark, folder, "me", ev, fail)
    assert P.push(spark, folder, "me", ev, lambda p: sent.extend(r["n"] for r in p.collect())) == 2 and sorted(sent) == [0, 1, 2, 3, 4]
    assert P.push(spark, folder, "me", ev, fail) == 0 and P.read_cursor(spark, folder, "other") == ""


def test_watch_holds_still_and_tries_again():
    runs = []

    def act():
        runs.append(1)
        if len(runs) == 1:
            raise ValueError

    w = P.Watch(act)
    assert [w.step(s) for s in ("a", "b", "b", "b", "b", "b", "c", "b")] == [False, False, False, False, True, False, False, False]
    assert len(runs) == 2 and w.failures == 1


def test_progressive_work_goes_on_where_it_stopped(spark, tmp_path):
    done = []

    def work(rows):
        done.append(1)
        return rows

    folder = str(tmp_path / "p")
    assert P.progressive(spark.range(100), "id", work, folder, 8, stop_after=3) == [0.1, 0.25]
    assert P.progressive(spark.range(100), "id", work, folder, 8) == [0.1, 0.25, 0.5, 0.75] and len(done) == 8
    assert spark.read.parquet(folder).select("id").distinct().count() == 100 and P.progress(spark, folder) == {"done": 8, "of": 8}


def test_phase_of_samples(spark):
    s = spark.createDataFrame([("x", at(1), 1.0), ("x", at(5), 2.0), ("y", at(9), 3.0)], "k string, ts timestamp, value double")
    m = spark.createDataFrame([("x", at(3), "p"), ("x", at(5), "q")], "k string, ts timestamp, phase string")
    assert {(r["value"], r["phase"]) for r in P.phase_of_samples(s, m, "k").collect()} == {(1.0, None), (2.0, "q"), (3.0, None)}


def test_manifest_tells_content(spark, tmp_path):
    root = str(tmp_path / "g")
    G.publish(spark, root, {"t": spark.range(3)})
    m = G.read_manifest(spark, root)
    assert m["counts"] == {"t": 3} and m["bytes"]["t"] > 0 and m["hashes"]["t"] == G.content_hash(spark.range(3).repartition(2))


def test_snapshots_rows_and_entities(spark, tmp_path):
    root = str(tmp_path / "e")
    S.write_entities({"entities.file": spark.createDataFrame([("a", ["x"])], "id string, tags array<string>")}, root)
    got = S.read_snapshot(spark, f"{root}/jsonl/entities.file", "id string, tags array<string>", 1, S.snapshot_hash(spark, f"{root}/jsonl/entities.file"))
    assert got.first()["tags"] == ["x"]
    with pytest.raises(ValueError):
        S.read_snapshot(spark, f"{root}/jsonl/entities.file", "id string", 2)
    with pytest.raises(ValueError):
        S.read_snapshot(spark, f"{root}/jsonl/entities.file", "id string", 1, "0")
    store = str(tmp_path / "s")
    for b, v in (("1", "old"), ("2", "new"), ("2", "newer")):
        S.upsert_rows(spark, store, spark.createDataFrame([("k", v)], "id string, v string"), "id", b)
    assert [(r["id"], r["v"]) for r in S.read_rows(spark, store, "id").collect()] == [("k", "newer")]
    (tmp_path / "v1/repos").mkdir(parents=True)
    (tmp_path / "v1/repos/a__b.json").write_text('{"files": 3,\n "k": {"x": 1}}')
    assert S.site_json(spark, str(tmp_path), "v1", "a/b").first()["files"] == 3


def test_lists_prefixes_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("[a, 'b' , ]",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.list_of(F.col("t"))).collect()] == [["a", "b"], ["x"], [], []]
    p = spark.createDataFrame([("src/a.py",), ("src/node_modules/b.js",), ("docs/x.md",), ("src",), ("other/y",)], "path string")
    assert {r["path"] for r in S.with_prefixes(p, "path", ["src", "docs/"]).collect()} == {"src/a.py", "docs/x.md", "src"}
    assert S.with_prefixes(p, "path", ["."]).count() == 4
    (tmp_path / "c.json").write_text('{"total": {"lines": {"total": 10, "covered": 7, "pct": 70}, "branches": {"total": 4, "covered": 1, "pct": 25}}}')
    r = S.coverage_summary(spark, str(tmp_path / "c.json")).first()
    assert (r["lines"], r["lines_hit"], r["branches_hit"], r["line_pct"]) == (10, 7, 1, 70.0)
