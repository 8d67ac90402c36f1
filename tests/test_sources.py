import pytest

from loomgraph.sources import files as S
from loomgraph.sources import generations as G


def test_json_lines_drop_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\nnot json\n{"id": ""}\n{"id": "3", "extra": 1}\n')
    got = S.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int", ["id"]).collect()
    assert [(r["id"], r["n"]) for r in got] == [("1", 2), ("3", None)]


def test_csv_round_trip_of_odd_texts(spark, tmp_path):
    rows = [("a,\"b\"\r\n\t\\ é😀",), ("",), (None,)]
    S.write_csv(spark.createDataFrame(rows, "t string"), str(tmp_path / "c"))
    assert sorted(map(str, (r["t"] for r in S.read_csv(spark, str(tmp_path / "c"), "t string").collect()))) == sorted(map(str, (r[0] for r in rows)))


def test_tsv_has_one_line_per_row(spark, tmp_path):
    S.write_tsv(spark.createDataFrame([("a\tb\nc", 1)], "t string, n int").coalesce(1), str(tmp_path / "t"))
    text = next(tmp_path.glob("t/*.csv")).read_text()
    assert text.splitlines() == ["t\tn", "a b c\t1"]


def test_tree_scan(spark, tmp_path):
    for p, b in (("a.txt", b"x"), ("bin/b.txt", b"y"), ("src/bin/c.txt", b"z"), ("node_modules/d.txt", b"z"), ("e.txt", b"a\0b"), ("f.bin", b"q")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = {r["path"]: (r["text"], r["skipped"]) for r in S.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("x", ""), "bin/b.txt": ("y", ""), "e.txt": (None, "binary"), "f.bin": (None, "unsupported")}


def test_status_and_processes(spark):
    got = {(r["path"], r["change"]) for r in S.changed_files(spark, " M a.py\0D  b.py\0R  new.py\0old.py\0?? c d.py\0").collect()}
    assert got == {("a.py", "changed"), ("b.py", "deleted"), ("new.py", "changed"), ("old.py", "deleted"), ("c d.py", "changed")}
    assert [(r["pid"], r["comm"]) for r in S.processes(spark, ["  1 0 root init /sbin/init", "junk"]).collect()] == [(1, "init")]


def test_small_configurations(spark):
    yaml = "source_paths:\n  - src  # code\n  - docs\nranking:\n  semantic: 0.5\n  graph: x\nrules:\n  - id: r1\n    title: T\n    priority: 3\n    enforce: true\n  - id: r2\n"
    assert S.source_paths(yaml) == ["src", "docs"] and S.ranking_weights(yaml)["semantic"] == 0.5 and S.ranking_weights(yaml)["graph"] == 0.25
    assert [(r["id"], r["status"], r["priority"]) for r in S.rule_list(yaml)] == [("r1", "active", 3), ("r2", "draft", 0)]
    from pyspark.sql import functions as F
    m = spark.createDataFrame([("---\ntitle: A: b\ntype: note\n---\nbody",)], "t string").select(S.front_matter(F.col("t"))).first()[0]
    assert m == {"title": "A: b", "type": "note"}


def test_logs_by_day_and_coverage(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / f"logs/date={day}").mkdir(parents=True)
        (tmp_path / f"logs/date={day}/x.json").write_text('{"tool": "search"}\n')
    assert S.read_logs(spark, str(tmp_path / "logs"), "tool string", first="2024-01-02").count() == 1
    (tmp_path / "lcov").write_text("LF:10\nLH:5\nLF:10\nLH:10\n")
    assert S.coverage_totals(spark, str(tmp_path / "lcov")).first()["line_pct"] == 75.0


def test_generations(spark, tmp_path):
    root = str(tmp_path / "g")
    first = G.publish(spark, root, {"t": spark.range(3)})
    G.publish(spark, root, {"t": spark.range(4)}, expected=first)
    G.publish(spark, root, {"t": spark.range(5)})
    assert G.load(spark, root, "t").count() == 5 and len(G.read_manifest(spark, root)["history"]) == 2
    with pytest.raises(ValueError):
        G.publish(spark, root, {"t": spark.range(6)}, expected=first)
    assert G.load(spark, root, "t").count() == 5
