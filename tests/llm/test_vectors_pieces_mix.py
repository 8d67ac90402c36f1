import random

import numpy as np
import pytest

from loomgraph.llm import mixing, neighbours, pieces

VECTORS = "key long, model string, vector array<float>"


def _brute(rows, k, least):
    out = {}
    good = [(i, m, np.array(v, float)) for i, m, v in rows if v is not None and len(v) == 16 and all(x is not None for x in v) and np.isfinite(v).all() and any(v)]
    good = list({i: (i, m, v / np.linalg.norm(v)) for i, m, v in good}.values())
    for i, m, v in good:
        c = sorted(((round(float(v @ w), 5), j) for j, n, w in good if n == m and j != i), key=lambda x: (-x[0], x[1]))
        out[i] = [j for s, j in c if s >= least][:k]
    return {k: v for k, v in out.items() if v}


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(40):
        c = rng.normal(size=16)
        rows += [(len(rows) + j, "a" if g % 3 else "b", (c + rng.normal(size=16) * 0.25).tolist()) for j in range(6)]
    rows += [(900, "a", None), (901, "a", [0.0] * 16), (902, "a", [float("nan")] * 16), (903, "a", [1.0]), rows[0], (904, "a", [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in neighbours.nearest(df, 5, 0.8, 16, list_size=16).orderBy("key", "rank").collect():
        got.setdefault(r["key"], []).append(r["other"])
    want = _brute(rows, 5, 0.8)
    hits = sum(len(set(got.get(k, [])) & set(v)) for k, v in want.items())
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert neighbours.nearest(df.limit(0), 5, 0.8, 16).count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, "a", [1.0, 2.0] + [0.0] * 14) for i in range(40)] + [(100, "a", [1.0, 2.1] + [0.0] * 14)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), 5, 0.8, 16).collect():
        got.setdefault(r["key"], {})[r["rank"]] = r["other"]
    assert sorted(got[0].values()) == [1, 2, 3, 4, 5] and sorted(got[39].values()) == [0, 1, 2, 3, 4] and sorted(got[100].values()) == [0, 1, 2, 3, 4]


def test_graph_search_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(1500, 32)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[:200] + 0.1 * rng.normal(size=(200, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.argsort(-(x @ c.T), axis=1)[:, :4]
    near = neighbours.CentroidGraph(c).nearest(x, 4)[0]
    assert (exact[:, 0] == near[:, 0]).mean() >= 0.95


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_graph_of_few_centroids_is_exact(n):
    rng = np.random.default_rng(4)
    c = rng.normal(size=(n, 8)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = rng.normal(size=(20, 8)).astype(np.float32)
    ids, cos = neighbours.CentroidGraph(c).nearest(x, 4)
    assert (ids[:, 0] == (x @ c.T).argmax(axis=1)).mean() >= 0.95 and ids.shape[1] == min(4, n) and (np.diff(cos, axis=1) <= 0).all()


def test_lists_above_the_bound_are_compared_in_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "m", [float(v) for v in rng.normal(size=16)]) for i in range(300)]
    df = spark.createDataFrame(rows, VECTORS)
    whole = {(r["key"], r["other"]) for r in neighbours.nearest(df, 5, 0.3, 16, list_size=300).collect()}
    assert {(r["key"], r["other"]) for r in neighbours.nearest(df, 5, 0.3, 16, list_size=300, most=40).collect()} == whole and len(whole) > 100


@pytest.mark.parametrize("kind", ["section", "function", None])
def test_pieces_give_back_the_text(kind):
    rnd = random.Random(6)
    texts = ["x" * 9001, "a\r\n" * 4000, "# h\n\ntext. " * 900, "é" * 5000, "e\u0301" * 4100, "".join(rnd.choice("ab \n;}#.") for _ in range(20_000)), "w\n" * 2001]
    for t in texts:
        parts = pieces.split_text(t, 4000, 200, kind, 7)
        assert "".join(p[2][p[1] :] for p in parts) == t and max(len(p[2]) for p in parts) <= 4000
        for a, b in zip(parts[:-1], parts[1:], strict=True):
            assert b[2][: b[1]] == t[b[0] : b[0] + b[1]] and 200 <= b[1] <= 201 and a[4] >= b[3] >= a[3]
        assert parts[0][3] == 7 and parts[-1][4] == 7 + sum(m.end() < len(t) for m in pieces.LINE_END.finditer(t))
        assert all(not (t[p[0] + p[1] - 1 : p[0] + p[1] + 1] == "\r\n") for p in parts[1:])


def test_only_oversized_items_are_cut(spark):
    rows = [(1, "a" * 4000, "x", 1), (2, "b\n" * 2001, None, None), (2, "b\n" * 2001, None, None), (3, None, "x", 0), (4, "", "x", 0)]
    got = pieces.split_oversized(spark.createDataFrame(rows, "key long, text string, kind string, start_line int")).collect()
    assert {r["key"] for r in got} == {2} and len(got) == got[0]["n_pieces"] and min(r["start_line"] for r in got) == 1
    with pytest.raises(ValueError):
        pieces.split_text("x", 10, 10, None)


def test_budget_is_met_exactly_where_it_can_be():
    rnd = random.Random(8)
    counts = {rnd.randrange(50, 900): rnd.randrange(1, 5) for _ in range(200)}
    total = sum(n * c for n, c in counts.items())
    for share in (0.1, 0.37, 0.9):
        budget = int(total * share)
        got = mixing.fit_budget(counts, budget, 1)
        assert sum(n * c for n, c in got.items()) == budget and all(c <= counts[n] for n, c in got.items())
    assert mixing.fit_budget(counts, total + 5) == counts and mixing.fit_budget({}, 5) == {} and mixing.fit_budget({7: 1}, 3) == {}
    best = max(a * 7 + b * 11 for a in range(3) for b in range(3) if a * 7 + b * 11 <= 30)
    assert sum(n * c for n, c in mixing.fit_budget({7: 2, 11: 2}, 30).items()) == best
    assert mixing.plan_source({10: 3}, 75, 4, 0) == (2, {10: 1}) and mixing.plan_source({10: 3}, 1000, 4, 0) == (4, {})


def test_mix_keeps_caps_and_reports(spark):
    rows = [(i, "A " if i % 2 else "a", "word " * (i % 9 + 1)) for i in range(60)] + [(100, "b", "tiny text"), (101, None, "x"), (102, "b", None), (103, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets).collect()
    uses = {r["doc_id"]: r["repeats"] for r in got}
    assert uses[100] == 3 and 102 not in uses and 101 not in uses and max(uses[i] for i in uses if i < 60) == 1
    rep = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    taken = sum(r["n_tokens"] * r["repeats"] for r in got if r["source"] == "a")
    assert rep["a"]["taken_tokens"] == taken and abs(taken - rep["a"]["wanted_tokens"]) <= 1 and rep["none"]["taken_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    assert mixing.mix(docs.limit(0), targets).count() == 0
