import random

from loomgraph.operators.components import connected_components
from loomgraph.operators.hierarchy import _walk_levels, descendants, hierarchies, walk_component

LINKS = "parent string, child string, component string, path string"


def test_tree_circle_and_below():
    rows = {r[0]: r for r in walk_component([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("y", "z"), ("s", "s")])}
    assert rows["c"][1:4] == ("a", 2, ["a", "b", "c"]) and rows["a"][4] == 2
    assert all(rows[n][1:3] == ("", -1) for n in "xyzs")
    assert rows["x"][5] == ["y"] and rows["s"][5] == ["s"]


def test_several_parents_take_the_shortest_path():
    rows = {r[0]: r for r in walk_component([("r", "a"), ("a", "b"), ("r", "b"), ("q", "b")])}
    assert rows["b"][3] == ["q", "b"] and rows["r"][4] == 2


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", "b", "x", "y"), ("a", "b", "x", "y"), (None, "b", "", ""), ("", "c", None, None), ("b", "c", "", "")], LINKS)
    out = {r["node"]: (r["root"], r["depth"], r["n_descendants"]) for r in hierarchies(df, "parent", "child").collect()}
    assert out == {"a": ("a", 0, 2), "b": ("a", 1, 1), "c": ("a", 2, 0)}
    assert {(r["node"], r["descendant"], r["distance"]) for r in descendants(hierarchies(df, "parent", "child")).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_no_links(spark):
    assert hierarchies(spark.createDataFrame([], LINKS), "parent", "child").count() == 0


def test_walk_over_the_cluster_equals_walk_in_a_task(spark):
    rnd = random.Random(3)
    links = [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 60)] + [("c1", "c2"), ("c2", "c1"), ("c2", "c3")]
    df = spark.createDataFrame(links, "parent string, child string")
    want = {(r[0], r[1], r[2], tuple(r[3])) for r in walk_component(links)}
    assert {(r["node"], r["root"], r["depth"], tuple(r["path"])) for r in _walk_levels(df).collect()} == want
    assert {(r["node"], r["root"], r["depth"], tuple(r["path"])) for r in hierarchies(df, "parent", "child", max_links=3).collect()} == want


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(70)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    low = {}
    for n in up:
        low.setdefault(root(n), []).append(n)
    want = {n: min(v) for v in low.values() for n in v}
    got = connected_components(spark.createDataFrame(edges, "s string, t string"), "s", "t")
    assert {r["node"]: r["component"] for r in got.collect()} == want
