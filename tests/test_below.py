import random

from loomgraph.operators.hierarchy import below
from loomgraph.plans.hierarchy_queries import p1_descendants


def pairs(links):
    """Distances by relaxing all links until nothing changes."""
    far = {(p, c): 1 for p, c in links if p != c}
    while True:
        more = {(a, c): n + 1 for (a, b), n in far.items() for p, c in links if p == b and c != a and far.get((a, c), 9_999) > n + 1}
        if not more:
            return {(a, b, n) for (a, b), n in far.items()}
        far |= more


def test_circles_and_several_parents_in_a_task_and_over_the_cluster(spark):
    rnd = random.Random(11)
    links = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(40)] + [("r", "a"), ("a", "b"), ("b", "a"), ("b", "z"), ("s", "s"), ("s", "t")]
    df = spark.createDataFrame(links, "parent string, child string")
    for most in (1_000_000, 3):
        got = [(r["node"], r["descendant"], r["distance"]) for r in below(df, "parent", "child", max_links=most).collect()]
        assert len(got) == len(set(got)) and set(got) == pairs(set(links))


def test_query_has_modules_in_and_below_circles(spark, tmp_path):
    rows = [("r", "a", "CONTAINS_MODULE"), ("x", "y", "contains_module"), ("y", "x", "CONTAINS_MODULE"), ("y", "z", "CONTAINS_MODULE"), ("x", "q", "CALLS")]
    spark.createDataFrame(rows, "from_id string, to_id string, relation string").write.parquet(f"{tmp_path}/relations.parquet")
    got = {(r["module_id"], r["below_id"], r["distance"]) for r in p1_descendants(spark, str(tmp_path)).collect()}
    assert got == {("r", "a", 1), ("x", "y", 1), ("x", "z", 2), ("y", "x", 1), ("y", "z", 1)}
