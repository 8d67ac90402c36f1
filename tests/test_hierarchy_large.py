import random

from loomgraph.operators.hierarchy import hierarchies, walk_component


def test_all_columns_of_the_large_walk(spark):
    rnd = random.Random(7)
    links = [(f"n{rnd.randrange(i)}", f"n{i}") for i in range(1, 40) for _ in range(2)]
    links += [("n3", "c5"), ("c5", "c1"), ("c1", "c9"), ("c9", "c5"), ("c9", "c1"), ("c9", "n7"), ("s", "s"), ("s", "t"), ("n1", "s")]
    want = {(r[0], r[1], r[2], tuple(r[3]), r[4], tuple(r[5])) for r in walk_component(links)}
    df = spark.createDataFrame(links, "parent string, child string")
    got = {(r["node"], r["root"], r["depth"], tuple(r["path"]), r["n_descendants"], tuple(r["back_edges"])) for r in hierarchies(df, "parent", "child", max_links=3).collect()}
    assert got == want
    rows = {r[0]: r for r in got}
    assert rows["c1"][5] == ("c5", "c9") and rows["c5"][5] == ("c9",) and rows["c9"][5] == () and rows["s"][4:] == (1, ("s",))
