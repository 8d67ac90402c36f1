import random

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators.search import diverse
from loomgraph.plans.context import degrees, midrank, part_of, relation_signals, rule_links


def _tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("t")).first()["t"]


def test_tokens_of_identifiers(spark):
    assert _tokens(spark, "parseHTTPRequest") == ["parsehttprequest", "parse", "http", "request"]
    assert _tokens(spark, "C# and F# or VB.NET") == ["csharp", "and", "fsharp", "or", "vbnet"]
    assert _tokens(spark, "GraphQL TypeScript x a_b") == ["graphql", "typescript"]
    assert _tokens(spark, None) is None and _tokens(spark, "") == []


def test_query_tokens_follow_the_same_rules(spark):
    for q in ("parseHTTPRequest in C#", "retry the trackerSnapshot", "GraphQL över Sökning", "v2Beta x"):
        assert sorted(T.query_tokens(q)) == sorted(_tokens(spark, q))


def test_alias_groups_count_once():
    assert len(T.token_groups(["hook", "hooks", "git"])) == 1 or len(T.token_groups(["hook", "hooks"])) == 1
    assert T.expand(["parser"]) == ["parser", "parsers"]
    assert len(T.token_groups(T.expand(["embed"]))) == 1


def test_lexical_score(spark):
    df = spark.createDataFrame([("the retry tracker",), ("retry",), ("none",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(T.lexical_score(F.col("t"), T.tokens(F.col("t")), ["retry", "tracker"], "retry tracker")).collect()]
    assert [round(x, 6) for x in got] == [1.0, 0.425, 0.0, 0.0, 0.0]


def test_cosine_of_odd_vectors(spark):
    df = spark.sql("select array(1f, 0f) a, array(1f, 1f) b union all select array(0f, 0f), array(1f, 1f) union all select array(1f), array(1f, 1f)")
    assert [round(r[0], 6) for r in df.select(T.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0, 0.0]


def test_midrank_ties_and_types(spark):
    df = spark.createDataFrame([(i, "c", 1) for i in range(4)] + [(9, "f", 7), (10, "x", 1), (11, "x", 3), (12, "r", 200), (13, "r", 400)], "id int, t string, d int")
    got = {r["id"]: r["graph_score"] for r in midrank(df, "t", "d").collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.5, 9: 0.5, 10: 0.25, 11: 0.75, 12: 0.25, 13: 0.75}


def test_diversity_equals_greedy_choice(spark):
    rnd = random.Random(2)
    for _ in range(3):
        rows = [(f"i{n}", f"p{rnd.randrange(3)}", round(rnd.random(), 2)) for n in range(24)]
        pool = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:15]
        left, chosen, used = list(pool), [], {}
        while len(chosen) < 5:
            best = min(left, key=lambda r: (-(r[2] - min(0.12, 0.04 * used.get(r[1], 0))), -r[2], r[0], r[1]))
            left.remove(best)
            chosen.append(best[0])
            used[best[1]] = used.get(best[1], 0) + 1
        got = diverse(spark.createDataFrame(rows, "id string, path string, score double"), 5)
        assert {r["id"] for r in got.collect()} == set(chosen)


def test_degree_counts_loops_twice(spark):
    rels = spark.createDataFrame([("a", "a"), ("a", "b")], "from_id string, to_id string")
    assert {r["id"]: r["degree"] for r in degrees(rels).collect()} == {"a": 3, "b": 1}


def test_rule_links_and_signals(spark):
    rels = spark.createDataFrame([("r1", "f", "CONSTRAINS", "", 2), ("f", "r0", "IMPLEMENTS", "", 1), ("f", "c", "CALLS_SQL", "n", 3)], "from_id string, to_id string, relation string, note string, ord long")
    assert rule_links(rels).first()["matched_rules"] == ["r0", "r1"]
    labels = spark.createDataFrame([("c", "proc")], "id string, label string")
    assert {r["id"]: r["signals"] for r in relation_signals(rels, labels).collect()} == {"f": "calls_sql n proc", "c": "affected_by calls_sql n f"}


def test_window_chunks_are_part_of_their_base(spark):
    c = spark.createDataFrame([("c:window:1:1-2", "f"), ("c", "")], "id string, file_id string")
    assert {(r["from_id"], r["to_id"]) for r in part_of(c).collect()} == {("c:window:1:1-2", "c"), ("c:window:1:1-2", "f")}


def _bfs(edges, seed, depth):
    seen, order = {seed: (0, None)}, [seed]
    for node in order:
        hop = seen[node][0]
        if hop >= depth:
            continue
        for nxt in [t for f, t in edges if f == node] + [f for f, t in edges if t == node]:
            if nxt not in seen:
                seen[nxt] = (hop + 1, node)
                order.append(nxt)
    return seen


def test_walk_equals_queue_search(spark):
    rnd = random.Random(7)
    edges = [(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)]
    rels = spark.createDataFrame([(a, b, "CALLS", "", i) for i, (a, b) in enumerate(edges)], "from_id string, to_id string, relation string, note string, ord long")
    got = {r["id"]: (r["hops"], r["path"][-2] if r["hops"] else None) for r in G.walk(rels, spark.createDataFrame([("n0",)], "id string"), 3).collect()}
    assert got == _bfs(edges, "n0", 3)


def test_walk_of_a_seed_without_relations(spark):
    rels = spark.createDataFrame([("a", "b", "CALLS", None, 1)], "from_id string, to_id string, relation string, note string, ord long")
    assert G.walk(rels, spark.createDataFrame([("z",)], "id string"), 2).count() == 1


def test_ancestors_stop_at_circles(spark):
    n = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "id string, up string")
    assert G.ancestors(n, "id", "up").count() == 6
