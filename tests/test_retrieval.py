import os

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import evaluate as E
from loomgraph.operators import governance as G
from loomgraph.operators import index as IX
from loomgraph.operators import present as P
from loomgraph.operators import search as S
from loomgraph.operators import twopass as TP
from loomgraph.operators.hooks import Hooks, QueryVectors
from loomgraph.plans import context as C

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _ask(spark, texts, words):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: set(r["t"]) for r in df.select("id", T.tokens_among(F.col("text"), words).alias("t"), T.tokens(F.col("text")).alias("all")).collect() if r["t"]}


def test_tokens_among_are_the_tokens_that_are_asked_for(spark):
    texts = ["parseHTTPRequest(C#, vb.net)", "javaScript x GraphQL", "naïve über_retry2Tracker", "", "C#sharp xC#", "—retry—", "a" * 5000 + "Retry"]
    words = ["csharp", "javascript", "request", "retry2", "tracker", "java", "über", "vbnet", "retry", "graphql", "sharp"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    want = {r["id"]: set(r["t"]) & set(words) for r in df.select("id", T.tokens(F.col("text")).alias("t")).collect()}
    assert _ask(spark, texts, words) == {k: v for k, v in want.items() if v}


def test_composition_is_only_asked_of_odd_texts(spark):
    texts = ["ｒｅｔｒｙ", "ﬁle", "plain", "äöü ß", None, "“quoted” – fine", "½"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import unicodedata
    got = df.select(T.composed(F.col("t")).alias("c"), T.unstable(F.col("t")).alias("u")).collect()
    assert [r["c"] for r in got] == [unicodedata.normalize("NFKC", t) if t else None for t in texts]
    assert [r["u"] for r in got] == [True, True, False, False, None, False, True]


def test_matches_unite_the_parts_of_a_text(spark):
    df = spark.createDataFrame([("a", "retry it"), ("a", "the tracker"), ("b", "ｒｅｔｒｙ"), ("c", "retrying"), ("d", None)], "id string, text string")
    got = {r["id"]: (set(r["tokens"]), r["whole"]) for r in S.matches(df, ["retry", "tracker"], "the tracker").collect()}
    assert got == {"a": ({"retry", "tracker"}, True), "b": ({"retry"}, False)}


@needs_data
def test_the_index_finds_what_texts_give(spark):
    index = C.search_index(spark, DATA)
    words = ["tracker", "snapshot", "retry"]
    a = {r["id"]: (frozenset(r["tokens"]), r["whole"]) for r in index.matches(words, "retry").collect()}
    b = {r["id"]: (frozenset(r["tokens"]), r["whole"]) for r in S.matches(C.entity_texts(spark, DATA), words, "retry").collect()}
    assert a == b and a
    assert index.heads.count() == C.entities(spark, DATA).count()


@needs_data
def test_many_queries_give_what_single_ones_give(spark):
    index = C.search_index(spark, DATA)
    cands = C.candidates(index.heads)
    queries = [("1", "retry tracker snapshot"), ("2", "Which rule covers the SQL table config?"), ("3", "the"), ("4", "typescript parsers of `walkCabinet`"), ("5", "zzz")]
    many = {(r["query_id"], r["id"]): round(r["score"], 9) for r in E.scored_many(index, cands, queries, "2025-06-30 00:00:00").collect()}
    for qid, q in queries:
        one = S.scored(cands, None, q, "2025-06-30 00:00:00", found=index.matches(S.asked_words(q), q.strip().lower()))
        assert {(qid, r["id"]): round(r["score"], 9) for r in one.collect()} == {k: v for k, v in many.items() if k[0] == qid}


def test_an_index_is_built_once_and_whole(spark, tmp_path):
    ents = spark.createDataFrame([("a", "File", "CODE", "x.py", "x.py", "active", False, 50, "")], "id string, entity_type string, kind string, label string, path string, status string, source_of_truth boolean, trust_level int, updated_at string")
    deg = spark.createDataFrame([("a", 3)], "id string, degree long")
    texts = spark.createDataFrame([("a", "Hello helloWorld"), ("a", None)], "id string, text string")
    root = str(tmp_path / "i")
    IX.build(spark, root, ents, deg, texts)
    IX.build(spark, root, ents, deg, texts)
    assert {r["token"] for r in spark.read.parquet(f"{root}/postings").collect()} == {"hello", "helloworld", "world"}
    assert spark.read.parquet(f"{root}/heads").first()["degree"] == 3 and len(os.listdir(tmp_path)) == 1


def test_scorers_and_predicates_can_be_given(spark):
    c = spark.createDataFrame([("a", "File", "CODE", "a", "a.py", "active", False, 50, "", 1, "retry"), ("b", "File", "CODE", "b", "b.py", "Deprecated", False, 50, "", 2, "retry")],
                              "id string, entity_type string, kind string, label string, path string, status string, source_of_truth boolean, trust_level int, updated_at string, degree int, text string")
    plain = S.scored(c, None, "retry", "2025-01-01").where("id = 'a'").first()["score"]
    more = S.scored(c, None, "retry", "2025-01-01", scorers={"boost": lambda x: x + 1.0}).where("id = 'a'").first()["score"]
    assert round(more - plain, 9) == 1.0
    assert [r["id"] for r in C.candidates(c, predicate=F.col("degree") > 0).collect()] == ["a"] and C.candidates(c, True, F.lit(None).cast("boolean")).count() == 0


def test_presets_hide_columns(spark):
    df = spark.createDataFrame([(1, 0.5, "r", "c")], "id int, score double, matched_rules string, content string")
    assert P.shown(df, "search").columns == ["id", "score", "matched_rules"] and P.shown(df, "search", "minimal", content=True).columns == ["id", "content"]
    assert P.options("impact", "compact")["scores"] is False and P.options("related")["edges"] is True


def test_wording_of_paths(spark):
    steps = "array<struct<relation: string, direction: string, note: string, via: string>>"
    df = spark.createDataFrame([(["a", "b"], [("CALLS", "outgoing", "", "a")], 1), (["a", "b", "c", "d", "e"], [("CALLS", "outgoing", "", "a"), ("PART_OF", "outgoing", "n", "b"), ("CALLS", "incoming", "", "c"), ("USES_CONFIG", "outgoing", "k", "d")], 4), (["a"], [], 0)], f"l array<string>, s {steps}, h int")
    got = [tuple(r) for r in df.select(P.path_summary(F.col("l"), F.col("s"), 2), P.why(F.col("l")[0], F.element_at("l", -1), F.col("s"), F.col("h"))).collect()]
    assert got == [("a -[CALLS]-> b", "b is impacted from a via calls in 1 hop."), ("a -[CALLS]-> b ... 2 more hops ... -[USES_CONFIG(k)]-> e", "e is impacted from a via calls, part of (n) and uses config (k) in 4 hops."), ("a", "a is reachable from a.")]


def test_words_and_symbols_of_a_question():
    assert TP.query_terms("Why does <!-- not this --> parseHTTPRequest use the fooBar?") == ["why", "parse", "http", "request", "foo", "bar"]
    assert TP.named_symbols("Fix fooBar in Store.save, not here or Store or MAX_SIZE a::b") == ["fooBar", "Store.save", "MAX_SIZE"]


def test_expected_hits(spark):
    res = spark.createDataFrame([("q", "file:src/a.py", "src/a.py", "a", 1), ("q", "chunk:src/b.py:run:1-2", "src/b.py", "run", 2)], "query_id string, id string, path string, label string, rank int")
    exp = spark.createDataFrame([("q", "file:src/a.py"), ("q", "src/b.py:run"), ("q", "src/b.py::other"), ("q", "src/c.py"), ("z", "src/a.py")], "query_id string, hit string")
    got = {(r["query_id"], r["hit"]): (r["rank"], r["level"]) for r in E.match_hits(res, exp).collect()}
    assert got == {("q", "file:src/a.py"): (1, "path"), ("q", "src/b.py:run"): (2, "symbol"), ("q", "src/b.py::other"): (2, "path"), ("q", "src/c.py"): (None, "missing"), ("z", "src/a.py"): (None, "missing")}


def test_traversal_and_containment(spark):
    rels = spark.createDataFrame([("c1", "c2", "CALLS"), ("c3", "c1", "CALLS"), ("f", "c1", "DEFINES"), ("c2", "g", "IMPORTS"), ("x", "c1", "OTHER")], "from_id string, to_id string, relation string")
    heads = spark.createDataFrame([("c1", "Chunk", "p/a.py", "one"), ("c2", "Chunk", "p/b.py", "two"), ("c3", "Chunk", "q/c.py", "startAll"), ("f", "File", "p/a.py", ""), ("g", "File", "vendor/g.py", "")], "id string, entity_type string, path string, name string")
    got = {(r["id"], r["role"], r["distance"]) for r in TP.traverse(rels, spark.createDataFrame([("c1",)], "id string"), heads).collect()}
    assert {("c2", "callee", 1), ("c3", "lifecycle_owner", 1), ("f", "definition_owner", 1)} <= got and not any(i == "g" for i, *_ in got)
    points = spark.createDataFrame([("file", "p/a.py", "owner_path", "c1"), ("directory", "p", "module_path", "c1")], "scope string, value string, kind string, cause string")
    rows = spark.createDataFrame([("1", "p/a.py"), ("2", "p/x/b.py"), ("3", "q/c.py"), ("4", "pp/a.py")], "id string, path string")
    assert {(r["id"], r["scope"]) for r in TP.contained(rows, points).collect()} == {("1", "file"), ("2", "directory")}


@needs_data
def test_two_passes_stay_within_their_lanes(spark):
    from loomgraph.plans.retrieval_queries import two_pass
    rows = two_pass(spark, DATA).collect()
    assert len({r["path"] for r in rows}) == len(rows) <= 44 and sum(r["lane"] == "test" for r in rows) <= 12


def test_policies_run_by_type_then_id_else_warn(spark):
    files = spark.createDataFrame([("a.py", 'PASSWORD = "hunter2222"\nx', 10), ("b.py", "# TODO\nfine", 900_000)], "path string, content string, size_bytes long")
    pol = [{"id": "secrets", "enforce": True}, {"id": "t", "type": "regex", "enforce": True, "config": {"pattern": "^# TODO"}}, {"id": "max-file-size", "enforce": True}, {"id": "nope", "enforce": True}, {"id": "off"}, {"id": "code-review", "enforce": True}]
    got = {r["policy_id"]: (r["passed"], r["severity"], r["n_hits"]) for r in G.run_policies(files, pol).collect()}
    assert got == {"secrets": (False, "error", 1), "t": (False, "warning", 1), "max-file-size": (False, "warning", 1), "nope": (False, "warning", 0), "code-review": (False, "warning", 0)}


def test_reviews_and_trees(spark):
    a = spark.createDataFrame([("x", True, "1"), ("y", True, None)], "path string, exists boolean, hash string")
    assert G.review_matches(a, a).first()["matches"] and G.review_matches(a, a.where("path = 'x'")).first()["n_differ"] == 1
    p = spark.createDataFrame([(1, 0, 10, 0.1), (2, 1, 5, 0.2), (3, 2, 1, 0.3), (9, 9, 7, 1.0)], "pid long, ppid long, rss long, cpu double")
    assert {tuple(r) for r in G.process_trees(p, spark.createDataFrame([(1,), (9,)], "root long")).collect()} == {(1, 3, 16, 0.6), (9, 1, 7, 1.0)}


def test_contradictions_are_counted_not_spelt_out(spark):
    notes = spark.createDataFrame([("a", "decision", "active", ["t"], ""), ("b", "decision", "active", ["t"], "a"), ("c", "decision", "active", ["t", "u"], ""), ("d", "gotcha", "active", ["t"], ""), ("e", "fix", "old", ["t"], "")], "id string, type string, status string, applies_to array<string>, supersedes string")
    assert {(r["type_a"], r["type_b"], r["n_pairs"]) for r in G.contradictions(notes).collect()} == {("decision", "decision", 2), ("decision", "gotcha", 3)}


def test_hooks_and_query_vectors():
    seen, made = [], []
    h = Hooks()
    h.on("tool_call", lambda e: 1 / 0)
    h.on("tool_call", seen.append)
    with h.call("search"):
        pass
    with pytest.raises(KeyError), h.call("impact"):
        raise KeyError
    assert [(e["tool"], e["ok"]) for e in seen] == [("search", True), ("impact", False)]
    q = QueryVectors(lambda m, t: made.append(t) or [1.0], 2)
    for t in ("a", "b", "a", "c", "a", "b"):
        q.get("m", t)
    assert made == ["a", "b", "c", "b"]
