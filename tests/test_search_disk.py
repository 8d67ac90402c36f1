"""Searches store nothing and move no texts."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.operators import evaluate as E
from loomgraph.operators import search as S
from loomgraph.operators.lineage import checkpoint_dir
from loomgraph.plans import context as C

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def _stored(spark):
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or checkpoint_dir(spark)).removeprefix("file:")
    return {p for p in os.listdir(base) if p.startswith("search-index")} if os.path.isdir(base) else set()


# F1, F3, F5 to F9, F11 to F17: an index on disk took many times the input.
@pytest.mark.parametrize("name", ["lexical_search_topk", "search_index_heads", "idf_weights", "pattern_evidence"])
def test_a_search_stores_no_index(spark, tmp_path, name):
    for t in ("documents", "chunks", "modules", "rules", "relations"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    before = _stored(spark)
    assert entry.queries()[name](spark, str(tmp_path)).count() > 0
    assert _stored(spark) == before


def test_a_step_on_texts_comes_before_they_are_joined(spark):
    each = lambda rows: rows.select(*[c for c in rows.columns if c != "text"], F.md5("text").alias("made"))
    plan = C.entity_texts(spark, DATA, each=each)._jdf.queryExecution().optimizedPlan().toString()
    # Above the join with the keys of the present rows there is only what was made of the texts.
    assert plan.index("Join Inner") < plan.index("md5(") and "concat_ws" not in plan[: plan.index("Join Inner")]
    words = ["tracker", "retry"]
    whole = S.matches(C.entity_texts(spark, DATA), words).collect()
    assert {(r["id"], *sorted(r["tokens"])) for r in C.search_index(spark, DATA).matches(words).collect()} == {(r["id"], *sorted(r["tokens"])) for r in whole} and whole


# all pairs of a query and an entity were moved; a task now keeps the best of each query.
def test_packs_move_only_the_best_of_each_task(spark):
    index = C.search_index(spark, DATA)
    cands = C.candidates(index.heads)
    queries = [("1", "retry tracker snapshot"), ("2", "the module of the tracker"), ("3", "retry tracker snapshot")]
    ask = lambda **o: [(r["query_id"], -r["score"], r["id"], r["path"]) for r in E.scored_many(index, cands, queries, "2025-06-30 00:00:00", **o).coalesce(1).collect()]
    every, some = sorted(ask()), sorted(ask(top=3))
    best = [r for q, _ in queries for r in [x for x in every if x[0] == q][:3]]
    assert set(best) <= set(some) and len(some) < len(every)
    assert [r[1:] for r in best if r[0] == "1"] == [r[1:] for r in best if r[0] == "3"]


# only the first 12,000 characters of a decision record were searched.
@pytest.mark.parametrize("name", ["result_ranks", "search_compact", "search_full_content"])
def test_all_of_a_decision_record_is_searched(spark, tmp_path, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    late = docs.limit(1).withColumns({"file_id": F.lit("file:docs/late.md"), "path": F.lit("docs/late.md"), "kind": F.lit("ADR"), "updated_at": F.lit("2025-06-29"), "status": F.lit("active"),
                                      "text": F.concat(F.repeat(F.lit("word "), 2600), F.lit("retry tracker snapshot"))})
    con = duckdb.connect()
    for t in ("documents", "chunks", "modules", "rules", "relations"):
        path = str(tmp_path / f"{t}.parquet")
        (docs.unionByName(late) if t == "documents" else spark.read.parquet(f"{DATA}/{t}.parquet")).write.parquet(path)
        con.execute(f"create view {t} as select * from '{path}/*.parquet'")
    got = {r["id"] for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    asked = con.execute(entry.oracle_sql()[name])
    at = [c[0] for c in asked.description].index("id")
    assert "adr:late" in got and got == {r[at] for r in asked.fetchall()}
