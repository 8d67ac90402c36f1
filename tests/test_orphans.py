import random

from loomgraph.operators.orphans import orphan_references
from loomgraph.operators.skew import hot_keys, salted_join

REFS = "ref long, key string, period string, kid string"


def test_against_sets_with_a_hot_key(spark):
    rnd = random.Random(1)
    refs = [(i, "hot" if i % 3 == 0 else f"k{rnd.randrange(500)}", f"2024-{rnd.randrange(1, 13):02d}", "x") for i in range(3000)] + [(9000, None, "2024-01", "x"), (9001, "", "", None)]
    parents = [(f"k{i}",) for i in range(0, 500, 2)] + [("k0",), (None,)]
    got = orphan_references(spark.createDataFrame(refs, REFS).drop("kid"), spark.createDataFrame(parents, "key string"))
    have = {p[0] for p in parents}
    assert sorted(r["ref"] for r in got.collect()) == sorted(r[0] for r in refs if r[1] is not None and r[1] not in have)


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([(1, "a", "p", "")], REFS).drop("kid"), spark.createDataFrame([("a",)], "key string")
    assert orphan_references(refs, parents.limit(0)).count() == 1
    assert orphan_references(refs.limit(0), parents).count() == 0
    assert orphan_references(refs, parents).count() == 0


def test_salted_join_keeps_every_row(spark):
    fact = spark.range(1000).selectExpr("id", "case when id % 2 = 0 then 'hot' else concat('k', id) end key")
    dim = fact.select("key").distinct().selectExpr("key", "length(key) n")
    assert salted_join(fact, dim, "key", fact["id"]).count() == 1000
    assert [r["key"] for r in hot_keys(fact, "key", 4).collect()] == ["hot"]
