from loomgraph.llm import privacy


def test_quoted_names_come_out_of_the_join_too(spark):
    given, family = ["Anna", "Bertil", "Carla", "David"], ["Lindqvarn", "Osmund", "Tjell", "Vexley-Holm"]
    rows = [(i, f"Some plain text.\nOwner: {given[i % 4]} {family[i // 4 % 4]} <a{i}@x.test>\n" + "filler words " * 60) for i in range(64)]
    rows += [(100, "x = 'Anna Tjell'; " + "filler " * 50), (101, "seen by Carla Vexley-Holm- twice " + "filler " * 50), (102, "const who = 'David Osmund' + ’Bertil Lindqvarn’ " + "filler " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = {r["doc_id"]: (r["redacted"], r["spans"]) for r in privacy.sanitise(df).collect()}
    joined = {r["doc_id"]: (r["redacted"], r["spans"]) for r in privacy.sanitise(df, max_broadcast_terms=0).collect()}
    assert joined == sent
    assert all(s["pii_type"] == "NAME" for i in (100, 101, 102) for s in joined[i][1])
