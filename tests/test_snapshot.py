from datetime import datetime

from loomgraph.plans.ingest_queries import snapshot_diff


def test_snapshot_diff_covers_every_id(spark, tmp_path):
    rows = [("chunk:a/x", 1, "p", "active", 1), ("chunk:a/x", 2, "q", "active", 2), ("chunk:b/gone", 3, "p", "deleted", 1),
            ("chunk:t/x", 4, "p", "active", 1), ("chunk:t/x", 5, "q", "active", 2), ("chunk:w/same", 6, "p", None, 1), ("chunk:z/gone", 7, "p", "deleted", 1)]
    df = spark.createDataFrame([(i, k, c, s, datetime(2026, 1, d)) for i, k, c, s, d in rows], "id string, chunk_key long, checksum string, status string, ingested_at timestamp")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    assert {r["change"]: r["n"] for r in snapshot_diff(spark, str(tmp_path)).collect()} == {"changed": 2, "unchanged": 1, "removed": 2}
