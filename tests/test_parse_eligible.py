from datetime import datetime

from loomgraph.plans.ingest_queries import parse_eligible
from loomgraph.sources.tables import table

DATA = "/root/testdata/sf0.001"


def test_files_changed_after_their_chunks(spark, tmp_path):
    day = lambda n: datetime(2026, 1, n)
    docs, chunks = (table(spark, DATA, t).schema for t in ("documents", "chunks"))
    file = lambda i, kind, at: {"doc_id": i, "file_id": f"file:f{i}", "path": f"f{i}", "kind": kind, "ingested_at": at}
    piece = lambda i, k, at: {"chunk_key": k, "id": f"chunk:{k}", "file_id": f"file:f{i}", "name": "n", "ingested_at": at}
    row = lambda schema, r: tuple(r.get(c) for c in schema.names)
    files = [file(1, "CODE", day(5)), file(2, "CODE", day(2)), file(3, "CODE", day(1)), file(4, "DOC", day(9)), file(5, "CODE", None), file(6, "CODE", day(4))]
    pieces = [piece(1, 1, day(3)), piece(1, 2, day(4)), piece(2, 3, day(3)), piece(4, 4, day(1)), piece(5, 5, day(1)), piece(6, 6, day(1)), piece(6, 7, day(4))]
    spark.createDataFrame([row(docs, r) for r in files], docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([row(chunks, r) for r in pieces], chunks).write.parquet(f"{tmp_path}/chunks.parquet")
    assert sorted(r["id"] for r in parse_eligible(spark, str(tmp_path)).collect()) == ["file:f1", "file:f3"]
