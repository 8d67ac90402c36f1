"""Each search that the review saw fail by disk leaves nothing in the folder of checkpoints."""

import os
import shutil

import pytest

import __spark_entry__ as entry
from loomgraph.operators.lineage import checkpoint_dir

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
#: By finding. F7 search_index_heads and F15 pattern_evidence have theirs in test_search_disk.
SEARCHES = {
    "F6": "search_compact",
    "F8": "best_scored_per_path",
    "F12": "seed_by_search",
    "F13": "hybrid_search_topk",
    "F14": "lexical_evidence",
    "F16": "search_full_content",
}


def _stored(spark):
    base = (spark.sparkContext.getConf().get("spark.checkpoint.dir") or checkpoint_dir(spark)).removeprefix("file:")
    return {os.path.join(at, f) for at, _, fs in os.walk(base) for f in fs}


@pytest.mark.parametrize("name", SEARCHES.values(), ids=SEARCHES.keys())
def test_a_search_writes_no_files(spark, tmp_path, name):
    # A copy has a path of its own, so nothing that another test stored is found for it.
    for t in ("documents", "chunks", "modules", "rules", "relations", "vectors"):
        src = f"{DATA}/{t}.parquet"
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / f"{t}.parquet")
    before = _stored(spark)
    assert entry.queries()[name](spark, str(tmp_path)).count() > 0
    assert _stored(spark) == before
