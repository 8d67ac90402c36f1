"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list; the component is its smallest node.

    Every round sends each node's larger neighbours to its smallest one and then links the smaller
    neighbours together, so the rounds grow with the logarithm of the size of a component. Minima are
    combined before each shuffle; a node with very many edges is joined through AQE's skew handling.
    Nulls at either end drop the edge; a node that only has a link to itself is its own component; an
    empty edge list gives an empty result.
    """
    base = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = base.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = cut(
        base.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _digest(links)
    for _ in range(max_rounds):
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(down.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
        links = cut(small)
        now = _digest(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.join(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")), "node", "left").select(
        "node", F.coalesce("_m", "node").alias("component")
    )
