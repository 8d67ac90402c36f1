"""Corpus statistics: distributions, histograms, roll-ups, recall and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where the buckets of the histograms start; the last one is open.
LINE_BUCKETS = (1, 11, 21, 41, 81, 161, 321)
CHAR_BUCKETS = (0, 201, 501, 1001, 2001, 4001, 8001, 12001)
DEGREE_BUCKETS = (0, 1, 2, 3, 5, 9, 17, 33)


def distribution(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, min, max, mean (2 places) and exact percentiles with linear interpolation, per group.

    Nulls don't count. The percentiles aggregate values with their counts, so equal values combine before
    the shuffle.
    """
    v = F.col(value).cast("double")
    p = F.percentile(v, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.9, 0.99)]))
    aggs = [F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 2).alias("mean"), p.alias("_p")]
    out = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    return out.select(*(by or []), "n", "min", "max", "mean", *[F.round(F.col("_p")[i], 6).alias(f"p{q}") for i, q in enumerate((25, 50, 75, 90, 99))])


def bucket(value: Column, edges: tuple[int, ...]) -> Column:
    """Number of the bucket: the last edge that is not above the value; below the first edge is bucket 0."""
    return F.greatest(F.lit(0), sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)) - 1)


def histogram(rows: DataFrame, value: str, edges: tuple[int, ...]) -> DataFrame:
    """``(bucket, label, n)`` with empty buckets; nulls don't count."""
    spark = rows.sparkSession
    labels = [(i, f"{a}-{edges[i + 1] - 1}" if i + 1 < len(edges) else f"{a}+") for i, a in enumerate(edges)]
    frame = F.broadcast(spark.createDataFrame(labels, "bucket int, label string"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(bucket(F.col(value), edges).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counts, "bucket", "left").select("bucket", "label", F.coalesce("n", F.lit(0)).alias("n"))


def merge_histograms(*parts: DataFrame, edges: tuple[int, ...] | None = None) -> DataFrame:
    """Sum of histograms of the same layout; with ``edges`` a bucket that is not of that layout raises an error."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if edges is not None:
        known = F.array(*[F.lit(f"{a}-{edges[i + 1] - 1}" if i + 1 < len(edges) else f"{a}+") for i, a in enumerate(edges)])
        ok = F.coalesce(F.get(known, "bucket") == F.col("label"), F.lit(False))
        out = out.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("histograms of another layout"))))
    return out.groupBy("bucket", "label").agg(F.sum("n").alias("n"))


def vector_sanity(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """One row on the vectors: usual length, zero, non-finite and misfit ones, and the norms of the finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    good = rows.select(F.size(v).alias("d"), F.coalesce(bad, F.lit(False)).alias("bad"), F.when(~bad, norm).alias("norm"), v.isNull().alias("none"))
    return good.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("none").alias("n_null"), F.mode(F.when(F.col("d") >= 0, F.col("d"))).alias("dims"),
        F.count_if((F.col("d") != dims) & ~F.col("none")).alias("n_misfit"), F.count_if("bad").alias("n_nonfinite"), F.count_if(F.col("norm") == 0).alias("n_zero"),
        F.round(F.min("norm"), 6).alias("norm_min"), F.round(F.max("norm"), 6).alias("norm_max"), F.round(F.avg("norm"), 6).alias("norm_mean"),
        F.round(F.percentile("norm", F.lit(0.5)), 6).alias("norm_p50"),
    )


def extension(path: Column) -> Column:
    """Extension of the last part of a path in lower case with its dot, '' without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def share(value: str, by: list[str] | None = None, name: str = "share") -> Column:
    """Share of a value in the total of its group."""
    w = W.partitionBy(*(by or [F.lit(0)]))
    return (F.col(value) / F.sum(value).over(w)).alias(name)


def durations(events: DataFrame, key: str, order: list[str], time: str) -> DataFrame:
    """Adds ``seconds``: from each event to the next one of its key, null for the last."""
    nxt = F.lead(F.unix_micros(F.col(time).cast("timestamp"))).over(W.partitionBy(key).orderBy(*order))
    return events.withColumn("seconds", (nxt - F.unix_micros(F.col(time).cast("timestamp"))) / 1e6)


def latest(rows: DataFrame, key: str, time: Column, tie: str) -> DataFrame:
    """Latest row per key; rows without a readable time lose to others, the smallest ``tie`` wins among equals."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(time.isNotNull(), time, -F.col(tie))).alias("_r")).select(key, "_r.*")


def recall(hits: DataFrame, by: list[str]) -> DataFrame:
    """Expected hits found and missing, and recall in percent with 2 places, per group of ``hits(rank)``."""
    return hits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("expected"), F.count("rank").alias("found"), F.count_if(F.col("rank").isNull()).alias("missing"),
        F.round(F.count("rank") / F.count(F.lit(1)) * 100, 2).alias("recall_pct"), F.min("rank").alias("first_rank"),
    )


def gates(metrics: DataFrame, limits: list[tuple[str, float]]) -> DataFrame:
    """``(metric, actual, threshold, passed)``: metrics must not be above their thresholds; a missing one fails."""
    frame = F.broadcast(metrics.sparkSession.createDataFrame(limits, "metric string, threshold double"))
    return frame.join(metrics, "metric", "left").select("metric", "actual", "threshold", F.coalesce(F.col("actual") <= F.col("threshold"), F.lit(False)).alias("passed"))


def idf(found: DataFrame, total: DataFrame, words: list[str]) -> DataFrame:
    """``(token, n, idf)`` for the words of a query: ln((N + 1) / (n + 1)) + 1.

    ``found(id, tokens)`` tells which of the words each text holds, ``total`` has a row per text.
    """
    spark = found.sparkSession
    count = total.agg(F.count(F.lit(1)).alias("_total"))
    seen = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    frame = spark.createDataFrame([(w,) for w in words], "token string")
    return frame.join(seen, "token", "left").crossJoin(F.broadcast(count)).select(
        "token", F.coalesce("n", F.lit(0)).alias("n"), (F.log((F.col("_total") + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1).alias("idf"))
