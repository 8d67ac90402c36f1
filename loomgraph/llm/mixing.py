"""Mixing sources to target shares of the total size, in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import random
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that public vocabulary parts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Budget in tokens from which on the exact fit is searched.
EXACT_TOKENS = 16_384


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of whole texts; null and empty texts have 0 tokens."""

    def run(batches):
        enc = _encoding(tokenizer)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"]
            )

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def same_source(c: Column) -> Column:
    """One spelling of a source: trimmed, lower case, hyphens for underscores and blanks."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")


def fit_budget(counts: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """How many items of each length to take so that their total comes as close to ``budget`` as it can from below.

    Lengths are used in proportion to their counts first, then one by one in seeded order, until the rest
    is small; that rest is fitted by bounded-knapsack dynamic programming over the lengths left, as
    bitsets of reachable totals, which stops as soon as the budget itself is reached.
    """
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    size = sum(n * c for n, c in counts.items())
    if budget >= size:
        return dict(counts)
    if budget <= 0 or not counts:
        return {}
    rng = random.Random(seed)
    exact = max(EXACT_TOKENS, 4 * sorted(counts)[len(counts) // 2])
    share = max(0.0, (budget - exact) / size)
    taken = {n: int(c * share) for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    order = sorted(counts)
    rng.shuffle(order)
    moved = True
    while left > exact and moved:
        moved = False
        for n in order:
            if left <= exact:
                break
            if taken[n] < counts[n] and n <= left:
                taken[n] += 1
                left -= n
                moved = True
    rng.shuffle(order)
    mask, reach = (1 << (left + 1)) - 1, [1]
    steps: list[tuple[int, int]] = []
    for n in order:
        free, power = min(counts[n] - taken[n], left // n), 1
        while free > 0:
            k = min(power, free)
            steps.append((n, k))
            reach.append((reach[-1] | reach[-1] << (n * k)) & mask)
            free -= k
            power *= 2
        if reach[-1] >> left & 1:
            break
    at = reach[-1].bit_length() - 1
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> at & 1:
            n, k = steps[i]
            taken[n] += k
            at -= n * k
    return {n: c for n, c in taken.items() if c}


def plan_source(counts: dict[int, int], target: int, max_repeats: int, seed: int) -> tuple[int, dict[int, int]]:
    """Whole passes over all documents of a source, and how many of each length to take once more."""
    size = sum(n * c for n, c in counts.items())
    if not size or target <= 0 or max_repeats <= 0:
        return 0, {}
    passes = min(max_repeats, target // size)
    return passes, fit_budget(counts, target - passes * size, seed) if passes < max_repeats else {}


def _plan(spark: SparkSession, sizes: DataFrame, targets: DataFrame, budget: int | None, seed: int):
    """The plan per source. Only counts per source and length come to the driver, not documents."""
    lengths: dict[str, dict[int, int]] = {}
    for r in sizes.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("c")).toLocalIterator():
        lengths.setdefault(r["source"], {})[r["n_tokens"]] = r["c"]
    wanted = [(r["source"], r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.collect()]
    total = budget if budget is not None else sum(n * c for s in lengths.values() for n, c in s.items())
    out = []
    for i, (source, share, repeats) in enumerate(sorted(wanted)):
        counts = lengths.get(source, {})
        target = round(total * share)
        passes, more = plan_source(counts, target, repeats, seed + i)
        out.append((source, share, repeats, target, counts, passes, more))
    return out


def _ready(docs: DataFrame, targets: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    targets = targets.select(same_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    named = docs.select("doc_id", same_source(F.col("source")).alias("source"), "text")
    listed = named.join(targets.select("source").distinct(), "source", "left_semi")
    return cut(token_counts(listed, tokenizer)), targets


def mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 13, tokenizer: str = TOKENIZER) -> DataFrame:
    """Selected documents ``(doc_id, source, n_tokens, repeats)`` of the sources in ``targets``.

    Each source gets its share of ``budget`` tokens (by default as many as all listed sources have once):
    whole passes first, then a seeded selection by length that fits the rest, never more than
    ``max_repeats`` uses of a document. A source that is too small gives all it may, one without documents
    nothing; the others don't make up for it. Spellings of a source are made one; documents of no listed
    source, and those without a token, are not used.
    """
    spark = docs.sparkSession
    sizes, targets = _ready(docs, targets, tokenizer)
    plan = _plan(spark, sizes, targets, budget, seed)
    passes = spark.createDataFrame([(p[0], p[5]) for p in plan] or [("", 0)], "source string, passes int")
    picks = spark.createDataFrame([(p[0], n, c) for p in plan for n, c in p[6].items()] or [("", -1, 0)], "source string, n_tokens long, picks long")
    # Rank within a length by a seeded hash; ranges of the hash are counted first, so that a length that very
    # many documents share is ranked range by range in many tasks.
    used = sizes.where("n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod("h", F.lit(64)))
    same = ["source", "n_tokens", "part"]
    before = used.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).withColumn(
        "before", F.sum("c").over(Window.partitionBy("source", "n_tokens").orderBy("part")) - F.col("c")
    ).drop("c")
    ranked = used.join(before, same).withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy("h", "doc_id")) + F.col("before"))
    return (
        ranked.join(picks, ["source", "n_tokens"], "left").join(passes, "source")
        .withColumn("repeats", (F.col("passes") + F.when(F.col("r") <= F.col("picks"), 1).otherwise(0)).cast("int"))
        .where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    )


def shares(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 13, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per source of ``targets``: documents and tokens there are, tokens wanted and taken, and the share reached."""
    sizes, targets = _ready(docs, targets, tokenizer)
    plan = _plan(docs.sparkSession, sizes, targets, budget, seed)
    rows = []
    for source, share, repeats, target, counts, passes, more in plan:
        size = sum(n * c for n, c in counts.items())
        rows.append((source, share, repeats, sum(counts.values()), size, target, passes * size + sum(n * c for n, c in more.items())))
    total = sum(r[-1] for r in rows)
    rows = [(*r, r[-1] / total if total else 0.0) for r in rows]
    return docs.sparkSession.createDataFrame(
        rows, "source string, target_share double, max_repeats int, n_docs long, n_tokens long, wanted_tokens long, taken_tokens long, actual_share double"
    )
