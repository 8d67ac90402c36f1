"""Ranked search over entities: relevance gate, combined score, diversity by path, top k."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.context import base_id, is_window, midrank

#: Relevance that an entity needs, lexically or by its vector.
MIN_LEXICAL, MIN_VECTOR = 0.05, 0.2


@dataclass(frozen=True)
class Weights:
    semantic: float = 0.4
    graph: float = 0.25
    trust: float = 0.2
    recency: float = 0.15


def test_evidence(path: Column) -> Column:
    return path.rlike(r"(^|/)(tests?|__tests__)/") | path.rlike(r"\.(test|spec)\.[^.]+$")


def matches(texts: DataFrame | Callable[[Callable[[DataFrame], DataFrame]], DataFrame], words: list[str], phrase: str = "") -> DataFrame:
    """``(id, tokens, whole)``: which of the words each text has among its tokens, and whether it holds the phrase.

    ``texts(id, text)`` may hold an id in several rows; their tokens are united. Texts without any word are
    dropped by one search for substrings where they are read, so only ids and found words are moved: ``texts``
    may be a function that works such a step on its rows before it joins them, see ``context.entity_texts``.
    A null text has no tokens.
    """
    text = F.col("text")

    def found(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "text"]
        some = rows.where(T.holds(text, words) | T.unstable(text)).select(*keys, T.composed(text).alias("text"))
        return some.select(*keys, T.tokens_among(text, words).alias("tokens"), (F.lower("text").contains(phrase) if phrase else F.lit(False)).alias("whole"))

    some = texts(found) if callable(texts) else found(texts.select("id", "text"))
    return some.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"), F.bool_or("whole").alias("whole")).where(F.size("tokens") > 0)


def asked_words(query: str) -> list[str]:
    """All words that count for a query: its own, their aliases and those that lead to them."""
    return sorted({w for g in T.token_groups(T.expand(T.query_tokens(query))) for w in g})


def lexical(rows: DataFrame, words: list[str], phrase: str) -> DataFrame:
    """``(id, lexical_score)`` of the texts that hold a word of the query, from ``matches`` or from texts."""
    found = rows if "tokens" in rows.columns else matches(rows, sorted({w for g in T.token_groups(words) for w in g}), phrase)
    return found.select("id", T.lexical_share(F.col("tokens"), F.col("whole"), words).alias("lexical_score"))


def _names(cands: DataFrame) -> tuple | None:
    """Token columns of path, file name, label and kind, where the candidates come from an index."""
    names = ("path_tokens", "base_tokens", "label_tokens", "kind_tokens")
    return tuple(F.col(n) for n in names) if set(names) <= set(cands.columns) else None


def scored(cands: DataFrame, degree: DataFrame | None, query: str, reference: str, weights: Weights = Weights(),
           vectors: DataFrame | None = None, query_vector: list[float] | None = None, tier: str | None = None,
           found: DataFrame | None = None, scorers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Relevant candidates with all their scores.

    The midrank of the degree is taken over all candidates of a type (and tier), before the relevance gate
    and without touching texts. Texts give only ids and lexical scores: those that hold none of the query's
    words are dropped by one search for substrings where they are read, and the rest is joined to the heads
    of the candidates by id. ``found`` are the ``matches`` of the query's words, as an index gives them;
    without it the candidates' own texts are read. A ``degree`` of the candidates is used where they have
    one. ``scorers`` replace or add parts of the score by name
    (``semantic``, ``recency``, ``boost``): functions from a Column of the usual value to a Column.
    """
    plug = lambda name, usual: (scorers or {}).get(name, lambda c: c)(usual)
    phrase = query.strip().lower()
    words = T.expand(T.query_tokens(query))
    groups = ["entity_type"] if tier is None else [tier, "entity_type"]
    extra = [] if tier is None else [tier]
    with_degree = cands if degree is None else cands.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    counts = with_degree.groupBy(*groups, "degree").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*groups).orderBy("degree"))
    ranks = counts.select(*groups, "degree", ((upto - F.col("_c") + upto) / (2 * F.sum("_c").over(W.partitionBy(*groups)))).alias("graph_score"))
    rows = with_degree
    if vectors is not None and query_vector is not None:
        asked = F.array(*[F.lit(float(x)) for x in query_vector])
        close = vectors.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), T.cosine(F.col("vector"), asked))).alias("embedding_score"))
        rows = rows.join(close.where("embedding_score > 0"), "id", "left").withColumn("embedding_score", F.coalesce("embedding_score", F.lit(0.0)))
    else:
        rows = rows.withColumn("embedding_score", F.lit(0.0))
    rows = rows.join(lexical(cands if found is None else found, words, phrase), "id", "left").withColumn("lexical_score", F.coalesce("lexical_score", F.lit(0.0)))
    rows = rows.where((F.col("lexical_score") >= MIN_LEXICAL) | (F.col("embedding_score") >= MIN_VECTOR)).join(ranks, [*groups, "degree"])
    rows = rows.withColumn(
        "semantic_score", plug("semantic", F.when(F.col("embedding_score") > 0, F.col("embedding_score") * 0.75 + F.col("lexical_score") * 0.25).otherwise(F.col("lexical_score")))
    ).withColumn("_structural", T.structural_boost(F.col("path"), F.col("label"), F.col("kind"), words, phrase, _names(cands)))
    sem, lex = F.col("semantic_score"), F.col("lexical_score")
    evidence = F.when(
        test_evidence(F.col("path")), F.when((sem >= 0.5) & (lex >= 0.4), 0.07).when((sem >= 0.4) & (lex >= 0.25), 0.04).otherwise(0.0)
    ).otherwise(0.0)
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.0), sem, F.col("_structural")) * 0.85 + 0.15)
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_level") / 100))
    score = (
        sem * weights.semantic + F.col("graph_score") * weights.graph * scale + trust * weights.trust * scale
        + plug("recency", T.recency(F.col("updated_at"), reference)) * weights.recency * scale + F.col("_structural") + evidence
        + plug("boost", T.data_access_boost(F.col("entity_type"), F.col("kind"), F.col("path"), words, phrase))
        + F.when(F.col("source_of_truth"), sem * 0.1).otherwise(0.0)
    )
    return rows.select(
        *extra, "id", "entity_type", "kind", "label", "path", "status", "source_of_truth", "updated_at", "semantic_score",
        "embedding_score", "lexical_score", "graph_score", score.alias("score"),
    )


def collapse_windows(ranked: DataFrame, cands: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best row per id, after window chunks took the id of their base chunk where that is a candidate."""
    base = cands.where((F.col("entity_type") == "Chunk") & ~is_window(F.col("id"))).select(F.col("id").alias("_base"), F.col("path").alias("_path"), F.col("label").alias("_label"))
    rows = ranked.withColumn("_base", F.when(is_window(F.col("id")), base_id(F.col("id"))))
    rows = rows.join(base, "_base", "left").select(
        *[c for c in ranked.columns if c not in ("id", "path", "label")], F.when(F.col("_path").isNotNull(), F.col("_base")).otherwise(F.col("id")).alias("id"),
        F.coalesce("_path", "path").alias("path"), F.coalesce("_label", "label").alias("label"),
    )
    best = W.partitionBy(*(by or []), "id").orderBy(F.desc("score"), "path", "label")
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def diverse(ranked: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """Top ``k`` with a penalty of 0.04 (at most 0.12) for every better result of the same path.

    The pool is the best 3k by score; within a path the score falls and the penalty grows, so one sort by
    the adjusted score equals picking greedily. Ties go by id and path.
    """
    by = by or []
    pool_order = [F.desc("score"), F.col("id"), F.col("path")]
    if by:
        pool = ranked.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*pool_order))).where(F.col("_r") <= 3 * k).drop("_r")
    else:
        pool = ranked.orderBy(*pool_order).limit(3 * k)
    key = F.when(F.col("path") != "", F.col("path")).otherwise(F.col("id"))
    pool = pool.withColumn("_n", F.row_number().over(W.partitionBy(*by, key).orderBy(*pool_order)))
    pool = pool.withColumn("_adjusted", F.col("score") - F.least(F.lit(0.12), (F.col("_n") - 1) * 0.04))
    if by:
        order = W.partitionBy(*by).orderBy(F.desc("_adjusted"), *pool_order)
        return pool.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_n", "_adjusted", "_k")
    return pool.orderBy(F.desc("_adjusted"), *pool_order).limit(k).drop("_n", "_adjusted")


def search(cands: DataFrame, degree: DataFrame | None, query: str, reference: str, top_k: int = 5, **options) -> DataFrame:
    """The ranked answer to a query: at most ``top_k`` rows, best first."""
    ranked = collapse_windows(scored(cands, degree, query, reference, **options), cands)
    return diverse(ranked, top_k)


__all__ = ["Weights", "collapse_windows", "diverse", "midrank", "scored", "search"]
