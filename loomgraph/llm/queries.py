"""Queries of the training-data operators, and their SQL where SQL can express them over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import handwritten, leaks, mixing, neardups, neighbours, pieces, privacy, syntax


def chunk_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select(F.col("chunk_key").alias("key"), F.col("body").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neardups.similar_pairs(chunk_bodies(spark, sf_dir), k=3, threshold=0.6)
    return pairs.select(F.col("a").alias("chunk_key_a"), F.col("b").alias("chunk_key_b"))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linear form of ``p6_found``: linked classes, by their smallest chunks."""
    links, _ = neardups.links_and_members(chunk_bodies(spark, sf_dir), k=3, threshold=0.6)
    return links.select(F.col("a").alias("chunk_key_a"), F.col("b").alias("chunk_key_b"))


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of that form: the class of every chunk that has a run of three words."""
    _, members = neardups.links_and_members(chunk_bodies(spark, sf_dir), k=3, threshold=0.6)
    return members.select(F.col("key").alias("chunk_key"), F.col("rep").alias("class_id"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with five words in a run and a similarity of 0.8, one row per chunk."""
    out = neardups.groups(chunk_bodies(spark, sf_dir), k=5, threshold=0.8)
    return out.select(F.col("key").alias("chunk_key"), F.col("group").alias("group_id"), F.col("class").alias("class_id"), "n_links")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: in how many documents, and the longest span."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "vectors").select(F.col("vec_id").alias("key"), "model", "vector"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.least("key", "other"), F.greatest("key", "other")
    return _neighbours(spark, sf_dir).select(a.alias("vec_id_a"), b.alias("vec_id_b")).distinct()


def p3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked neighbours of every vector whose id is divisible by 20, among all vectors."""
    out = _neighbours(spark, sf_dir).where("key % 20 = 0")
    return out.select(F.col("key").alias("vec_id"), "rank", F.col("other").alias("neighbour_id"), F.round("cosine", 4).alias("cosine"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "chunks").select(F.col("chunk_key").alias("key"), F.col("body").alias("text"), "kind", "start_line"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select(F.col("key").alias("chunk_key"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumnRenamed("key", "chunk_key")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = privacy.sanitise(table(spark, sf_dir, "documents")).select("doc_id", F.explode("spans").alias("s"))
    return spans.select("doc_id", "s.pii_type", "s.found_text").distinct()


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with personal information, their spans replaced by placeholders."""
    return privacy.sanitise(table(spark, sf_dir, "documents")).select("doc_id", "redacted", F.size("spans").alias("n_spans"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.classify(table(spark, sf_dir, "documents").where("kind = 'CODE'").select("doc_id", "path", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where("not by_hand").select("doc_id")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code file with its notice and the forest's probability."""
    return _files(spark, sf_dir).select("doc_id", "notice", F.round("probability", 3).alias("probability"), "by_hand")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("kind = 'CODE'")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_files(_code(spark, sf_dir)).select("doc_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, files that don't parse, and files that a parser reported on their present text, per repository
    and language."""
    code = _code(spark, sf_dir)
    broken = syntax.broken_files(code).select("doc_id", "reason")
    reports = (
        table(spark, sf_dir, "parser_errors").where("file_id is not null and checksum is not null")
        .select("file_id", "checksum").distinct().withColumn("reported", F.lit(1))
    )
    same = [F.coalesce(mixing.same_source(F.col("source")), F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")]
    return (
        code.select("doc_id", "file_id", "checksum", "source", "lang").join(broken, "doc_id", "left").join(reports, ["file_id", "checksum"], "left")
        .groupBy(*same).agg(
            F.count(F.lit(1)).alias("n_files"), F.count("reason").alias("n_broken"), F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("rate"),
            *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("truncated", "conflict", "mismatch", "other")],
            F.count("reported").alias("n_reported"), F.count(F.when(F.col("reason").isNotNull(), F.col("reported"))).alias("n_broken_reported"),
        )
    )


QUERIES = {
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p5_found": p5_found,
    "p5_classes": p5_classes,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p3_found": p3_found,
    "p3_search": p3_search,
    "p6_found": p6_found,
    "p6_links": p6_links,
    "p6_members": p6_members,
    "p6_groups": p6_groups,
    "p8_found": p8_found,
    "p8_items": p8_items,
}

_LEAKED = r"""d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w from documents where length(text) > 0),
    i as (select distinct item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') w from eval_items where length(passage) > 0),
    ig as (select item_id, k, array_to_string(w[k:k + 11], ' ') g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) k from i where len(w) >= 12)),
    dg as (select doc_id, k, array_to_string(w[k:k + 11], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) k from d where len(w) >= 12)),
    hit as (select doc_id, item_id, d.k - i.k diagonal, d.k from dg d join ig i using (g)),
    isle as (select *, k - row_number() over (partition by doc_id, item_id, diagonal order by k) island from hit),
    span as (select doc_id, item_id, count(*) + 11 n from isle group by doc_id, item_id, diagonal, island)"""
_RUNS = r"""c as (select chunk_key, any_value(body) body from chunks where length(body) > 0 and chunk_key is not null group by 1),
    w as (select chunk_key, regexp_extract_all(lower(regexp_replace(body, '[^A-Za-z0-9_]+', ' ', 'g')), '[a-z0-9_]+') w from c),
    g as (select distinct chunk_key, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] g from (select chunk_key, w, unnest(generate_series(1, len(w) - 2)) k from w where len(w) >= 3)),
    n as (select chunk_key, count(*) n from g group by 1),
    pairs as (select a.chunk_key a, b.chunk_key b, count(*) s from g a join g b on a.g = b.g and a.chunk_key < b.chunk_key group by 1, 2),
    near as (select a, b from pairs join n x on x.chunk_key = a join n y on y.chunk_key = b where s * 10 >= (x.n + y.n - s) * 6),
    classes as (select chunk_key, min(chunk_key) over (partition by runs) rep from (select chunk_key, md5(string_agg(g, chr(10) order by g)) runs from g group by 1))"""
_NEAREST = """v as (select distinct on (vec_id) vec_id, coalesce(model, chr(0)) model, list_transform(vector, lambda x: x::double) x from vectors
        where len(vector) = 128 and not list_bool_or(list_transform(vector, lambda x: x is null or isnan(x) or isinf(x))) and list_bool_or(list_transform(vector, lambda x: x <> 0))),
    u as (select *, sqrt(list_dot_product(x, x)) n from v), cosines as (select a.vec_id a, b.vec_id b, list_dot_product(a.x, b.x) / (a.n * b.n) c from u a join u b on a.model = b.model and a.vec_id <> b.vec_id),
    ranked as (select *, row_number() over (partition by a order by c desc, b) k from cosines where c >= 0.8)"""

SQL: dict[str, str] = {
    "p3_found": f"with {_NEAREST} select distinct least(a, b) vec_id_a, greatest(a, b) vec_id_b from ranked where k <= 5",
    "p6_found": f"with {_RUNS} select a chunk_key_a, b chunk_key_b from near",
    "p6_links": f"with {_RUNS}, r as (select distinct x.rep p, y.rep q from near join classes x on x.chunk_key = a join classes y on y.chunk_key = b where x.rep <> y.rep) select distinct least(p, q) chunk_key_a, greatest(p, q) chunk_key_b from r",
    "p6_members": f"with {_RUNS} select chunk_key, rep class_id from classes",
    "p8_found": f"with {_LEAKED} select distinct doc_id, item_id from hit",
    "p8_items": f"with {_LEAKED} select item_id, count(distinct doc_id) n_docs, max(n) longest from span group by 1",
    "p4_found": "select distinct chunk_key from chunks where length(body) > 4000",
}
