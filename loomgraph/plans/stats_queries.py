"""Queries on corpus statistics, evaluation, events and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import stats as S
from ..sources.tables import table
from . import context as C
from . import sqltext as X


def n_rows() -> Column:
    return F.count(F.lit(1))



def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunks(spark, d)
    return c.groupBy("kind", "language").agg(n_rows().alias("n"), F.count_if("exported").alias("n_exported"), F.count_if(C.is_window(F.col("id"))).alias("n_windowed"), F.sum(F.length("body")).alias("chars"))


def chunk_char_distribution(spark: SparkSession, d: str) -> DataFrame:
    return S.distribution(C.chunks(spark, d).withColumn("v", F.length("body")), "v", ["kind"])


def chunk_line_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = C.chunks(spark, d).where("start_line > 0 and end_line >= start_line").withColumn("v", F.expr("end_line - start_line + 1"))
    return S.distribution(rows, "v")


def char_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(C.chunks(spark, d).withColumn("v", F.length("body")), "v", S.CHAR_BUCKETS)


def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram(C.degrees(C.stored_relations(spark, d)), "degree", S.DEGREE_BUCKETS)


def merged_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunks(spark, d).withColumn("v", F.length("body"))
    return S.merge_histograms(*[S.histogram(c.where(p), "v", S.CHAR_BUCKETS) for p in ("exported", "not exported")])


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Degree over CALLS among known chunks: average, maximum, chunks without a call."""
    ids = C.chunks(spark, d).select("id")
    calls = C.without_dangling(C.stored_relations(spark, d).where("relation = 'CALLS'"), ids)
    deg = ids.join(C.degrees(calls), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return deg.agg(n_rows().alias("n_chunks"), F.round(F.avg("degree"), 4).alias("avg_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"),
                   F.round(F.count_if(F.col("degree") == 0) / n_rows() * 100, 2).alias("isolated_pct"))


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_sanity(table(spark, d, "vectors"), "vector", 128)


def embedding_stats(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_sanity(table(spark, d, "embeddings"), "embedding", 64)


def coverage_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """Files, files with chunks, and empty or missing texts, per extension."""
    f = C.files(spark, d).withColumn("ext", S.extension(F.col("path")))
    with_chunks = C.chunks(spark, d).select(F.col("file_id").alias("id"), F.lit(1).alias("has")).distinct()
    return f.join(with_chunks, "id", "left").groupBy("ext").agg(n_rows().alias("n_files"), F.count("has").alias("n_chunked"), F.count_if(F.length("content") == 0).alias("n_empty"),
                                                               F.round(F.count("has") / n_rows() * 100, 2).alias("pct"))


def top_extensions(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).groupBy(S.extension(F.col("path")).alias("ext")).agg(n_rows().alias("n")).orderBy(F.desc("n"), "ext").limit(10)


def phase_durations(spark: SparkSession, d: str) -> DataFrame:
    """Seconds from each event of a user to the next, summed per type."""
    e = S.durations(table(spark, d, "events"), "user_id", ["ts", "event_id"], "ts")
    return e.groupBy("event_type").agg(F.count("seconds").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


def phase_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of each type of event in the sum of values per user."""
    per = table(spark, d, "events").where("value > 0").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    return per.select("user_id", "event_type", F.round(F.col("v") / F.sum("v").over(W.partitionBy("user_id")), 6).alias("share"))


def repo_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per language: repositories, files, mean size weighted by files."""
    f = table(spark, d, "documents").where("kind = 'CODE'")
    per = f.groupBy("lang", "source").agg(n_rows().alias("n"), F.avg("n_chars").alias("mean_chars"))
    return per.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.sum("n").alias("n_files"), F.round(F.sum(F.col("mean_chars") * F.col("n")) / F.sum("n"), 4).alias("mean_chars"))


def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, lines, characters, and tokens taken as a quarter of the characters."""
    f = table(spark, d, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    return f.agg(n_rows().alias("files"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.length("text")).alias("chars"), F.sum(F.floor(F.length("text") / 4 + 0.5)).alias("tokens"))


def task_reduction(spark: SparkSession, d: str, results: int = 10) -> DataFrame:
    """Tokens of a task that reads a source whole against one that reads ``results`` average chunks."""
    total = table(spark, d, "documents").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    piece = C.chunks(spark, d).agg(F.avg(F.length("body")).alias("piece"))
    return total.crossJoin(F.broadcast(piece)).select(
        F.floor(F.col("chars") / 4 + 0.5).cast("long").alias("baseline_tokens"), F.floor(F.col("piece") * results / 4 + 0.5).cast("long").alias("task_tokens"),
        F.round(1 - (F.col("piece") * results) / F.col("chars"), 6).alias("reduction"))


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.count_distinct("chunk_key").alias("n")).where("n > 1")


def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts before embedding: one representative per text with the number of its rows."""
    c = C.chunks(spark, d).where("body <> ''")
    return c.groupBy(F.sha2("body", 256).alias("text_hash")).agg(F.min("id").alias("id"), n_rows().alias("n"))


def membership_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many items each expected hit's repository occurs."""
    e = table(spark, d, "eval_items")
    hits = e.select("item_id", F.explode("expected_hits").alias("hit")).withColumn("repo", F.regexp_extract("hit", r"^file:([^/]+)/", 1))
    return hits.groupBy("repo").agg(F.count_distinct("item_id").alias("n_items"), n_rows().alias("n_hits"))


def size_slices(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents")
    size = F.when(F.col("size_bytes").isNull(), "unknown").when(F.col("size_bytes") < 1024, "small").when(F.col("size_bytes") < 4096, "medium").otherwise("large")
    return f.groupBy(size.alias("slice")).agg(n_rows().alias("n"), F.round(F.avg("size_bytes"), 4).alias("mean_bytes"))


def reference_time(spark: SparkSession, d: str) -> DataFrame:
    """Latest readable time of all nodes."""
    times = None
    for name in ("documents", "chunks", "modules", "rules"):
        t = table(spark, d, name).select(T.iso_time(F.col("updated_at")).alias("t"))
        times = t if times is None else times.unionByName(t)
    return times.agg(F.date_format(F.max("t"), "yyyy-MM-dd HH:mm:ss").alias("reference_time"))


def latest_reports(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "parser_errors").where("file_id is not null").dropDuplicates(["error_id"])
    return S.latest(e, "file_id", F.col("reported_at"), "error_id").select("file_id", "error_id", "parser")


def freshness(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents")
    row = f.agg(n_rows().alias("indexed"), F.count_if(F.expr("status = 'deleted'")).alias("pending"))
    top = F.greatest("indexed", "pending", F.lit(1))
    return row.select("indexed", "pending", F.round(F.greatest(F.lit(0), top - F.col("pending")) / top, 6).alias("freshness"))


def quality_gates(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents")
    m = f.agg((F.count_if(F.expr("status = 'deleted'")) / n_rows()).alias("deleted_share"), (F.count_if(F.expr("coalesce(text, '') = ''")) / n_rows()).alias("empty_share"), F.max("n_chars").cast("double").alias("max_chars"))
    metrics = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("actual")) for c in m.columns])).alias("x")).select("x.*")
    return S.gates(metrics, [("deleted_share", 0.05), ("empty_share", 0.001), ("max_chars", 100_000.0), ("missing", 1.0)])


def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality_gates(spark, d).agg(F.count_if("passed").alias("passed"), F.count_if(F.expr("not passed")).alias("failed"))


def line_windows(spark: SparkSession, d: str, size: int = 80, overlap: int = 16, least: int = 120, most: int = 8) -> DataFrame:
    """Overlapping windows of long chunks: the last allowed window takes the rest."""
    c = C.chunks(spark, d).select("id", "start_line", F.split("body", r"\r?\n").alias("lines")).withColumn("n", F.size("lines")).where((F.col("n") >= least) & (F.col("n") > size))
    step = size - overlap
    count = F.least(F.lit(most), F.ceil((F.col("n") - size) / step) + 1).cast("int")
    w = c.withColumn("count", count).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("count"))))
    start = (F.col("i") - 1) * step
    end = F.when(F.col("i") == F.col("count"), F.col("n")).otherwise(F.least(F.col("n"), start + size))
    body = F.array_join(F.slice("lines", start + 1, end - start), "\n")
    return w.select(
        F.concat("id", F.lit(":window:"), F.col("i").cast("string"), F.lit(":"), (F.col("start_line") + start).cast("string"), F.lit("-"), (F.col("start_line") + end - 1).cast("string")).alias("id"),
        F.md5(F.when(F.col("i") == most, body).otherwise(F.substring(body, 1, 12000))).alias("body_hash"))


def _evidence(spark: SparkSession, d: str, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """Heads of chunks and files, and which of the words they hold."""
    index = C.search_index(spark, d)
    heads = index.heads.where("entity_type in ('Chunk', 'File')")
    return heads, index.matches(words).join(heads.select("id"), "id", "left_semi")


def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    words = ["tracker", "snapshot", "missingword"]
    heads, found = _evidence(spark, d, words)
    return S.idf(found, heads, words).select("token", "n", F.round("idf", 6).alias("idf"))


def lexical_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of query words: sum of their weights, 1.5 for each in the path, 2 for each in the name; best 25."""
    words = ["tracker", "snapshot"]
    heads, found = _evidence(spark, d, words)
    weights = F.broadcast(S.idf(found, heads, words).groupBy().pivot("token", words).agg(F.first("idf")))
    some = heads.join(found, "id").crossJoin(weights)
    score = sum((F.when(F.array_contains("tokens", w), F.col(w)).otherwise(0.0) for w in words), F.lit(0.0))
    score = score + T.overlap(words, T.tokens_among(F.col("path"), words)) * 1.5 + T.overlap(words, T.tokens_among(F.col("label"), words)) * 2
    return some.select("id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(25)


def best_per_path(spark: SparkSession, d: str) -> DataFrame:
    """Largest chunk of each file, smallest id on ties."""
    c = C.chunks(spark, d)
    w = W.partitionBy("file_id").orderBy(F.desc(F.length("body")), "id")
    return c.withColumn("r", F.row_number().over(w)).where("r = 1").select("file_id", "id")


def capped_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The two earliest relations of each kind and source node: that cap is the evidence rule itself."""
    w = W.partitionBy("from_id", "relation").orderBy("ord")
    return C.stored_relations(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 2").select("from_id", "relation", "to_id", "ord", "r")


def listing_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d).groupBy("kind").agg(n_rows().alias("n")).orderBy(F.desc("n"), "kind")


def versions_descending(spark: SparkSession, d: str) -> DataFrame:
    """The twenty highest versions named in texts: by their numbers, releases above their pre-releases."""
    p = r"@(\d+\.\d+\.\d+(?:-[0-9A-Za-z.]+)?)"
    t = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("version")).distinct()
    t = t.unionByName(spark.createDataFrame([("99.0.0",), ("99.0.0-rc.1",), ("99.0.0-beta",)], "version string"))
    nums = F.transform(F.split(F.split("version", "-")[0], r"\."), lambda x: x.cast("int"))
    pre = F.get(F.split("version", "-", 2), F.lit(1))
    best = t.select("version", nums.alias("nums"), pre.alias("pre")).orderBy(F.desc("nums"), F.desc(F.col("pre").isNull()), F.desc("pre"), "version").limit(20)
    return best.select("version", F.row_number().over(W.orderBy(F.desc("nums"), F.desc(F.col("pre").isNull()), F.desc("pre"), "version")).alias("place"))


QUERIES = {f.__name__: f for f in (
    chunk_stats, chunk_char_distribution, chunk_line_distribution, char_histogram, degree_histogram, merged_histogram, graph_stats, vector_stats, embedding_stats,
    coverage_by_extension, top_extensions, phase_durations, phase_shares, repo_rollup, corpus_totals, task_reduction, duplicate_ids, duplicate_texts,
    membership_counts, size_slices, reference_time, latest_reports, freshness, quality_gates, review_summary,
    line_windows, idf_weights, lexical_evidence, best_per_path, capped_per_group, listing_by_kind, versions_descending,
)}


def _dist_sql(src: str, by: str = "") -> str:
    ps = ", ".join(f"round(quantile_cont(v, {q / 100}), 6) p{q}" for q in (25, 50, 75, 90, 99))
    return f"select {by + ',' if by else ''} count(v) n, min(v) \"min\", max(v) \"max\", round(avg(v), 2) mean, {ps} from ({src}) {'group by ' + by if by else ''}"


def _hist_sql(src: str, edges: tuple[int, ...]) -> str:
    rows = " union all ".join(f"select {i} bucket, '{f'{a}-{edges[i + 1] - 1}' if i + 1 < len(edges) else f'{a}+'}' \"label\", {a} lo, {edges[i + 1] if i + 1 < len(edges) else 'null'} hi" for i, a in enumerate(edges))
    return f"e as ({rows}), s as ({src}) select bucket, \"label\", (select count(*) from s where (v >= lo or bucket = 0) and (hi is null or v < hi)) n from e"


_GATES = """m as (select count(*) filter (status = 'deleted') / count(*)::double deleted_share, count(*) filter (coalesce(text, '') = '') / count(*)::double empty_share, max(n_chars)::double max_chars from documents),
    g as (select 'deleted_share' metric, round(deleted_share, 6) actual, 0.05::double threshold from m union all select 'empty_share', round(empty_share, 6), 0.001 from m
          union all select 'max_chars', max_chars, 100000 from m union all select 'missing', null, 1)"""
_VEC = """select count(*) n, count(*) filter ({v} is null) n_null, mode(len({v})) dims, count(*) filter (len({v}) <> {d}) n_misfit,
    count(*) filter (list_bool_or(list_transform({v}, lambda x: x is null or isnan(x) or isinf(x)))) n_nonfinite, count(*) filter (nm = 0) n_zero, round(min(nm), 6) norm_min, round(max(nm), 6) norm_max,
    round(avg(nm), 6) norm_mean, round(quantile_cont(nm, 0.5), 6) norm_p50
    from (select {v}, case when not list_bool_or(list_transform({v}, lambda x: x is null or isnan(x) or isinf(x))) then sqrt(list_dot_product({v}::double[], {v}::double[])) end nm from {t})"""

SQL = {
    "chunk_stats": f"with {X.CHUNKS} select kind, \"language\", count(*) n, count(*) filter (exported) n_exported, count(*) filter (contains(id, ':window:')) n_windowed, sum(length(body)) chars from pieces group by 1, 2",
    "chunk_char_distribution": f"with {X.CHUNKS} {_dist_sql('select kind, length(body)::double v from pieces', 'kind')}",
    "chunk_line_distribution": f"with {X.CHUNKS} {_dist_sql('select (end_line - start_line + 1)::double v from pieces where start_line > 0 and end_line >= start_line')}",
    "char_histogram": f"with {X.CHUNKS}, {_hist_sql('select length(body) v from pieces', S.CHAR_BUCKETS)}",
    "merged_histogram": f"with {X.CHUNKS}, {_hist_sql('select length(body) v from pieces', S.CHAR_BUCKETS)}",
    "degree_histogram": f"with {X.RELATIONS}, {_hist_sql('select count(*) v from (select from_id id from stored union all select to_id from stored) group by id', S.DEGREE_BUCKETS)}",
    "graph_stats": f"""with {X.CHUNKS}, {X.RELATIONS}, c as (select * from stored where relation = 'CALLS' and from_id in (select id from pieces) and to_id in (select id from pieces)),
        d as (select id, count(*) n from (select from_id id from c union all select to_id from c) group by id), a as (select coalesce(n, 0) n from pieces left join d using (id))
        select count(*) n_chunks, round(avg(n), 4) avg_degree, max(n) max_degree, count(*) filter (n = 0) isolated, round(count(*) filter (n = 0) / count(*)::double * 100, 2) isolated_pct from a""",
    "vector_stats": _VEC.format(v="vector", t="vectors", d=128), "embedding_stats": _VEC.format(v="embedding", t="embeddings", d=64),
    "coverage_by_extension": f"""with {X.FILES}, {X.CHUNKS} select lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) ext, count(*) n_files, count(*) filter (id in (select file_id from pieces)) n_chunked,
        count(*) filter (length(content) = 0) n_empty, round(count(*) filter (id in (select file_id from pieces)) / count(*)::double * 100, 2) pct from files group by 1""",
    "top_extensions": f"with {X.FILES} select lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) ext, count(*) n from files group by 1 order by 2 desc, 1 limit 10",
    "phase_durations": """with e as (select event_type, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) / 1e6::double s from events)
        select event_type, count(s) n, round(sum(s), 3) "seconds" from e group by 1""",
    "phase_shares": "with p as (select user_id, event_type, sum(value) v from events where value > 0 group by 1, 2) select user_id, event_type, round(v / sum(v) over (partition by user_id), 6) \"share\" from p",
    "repo_rollup": """with p as (select lang, source, count(*) n, avg(n_chars) m from documents where kind = 'CODE' group by 1, 2)
        select lang, count(distinct source) n_sources, sum(n) n_files, round(sum(m * n) / sum(n), 4) mean_chars from p group by 1""",
    "corpus_totals": "select count(*) files, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) \"lines\", sum(length(coalesce(text, ''))) chars, sum(floor(length(coalesce(text, '')) / 4 + 0.5)::bigint) tokens from documents",
    "task_reduction": f"""with {X.CHUNKS}, t as (select sum(length(coalesce(text, ''))) chars from documents), p as (select avg(length(body)) piece from pieces)
        select floor(chars / 4 + 0.5)::bigint baseline_tokens, floor(piece * 10 / 4 + 0.5)::bigint task_tokens, round(1 - piece * 10 / chars, 6) reduction from t, p""",
    "duplicate_ids": "select id, count(distinct chunk_key) n from chunks where id is not null group by 1 having count(distinct chunk_key) > 1",
    "duplicate_texts": f"with {X.CHUNKS} select sha256(body) text_hash, min(id) id, count(*) n from pieces where body <> '' group by 1",
    "membership_counts": "with h as (select item_id, unnest(expected_hits) hit from eval_items) select regexp_extract(hit, '^file:([^/]+)/', 1) repo, count(distinct item_id) n_items, count(*) n_hits from h group by 1",
    "size_slices": "select case when size_bytes is null then 'unknown' when size_bytes < 1024 then 'small' when size_bytes < 4096 then 'medium' else 'large' end slice, count(*) n, round(avg(size_bytes), 4) mean_bytes from documents group by 1",
    "reference_time": """select strftime(max(try_cast(nullif(trim(updated_at), '') as timestamp)), '%Y-%m-%d %H:%M:%S') reference_time from
        (select updated_at from documents union all select updated_at from chunks union all select updated_at from modules union all select updated_at from rules)""",
    "latest_reports": """with e as (select distinct on (error_id) * from parser_errors where file_id is not null)
        select file_id, arg_max(error_id, (reported_at is not null, reported_at, -error_id)) error_id, arg_max(parser, (reported_at is not null, reported_at, -error_id)) parser from e group by 1""",
    "freshness": "select count(*) indexed, count(*) filter (status = 'deleted') pending, round((greatest(count(*), 1) - count(*) filter (status = 'deleted')) / greatest(count(*), 1)::double, 6) freshness from documents",
    "quality_gates": f"with {_GATES} select *, coalesce(actual <= threshold, false) passed from g",
    "review_summary": f"with {_GATES} select count(*) filter (coalesce(actual <= threshold, false)) passed, count(*) filter (not coalesce(actual <= threshold, false)) failed from g",
    "line_windows": f"""with {X.CHUNKS}, l as (select id, start_line, string_split_regex(body, '\\r?\\n') ls from pieces), c as (select *, len(ls) n, least(8, ceil((len(ls) - 80) / 64.0)::int + 1) k from l where len(ls) >= 120),
        w as (select *, unnest(generate_series(1, k)) i from c), b as (select *, (i - 1) * 64 s, case when i = k then n else least(n, (i - 1) * 64 + 80) end e from w)
        select id || ':window:' || i || ':' || (start_line + s) || '-' || (start_line + e - 1) id, md5(case when i = 8 then array_to_string(ls[s + 1:e], chr(10)) else substr(array_to_string(ls[s + 1:e], chr(10)), 1, 12000) end) body_hash from b""",
    "idf_weights": f"""with {X.ALL}, t as (select {X.sql_tokens('"text"')} toks from ents where entity_type in ('Chunk', 'File')), q as (select unnest(['tracker', 'snapshot', 'missingword']) token),
        n as (select token, (select count(*) from t where list_contains(toks, token)) n from q) select token, n, round(ln(((select count(*) from t) + 1) / (n + 1)::double) + 1, 6) idf from n""",
    "lexical_evidence": f"""with {X.ALL}, t as (select id, path, "label", {X.sql_tokens('"text"')} toks from ents where entity_type in ('Chunk', 'File')),
        w as (select {", ".join(f"ln(((select count(*) from t) + 1) / ((select count(*) from t where list_contains(toks, '{w}')) + 1)::double) + 1 {w}" for w in ("tracker", "snapshot"))}),
        s as (select id, case when list_contains(toks, 'tracker') then tracker else 0 end + case when list_contains(toks, 'snapshot') then snapshot else 0 end
              + len(list_intersect({X.sql_tokens('path')}, ['tracker', 'snapshot'])) * 1.5::double + len(list_intersect({X.sql_tokens('"label"')}, ['tracker', 'snapshot'])) * 2::double x
              from t, w where list_has_any(toks, ['tracker', 'snapshot']))
        select id, round(x, 6) score from s where x > 0 order by 2 desc, 1 limit 25""",
    "best_per_path": f"with {X.CHUNKS} select file_id, arg_min(id, (-length(body), id)) id from pieces group by 1",
    "capped_per_group": f"with {X.RELATIONS}, r as (select *, row_number() over (partition by from_id, relation order by ord) r from stored) select from_id, relation, to_id, ord, r from r where r <= 2",
    "listing_by_kind": f"with {X.CHUNKS} select kind, count(*) n from pieces group by 1",
    "versions_descending": """with v as (select distinct unnest(regexp_extract_all(text, '@(\\d+\\.\\d+\\.\\d+(?:-[0-9A-Za-z.]+)?)', 1)) "version" from documents union all select unnest(['99.0.0', '99.0.0-rc.1', '99.0.0-beta'])),
        p as (select *, list_transform(string_split(string_split("version", '-')[1], '.'), lambda x: x::int) n, case when instr("version", '-') > 0 then regexp_replace("version", '^[^-]*-', '') end pre from v)
        select "version", row_number() over (order by n desc, pre is null desc, pre desc, "version") place from p qualify place <= 20""",
}
