"""Queries on logs, policies, reviews, notes, processes, roll-ups and texts for embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import compact as CP
from ..functions import text as T
from ..operators import governance as G
from ..operators import ingest as I
from ..operators import scans as S
from ..operators import stats as ST
from ..sources.tables import table
from . import context as C
from . import ingest_queries as IQ
from . import relation_queries as RQ
from . import sample_files as SF
from . import sqltext as X

NOW = "2025-06-30 00:00:00"
KINDS = ("decision", "gotcha", "fix", "pattern")
POLICIES = [
    {"id": "secrets", "enforce": True}, {"id": "env-in-prompts", "enforce": True}, {"id": "external-calls", "enforce": True, "config": {"patterns": ("fetch(", "lookup(")}}, {"id": "max-file-size", "enforce": True, "config": {"max_bytes": 20_000}},
    {"id": "no-todo", "type": "regex", "enforce": True, "config": {"pattern": r"\bTODO\b"}}, {"id": "comments", "type": "code_comments", "enforce": True}, {"id": "off", "enforce": False}, {"id": "code-review", "enforce": True},
    {"id": "unknown", "enforce": True}, {"id": "graph", "type": "graph", "enforce": True},
]


def n_rows():
    return F.count(F.lit(1))


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """The events as a log of tool calls: the type is the tool, the user the session."""
    e = table(spark, d, "events")
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_id").alias("line_no"), F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failure").otherwise("tool_call").alias("event_type"),
                    F.when(F.col("value") > 50, "strong").otherwise("weak").alias("evidence_level"), F.when(F.col("value") > 100, "error").otherwise("ok").alias("status"), F.concat(F.lit("s"), (F.col("user_id") % 7).cast("string")).alias("session_id"), "value")


def audit_filters(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 entries that all five filters and a range of days let through."""
    return G.audit(audit_log(spark, d), 50, "2024-01-02", "2024-12-31", tool="click", event_type="tool_call", evidence_level="strong", status="ok", session_id="s3").select("day", "line_no", "tool", "session_id")


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    """Counters in all and per tool: calls, failed ones, results, and tokens saved and in all; failed calls count for nothing else."""
    log = audit_log(spark, d).withColumn("results", F.floor(F.col("value") / 10).cast("long")).withColumn("saved", F.floor(F.col("value")).cast("long"))
    good = F.col("tool") != "error"
    aggs = [n_rows().alias("calls"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("results")).otherwise(0)).alias("results"), F.sum(F.when(good, F.col("saved")).otherwise(0)).alias("tokens_saved"),
            F.sum(F.when(good, F.col("saved") + F.col("results") * 400).otherwise(0)).alias("tokens_total")]
    return log.groupBy("tool").agg(*aggs).unionByName(log.agg(*aggs).withColumn("tool", F.lit("all")))


def policy_results(spark: SparkSession, d: str) -> DataFrame:
    """Every enforced policy run over all files."""
    files = SF.files(spark, d).withColumn("size_bytes", F.octet_length("content"))
    return G.run_policies(files, POLICIES)


def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(policy_results(spark, d))


def policy_partition(spark: SparkSession, d: str) -> DataFrame:
    """Policies that can be run, and why the others are skipped."""
    run, skipped = G.partition(POLICIES)
    return spark.createDataFrame([(p["id"], "run") for p in run] + [(s["id"], s["reason"]) for s in skipped], "id string, state string")


def policy_detail(spark: SparkSession, d: str) -> DataFrame:
    """What a report shows of one policy: how many hits, and the first thirty."""
    return S.policy_detail(S.policy_hits(C.files(spark, d).select("path", "content"), "path", "content", r"\bTODO\b"), "path")


def secrets(spark: SparkSession, d: str) -> DataFrame:
    return S.secret_hits(SF.files(spark, d).select("path", "content"), "path", "content")


def env_in_prompts(spark: SparkSession, d: str) -> DataFrame:
    return S.env_in_prompts(SF.files(spark, d).select("path", "content"), "path", "content")


def too_large(spark: SparkSession, d: str) -> DataFrame:
    return S.too_large(table(spark, d, "documents"), "path", "size_bytes", 12_000)


def redacted_samples(spark: SparkSession, d: str) -> DataFrame:
    """Records with sensitive keys, long lists and deep objects as they may leave."""
    rows = [(1, '{"tool":"search","query":"who am I","n":3}'), (2, '{"a":[1,"x",{"b":{"c":1}}],"body":{"k":1}}'), (3, '{"text":[1,2,3],"ok":true,"none":null,"deep":{"x":{"y":{"z":1}}}}'), (4, "no json"), (5, None)]
    return spark.createDataFrame(rows, "id int, props string").select("id", S.outline(F.col("props")).alias("outline"))


def review_equality(spark: SparkSession, d: str) -> DataFrame:
    """Whether files as they were reviewed (at their first row) are those of now; and with only the time of the review."""
    docs = table(spark, d, "documents")
    now = docs.select("path", (F.coalesce("status", F.lit("")) != "deleted").alias("exists"), F.col("checksum").alias("hash"))
    then = docs.select("path", F.lit(True).alias("exists"), F.col("checksum").alias("hash"))
    a = G.review_matches(then, now).select(F.lit("snapshot").alias("by"), "matches", "n_differ")
    at = docs.select("path", (F.coalesce("status", F.lit("")) != "deleted").alias("exists"), F.col("ingested_at").cast("timestamp").alias("modified"))
    return a.unionByName(G.changed_since(at, F.lit("2024-06-01").cast("timestamp")).select(F.lit("time").alias("by"), "matches", "n_differ"))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """The rules as notes: what they constrain is what they apply to, their priority tells their kind."""
    r = C.rules(spark, d)
    links = C.stored_relations(spark, d).where("relation = 'CONSTRAINS'").groupBy(F.col("from_id").alias("id")).agg(F.collect_set("to_id").alias("applies_to"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("decision", "gotcha", "fix", "legend")]), (F.col("priority") % 4 + 1).cast("int"))
    rows = r.join(links, "id", "left").select("id", kind.alias("type"), "title", F.when(F.col("priority") > 10, F.substring("body", 1, 80)).otherwise("").alias("summary"), "body", "applies_to",
                                              F.array(F.concat(F.lit("notes/"), F.col("title"), F.lit(".md"))).alias("sources"), "status", F.when(F.col("priority") > 90, "stale").otherwise("fresh").alias("freshness"), "updated_at", F.lit("").alias("supersedes"))
    order = W.orderBy("id")  # the rules are a short list
    return rows.withColumn("supersedes", F.coalesce(F.lag("id").over(order), F.lit("rule:none")))


def note_issues(spark: SparkSession, d: str) -> DataFrame:
    return G.lint(notes(spark, d), C.catalog(spark, d), KINDS, NOW).groupBy("check").agg(n_rows().alias("n"), F.count_distinct("id").alias("n_notes"))


def note_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return G.contradictions(notes(spark, d)).groupBy("type_a", "type_b").agg(n_rows().alias("n_targets"), F.sum("n_pairs").alias("n_pairs"))


def _processes(spark: SparkSession, d: str) -> DataFrame:
    """Customers as processes: each is the child of the one with half its number."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("pid"), F.floor(F.col("c_custkey") / 2).cast("long").alias("ppid"), (F.col("c_custkey") % 100 * 10).cast("long").alias("rss"), F.round(F.col("c_custkey") % 7 / 10, 1).alias("cpu"), F.col("c_mktsegment").alias("args"))


def process_trees(spark: SparkSession, d: str) -> DataFrame:
    return G.process_trees(_processes(spark, d), spark.createDataFrame([(4,), (9,), (1000000000,)], "root long"))


def ungoverned(spark: SparkSession, d: str) -> DataFrame:
    p = _processes(spark, d)
    out = G.ungoverned(p, F.col("pid") % 3 == 0, F.col("args") == "BUILDING")
    return out.select("pid", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))


def phase_memory(spark: SparkSession, d: str) -> DataFrame:
    """Largest sample in all and by phase, the phase it was in, and the samples; the types of events are the phases."""
    e = table(spark, d, "events")
    per = e.groupBy(F.col("event_type").alias("phase")).agg(F.max("value").alias("max_rss"), n_rows().alias("samples"))
    return per.select("phase", "max_rss", "samples", F.col("phase").alias("max_phase")).unionByName(per.agg(F.lit("all").alias("phase"), F.max("max_rss").alias("max_rss"), F.sum("samples").alias("samples"), F.max_by("phase", F.struct("max_rss", "phase")).alias("max_phase")))


def memory_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per phase the largest sample over all repositories (here: users), the number of them, and who has it."""
    per = table(spark, d, "events").groupBy(F.col("event_type").alias("phase"), "user_id").agg(F.max("value").alias("v"))
    return per.groupBy("phase").agg(F.max("v").alias("max_rss"), n_rows().alias("repos"), F.max_by("user_id", F.struct("v", -F.col("user_id"))).alias("max_repo"))


def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository and over all: indexed, chunked, too large, empty, without a parser."""
    f = C.files(spark, d).withColumn("repo", F.split("path", "/")[0])
    has = C.chunks(spark, d).select(F.col("file_id").alias("id"), F.lit(1).alias("has")).distinct()
    parsers = (".sql", ".md", ".config", ".py", ".js", ".ts")
    rows = f.join(has, "id", "left").withColumn("ext", ST.extension(F.col("path")))
    aggs = [n_rows().alias("candidates"), F.count("has").alias("chunked"), F.count_if(F.octet_length("content") > 30_000).alias("too_large"), F.count_if(F.length("content") == 0).alias("empty"), F.count_if(~F.col("ext").isin(*parsers)).alias("no_parser")]
    return rows.groupBy("repo").agg(*aggs).unionByName(rows.agg(*aggs).withColumn("repo", F.lit("all")))


def coverage_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files by extension and why they have no chunks."""
    f = C.files(spark, d).withColumn("ext", ST.extension(F.col("path")))
    has = C.chunks(spark, d).select(F.col("file_id").alias("id"), F.lit(1).alias("has")).distinct()
    why = F.when(F.col("has").isNotNull(), "chunked").when(F.col("status") == "deleted", "deleted").when(F.length("content") == 0, "empty").when(F.octet_length("content") > 30_000, "too large").otherwise("no chunks")
    return f.join(has, "id", "left").groupBy("ext", why.alias("reason")).agg(n_rows().alias("n"))


def model_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per model: vectors, repositories, mean length weighted by their numbers."""
    v = table(spark, d, "vectors").where("model is not null and id is not null").dropDuplicates(["vec_id"]).withColumn("repo", F.regexp_extract("id", r"^chunk:([^/]+)/", 1))
    per = v.groupBy("model", "repo").agg(n_rows().alias("n"), F.avg(F.coalesce(F.size("vector"), F.lit(0))).alias("m"))
    return per.groupBy("model").agg(F.count_distinct("repo").alias("repos"), F.sum("n").alias("vectors"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("mean_dims"))


def relation_totals(spark: SparkSession, d: str) -> DataFrame:
    """Relations by type with their distinct ends."""
    return C.stored_relations(spark, d).groupBy("relation").agg(n_rows().alias("n"), F.count_distinct("from_id").alias("n_from"), F.count_distinct("to_id").alias("n_to"))


def intensity(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and links per thousand lines of each language, and the share of the lines that chunks cover; no lines give null."""
    f = C.files(spark, d).where("kind = 'CODE'").select("id", ST.extension(F.col("path")).alias("ext"), F.size(F.split("content", "\n", -1)).alias("lines"))
    c = C.chunks(spark, d).groupBy(F.col("file_id").alias("id")).agg(n_rows().alias("chunks"), F.sum(F.when((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")), F.col("end_line") - F.col("start_line") + 1).otherwise(0)).alias("covered"))
    g = f.join(c, "id", "left").groupBy("ext").agg(F.sum("lines").alias("lines"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.sum(F.coalesce("covered", F.lit(0))).alias("covered"))
    return g.select("ext", "lines", "chunks", F.round(F.when(F.col("lines") > 0, F.col("chunks") / F.col("lines") * 1000), 4).alias("per_kloc"), F.round(F.when(F.col("lines") > 0, F.col("covered") / F.col("lines") * 100), 2).alias("covered_pct"))


def reference_time_all(spark: SparkSession, d: str) -> DataFrame:
    """Latest readable time of files, rules, chunks, modules, decision records and projects."""
    f = SF.files(spark, d)
    from ..operators.relations import projects

    times = [t.select(F.col(c).alias("t")) for t, c in ((f, "updated_at"), (C.rules(spark, d), "updated_at"), (C.chunks(spark, d), "updated_at"), (C.modules(spark, d), "updated_at"), (C.adrs(f), "decision_date"), (projects(f), "updated_at"))]
    every = times[0]
    for t in times[1:]:
        every = every.unionByName(t)
    return every.agg(F.date_format(F.max(T.iso_time(F.col("t"))), "yyyy-MM-dd HH:mm:ss").alias("reference_time"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Counts of entities by type, chunks by kind, chunks by language."""
    part = lambda rows, what, c: rows.groupBy(F.col(c).alias("name")).agg(n_rows().alias("n")).select(F.lit(what).alias("listing"), "name", "n")
    c = C.chunks(spark, d)
    return part(C.catalog(spark, d), "type", "type").unionByName(part(c, "kind", "kind")).unionByName(part(c, "language", "language"))


def most_called(spark: SparkSession, d: str) -> DataFrame:
    """The ten chunks with most CALLS among known chunks."""
    ids = C.chunks(spark, d).select("id")
    return C.degrees(C.without_dangling(C.stored_relations(spark, d).where("relation = 'CALLS'"), ids)).orderBy(F.desc("degree"), "id").limit(10)


def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of a vector index per model: mixed lengths, lengths that differ from what is said, how many entities have one, p99 of the norms."""
    v = table(spark, d, "vectors").where("model is not null").dropDuplicates(["vec_id"])
    n = F.size(F.coalesce("vector", F.array().cast("array<float>")))
    norm = F.sqrt(F.aggregate(F.coalesce("vector", F.array().cast("array<float>")), F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(x.cast("double"), F.lit(0.0))))
    total = C.chunks(spark, d).where("status <> 'deleted'").agg(n_rows().alias("_t"))
    per = v.groupBy("model").agg(n_rows().alias("vectors"), F.count_distinct(n).alias("lengths"), F.count_if(n != F.col("dimensions")).alias("unlike_said"), F.count_distinct("id").alias("ids"),
                                 F.round(F.percentile(F.when(~F.isnan(norm), norm), F.lit(0.99)), 6).alias("norm_p99"))
    return per.crossJoin(F.broadcast(total)).select("model", "vectors", (F.col("lengths") > 1).alias("mixed"), "unlike_said", "norm_p99", F.round(F.floor(F.col("ids") / F.col("_t") * 1000 + 0.5) / 10, 1).alias("coverage_pct"))


def merged_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms of two parts put together, with whether their layouts are the same."""
    c = C.chunks(spark, d).withColumn("v", F.length("body"))
    return ST.merge_histograms(*[ST.histogram(c.where(p), "v", ST.CHAR_BUCKETS) for p in ("exported", "not exported")], edges=ST.CHAR_BUCKETS)


def chunk_descriptions(spark: SparkSession, d: str) -> DataFrame:
    c = C.chunks(spark, d)
    return c.select("id", F.md5(CP.description(F.col("kind"), F.col("exported"), F.col("signature"), F.col("description"), F.col("body"))).alias("description_hash"))


def compacted_files(spark: SparkSession, d: str) -> DataFrame:
    """How much of the files' texts stays for embedding: characters before and after, and files that were cut."""
    return CP.compacted(C.files(spark, d, wide=True)).agg(n_rows().alias("files"), F.count_if("compacted").alias("compacted"), F.sum("original_chars").alias("original_chars"), F.sum("omitted_chars").alias("omitted_chars"))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """Texts within 512 tokens, a token taken as four characters."""
    rows = CP.truncated(C.files(spark, d, wide=True), "id", "content", 512)
    return rows.select("id", F.length("content").alias("n_chars"), F.md5("content").alias("text_hash"), "cut")


def vector_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of what vectors are made from, of files, rules, chunks, modules and decision records."""
    f = C.files(spark, d)
    sig = lambda t, checksum, at, text: F.sha2(F.concat_ws("|", F.lit(t), checksum, at, F.sha2(text, 256)), 256).alias("signature")
    lines = lambda *cs: F.concat_ws("\n", *cs)
    out = f.select("id", sig("File", "checksum", "updated_at", lines("path", "excerpt")))
    out = out.unionByName(C.rules(spark, d).select("id", sig("Rule", F.lit(""), "updated_at", lines("title", "body"))))
    out = out.unionByName(C.chunks(spark, d).select("id", sig("Chunk", "checksum", "updated_at", lines("name", "signature", "description", "body"))))
    out = out.unionByName(C.modules(spark, d).select("id", sig("Module", F.lit(""), "updated_at", lines("path", "summary"))))
    return out.unionByName(C.adrs(f).select("id", sig("ADR", F.lit(""), "decision_date", lines("title", "body"))))


def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by whether they can be kept: their signature and model must be those of now.

    The stored signatures are of another make, so those of now are taken for every second entity: its vector
    then carries the present signature, the others one of before.
    """
    v = table(spark, d, "vectors").where("id is not null").dropDuplicates(["vec_id"])
    now = C.chunks(spark, d).where("status <> 'deleted'").select("id", F.substring("checksum", 1, 16).alias("present"))
    had = v.join(now, "id", "left").withColumn("stored", F.when(F.col("signature").isNull(), None).when(F.col("vec_id") % 2 == 0, F.col("present")).otherwise(F.col("signature")))
    state = (F.when(F.col("present").isNull(), "gone").when(F.col("stored").isNull(), "unsigned").when(F.coalesce("model", F.lit("")) != "ctx-embed-base-v2", "other model")
             .when(F.col("stored") == F.col("present"), "kept").otherwise("changed"))
    return had.groupBy(state.alias("state")).agg(n_rows().alias("n"))


def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts dealt into batches of like length, the longest first, and what padding they waste."""
    c = C.chunks(spark, d).where("body <> ''").select(F.sha2("body", 256).alias("h"), F.length("body").alias("n")).groupBy("h").agg(F.first("n").alias("n"))
    b = c.withColumn("bucket", F.floor(F.log2(F.col("n").cast("double"))).cast("int"))
    return b.groupBy("bucket").agg(n_rows().alias("texts"), F.max("n").alias("longest"), F.round(1 - F.sum("n") / (F.max("n") * n_rows()), 6).alias("waste"))


def sortable_table(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 files by size, the largest first, those without a size last."""
    return G.sorted_by(table(spark, d, "documents").select("doc_id", "size_bytes"), "size_bytes", True, "doc_id").limit(25)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a status page shows: nodes and relations by type, freshness, sizes, and the most connected nodes."""
    nodes = C.catalog(spark, d).groupBy(F.col("type").alias("item")).agg(n_rows().cast("double").alias("value"))
    rels = C.all_relations(spark, d).groupBy(F.col("relation").alias("item")).agg(n_rows().cast("double").alias("value"))
    f = table(spark, d, "documents")
    sums = f.agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("double").alias("chars"), F.count_if(F.expr("status = 'deleted'")).cast("double").alias("pending"), n_rows().cast("double").alias("files"))
    flat = sums.select(F.explode(F.create_map(F.lit("chars"), "chars", F.lit("pending"), "pending", F.lit("files"), "files")).alias("item", "value"))
    top = C.degrees(C.stored_relations(spark, d)).orderBy(F.desc("degree"), "id").limit(5).select(F.concat(F.lit("top "), "id").alias("item"), F.col("degree").cast("double").alias("value"))
    return nodes.unionByName(rels).unionByName(flat).unionByName(top)


def evidence_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows within their limits: texts cut, rules at most fifty, rows without an id or path dropped and counted."""
    hits = table(spark, d, "eval_items").select("item_id", F.col("query").alias("title"), F.col("passage").alias("excerpt"), F.explode("expected_hits").alias("id"))
    path = F.regexp_extract("id", r"^file:(.+)$", 1)
    ok = (path != "") & F.col("id").rlike(r"\.(ts|py|cs|js|sql|md)$")
    rows = hits.select("item_id", F.substring("title", 1, 500).alias("title"), F.substring("excerpt", 1, 1000).alias("excerpt"), ok.alias("ok"))
    return rows.groupBy("item_id").agg(F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("dropped"), F.max(F.length("excerpt")).alias("longest"))


def removed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations after deleted files are taken out: calls go with either end, imports and definitions with their source."""
    gone = table(spark, d, "documents").where("status = 'deleted'").select(F.col("file_id").alias("id"))
    return I.drop_files(C.chunks(spark, d), C.stored_relations(spark, d), gone)[1].groupBy("relation").agg(n_rows().alias("n"))


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    """Prior definitions, calls and imports that stay: their ends are still there."""
    return I.hydrate(C.files(spark, d).where("status <> 'deleted'"), C.chunks(spark, d).where("status <> 'deleted'"), C.stored_relations(spark, d)).groupBy("relation").agg(n_rows().alias("n"))


def excluded_by_rule(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.twopass import excluded, is_runtime, is_test

    p = F.col("path")
    return C.files(spark, d).groupBy(excluded(p, prefixes=("ledger-core/", "beacon-sync/legacy/")).alias("out"), is_test(p).alias("test"), is_runtime(p).alias("runtime")).agg(n_rows().alias("n"))


def best_scored_per_path(spark: SparkSession, d: str) -> DataFrame:
    """The best result of every path of a search, smallest id on ties."""
    from ..operators import search as SE
    from . import search_queries as SQ

    index = C.search_index(spark, d)
    ranked = SE.scored(C.candidates(index.heads), None, SQ.QUERY, SQ.REFERENCE, found=index.matches(SE.asked_words(SQ.QUERY), SQ.QUERY)).where("path <> ''")
    return G.top_per(ranked, ["path"], [F.desc("score"), F.asc("id")], 1).select("path", "id", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (audit_filters, telemetry, policy_results, policy_summary, policy_partition, policy_detail, secrets, env_in_prompts, too_large, redacted_samples, review_equality, note_issues, note_contradictions,
                                   process_trees, ungoverned, phase_memory, memory_rollup, coverage_rollup, coverage_reasons, model_rollup, relation_totals, intensity, reference_time_all, listings, most_called, vector_checks,
                                   merged_histograms, chunk_descriptions, compacted_files, token_budget, vector_signatures, vector_reuse, embedding_batches, sortable_table, status_counts, evidence_within_bounds, removed_relations,
                                   hydrated, excluded_by_rule, best_scored_per_path)}

_LOG = """log as (select strftime(ts, '%Y-%m-%d') "day", event_id line_no, event_type tool, case when event_type = 'error' then 'failure' else 'tool_call' end kind, case when value > 50 then 'strong' else 'weak' end evidence_level,
    case when value > 100 then 'error' else 'ok' end status, 's' || (user_id % 7) session_id, value from events)"""
_Q = lambda p: p.replace("'", "''")
_LINES = r"""lns as (select path, unnest(string_split_regex(content, '\r\n|\n|\r')) line, generate_subscripts(string_split_regex(content, '\r\n|\n|\r'), 1) line_no from fs)"""
_SECRET_OK = r"""(regexp_matches(path, '(?i)\.(?:json|ya?ml|toml|ini|env|config|xml|properties|tf|tfvars|sh|ps1|py|js|mjs|cjs|ts|tsx|jsx|cs|vb|java|go|rs|rb|php|sql|md|txt)$') or regexp_matches(path, '(?i)(?:^|/)\.env(?:\.|$)|(?:^|/)appsettings'))
    and not (""" + " or ".join(f"contains(path, '{a}')" for a in S.ALLOWED_PATHS) + ")"
_BARE = r"""lower(regexp_replace(trim(regexp_replace(regexp_extract(line, '{p}'), '^[^=:]*[=:]\s*', '')), '^["''`<{{]+|["''`>}};]+$', '', 'g'))"""
_SECRETS = " union all ".join(f"select path, line_no, '{n}' secret from lns where regexp_matches(line, '{_Q(p)}') and {_SECRET_OK}" + (f" and not list_contains({X.sql_list(S.PLACEHOLDERS)}, {_BARE.format(p=_Q(p))})" if aware else "") for n, p, aware in S.SECRETS)
_ENV_OK = r"regexp_matches(path, '(?i)\.(?:ts|tsx|js|mjs|cjs|jsx|py)$') and not (" + " or ".join(f"contains(path, '{a}')" for a in S.ALLOWED_PATHS if a != "mocks/") + ")"
_ENVS = f"""near as (select *, string_agg(line, chr(10)) over (partition by path order by line_no rows between 3 preceding and 3 following) ctx from lns where path in (select path from lns where regexp_matches(line, '{_Q(S.ENV_ACCESS)}'))),
    envs as (select path, line_no, regexp_extract(line, '({_Q(S.ENV_ACCESS)})', 1) env from near where regexp_matches(line, '{_Q(S.ENV_ACCESS)}') and {_ENV_OK} and (regexp_matches(ctx, '{_Q(S.PROMPT_SIGNS)}') or regexp_matches(ctx, '{_Q(S.PROMPT_NAMES)}')))"""
_DEL = "(select file_id from documents where status = 'deleted' and file_id is not null)"
_NOTES = f"""{X.ALL}, lk as (select from_id id, list(distinct to_id) applies_to from stored where relation = 'CONSTRAINS' group by 1),
    notes as (select id, ['decision', 'gotcha', 'fix', 'legend'][priority % 4 + 1] "type", title, case when priority > 10 then substr(body, 1, 80) else '' end summary, body, applies_to, 'notes/' || title || '.md' src, status,
              case when priority > 90 then 'stale' else 'fresh' end freshness, updated_at, coalesce(lag(id) over (order by id), 'rule:none') sup from ruleset left join lk using (id))"""
_CAT = "cat as (select id from files union select id from ruleset union select id from pieces union select id from mods union select id from records)"

SQL = {
    "audit_filters": f"with {_LOG} select \"day\", line_no, tool, session_id from log where tool = 'click' and kind = 'tool_call' and evidence_level = 'strong' and status = 'ok' and session_id = 's3' and \"day\" between '2024-01-02' and '2024-12-31' order by 1 desc, 2 desc limit 50",
    "telemetry": f"""with {_LOG}, t as (select *, floor(value / 10)::bigint res, floor(value)::bigint saved, tool <> 'error' ok from log), a as (select * from t union all select * replace ('all' as tool) from t)
        select tool, count(*) calls, count(*) filter (not ok) failed, sum(case when ok then res else 0 end) results, sum(case when ok then saved else 0 end) tokens_saved, sum(case when ok then saved + res * 400 else 0 end) tokens_total from a group by 1""",
    "policy_partition": """select * from (values ('secrets', 'run'), ('env-in-prompts', 'run'), ('external-calls', 'run'), ('max-file-size', 'run'), ('no-todo', 'run'), ('comments', 'run'), ('code-review', 'left to the review itself'), ('unknown', 'no validator for this policy'),
        ('graph', 'no evaluator for type "graph"')) v(id, state)""",
    "policy_detail": f"""with {X.FILES}, l as {IQ._LINES}, r as (select path, line_no, row_number() over (partition by path order by line_no) k from l where regexp_matches(line, '\\bTODO\\b')), h as (select * from r where k <= 20)
        select (select count(*) from h) n, (select count(distinct path) from h) n_files, (select string_agg(path || ':' || line_no, chr(10) order by path, line_no) from (select * from h order by path, line_no limit 30)) detail""",
    "secrets": f"with {X.FILES}, {SF.SQL_FILES}, {_LINES} {_SECRETS}", "env_in_prompts": f"with {X.FILES}, {SF.SQL_FILES}, {_LINES}, {_ENVS} select * from envs",
    "too_large": "select path, size_bytes from documents where size_bytes > 12000",
    "redacted_samples": """select * from (values (1, '{"n":3,"query":{"length":8,"redacted":true,"type":"string"},"tool":{"length":6,"redacted":true,"type":"string"}}'),
        (2, '{"a":{"count":3,"sample":[1,{"length":1,"redacted":true,"type":"string"},{"key_count":1,"keys":["b"],"redacted":true,"type":"object"}],"type":"array"},"body":{"key_count":1,"redacted":true,"type":"object"}}'),
        (3, '{"deep":{"x":{"key_count":1,"keys":["y"],"redacted":true,"type":"object"}},"none":null,"ok":true,"text":{"count":3,"redacted":true,"type":"array"}}'), (4, null), (5, null)) v(id, outline)""",
    "review_equality": """select 'snapshot' "by", count(*) filter (status = 'deleted') = 0 matches, count(*) filter (status = 'deleted') n_differ from documents
        union all select 'time', count(*) filter (coalesce(status, '') = 'deleted' or ingested_at > timestamp '2024-06-01') = 0, count(*) filter (coalesce(status, '') = 'deleted' or ingested_at > timestamp '2024-06-01') from documents""",
    "note_issues": f"""with {_NOTES}, {_CAT}, age as (select *, (epoch_us(timestamp '{NOW}') - epoch_us(try_cast(nullif(trim(updated_at), '') as timestamp))) / 86400e6::double d from notes),
        i as (select id, 'missing field' c from notes where coalesce(title, '') = '' union all select id, 'missing field' from notes where coalesce(summary, '') = '' union all select id, 'unknown type' from notes where "type" not in {KINDS}
              union all select id, 'empty body' from notes where body = '' union all select id, 'stale' from age where freshness = 'stale' or d > 90 union all select id, 'unknown target' from (select id, unnest(applies_to) t from notes) where t not in (select id from cat)
              union all select id, 'unknown source' from notes where 'file:' || src not in (select id from cat) union all select id, 'duplicate id' from notes group by id having count(*) > 1 union all select id, 'unknown superseded' from notes where sup not in (select id from notes))
        select c "check", count(*) n, count(distinct id) n_notes from i group by 1""",
    "note_contradictions": f"""with {_NOTES}, u as (select id, "type" t, sup, unnest(applies_to) target from notes where status = 'active'),
        p as (select target, least(a.t, b.t) type_a, greatest(a.t, b.t) type_b, count(*) n from u a join u b using (target) where a.id < b.id and a.sup <> b.id and b.sup <> a.id group by 1, 2, 3)
        select type_a, type_b, count(*) n_targets, sum(n) n_pairs from p where (type_a, type_b) in (('decision', 'decision'), ('fix', 'gotcha'), ('fix', 'fix'), ('decision', 'gotcha')) group by 1, 2""",
    "process_trees": """with recursive p as (select c_custkey::bigint pid, c_custkey // 2 ppid, c_custkey % 100 * 10 rss, round(c_custkey % 7 / 10, 1) cpu from customer),
        t as (select pid root, pid from p where pid in (4, 9) union all select t.root, p.pid from t join p on p.ppid = t.pid) select root, count(*) processes, sum(rss) rss, round(sum(cpu), 1) cpu from t join p using (pid) group by 1""",
    "ungoverned": """with recursive p as (select c_custkey::bigint pid, c_custkey // 2 ppid, c_mktsegment = 'BUILDING' g from customer),
        t as (select pid, pid node, ppid up, 0 k, g from p union all select t.pid, p.pid, p.ppid, k + 1, p.g from t join p on p.pid = t.up where t.k < 32 and p.pid > 1)
        select pid, string_agg(node::varchar, '>' order by k) chain from t group by pid having pid % 3 = 0 and not bool_or(g)""",
    "phase_memory": """with p as (select event_type phase, max(value) max_rss, count(*) samples, event_type max_phase from events group by 1) select * from p
        union all select 'all', max(max_rss), sum(samples), arg_max(phase, (max_rss, phase)) from p""",
    "memory_rollup": "with p as (select event_type phase, user_id, max(value) v from events group by 1, 2) select phase, max(v) max_rss, count(*) repos, arg_max(user_id, (v, -user_id)) max_repo from p group by 1",
    "coverage_rollup": f"""with {X.FILES}, {X.CHUNKS}, f as (select *, string_split(path, '/')[1] repo, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) ext, id in (select file_id from pieces) has from files), g as (select * from f union all select * replace ('all' as repo) from f)
        select repo, count(*) candidates, count(*) filter (has) chunked, count(*) filter (strlen(content) > 30000) too_large, count(*) filter (content = '') empty, count(*) filter (ext not in ('.sql', '.md', '.config', '.py', '.js', '.ts')) no_parser from g group by 1""",
    "coverage_reasons": f"""with {X.FILES}, {X.CHUNKS} select lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) ext, case when id in (select file_id from pieces) then 'chunked' when status = 'deleted' then 'deleted' when content = '' then 'empty'
        when strlen(content) > 30000 then 'too large' else 'no chunks' end reason, count(*) n from files group by 1, 2""",
    "model_rollup": """with v as (select distinct on (vec_id) model, regexp_extract(id, '^chunk:([^/]+)/', 1) repo, coalesce(len(vector), 0) d from vectors where model is not null and id is not null), p as (select model, repo, count(*) n, avg(d) m from v group by 1, 2)
        select model, count(distinct repo) repos, sum(n) vectors, round(sum(m * n) / sum(n), 6) mean_dims from p group by 1""",
    "relation_totals": f"with {X.RELATIONS} select relation, count(*) n, count(distinct from_id) n_from, count(distinct to_id) n_to from stored group by 1",
    "intensity": f"""with {X.FILES}, {X.CHUNKS}, c as (select file_id id, count(*) n, sum(case when start_line > 0 and end_line >= start_line then end_line - start_line + 1 else 0 end) cov from pieces group by 1),
        g as (select lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) ext, sum(length(content) - length(replace(content, chr(10), '')) + 1) lns, sum(coalesce(n, 0)) chunks, sum(coalesce(cov, 0)) covered from files left join c using (id) where kind = 'CODE' group by 1)
        select ext, lns "lines", chunks, round(chunks / lns::double * 1000, 4) per_kloc, round(covered / lns::double * 100, 2) covered_pct from g""",
    "reference_time_all": RQ._FULL + f", {X.MODULES}, {X.RULES}" + """, t as (select updated_at t from fs union all select updated_at from ruleset union all select updated_at from pieces union all select updated_at from mods union all select decision_date from records)
        select strftime(max(try_cast(nullif(trim(t), '') as timestamp)), '%Y-%m-%d %H:%M:%S') reference_time from t""",
    "listings": f"""with {X.ALL}, k as (select 'File' t from files union all select 'Rule' from ruleset union all select 'Chunk' from pieces union all select 'Module' from mods union all select 'ADR' from records)
        select 'type' listing, t "name", count(*) n from k group by 2 union all select 'kind', kind, count(*) from pieces group by 2 union all select 'language', "language", count(*) from pieces group by 2""",
    "most_called": f"""with {X.CHUNKS}, {X.RELATIONS}, c as (select * from stored where relation = 'CALLS' and from_id in (select id from pieces) and to_id in (select id from pieces))
        select id, count(*) degree from (select from_id id from c union all select to_id from c) group by 1 order by 2 desc, 1 limit 10""",
    "vector_checks": f"""with {X.CHUNKS}, v as (select distinct on (vec_id) model, dimensions, id, coalesce(vector, []) vector from vectors where model is not null),
        n as (select *, sqrt(list_sum(list_transform(vector, lambda x: coalesce(x::double, 0) * coalesce(x::double, 0)))) nm from v)
        select model, count(*) vectors, count(distinct len(vector)) > 1 mixed, count(*) filter (len(vector) <> dimensions) unlike_said, round(quantile_cont(case when not isnan(coalesce(nm, 0)) then coalesce(nm, 0) end, 0.99), 6) norm_p99,
        round(floor(count(distinct id) / (select count(*) from pieces where status <> 'deleted')::double * 1000 + 0.5) / 10, 1) coverage_pct from n group by 1""",
    "merged_histograms": f"with {X.CHUNKS}, " + "{h}",
    "chunk_descriptions": f"""with {X.CHUNKS}, d as (select id, kind, exported, signature, trim(description) said, substr(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 200) tidy,
            substr(trim(regexp_replace(regexp_replace(regexp_extract(body, '^((?:\\s*(?:/\\*[\\s\\S]*?\\*/|//[^\\n]*)[\\s\\n]*)+)', 1), '/\\*\\*|\\*/|\\*|//', '', 'g'), '\\s+', ' ', 'g')), 1, 200) cm from pieces)
        select id, md5(array_to_string(list_filter([kind, case when exported then 'exported' end, signature, case when length(said) > 10 then tidy end, case when length(cm) > 10 then cm end], lambda x: x is not null), '. ') || '.') description_hash from d""",
    "token_budget": f"""with {X.FILES}, t as (select id, content, case when greatest(1, ceil(length(content) / 4.0)) <= 512 then content else regexp_replace(substr(content, 1, 2048), '\\s+$', '') end c from files)
        select id, length(c) n_chars, md5(c) text_hash, c <> content "cut" from t""",
    "vector_signatures": f"""with {X.FILES}, {X.ADRS}, {X.CHUNKS}, {X.MODULES}, {X.RULES}, s as (select f.id, 'File|' || coalesce(d.checksum, '') || '|' || f.updated_at || '|' || sha256(f.path || chr(10) || f.excerpt) x from files f join documents d on d.file_id = f.id
        union all select id, 'Rule||' || updated_at || '|' || sha256(title || chr(10) || body) from ruleset
        union all select p.id, 'Chunk|' || coalesce(c.checksum, '') || '|' || p.updated_at || '|' || sha256(p."name" || chr(10) || p.signature || chr(10) || p.description || chr(10) || p.body) from pieces p join now using (id) join (select distinct chunk_key, checksum from chunks) c using (chunk_key)
        union all select id, 'Module||' || updated_at || '|' || sha256(path || chr(10) || summary) from mods union all select id, 'ADR||' || decision_date || '|' || sha256(title || chr(10) || body) from records)
        select id, sha256(x) signature from s""",
    "vector_reuse": f"""with {X.CHUNKS}, n as (select p.id, substr(coalesce(c.checksum, ''), 1, 16) present from pieces p join now using (id) join (select distinct chunk_key, checksum from chunks) c using (chunk_key) where p.status <> 'deleted'),
        v as (select distinct on (vec_id) * from vectors where id is not null), h as (select v.*, present, case when signature is null then null when vec_id % 2 = 0 then present else signature end st from v left join n using (id))
        select case when present is null then 'gone' when st is null then 'unsigned' when coalesce(model, '') <> 'ctx-embed-base-v2' then 'other model' when st = present then 'kept' else 'changed' end state, count(*) n from h group by 1""",
    "embedding_batches": f"""with {X.CHUNKS}, t as (select distinct body from pieces where body <> ''), b as (select length(body) n, floor(log2(length(body)))::int bucket from t)
        select bucket, count(*) texts, max(n) longest, round(1 - sum(n) / (max(n) * count(*))::double, 6) waste from b group by 1""",
    "sortable_table": "select doc_id, size_bytes from documents order by size_bytes desc nulls last, doc_id limit 25",
    "status_counts": f"""with {X.ALL}, k as (select 'File' t from files union all select 'Rule' from ruleset union all select 'Chunk' from pieces union all select 'Module' from mods union all select 'ADR' from records)
        select t item, count(*)::double "value" from k group by 1 union all select relation, count(*) from rels group by 1 union all select 'chars', sum(length(coalesce(text, ''))) from documents union all select 'pending', count(*) filter (status = 'deleted') from documents
        union all select 'files', count(*) from documents union all select 'top ' || id, n from (select id, count(*) n from (select from_id id from stored union all select to_id from stored) group by 1 order by 2 desc, 1 limit 5)""",
    "evidence_within_bounds": """with h as (select item_id, passage, unnest(expected_hits) id from eval_items), r as (select *, regexp_matches(id, '^file:.+') and regexp_matches(id, '\\.(ts|py|cs|js|sql|md)$') ok from h)
        select item_id, count(*) filter (ok) kept, count(*) filter (not ok) dropped, max(length(substr(passage, 1, 1000))) longest from r group by 1""",
    "removed_relations": f"""with {X.CHUNKS}, {X.RELATIONS}, g as (select id from pieces where file_id in {_DEL}) select relation, count(*) n from stored where not case when relation in ('CALLS', 'CALLS_SQL') then from_id in (select id from g) or to_id in (select id from g) or (relation = 'CALLS_SQL' and from_id in {_DEL})
        when relation = 'IMPORTS' then from_id in (select id from g) when relation = 'DEFINES' then from_id in {_DEL} else false end group by 1""",
    "hydrated": f"""with {X.FILES}, {X.CHUNKS}, {X.RELATIONS}, f as (select id from files where status <> 'deleted'), c as (select id from pieces where status <> 'deleted' and file_id in (select id from f))
        select relation, count(*) n from stored where case relation when 'DEFINES' then from_id in (select id from f) and to_id in (select id from c) when 'CALLS' then from_id in (select id from c) and to_id in (select id from c)
        when 'IMPORTS' then from_id in (select id from c) and to_id in (select id from f) when 'CALLS_SQL' then from_id in (select id from f) and to_id in (select id from c) else false end group by 1""",
    "excluded_by_rule": f"""with {X.FILES} select starts_with(path, 'ledger-core/') or starts_with(path, 'beacon-sync/legacy/') or list_has_any(string_split(path, '/'), ['.context', '.git', '__pycache__', 'build', 'coverage', 'dist', 'generated', 'node_modules', 'target', 'vendor']) "out",
        regexp_matches(path, '(^|/)(?:test|tests|__tests__)(?:/|$)') or regexp_matches(path, '\\.(?:test|spec)\\.[^/]+$') test, regexp_matches(path, '(?i)\\.(?:c|cc|cpp|cs|cxx|go|h|hh|hpp|hxx|java|js|jsx|kt|kts|m|mm|mjs|php|py|rb|rs|swift|ts|tsx|vb)$') runtime, count(*) n from files group by 1, 2, 3""",
}
from . import search_queries as _SQ  # noqa: E402
from . import stats_queries as _ST  # noqa: E402

SQL["merged_histograms"] = f"with {X.CHUNKS}, {_ST._hist_sql('select length(body) v from pieces', ST.CHAR_BUCKETS)}"
SQL["best_scored_per_path"] = _SQ.scored_sql() + ", p as (select *, row_number() over (partition by path order by score desc, id) r from scored where path <> '') select path, id, round(score, 9) score from p where r = 1"
