"""Queries on parsing, relation building, rules, scans and incremental updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import scans as S
from ..operators import search as SE
from ..sources.tables import table
from . import context as C
from . import relation_queries as RQ
from . import sample_files as SF
from . import search_queries as SQ
from . import sqltext as X


def _count(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    c = P.parse_files(SF.files(spark, d).repartition(spark.sparkContext.defaultParallelism, "id"))
    return c.withColumn("id", F.concat(F.lit("chunk:"), "path", F.lit(":"), "name", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string")))


def parsed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).groupBy("kind", "language").agg(_count(), F.sum(F.length("body")).alias("chars"), F.sum(F.size("calls")).alias("n_calls"))


def sql_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that SQL files create, by pattern in the JVM."""
    f = C.files(spark, d).where(F.lower("path").endswith(".sql"))
    m = F.regexp_extract_all("content", F.lit(r"(?i)create\s+(?:or\s+alter\s+)?(?:procedure|proc|view|function|table|trigger)\s+([^\s(]+)"), F.lit(1))
    return f.select("id", F.explode(m).alias("name")).select("id", F.lower(F.regexp_replace("name", r"[\[\]\";`]", "")).alias("name"))


def sql_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    f = C.files(spark, d).where(F.lower("path").endswith(".sql"))
    pats = [F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in P.SQL_REFERENCES]
    return f.select("id", F.size(F.array_distinct(F.transform(F.flatten(F.array(*pats)), lambda x: F.lower(F.regexp_replace(x, r"[\[\]]", ""))))).alias("n_refs"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("kind = 'section'").select("file_id", "name", "start_line", "end_line", F.md5("body").alias("body_hash"))


def config_entries(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where("language = 'config'").select("file_id", "name", "kind", "start_line")


def calls_in_file(spark: SparkSession, d: str) -> DataFrame:
    """CALLS within files: names that a chunk calls and another of its file has; methods go by their own name."""
    c = _parsed(spark, d).where("language not in ('sql', 'markdown', 'config', 'resource', 'dotnet')")
    return I.calls_in_file(c.withColumn("name", F.element_at(F.split("name", r"\."), -1)))


def sql_references(spark: SparkSession, d: str) -> DataFrame:
    return I.sql_references(_parsed(spark, d).where("language = 'sql'"))


def import_resolution(spark: SparkSession, d: str) -> DataFrame:
    f = SF.files(spark, d)
    imp = f.where("kind = 'CODE'").select(F.col("id").alias("from_id"), "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"""(?m)^(?:import|export)\b[^;\n]*?\bfrom\s+["'](\.[^"'\n]+)["']"""), F.lit(1)))).alias("target"))
    return I.resolve_imports(imp, f)


def import_links(spark: SparkSession, d: str) -> DataFrame:
    """Notes of stored IMPORTS resolved anew against the indexed files."""
    f = C.files(spark, d)
    owner = C.chunks(spark, d).join(f.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("from_id"), "path")
    imp = C.stored_relations(spark, d).where("relation = 'IMPORTS' and note like './%'").select("from_id", F.col("note").alias("target")).distinct().join(owner, "from_id")
    return I.resolve_imports(imp, f)


def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    return I.module_rollup(C.files(spark, d), C.chunks(spark, d))


def module_parents(spark: SparkSession, d: str) -> DataFrame:
    return I.module_parents(module_rollup(spark, d).select("id", "path"))


def keyword_rule_match(spark: SparkSession, d: str) -> DataFrame:
    return I.keyword_rules(C.files(spark, d, wide=True), C.rules(spark, d))


def detected_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = I.detect_kind(F.col("path"))
    return C.files(spark, d).select("id", kind.alias("kind"), I.trust_of(kind).alias("trust"))


def file_titles(spark: SparkSession, d: str) -> DataFrame:
    f = C.files(spark, d).where("kind <> 'CODE'")
    return f.select("id", I.title_of(F.col("content"), F.col("path")).alias("title"), I.decision_date(F.col("content"), F.col("updated_at")).alias("decision_date"))


def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.rules(spark, d).select("id", F.array_join(F.array_sort(I.keywords(F.col("body"))), " ").alias("keywords"))


def checksums(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).select("id", F.sha2("content", 256).alias("sha256"), F.md5("excerpt").alias("excerpt_hash"))


def embedding_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signature of what an entity's vector is made from: type, checksum, time and text."""
    return C.files(spark, d).select("id", F.sha2(F.concat_ws("|", F.lit("File"), "checksum", "updated_at", F.sha2(F.concat_ws("\n", "path", "excerpt"), 256)), 256).alias("signature"))


def upserted_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("id is not null").select("id", "chunk_key", "status", "ingested_at")
    return I.upsert(rows, ["id"], F.struct("ingested_at", "chunk_key")).select("id", "chunk_key", "status")


def policy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Rules of scope api override local ones of the same id; highest priority first."""
    r = C.rules(spark, d).select("id", "scope", "priority")
    local = r.withColumn("origin", F.lit("local"))
    org = r.where("scope = 'api'").withColumn("priority", F.col("priority") + 10).withColumn("origin", F.lit("org"))
    return I.override(local, org, "id").select("id", "priority", "origin").orderBy(F.desc("priority"), "id")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Chunks between the first and the latest state of each id."""
    rows = table(spark, d, "chunks").where("id is not null")
    first = rows.groupBy("id").agg(F.min_by("checksum", F.struct("ingested_at", "chunk_key")).alias("checksum"))
    last = rows.where("coalesce(status, '') <> 'deleted'").groupBy("id").agg(F.max_by("checksum", F.struct("ingested_at", "chunk_key")).alias("checksum"))
    return I.snapshot_diff(first, last, "id", "checksum").groupBy("change").agg(_count())


def gained_lost(spark: SparkSession, d: str) -> DataFrame:
    """Expected hits of one pack that another lacks, and the reverse."""
    h = table(spark, d, "eval_items").select("pack", F.explode("expected_hits").alias("hit"))
    a, b = h.where("pack = 'semantic-pack-a'").select("hit").distinct(), h.where("pack = 'semantic-pack-b'").select("hit").distinct()
    return b.subtract(a).withColumn("change", F.lit("gained")).unionByName(a.subtract(b).withColumn("change", F.lit("lost")))


def incremental_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Prior DEFINES that stay: their file is there and their chunk is not deleted."""
    f = C.files(spark, d).where("status <> 'deleted'").select(F.col("id").alias("from_id"))
    c = C.chunks(spark, d).where("status <> 'deleted'").select(F.col("id").alias("to_id"))
    return C.stored_relations(spark, d).where("relation = 'DEFINES'").join(f, "from_id", "left_semi").join(c, "to_id", "left_semi").select("from_id", "to_id", "ord")


def prefix_delete(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).where(~I.under(F.col("path"), "ledger-core/src")).groupBy(F.split("path", "/")[0].alias("repo")).agg(_count())


def parse_eligible(spark: SparkSession, d: str) -> DataFrame:
    """Code files without chunks, or changed after their chunks came in."""
    got = C.chunks(spark, d).groupBy(F.col("file_id").alias("id")).agg(_count("n_chunks"))
    came = table(spark, d, "chunks").where("id <> '' and name <> ''").groupBy(F.col("file_id").alias("id")).agg(F.max("ingested_at").alias("chunks_at"))
    changed = table(spark, d, "documents").groupBy(F.col("file_id").alias("id")).agg(F.max("ingested_at").alias("file_at"))
    code = C.files(spark, d).where("kind = 'CODE'").join(got, "id", "left").join(came, "id", "left").join(changed, "id", "left")
    return code.where("n_chunks is null or file_at > chunks_at").select("id")


def excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("path", "/")
    skip = F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ("node_modules", "bin", "obj", "dist", "build", "coverage")]))
    return C.files(spark, d).groupBy(skip.alias("skipped"), SE.test_evidence(F.col("path")).alias("is_test")).agg(_count())


def injection_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entities with signs of injected instructions; texts are scanned in parts where they are read."""
    texts = C.entity_texts(spark, d).unionByName(SF.samples(spark).select("id", F.col("content").alias("text")))
    parts = texts.select("id", S.injection_total(F.col("text")).alias("s")).where("s > 0")
    e = parts.groupBy("id").agg(F.least(F.lit(1.0), F.sum("s")).alias("score"))
    return e.select("id", F.round("score", 4).alias("score"), (F.col("score") >= 0.3).alias("flagged"))


def injection_categories(spark: SparkSession, d: str) -> DataFrame:
    """Signs by name in all files, those that quote some among them."""
    return S.injection_matches(SF.files(spark, d).select("id", "content"), "content").groupBy("pattern", "category").agg(F.sum("n").alias("n"))


def regex_policy(spark: SparkSession, d: str) -> DataFrame:
    return S.policy_hits(C.files(spark, d).select("path", "content"), "path", "content", r"\bTODO\b").select("path", "line_no")


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    out = S.context_lines(C.files(spark, d).select("path", "content"), "path", "content", r"\bTODO\b")
    return out.select("path", "line_no", F.md5("context").alias("context_hash"))


def external_calls(spark: SparkSession, d: str) -> DataFrame:
    return S.external_calls(C.files(spark, d), "path", "content", ("fetch(", "axios.", "http.get", "lookup(", ".push("))


def undocumented_functions(spark: SparkSession, d: str) -> DataFrame:
    return S.undocumented(C.files(spark, d, wide=True).where("kind = 'CODE'"), "path", "content", 12)


def redacted_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.outline(F.col("props")).alias("outline"))


def sanitised_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Items within the length limits of evidence, cut to them; rows without a text are dropped and counted."""
    e = table(spark, d, "eval_items")
    return e.select(F.count_if(F.expr("coalesce(query, '') = ''")).alias("dropped"), F.count_if(F.length("passage") > 500).alias("cut"), F.sum(F.length(F.substring("passage", 1, 500))).alias("chars"))


def orphan_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that no relation touches."""
    rels = C.stored_relations(spark, d)
    ends = rels.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return C.rules(spark, d).select("id").join(ends, "id", "left_anti")


def work_items(spark: SparkSession, d: str) -> DataFrame:
    """Repositories by models without those that have a vector already: a product of two small name lists."""
    repos = table(spark, d, "mix_targets").select("source").distinct()
    models = table(spark, d, "vectors").where("model is not null").select("model").distinct()
    done = table(spark, d, "vectors").select(F.regexp_extract("id", r"^chunk:([^/]+)/", 1).alias("source"), "model").distinct()
    return repos.crossJoin(F.broadcast(models)).join(done, ["source", "model"], "left_anti")


def folder_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Folders of all files with the folders above them."""
    dirs = C.files(spark, d).select(I.dirname(F.col("path")).alias("dir")).distinct()
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda i: F.array_join(F.slice(F.split("dir", "/"), F.lit(1), i), "/"))
    every = dirs.select(F.explode(up).alias("dir")).distinct()
    nodes = every.select("dir", F.when(F.instr("dir", "/") > 0, F.regexp_replace("dir", "/[^/]*$", "")).alias("parent"))
    return G.ancestors(nodes, "dir", "parent").groupBy("ancestor").agg(_count("n_below"), F.max("distance").alias("deepest"))


def region_ancestors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("up"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("up"))
    return G.ancestors(n.unionByName(c), "id", "up").groupBy("ancestor", "distance").agg(_count())


def dataflow_degree(spark: SparkSession, d: str) -> DataFrame:
    """Degrees in a graph of foreign keys: customers, orders and parts as nodes."""
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("from_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("to_id"))
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_id"))
    deg = C.degrees(o.unionByName(li)).withColumn("kind", F.substring("id", 1, 1))
    return C.midrank(deg, "kind", "degree", "rank").groupBy("kind", "degree").agg(_count(), F.round(F.first("rank"), 6).alias("rank"))


_TARGET = "(select min(path) from files where kind = 'CODE' and status = 'active')"


def _tier(path, target):
    folder = I.dirname(target)
    area = F.when(F.instr(folder, "/") > 0, F.regexp_replace(folder, "/[^/]*$", ""))
    return F.when(path == target, "same_file").when((path != "") & (I.dirname(path) == folder), "same_module").when(area.isNotNull() & path.startswith(F.concat(area, F.lit("/"))), "same_feature_area").otherwise("repo_wide")


def pattern_query(name: str, signals: list[str], excerpt: str) -> str:
    """The question that a file stands for: its name, names and kinds of its first chunks, its excerpt; 1,000 characters."""
    base = name.rsplit("/", 1)[-1]
    base = base.rsplit(".", 1)[0] if "." in base[1:] else base
    return " ".join(x for x in (base, *signals, excerpt) if x)[:1000]


def _evidence(spark: SparkSession, d: str, target: str, entity: str, query: str, k: int = 3) -> DataFrame:
    """Evidence of a pattern in four tiers of nearness to a file, each ranked on its own; the target itself is none."""
    index = C.search_index(spark, d)
    kinds = F.col("entity_type").isin("File", "Chunk", "ADR") & (F.col("path") != "") & (F.col("id") != entity)
    rows = C.candidates(index.heads, predicate=kinds).withColumn("tier", _tier(F.col("path"), F.lit(target)))
    ranked = SE.scored(rows, None, query, SQ.REFERENCE, tier="tier", found=index.matches(SE.asked_words(query), query.strip().lower()))
    return SE.diverse(SE.collapse_windows(ranked, rows, ["tier"]), k, ["tier"])


def _target(spark: SparkSession, d: str):
    return C.files(spark, d).where("kind = 'CODE' and status = 'active'").orderBy("path").select("id", "path", "excerpt").first()


def pattern_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for a question that is given, around the first code file."""
    t = _target(spark, d)
    if t is None:
        return spark.createDataFrame([], "tier string, id string, score double, graph_score double")
    out = _evidence(spark, d, t["path"], t["id"], SQ.QUERY)
    return out.select("tier", "id", F.round("score", 6).alias("score"), F.round("graph_score", 6).alias("graph_score"))


def pattern_evidence_derived(spark: SparkSession, d: str) -> DataFrame:
    """The same for the question that the file itself stands for, with whether there is local evidence."""
    t = _target(spark, d)
    if t is None:
        return spark.createDataFrame([], "tier string, n int, local boolean, fallback boolean")
    own = C.chunks(spark, d).where((F.col("file_id") == t["id"]) & ~C.is_window(F.col("id"))).orderBy("id").limit(12).select("name", "kind").collect()
    query = pattern_query(t["path"], [x for r in own for x in (r["name"], r["kind"])], t["excerpt"])
    found = _evidence(spark, d, t["path"], t["id"], query).groupBy("tier").agg(_count("n"))
    tiers = spark.createDataFrame([("same_file",), ("same_module",), ("same_feature_area",), ("repo_wide",)], "tier string")
    rows = tiers.join(found, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    local = found.where("tier <> 'repo_wide'").agg((F.count(F.lit(1)) > 0).alias("local"))
    return rows.crossJoin(F.broadcast(local)).select("tier", F.col("n").cast("int").alias("n"), "local", (~F.col("local") & (F.col("tier") == "repo_wide") & (F.col("n") > 0)).alias("fallback"))


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a change: those of changed and deleted files go, the changed ones are parsed anew, the rest stays.

    A third of the folders stands for what a version control tells as changed, deleted files for deleted.
    """
    from ..sources.files import changed_files

    f = C.files(spark, d)
    some = f.where("kind = 'CODE' and status = 'active'").orderBy("path").limit(20).select("path").collect()
    status = changed_files(spark, "".join(f" M {r['path']}\0" for r in some[:15]) + "".join(f"D  {r['path']}\0" for r in some[15:]))
    touched = f.join(F.broadcast(status), "path").select("id", "path", "content", "change")
    kept, _ = I.drop_files(C.chunks(spark, d), C.stored_relations(spark, d), touched.select("id"))
    fresh = P.parse_files(touched.where("change = 'changed'"))
    old = kept.groupBy(F.lit("kept").alias("state")).agg(_count())
    return old.unionByName(fresh.groupBy(F.lit("parsed anew").alias("state")).agg(_count())).unionByName(status.groupBy(F.concat(F.lit("files "), "change").alias("state")).agg(_count()))


def entities_with_projects(spark: SparkSession, d: str) -> DataFrame:
    """All six kinds of entities, with the lines of their relations in the texts of files and chunks."""
    from ..operators.relations import projects
    from . import relation_queries as RQ
    labels = SF.files(spark, d).select("id", F.col("path").alias("label")).unionByName(SF.chunks(spark, d).select("id", F.col("name").alias("label")))
    rels = RQ.built_relations(spark, d).withColumn("ord", F.xxhash64("from_id", "to_id", "relation", "note"))
    e = C.entities(spark, d, projects=projects(SF.files(spark, d)), signals=C.relation_signals(rels, labels))
    return e.groupBy("entity_type").agg(_count(), F.count_if(F.col("text").contains("affected_by uses_config") | F.col("text").contains("uses_config inherits:machine")).alias("n_signalled"))


def content_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Files of the store with the contents that a cache has of them."""
    f = C.files(spark, d)
    cached = f.where("kind = 'CODE'").select("id", "content")
    return C.backfilled(f.select("id", "kind"), cached).groupBy("kind").agg(_count(), F.sum(F.length("content")).alias("chars"))


def composed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in compatibility composition, with letters in other than their usual form among them."""
    odd = spark.createDataFrame([("odd:1", "\uff32\uff45\uff54\uff52\uff59 \ufb01le x\u0308"), ("odd:2", "plain"), ("odd:3", None)], "id string, content string")
    rows = C.files(spark, d).select("id", "content").unionByName(odd)
    return rows.select("id", F.md5(F.lower(T.composed(F.col("content")))).alias("hash"))


def pattern_tiers(spark: SparkSession, d: str) -> DataFrame:
    f = C.files(spark, d)
    target = f.where("kind = 'CODE' and status = 'active'").agg(F.min("path").alias("target"))
    rows = f.crossJoin(F.broadcast(target))
    folder = I.dirname(F.col("target"))
    area = F.when(F.instr(folder, "/") > 0, F.regexp_replace(folder, "/[^/]*$", ""))
    tier = F.when(F.col("path") == F.col("target"), "same_file").when(I.dirname(F.col("path")) == folder, "same_module").when(area.isNotNull() & F.col("path").startswith(F.concat(area, F.lit("/"))), "same_feature_area").otherwise("repo_wide")
    return rows.groupBy(tier.alias("tier")).agg(_count())


def two_pass_contained(spark: SparkSession, d: str) -> DataFrame:
    """Second pass of a retrieval: chunks in the folders that the first pass found, best anchor and lane first."""
    words = ["tracker", "snapshot"]
    c = C.chunks(spark, d).join(C.files(spark, d).where("kind = 'CODE'").select(F.col("id").alias("file_id"), "path"), "file_id")
    hits = c.where(F.lower("name").contains(words[0]) | F.lower("name").contains(words[1]))
    anchors = hits.orderBy("id").limit(5).select(I.dirname(F.col("path")).alias("anchor")).distinct()
    near = c.withColumn("_folder", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/")))).join(F.broadcast(anchors), F.col("_folder") == F.col("anchor"))
    best = near.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(F.desc(F.length("anchor"))))).where("_n = 1")
    lane = F.when(SE.test_evidence(F.col("path")), "test").otherwise("runtime")
    scored = best.select("id", "anchor", lane.alias("lane"), F.when(F.lower("name").contains(words[0]), 1).otherwise(0).alias("a"), F.when(F.lower("name").contains(words[1]), 1).otherwise(0).alias("b"))
    order = W.partitionBy("lane").orderBy(F.desc(F.col("a") + F.col("b")), F.desc(F.length("anchor")), "id")
    return scored.withColumn("place", F.row_number().over(order)).where((F.col("lane") == "runtime") & (F.col("place") <= 32) | (F.col("lane") == "test") & (F.col("place") <= 12)).select("lane", "place", "id", "anchor")


QUERIES = {f.__name__: f for f in (
    parsed_chunks, sql_objects, sql_reference_counts, markdown_sections, config_entries, calls_in_file, sql_references, import_resolution, import_links, module_rollup, module_parents,
    keyword_rule_match, detected_kinds, file_titles, keyword_counts, checksums, embedding_signatures, upserted_chunks, policy_merge, snapshot_diff,
    gained_lost, incremental_hydrate, prefix_delete, parse_eligible, excluded_paths, injection_scan, injection_categories, regex_policy, context_lines,
    external_calls, undocumented_functions, redacted_props, sanitised_evidence, orphan_rules, work_items, folder_ancestors, region_ancestors,
    dataflow_degree, pattern_evidence, pattern_evidence_derived, incremental_ingest, entities_with_projects, content_backfill, composed_texts, pattern_tiers, two_pass_contained,
)}

_DIR = "case when instr(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '.' end"
_LINES = "(select path, unnest(string_split_regex(content, '\\r\\n|\\n|\\r')) line, generate_subscripts(string_split_regex(content, '\\r\\n|\\n|\\r'), 1) line_no from files where regexp_matches(content, '\\bTODO\\b'))"
_STOP = X.sql_list(I.STOP_WORDS)
_KEYS = "list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) >= 3 and not list_contains(" + _STOP + ", w)))"


_KEY = "regexp_replace(regexp_replace(lower(replace({x}, '&amp;', '&')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
_TDIR = f"(select regexp_replace(t, '/[^/]*$', '') from (select {_TARGET} t))"
_TIER = f"""case when path = {_TARGET} then 'same_file' when path <> '' and {_DIR} = {_TDIR} then 'same_module'
        when instr({_TDIR}, '/') > 0 and starts_with(path, regexp_replace({_TDIR}, '/[^/]*$', '') || '/') then 'same_feature_area' else 'repo_wide' end"""


def _re(p: str) -> str:
    return p.replace("'", "''")


_INJECTED = " + ".join(f"len(regexp_extract_all(\"text\", '{_re(p)}')) * {w}::double" for _, _, w, p in S.INJECTIONS)
_MODS = """dirs as (select {d} dir, count(*) file_count, max(updated_at) updated_at from files group by 1 having count(*) >= 2)""".format(d=_DIR)

SQL = {
    "sql_objects": f"""with {X.FILES}, m as (select id, unnest(regexp_extract_all(content, '(?i)create\\s+(?:or\\s+alter\\s+)?(?:procedure|proc|view|function|table|trigger)\\s+([^\\s(]+)', 1)) n from files where lower(path) like '%.sql')
        select id, lower(regexp_replace(n, '[\\[\\]";`]', '', 'g')) "name" from m""",
    "sql_reference_counts": f"""with {X.FILES} select id, len(list_distinct(list_transform(flatten([{", ".join("regexp_extract_all(content, '" + p + "', 1)" for p in P.SQL_REFERENCES)}]), lambda x: lower(regexp_replace(x, '[\\[\\]]', '', 'g'))))) n_refs
        from files where lower(path) like '%.sql'""",
    "module_rollup": f"""with {X.FILES}, {X.CHUNKS}, {_MODS}, ex as (select f.dir, c.name, row_number() over (partition by f.dir order by c.id) r from pieces c join (select id, {_DIR} dir from files) f on f.id = c.file_id where c.exported and not contains(c.id, ':window:')),
        u as (select dir, name, min(r) r from ex where r <= 20 group by 1, 2), n as (select dir, string_agg(name, ', ' order by r) e from u group by 1)
        select 'module:' || dir id, dir path, string_split(dir, '/')[-1] "name", file_count, coalesce(e, '') exported_symbols, updated_at from dirs left join n using (dir)""",
    "module_parents": f"with {X.FILES}, {_MODS} select 'module:' || p.dir from_id, 'module:' || c.dir to_id from (select dir, case when instr(dir, '/') > 0 then regexp_replace(dir, '/[^/]*$', '') else '.' end up from dirs) c join dirs p on p.dir = c.up where c.dir <> p.dir",
    "keyword_rule_match": f"""with {X.FILES}, {X.RULES}, k as (select id rule_id, list_sort(list_distinct(list_filter(list_concat(list_transform(string_split_regex(id, '[._-]+'), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), {_KEYS.format(x='body')}),
            lambda w: length(w) >= 3 and not list_contains({_STOP}, w))))[1:20] words from ruleset),
        t as (select id, kind, content, {_KEYS.format(x="path || chr(10) || substr(content, 1, 12000)")} toks from files),
        j as (select rule_id, t.id file_id, contains(lower(content), lower(rule_id)) m, len(list_intersect(words, toks)) n, least(case when kind = 'CODE' then 1 else 2 end, greatest(1, len(words))) need from k, t)
        select rule_id, file_id, case when m then 'mention' else 'keyword' end how from j where m or n >= need""",
    "detected_kinds": f"""with {X.FILES}, k as (select id, case when regexp_matches(lower(path), '(^|/)(adr|adrs|decisions)(/|$)') or regexp_matches(string_split(lower(path), '/')[-1], '^adr[-_ ]?\\d+') then 'ADR'
            when lower(path) like 'docs/%' or regexp_extract(lower(path), '(\\.[^./]+)$', 1) in ('.md', '.mdx', '.txt', '.adoc', '.rst') or not list_contains({X.sql_list(I.CODE_EXTENSIONS)}, regexp_extract(lower(path), '(\\.[^./]+)$', 1)) then 'DOC' else 'CODE' end kind from files)
        select id, kind, case kind when 'ADR' then 95 when 'CODE' then 80 else 70 end trust from k""",
    "file_titles": f"""with {X.FILES} select id, coalesce(nullif(trim(regexp_extract(content, '(?m)^#[ \\t]+(.+?)\\s*$', 1)), ''), path) title,
        coalesce(nullif(regexp_extract(content, '(?im)^\\s*date:\\s*["'']?(\\d{{4}}-\\d{{2}}-\\d{{2}})["'']?\\s*$', 1), ''), nullif(regexp_extract(content, '(?im)^\\s*decision[_\\s-]*date:\\s*["'']?(\\d{{4}}-\\d{{2}}-\\d{{2}})["'']?\\s*$', 1), ''), substr(updated_at, 1, 10)) decision_date
        from files where kind <> 'CODE'""",
    "keyword_counts": f"with {X.RULES} select id, array_to_string(list_sort({_KEYS.format(x='body')}), ' ') keywords from ruleset",
    "checksums": f"with {X.FILES} select id, sha256(content) sha256, md5(excerpt) excerpt_hash from files",
    "embedding_signatures": """with f as (select file_id id, path, coalesce(checksum, '') c, coalesce(updated_at, '') u, substr(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), 1, 500) e from documents where file_id <> '' and path <> '')
        select id, sha256('File|' || c || '|' || u || '|' || sha256(path || chr(10) || e)) signature from f""",
    "upserted_chunks": "select id, arg_max(chunk_key, (ingested_at, chunk_key)) chunk_key, arg_max(coalesce(status, '?'), (ingested_at, chunk_key)) status from chunks where id is not null group by 1",
    "policy_merge": f"with {X.RULES} select id, priority + case when \"scope\" = 'api' then 10 else 0 end priority, case when \"scope\" = 'api' then 'org' else 'local' end origin from ruleset",
    "snapshot_diff": """with a as (select id, arg_min(coalesce(checksum, '?'), (ingested_at, chunk_key)) c from chunks where id is not null group by 1),
        b as (select id, arg_max(coalesce(checksum, '?'), (ingested_at, chunk_key)) c from chunks where id is not null and coalesce(status, '') <> 'deleted' group by 1)
        select case when a.id is null then 'added' when b.id is null then 'removed' when a.c = b.c then 'unchanged' else 'changed' end "change", count(*) n from a full join b on a.id = b.id group by 1""",
    "gained_lost": """with h as (select pack, unnest(expected_hits) hit from eval_items), a as (select distinct hit from h where pack = 'semantic-pack-a'), b as (select distinct hit from h where pack = 'semantic-pack-b')
        select hit, 'gained' "change" from b where hit not in (select hit from a) union all select hit, 'lost' from a where hit not in (select hit from b)""",
    "incremental_hydrate": f"with {X.FILES}, {X.CHUNKS}, {X.RELATIONS} select from_id, to_id, ord from stored where relation = 'DEFINES' and from_id in (select id from files where status <> 'deleted') and to_id in (select id from pieces where status <> 'deleted')",
    "prefix_delete": f"with {X.FILES} select string_split(path, '/')[1] repo, count(*) n from files where not (path = 'ledger-core/src' or path like 'ledger-core/src/%') group by 1",
    "parse_eligible": f"with {X.FILES}, {X.CHUNKS} select id from files where kind = 'CODE' and id not in (select file_id from pieces)",
    "excluded_paths": f"""with {X.FILES} select list_has_any(string_split(path, '/'), ['node_modules', 'bin', 'obj', 'dist', 'build', 'coverage']) skipped,
        regexp_matches(path, '(^|/)(tests?|__tests__)/') or regexp_matches(path, '\\.(test|spec)\\.[^.]+$') is_test, count(*) n from files group by 1, 2""",
    "injection_scan": f"with {X.ALL}, s as (select id, least(1.0::double, {_INJECTED}) score from (select id, \"text\" from ents union all select id, content from {SF.SQL_SAMPLES})) select id, round(score, 4) score, score >= 0.3 flagged from s where score > 0",
    "injection_categories": f"""with {X.FILES}, {SF.SQL_FILES}, m as ({" union all ".join(f"select '{n}' pattern, '{c}' category, len(regexp_extract_all(content, '{_re(p)}')) n from fs" for n, c, _, p in S.INJECTIONS)})
        select pattern, category, sum(n) n from m where n > 0 group by 1, 2""",
    "regex_policy": f"with {X.FILES}, l as {_LINES}, r as (select path, line_no, row_number() over (partition by path order by line_no) k from l where regexp_matches(line, '\\bTODO\\b')) select path, line_no from r where k <= 20",
    "context_lines": f"""with {X.FILES}, l as {_LINES}, w as (select *, string_agg(line, chr(10)) over (partition by path order by line_no rows between 3 preceding and 3 following) c from l)
        select path, line_no, md5(c) context_hash from w where regexp_matches(line, '\\bTODO\\b')""",
    "external_calls": f"""with {X.FILES}, p as (select unnest(['fetch(', 'axios.', 'http.get', 'lookup(', '.push(']) call) select path, call from files, p where contains(content, call)""",
    "sanitised_evidence": "select count(*) filter (coalesce(query, '') = '') dropped, count(*) filter (length(passage) > 500) \"cut\", sum(length(substr(passage, 1, 500))) chars from eval_items",
    "orphan_rules": f"with {X.RULES}, {X.RELATIONS} select id from ruleset where id not in (select from_id from stored) and id not in (select to_id from stored)",
    "work_items": """select source, model from (select distinct source from mix_targets), (select distinct model from vectors where model is not null)
        where (source, model) not in (select distinct regexp_extract(id, '^chunk:([^/]+)/', 1), model from vectors where id is not null and model is not null)""",
    "folder_ancestors": f"""with recursive {X.FILES}, ds as (select distinct {_DIR} dir from files), parts as (select dir, string_split(dir, '/') p from ds),
        every_dir as (select distinct array_to_string(p[1:i], '/') dir from (select p, unnest(generate_series(1, len(p))) i from parts)),
        up as (select dir, regexp_replace(dir, '/[^/]*$', '') parent from every_dir where instr(dir, '/') > 0),
        tree as (select dir, parent ancestor, 1 distance from up union all select t.dir, u.parent, t.distance + 1 from tree t join up u on u.dir = t.ancestor)
        select ancestor, count(*) n_below, max(distance) deepest from tree group by 1""",
    "region_ancestors": """select ancestor, distance, count(*) n from (select 'r' || n_regionkey ancestor, 1 distance from nation union all select 'n' || c_nationkey, 1 from customer
        union all select 'r' || n_regionkey, 2 from customer join nation on n_nationkey = c_nationkey) group by 1, 2""",
    "dataflow_degree": """with e as (select 'c' || o_custkey id from orders union all select 'o' || o_orderkey from orders union all select 'o' || l_orderkey from lineitem union all select 'p' || l_partkey from lineitem),
        d as (select id, id[1] kind, count(*) degree from e group by 1, 2),
        r as (select kind, degree, (rank() over (partition by kind order by degree) - 1 + count(*) over (partition by kind order by degree range between unbounded preceding and current row)) / (2.0::double * count(*) over (partition by kind)) r from d)
        select kind, degree, count(*) n, round(min(r), 6) "rank" from r group by 1, 2""",
    "pattern_evidence": SQ.scored_sql("retry tracker snapshot", f"and entity_type in ('File', 'Chunk', 'ADR') and path <> '' and id <> (select arg_min(id, path) from files where kind = 'CODE' and status = 'active')", _TIER) + SQ.top_sql(3, "tier") + " select tier, id, round(score, 6) score, round(g, 6) graph_score from best",
    "content_backfill": f"with {X.FILES} select kind, count(*) n, sum(case when kind = 'CODE' then length(content) else 0 end) chars from files group by 1",
    "composed_texts": f"with {X.FILES} select id, md5(lower(nfc_normalize(content))) hash from files union all select * from (values ('odd:1', md5('retry file ẍ')), ('odd:2', md5('plain')), ('odd:3', null)) v(id, hash)",
    "import_resolution": RQ._BASE + r""", im as (select id from_id, dir, unnest(list_distinct(regexp_extract_all(content, '(?m)^(?:import|export)\b[^;\n]*?\bfrom\s+["''](\.[^"''\n]+)["'']', 1))) target from f where kind = 'CODE'),
        p as (select from_id, target, regexp_replace(regexp_replace(case when dir = '.' then '' else dir || '/' end || target, '(^|/)\./', '\1', 'g'), '[^/]+/\.\./', '', 'g') p from im),
        ex as (select unnest(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.json']) e, unnest(generate_series(1, 9)) k),
        c as (select from_id, target, p cand, 0 pos from p union all select from_id, target, p || e, k from p, ex union all select from_id, target, p || '/index' || e, 9 + k from p, ex
              union all select from_id, target, regexp_replace(p, '\.(js|jsx|mjs|cjs)$', '') || e, 18 + k from p, ex where k <= 4 and regexp_matches(p, '\.(js|jsx|mjs|cjs)$'))
        select from_id, target, arg_min(fs.id, pos) to_id from c join fs on fs.path = cand group by 1, 2""",
    "redacted_props": "select event_id, replace(props, ' ', '') outline from events",
    "markdown_sections": RQ._BASE + r""", ln as (select id, unnest(string_split_regex(content, '\r?\n')) x, generate_subscripts(string_split_regex(content, '\r?\n'), 1) i from f where ext in ('.md', '.mdx') and content <> ''),
        fe as (select *, regexp_matches(trim(x, chr(32) || chr(9) || chr(13) || chr(12)), '^(```|~~~)') fence from ln), st as (select *, sum(fence::int) over (partition by id order by i) n from fe),
        ok as (select *, not fence and n % 2 = 0 free from st), hd as (select *, free and regexp_matches(x, '^#{1,3}\s+.+') h from ok), fm as (select id, min(i) first_free, min(case when h then i end) first_head from hd where free group by 1),
        mk as (select id, i, trim(regexp_replace(regexp_extract(x, '^#{1,3}\s+(.+)$', 1), '\s*#*\s*$', '')) nm, true h from hd where h union all select id, first_free, 'preamble', false from fm where first_head is null or first_free < first_head),
        sp as (select *, coalesce(lead(i) over (partition by id order by i), (select max(i) + 1 from ln where ln.id = mk.id)) e from mk),
        bd as (select s.id, s.i, s.e, s.nm, s.h, regexp_replace(string_agg(l.x, chr(10) order by l.i), '\s+$', '') body, bool_or(trim(regexp_replace(l.x, '\s', '', 'g')) <> '' and (not s.h or l.i > s.i)) full_ from sp s join ln l on l.id = s.id and l.i >= s.i and l.i < s.e group by all)
        select id file_id, nm "name", i::int start_line, greatest(i, e - 1)::int end_line, md5(body) body_hash from bd where full_""",
    "import_links": RQ._BASE + r""", im as (select distinct s.from_id, s.note target, case when instr(fl.path, '/') > 0 then regexp_replace(fl.path, '/[^/]*$', '') else '.' end dir
            from (select distinct rel_id, from_id, upper(relation) relation, note from relations where from_id <> '' and to_id <> '') s join pieces pc on pc.id = s.from_id join files fl on fl.id = pc.file_id where s.relation = 'IMPORTS' and s.note like './%'),
        p as (select from_id, target, regexp_replace(regexp_replace(case when dir = '.' then '' else dir || '/' end || target, '(^|/)\./', '\1', 'g'), '[^/]+/\.\./', '', 'g') p from im),
        ex as (select unnest(['.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '.json']) e, unnest(generate_series(1, 9)) k),
        c as (select from_id, target, p cand, 0 pos from p union all select from_id, target, p || e, k from p, ex union all select from_id, target, p || '/index' || e, 9 + k from p, ex
              union all select from_id, target, regexp_replace(p, '\.(js|jsx|mjs|cjs)$', '') || e, 18 + k from p, ex where k <= 4 and regexp_matches(p, '\.(js|jsx|mjs|cjs)$'))
        select from_id, target, arg_min(files.id, pos) to_id from c join files on files.path = cand group by 1, 2""",
    "config_entries": RQ._BASE + rf""", cl as (select id, unnest(string_split(content, chr(10))) x, generate_subscripts(string_split(content, chr(10)), 1) i from f where ext = '.config' and content <> ''),
        ad as (select id, i, unnest(regexp_extract_all(x, '(?i)<add\b[^>]+?/?>')) m from cl), kv as (select id, i, {_KEY.format(x="regexp_extract(m, '\\bkey=\"([^\"]*)\"', 1)")} k, {_KEY.format(x="regexp_extract(m, '\\bname=\"([^\"]*)\"', 1)")} n,
        regexp_extract(m, '\bconnectionString="([^"]*)"', 1) <> '' c from ad)
        select id file_id, 'app_setting.' || k "name", 'app_setting' kind, i::int start_line from kv where not (n <> '' and c) and k <> '' union all select id, 'connection_string.' || n, 'connection_string', i::int from kv where n <> '' and c
        union all select id, 'database_target.' || n, 'database_target', i::int from kv where n <> '' and c""",
    "pattern_tiers": f"""with {X.FILES}, t as (select {_TARGET} target), f as (select path, target, {_DIR} dir, regexp_replace(target, '/[^/]*$', '') tdir from files, t)
        select case when path = target then 'same_file' when dir = tdir then 'same_module' when instr(tdir, '/') > 0 and starts_with(path, regexp_replace(tdir, '/[^/]*$', '') || '/') then 'same_feature_area' else 'repo_wide' end tier, count(*) n from f group by 1""",
}
