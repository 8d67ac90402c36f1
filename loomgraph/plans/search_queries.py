"""Queries on entities, search, graph neighbourhoods and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import search as S
from ..sources.tables import table
from . import context as C
from . import sqltext as X

#: Times and questions are fixed, so that results don't depend on when they are asked for.
REFERENCE = "2025-06-30 00:00:00"
QUERY = "retry tracker snapshot"
SEED_SQL = "(select min(id) from pieces where status = 'active')"


def entity_union(spark: SparkSession, d: str) -> DataFrame:
    return C.entities(spark, d).select("id", "entity_type", "kind", "label", "path", "status", "source_of_truth", "trust_level", "updated_at", F.md5("text").alias("text_hash"), F.md5("snippet").alias("snippet_hash"))


def entity_candidates(spark: SparkSession, d: str) -> DataFrame:
    return C.candidates(C.entities(spark, d)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def part_of_edges(spark: SparkSession, d: str) -> DataFrame:
    return C.part_of(C.chunks(spark, d))


def relation_union(spark: SparkSession, d: str) -> DataFrame:
    return C.all_relations(spark, d).select("from_id", "relation", "to_id", "note").distinct()


def dangling_edge_filter(spark: SparkSession, d: str) -> DataFrame:
    rels = C.stored_relations(spark, d)
    kept = C.without_dangling(rels, C.catalog(spark, d))
    total = rels.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    return total.join(kept.groupBy("relation").agg(F.count(F.lit(1)).alias("kept")), "relation", "left").select("relation", "n", F.coalesce("kept", F.lit(0)).alias("kept"))


def degree(spark: SparkSession, d: str) -> DataFrame:
    return C.degrees(C.all_relations(spark, d))


def top_connected(spark: SparkSession, d: str) -> DataFrame:
    return C.degrees(C.stored_relations(spark, d)).orderBy(F.desc("degree"), "id").limit(5)


def rule_links(spark: SparkSession, d: str) -> DataFrame:
    return C.rule_links(C.stored_relations(spark, d)).select("id", F.array_join("matched_rules", ",").alias("rules"))


def relation_signals(spark: SparkSession, d: str) -> DataFrame:
    """Lines for CALLS and IMPORTS; the kinds that a search uses are not in every corpus."""
    return C.relation_signals(C.stored_relations(spark, d), C.catalog(spark, d), ("CALLS", "IMPORTS")).select("id", F.md5("signals").alias("signals_hash"))


def midrank_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = C.candidates(C.entities(spark, d)).select("id", "entity_type").join(C.degrees(C.all_relations(spark, d)), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return C.midrank(rows, "entity_type", "degree").select("id", "entity_type", "degree", F.round("graph_score", 6).alias("graph_score"))


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return C.catalog(spark, d)


def node_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    nodes = C.catalog(spark, d).groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(C.all_relations(spark, d).groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def rules_by_scope(spark: SparkSession, d: str, scope: str = "api", include_inactive: bool = False) -> DataFrame:
    rows = C.rules(spark, d).where(F.col("scope").isin(scope, "global"))
    rows = rows if include_inactive else rows.where("status = 'active'")
    return rows.select("id", "title", "scope", "priority", "status").orderBy(F.desc("priority"), "id")


def adr_shadowing(spark: SparkSession, d: str) -> DataFrame:
    """Files that stay when decision records are nodes of their own: ADR files are dropped by path."""
    f = C.files(spark, d)
    return C.unshadowed(f, C.adrs(f)).select("id", "kind")


def _search_frames(spark: SparkSession, d: str, whole: bool = False):
    """Candidates with their degrees, and the matches of the query, from the index."""
    index = C.search_index(spark, d, whole)
    return C.candidates(index.heads), None, {"found": index.matches(S.asked_words(QUERY), QUERY)}


def search_index_heads(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the search index by type, with their degrees; the first use builds the index."""
    return C.search_index(spark, d).heads.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("degrees"))


def lexical_search_topk(spark: SparkSession, d: str) -> DataFrame:
    cands, deg, found = _search_frames(spark, d)
    return S.search(cands, deg, QUERY, REFERENCE, top_k=20, **found).select("id", "entity_type", "path", F.round("score", 6).alias("score"), F.round("lexical_score", 6).alias("lexical_score"))


def search_scores(spark: SparkSession, d: str) -> DataFrame:
    """All relevant entities with their scores, as an explanation shows them."""
    cands, deg, found = _search_frames(spark, d)
    return S.scored(cands, deg, QUERY, REFERENCE, **found).select("id", F.round("lexical_score", 9).alias("lexical_score"), F.round("graph_score", 9).alias("graph_score"), F.round("score", 9).alias("score"))


def search_explain(spark: SparkSession, d: str) -> DataFrame:
    """The three best results with their scores and the rules that hold for them."""
    cands, deg, found = _search_frames(spark, d)
    best = S.search(cands, deg, QUERY, REFERENCE, top_k=3, **found)
    owners = C.chunks(spark, d).select("id", "file_id")
    links = C.rule_links(C.stored_relations(spark, d)).select(F.col("id").alias("file_id"), "matched_rules")
    rows = best.join(owners, "id", "left").withColumn("file_id", F.coalesce("file_id", "id")).join(links, "file_id", "left")
    return rows.select("id", F.round("score", 6).alias("score"), F.round("graph_score", 6).alias("graph_score"), F.coalesce(F.array_join("matched_rules", ","), F.lit("")).alias("rules"))


def search_with_rules(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The best ``k`` with their scores and, for files and chunks, the rules that hold for their file; decision records count with all of their text."""
    cands, deg, found = _search_frames(spark, d, whole=True)
    best = S.search(cands, deg, QUERY, REFERENCE, top_k=k, **found)
    scores = [F.round(c, 6).alias(c) for c in ("score", "semantic_score", "embedding_score", "lexical_score", "graph_score")]
    owners = C.chunks(spark, d).select("id", "file_id")
    links = C.rule_links(C.stored_relations(spark, d)).select(F.col("id").alias("file_id"), F.array_join("matched_rules", ",").alias("matched_rules"))
    rows = best.join(owners, "id", "left").withColumn("file_id", F.coalesce("file_id", "id")).join(links, "file_id", "left")
    return rows.select("id", "entity_type", "kind", "label", "path", "status", "source_of_truth", "updated_at", *scores, F.coalesce("matched_rules", F.lit("")).alias("matched_rules"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """One usable vector per chunk id: the smallest ``vec_id`` of the main model."""
    v = table(spark, d, "vectors").where("model = 'ctx-embed-base-v2' and size(vector) = 128 and not exists(vector, x -> isnan(x) or x is null)")
    return v.groupBy("id").agg(F.min_by("vector", "vec_id").alias("vector"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    asked = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("asked")))
    return e.crossJoin(asked).select("vec_id", F.round(T.cosine(F.col("embedding"), F.col("asked")), 6).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)


def hybrid_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """A search with words and with the vector of one chunk as the query's vector."""
    cands, deg, found = _search_frames(spark, d)
    vectors = _vectors(spark, d)
    first = vectors.orderBy("id").limit(1).collect()
    asked = list(first[0]["vector"]) if first else None
    return S.search(cands, deg, QUERY, REFERENCE, top_k=10, vectors=vectors, query_vector=asked, **found).select(
        "id", F.round("score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"), F.round("embedding_score", 6).alias("embedding_score"))


def recency_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.files(spark, d).select("id", F.round(T.recency(F.col("updated_at"), REFERENCE), 8).alias("recency"))


def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of every file, counted, and a hash of them in order."""
    toks = F.col("toks")
    return C.files(spark, d).select("id", F.array_sort(T.tokens(F.col("content"))).alias("toks")).select("id", F.size(toks).alias("n_tokens"), F.md5(F.array_join(toks, " ")).alias("tokens_hash"))


def structural_boosts(spark: SparkSession, d: str) -> DataFrame:
    words = T.expand(T.query_tokens(QUERY))
    e = C.entities(spark, d)
    return e.select("id", F.round(T.structural_boost(F.col("path"), F.col("label"), F.col("kind"), words, QUERY), 6).alias("boost")).where("boost <> 0")


def data_access_boosts(spark: SparkSession, d: str) -> DataFrame:
    q = "impact of changing the stored procedure connection string"
    words = T.expand(T.query_tokens(q))
    e = C.entities(spark, d)
    return e.select("id", F.round(T.data_access_boost(F.col("entity_type"), F.col("kind"), F.col("path"), words, q), 6).alias("boost")).where("boost <> 0")


def _seed(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(spark, d).where("status = 'active'").agg(F.min("id").alias("id"))


def _related(depth: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = G.walk(C.all_relations(spark, d), _seed(spark, d), depth).where("hops > 0")
        return out.select("id", F.col("hops").cast("int").alias("hops"))

    return run


def related_edges(spark: SparkSession, d: str) -> DataFrame:
    rels = C.all_relations(spark, d)
    return G.traversed(rels, G.walk(rels, _seed(spark, d), 2), 2)


def _impact(profile: str, sort_by: str, **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rels, ents = C.all_relations(spark, d), C.entities(spark, d)
        out = G.impact(rels, _seed(spark, d), ents, C.degrees(rels), depth=3, profile=profile, sort_by=sort_by, top_k=20, catalog=C.catalog(spark, d), **options)
        return out.select("id", "hops", F.array_join("domains", ",").alias("domains"), F.round("impact_score", 4).alias("impact_score"), F.round("graph_score", 4).alias("graph_score"), F.round("trust_score", 4).alias("trust_score"))

    return run


def _walk_sql(depth: int, kinds: str = "") -> str:
    hops = []
    for i in range(1, depth + 1):
        seen = " union all ".join(f"select id from h{j}" for j in range(i))
        hops.append(f"h{i} as (select distinct b.nxt id from h{i-1} join both_ways b on b.src = h{i-1}.id where b.nxt not in ({seen}))")
    all_hops = " union all ".join(f"select id, {i} hops from h{i}" for i in range(1, depth + 1))
    return f"""both_ways as (select from_id src, to_id nxt from rels {kinds} union all select to_id, from_id from rels {kinds}),
        h0 as (select {SEED_SQL} id), {", ".join(hops)}, found as ({all_hops})"""


def _impact_sql(order: str) -> str:
    kinds = "where relation in ('CALLS', 'CALLS_SQL', 'IMPORTS', 'USES_CONFIG_KEY', 'USES_RESOURCE_KEY', 'USES_SETTING_KEY', 'USES_CONFIG', 'TRANSFORMS_CONFIG', 'PART_OF')"
    return f"""with {X.ALL}, {_walk_sql(3, kinds)},
        scored as (select f.id, f.hops, coalesce(e.entity_type, 'Unknown') typ, lower(coalesce(e.kind, '')) kind, lower(coalesce(e.path, '')) path,
                   least(1.0::double, coalesce(d.degree, 0) / 4.0::double) g, case when e.trust_level is not null then greatest(0.0::double, least(1.0::double, e.trust_level / 100.0::double)) else 0.5::double end t
                   from found f left join (select id, entity_type, kind, path, trust_level, "text" from ents union all select id, 'File', '', path, null, '' from files where id not in (select id from ents)) e using (id) left join degree d using (id)),
        doms as (select *, (kind in ('procedure', 'view', 'function', 'table', 'trigger') or path like '%.sql') s,
                 (kind in ('connection_string', 'database_target', 'app_setting') or path like '%.config') c from scored)
        select id, hops, concat_ws(',', case when s then 'sql' end, case when c then 'config' end, case when not s and not c and typ in ('File', 'Chunk', 'Module') then 'code' end) domains,
               round(round(0.55::double / (1 + hops) + g * 0.2::double + t * 0.15::double, 4), 4) impact_score, round(g, 4) graph_score, round(t, 4) trust_score
        from doms order by {order} limit 20"""


def _profile_sql(kinds: tuple[str, ...], boost: str, order: str, where: str, query: str = "") -> str:
    """Impact by a profile whose boost depends on domains only; notes of its relations hold no word of the query."""
    words = T.expand(T.query_tokens(query))
    lex = X.sql_lexical('"text"', X.sql_tokens('"text"'), words, query) if query else "0.0::double"
    return f"""with {X.ALL}, {_walk_sql(3, f"where relation in {kinds}")},
        base as (select f.id, f.hops, coalesce(e.entity_type, 'Unknown') typ, lower(coalesce(e.kind, '')) kind, lower(coalesce(e.path, '')) path, coalesce({lex}, 0.0::double) sem,
                 least(1.0::double, coalesce(d.degree, 0) / 4.0::double) g, case when e.trust_level is not null then greatest(0.0::double, least(1.0::double, e.trust_level / 100.0::double)) else 0.5::double end t from found f left join (select id, entity_type, kind, path, trust_level, "text" from ents union all select id, 'File', '', path, null, '' from files where id not in (select id from ents)) e using (id) left join degree d using (id)),
        doms as (select *, (kind in ('procedure', 'view', 'function', 'table', 'trigger') or path like '%.sql') s, (kind in ('connection_string', 'database_target', 'app_setting') or path like '%.config') c from base),
        res as (select *, not s and not c and typ in ('File', 'Chunk', 'Module') k from doms)
        select id, hops, concat_ws(',', case when s then 'sql' end, case when c then 'config' end, case when k then 'code' end) domains,
               round(round(0.55::double / (1 + hops) + g * 0.2::double + t * 0.15::double + sem * 0.1::double, 4) + round({boost}, 4), 4) impact_score, round(g, 4) graph_score, round(t, 4) trust_score
        from res where {where} order by {order} limit 20"""


def scored_sql(query: str = QUERY, where: str = "", tier: str = "", vectors: str = "", whole: bool = False) -> str:
    """The scored candidates as SQL: ``tier`` is an expression that splits the percentiles, ``vectors`` a relation
    ``(id, vec)`` whose row of the smallest id is the query's vector, ``whole`` takes all of a decision record's text."""
    views = X.ALL.replace("substr(content, 1, 12000) body", "content body") if whole else X.ALL
    words = T.expand(T.query_tokens(query))
    lex = X.sql_lexical('"text"', "toks", words, query)
    emb = f""", vecs as ({vectors}), asked as (select vec av from vecs order by id limit 1),
        embs as (select id, greatest(0.0::double, least(1.0::double, list_dot_product(vec, av) / (sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(av, av))))) emb from vecs, asked)""" if vectors else ""
    joined = "lexed0.*, coalesce(emb, 0.0::double) emb from lexed0 left join embs using (id)" if vectors else "*, 0.0::double emb from lexed0"
    return f"""with {views},
    cands as (select e.*, coalesce(d.degree, 0) degree, {tier or "''"} tier from ents e left join degree d using (id) where lower(status) <> 'deprecated' {where}),
    ranked as (select *, (rank() over (partition by tier, entity_type order by degree) - 1 + count(*) over (partition by tier, entity_type order by degree range between unbounded preceding and current row))
               / (2.0::double * count(*) over (partition by tier, entity_type)) g from cands),
    lexed0 as (select *, {lex} lex from (select *, {X.sql_tokens('"text"')} toks from ranked)){emb},
    lexed as (select *, case when emb > 0 then emb * 0.75::double + lex * 0.25::double else lex end sem from (select {joined})),
    parts as (select *, {X.sql_structural(words)} st, {X.sql_recency('updated_at', REFERENCE)} rec,
              case when regexp_matches(path, '(^|/)(tests?|__tests__)/') or regexp_matches(path, '\\.(test|spec)\\.[^.]+$')
                   then case when sem >= 0.5 and lex >= 0.4 then 0.07::double when sem >= 0.4 and lex >= 0.25 then 0.04::double else 0.0::double end else 0.0::double end ev
              from lexed where lex >= 0.05 or emb >= 0.2),
    scored as (select *, sem * 0.4::double + g * 0.25::double * least(1.0::double, greatest(sem, st) * 0.85::double + 0.15::double)
               + greatest(0.0::double, least(1.0::double, trust_level / 100.0::double)) * 0.2::double * least(1.0::double, greatest(sem, st) * 0.85::double + 0.15::double)
               + rec * 0.15::double * least(1.0::double, greatest(sem, st) * 0.85::double + 0.15::double) + st + ev + case when source_of_truth then sem * 0.1::double else 0.0::double end score from parts)"""


def top_sql(k: int, by: str = "") -> str:
    """The diverse top ``k`` of ``scored``, of each ``by`` if given."""
    part = f"partition by {by} " if by else ""
    more = f"{by}, " if by else ""
    return f""",
        pool0 as (select *, row_number() over ({part}order by score desc, id, path) r from scored),
        pool as (select *, row_number() over (partition by {more}case when path <> '' then path else id end order by score desc, id, path) n from pool0 where r <= {3 * k}),
        best as (select *, row_number() over ({part}order by score - least(0.12::double, (n - 1) * 0.04::double) desc, score desc, id, path) place from pool qualify place <= {k})"""


RULES_SQL = """, l as (select to_id id, from_id r, ord from stored where relation = 'CONSTRAINS' union all select from_id, to_id, ord from stored where relation = 'IMPLEMENTS'),
        m as (select id file_id, string_agg(r, ',' order by ord, r) rules from l group by 1)"""
_VECTORS = "select id, arg_min(vector, vec_id)::double[] vec from vectors where model = 'ctx-embed-base-v2' and len(vector) = 128 and not list_bool_or(list_transform(vector, lambda x: isnan(x) or x is null)) and id is not null group by id"

QUERIES = {
    "entity_union": entity_union, "entity_candidates": entity_candidates, "part_of_edges": part_of_edges, "relation_union": relation_union,
    "dangling_edge_filter": dangling_edge_filter, "degree": degree, "top_connected": top_connected, "rule_links": rule_links,
    "relation_signals": relation_signals, "midrank_by_type": midrank_by_type, "catalog": catalog, "node_edge_counts": node_edge_counts,
    "rules_by_scope": rules_by_scope, "adr_shadowing": adr_shadowing, "search_index_heads": search_index_heads, "lexical_search_topk": lexical_search_topk, "search_scores": search_scores,
    "search_explain": search_explain, "cosine_topk": cosine_topk, "hybrid_search_topk": hybrid_search_topk, "recency_scores": recency_scores,
    "text_tokens": text_tokens, "structural_boosts": structural_boosts, "data_access_boosts": data_access_boosts,
    "related_depth1": _related(1), "related_depth2": _related(2), "related_depth3": _related(3), "related_edges": related_edges,
    "impact_topk": _impact("all", "impact_score"), "impact_shortest_path": _impact("all", "shortest_path"), "impact_graph_score": _impact("all", "graph_score"),
    "impact_trust_score": _impact("all", "trust_score"), "impact_code_only": _impact("code_only", "impact_score", query="retry tracker", must_exclude=["IMPORTS"]),
    "impact_sql_only": _impact("sql_only", "semantic_score", query="retry tracker", entity_types=["File", "Chunk"]),
    "impact_config": _impact("config_only", "impact_score", result_domains=["config", "code"]),
}

SQL = {
    "entity_union": f"with {X.ALL} select id, entity_type, kind, \"label\", path, status, source_of_truth, trust_level, updated_at, md5(\"text\") text_hash, md5(snippet) snippet_hash from ents",
    "entity_candidates": f"with {X.ALL} select entity_type, count(*) n from ents where lower(status) <> 'deprecated' group by 1",
    "part_of_edges": f"with {X.CHUNKS}, {X.PART_OF} select * from part_of",
    "relation_union": f"with {X.ALL} select distinct from_id, relation, to_id, note from rels",
    "dangling_edge_filter": f"with {X.ALL} select relation, count(*) n, count(*) filter (from_id in (select id from ents union select id from files) and to_id in (select id from ents union select id from files)) kept from stored group by 1",
    "degree": f"with {X.ALL} select * from degree",
    "top_connected": f"with {X.RELATIONS} select id, count(*) degree from (select from_id id from stored union all select to_id from stored) group by id order by 2 desc, 1 limit 5",
    "rule_links": f"""with {X.RELATIONS}, l as (select to_id id, from_id r, ord from stored where relation = 'CONSTRAINS' union all select from_id, to_id, ord from stored where relation = 'IMPLEMENTS')
        select id, string_agg(r, ',' order by ord, r) rules from l group by id""",
    "relation_signals": f"""with {X.ALL}, labels as (select id, case when entity_type = 'Module' and "label" = '' then path else "label" end lab from ents union select id, path from files),
        s as (select r.*, coalesce(a.lab, from_id) src, coalesce(b.lab, to_id) tgt from stored r left join labels a on a.id = from_id left join labels b on b.id = to_id where relation in ('CALLS', 'IMPORTS')),
        l as (select from_id id, ord, 0 side, concat_ws(' ', lower(relation), nullif(note, ''), tgt) line from s union all select to_id, ord, 1, concat_ws(' ', 'affected_by', lower(relation), nullif(note, ''), src) from s)
        select id, md5(string_agg(line, chr(10) order by ord, side, line)) signals_hash from l group by id""",
    "midrank_by_type": f"""with {X.ALL}, c as (select e.id, entity_type, coalesce(degree, 0) degree from ents e left join degree using (id) where lower(status) <> 'deprecated')
        select id, entity_type, degree, round((rank() over w - 1 + count(*) over (partition by entity_type order by degree range between unbounded preceding and current row)) / (2.0::double * count(*) over (partition by entity_type)), 6) graph_score
        from c window w as (partition by entity_type order by degree)""",
    "catalog": f"""with {X.ALL} select id, 'File' "type", path "label", path, status, source_of_truth from files union all select id, 'Rule', title, '', status, source_of_truth from ruleset
        union all select c.id, 'Chunk', name, coalesce(f.path, ''), c.status, c.source_of_truth from pieces c left join files f on f.id = c.file_id
        union all select id, 'ADR', title, path, 'active', true from records
        union all select id, 'Module', coalesce(nullif(name, ''), path), path, status, source_of_truth from mods""",
    "node_edge_counts": f"with {X.ALL}, k as (select 'File' t from files union all select 'Rule' from ruleset union all select 'Chunk' from pieces union all select 'Module' from mods union all select 'ADR' from records) select t \"name\", count(*) n from k group by 1 union all select relation, count(*) from rels group by 1",
    "rules_by_scope": f"with {X.RULES} select id, title, \"scope\", priority, status from ruleset where \"scope\" in ('api', 'global') and status = 'active'",
    "adr_shadowing": f"with {X.FILES}, {X.ADRS} select id, kind from files where not (kind = 'ADR' and lower(trim(path)) in (select lower(trim(path)) from records))",
    "lexical_search_topk": scored_sql() + top_sql(20) + " select id, entity_type, path, round(score, 6) score, round(lex, 6) lexical_score from best",
    "search_scores": scored_sql() + " select id, round(lex, 9) lexical_score, round(g, 9) graph_score, round(score, 9) score from scored",
    "hybrid_search_topk": scored_sql(vectors=_VECTORS) + top_sql(10) + " select id, round(score, 6) score, round(sem, 6) semantic_score, round(emb, 6) embedding_score from best",
    "search_explain": scored_sql() + top_sql(3) + """, l as (select to_id id, from_id r, ord from stored where relation = 'CONSTRAINS' union all select from_id, to_id, ord from stored where relation = 'IMPLEMENTS'),
        m as (select id file_id, string_agg(r, ',' order by ord, r) rules from l group by 1)
        select b.id, round(score, 6) score, round(g, 6) graph_score, coalesce(rules, '') rules from best b left join pieces p on p.id = b.id left join m on m.file_id = coalesce(p.file_id, b.id)""",
    "search_index_heads": f"with {X.ALL} select entity_type, count(*) n, sum(coalesce(degree, 0)) degrees from ents left join degree using (id) group by 1",
    "cosine_topk": """with q as (select embedding asked from embeddings where vec_id = 0),
        c as (select vec_id, list_dot_product(embedding::double[], asked::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(asked::double[], asked::double[]))) x from embeddings, q)
        select vec_id, round(x, 6) cosine from c order by 2 desc, 1 limit 10""",
    "recency_scores": f"with {X.FILES} select id, round({X.sql_recency('updated_at', REFERENCE)}, 8) recency from files",
    "text_tokens": f"with {X.FILES}, t as (select id, list_sort({X.sql_tokens('content')}) toks from files) select id, len(toks) n_tokens, md5(array_to_string(toks, ' ')) tokens_hash from t",
    "structural_boosts": f"with {X.ALL}, b as (select id, round({X.sql_structural(T.expand(T.query_tokens(QUERY)))}, 6) boost from ents) select * from b where boost <> 0",
    "data_access_boosts": f"""with {X.ALL}, b as (select id, round(case when entity_type = 'Chunk' then case when kind in ('connection_string', 'database_target') then 0.24 when kind = 'app_setting' then 0.2
            when kind in ('resource_entry', 'setting_entry') then 0.1 when kind in ('procedure', 'view', 'function', 'table', 'trigger') then 0.2 else 0 end
        when entity_type = 'File' then case when lower(path) like '%.sql' then 0.04 when lower(path) like '%.config' then 0.14 when lower(path) like '%.resx' or lower(path) like '%.settings' then 0.05 else 0 end else 0 end::double, 6) boost from ents) select * from b where boost <> 0""",
    **{f"related_depth{n}": f"with {X.ALL}, {_walk_sql(n)} select id, hops from found" for n in (1, 2, 3)},
    "related_edges": f"with {X.ALL}, {_walk_sql(2)}, inn as (select id from h0 union all select id from h1) select distinct from_id, to_id, relation, note from rels where from_id in (select id from inn) or to_id in (select id from inn)",
    "impact_config": _profile_sql(("USES_CONFIG_KEY", "USES_RESOURCE_KEY", "USES_SETTING_KEY", "USES_CONFIG", "TRANSFORMS_CONFIG", "PART_OF"), "case when c then 0.08::double else 0 end + 0.04::double", "impact_score desc, hops, id", "c or k"),
    "impact_sql_only": _profile_sql(("CALLS_SQL", "PART_OF"), "case when s then 0.14::double else 0 end", "sem desc, impact_score desc, hops, id", "typ in ('File', 'Chunk')", "retry tracker"),
    "impact_topk": _impact_sql("impact_score desc, hops, id"),
    "impact_shortest_path": _impact_sql("hops, impact_score desc, id"),
    "impact_graph_score": _impact_sql("graph_score desc, impact_score desc, hops, id"),
    "impact_trust_score": _impact_sql("trust_score desc, impact_score desc, hops, id"),
}
