"""Queries on seeds, presets and wording of responses, evaluation of query packs, and two-pass retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import present as P
from ..operators import search as S
from ..operators import twopass as TP
from ..sources.tables import table
from . import context as C
from . import search_queries as SQ
from . import sqltext as X

SEED_QUERY = "retry tracker snapshot"


def seed_by_search(spark: SparkSession, d: str) -> DataFrame:
    """The seed of a question in words: the best result of a search for it, with at least five looked at."""
    index = C.search_index(spark, d)
    return S.search(C.candidates(index.heads), None, SEED_QUERY, SQ.REFERENCE, top_k=8, found=index.matches(S.asked_words(SEED_QUERY), SEED_QUERY)).orderBy(F.desc("score"), "id", "path").limit(1).select("id", F.round("score", 6).alias("score"))


def _impact(spark: SparkSession, d: str, **options) -> DataFrame:
    rels, ents = C.all_relations(spark, d), C.entities(spark, d)
    seed = SQ._seed(spark, d)
    nodes = C.catalog(spark, d)
    out = G.impact(rels, seed, ents, C.degrees(rels), depth=3, top_k=12, catalog=nodes, **options)
    return P.impact_response(out, nodes, preset=options.get("preset", "full"))


def impact_paths(spark: SparkSession, d: str) -> DataFrame:
    """Impact with the nodes on the way and the wording of its path, for answers one step away."""
    out = _impact(spark, d, sort_by="shortest_path")
    return out.where("hops = 1").select("id", "path_summary", "why", F.array_join("path_entities", " > ").alias("nodes"), F.size("path_edges").alias("n_edges"))


def impact_minimal(spark: SparkSession, d: str) -> DataFrame:
    """The minimal response: no scores, so results are ordered by hops."""
    return _impact(spark, d, preset="minimal").select("id", "hops", "path_summary")


def impact_reasons(spark: SparkSession, d: str) -> DataFrame:
    out = _impact(spark, d, sort_by="impact_score")
    return out.select("id", F.array_join("top_reasons", "; ").alias("reasons"))


def impact_listed_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A walk over relations that are listed instead of those of a profile."""
    rels = C.all_relations(spark, d).where(F.col("relation").isin("PART_OF", "DEFINES"))
    return G.walk(rels, SQ._seed(spark, d), 2).where("hops > 0").select("id", F.col("hops").cast("int").alias("hops"))


def related_steps(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in one step with how they were met, and a stub for ids that no entity has."""
    out = G.walk(C.all_relations(spark, d), SQ._seed(spark, d), 1).where("hops = 1")
    names = C.catalog(spark, d).select("id", "type", "label")
    step = F.element_at("steps", -1)
    return out.join(names, "id", "left").select("id", F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("label", "id").alias("label"), step["direction"].alias("direction"), step["relation"].alias("relation"))


def search_compact(spark: SparkSession, d: str) -> DataFrame:
    """A response of the compact preset: rules that hold, but no scores."""
    best = SQ.search_with_rules(spark, d, 5)
    return P.shown(best, "search", "compact")


def search_full_content(spark: SparkSession, d: str) -> DataFrame:
    """A response of the minimal preset whose scores are asked for."""
    return P.shown(SQ.search_with_rules(spark, d, 5), "search", "minimal", scores=True)


def _packs(spark: SparkSession, d: str):
    items = table(spark, d, "eval_items").where("query <> ''").select(F.col("item_id").cast("string").alias("query_id"), "pack", "category", "query", "expected_hits", "must_keep")
    # The packs are a short list that does not grow with the corpus.
    queries = [(r["query_id"], r["query"]) for r in items.select("query_id", "query").collect()]
    index = C.search_index(spark, d)
    results = E.search_many(index, C.candidates(index.heads), queries, SQ.REFERENCE, 10)
    return items, results


def pack_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten best results of every query of the packs, with their ranks."""
    return _packs(spark, d)[1].select("query_id", "id", F.round("score", 6).alias("score"))


def pack_recall(spark: SparkSession, d: str) -> DataFrame:
    """Expected hits that the searches of a pack find: totals, by symbol and by path, and recall."""
    items, results = _packs(spark, d)
    expected = items.select("query_id", "pack", F.explode("expected_hits").alias("hit"))
    matched = E.match_hits(results, expected).join(expected.select("query_id", "hit", "pack").distinct(), ["query_id", "hit"])
    return E.summary(matched, ["pack"])


def primary_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the hits that must be kept, and of definitions, with the first rank of each category."""
    items, results = _packs(spark, d)
    expected = items.where("must_keep").select("query_id", "category", F.explode("expected_hits").alias("hit"))
    matched = E.match_hits(results, expected).join(expected.distinct(), ["query_id", "hit"])
    return E.summary(matched, ["category"])


def result_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of the results of one search, from 1."""
    from pyspark.sql import Window as W

    best = SQ.search_with_rules(spark, d, 10)
    return best.select("id", F.row_number().over(W.orderBy(F.desc("score"), "id", "path")).alias("rank"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """Heads for the second pass: entities with name, signature, and the kind of their file."""
    f = C.files(spark, d)
    owner = f.select(F.col("id").alias("file_id"), F.col("path").alias("path"), F.col("kind").alias("owner_kind"))
    chunks = C.chunks(spark, d).join(owner, "file_id", "left").select("id", F.lit("Chunk").alias("entity_type"), F.coalesce("owner_kind", F.lit("")).alias("owner_kind"), "kind", "language", F.coalesce("path", F.lit("")).alias("path"), "name", "signature", "exported")
    none = lambda c: F.lit("").alias(c)
    files = f.select("id", F.lit("File").alias("entity_type"), F.col("kind").alias("owner_kind"), none("k"), none("l"), "path", none("n"), none("s"), F.lit(False).alias("exported")).toDF(*chunks.columns)
    mods = C.modules(spark, d).select("id", F.lit("Module").alias("entity_type"), none("o"), none("k"), none("l"), "path", "name", none("s"), F.lit(False).alias("exported")).toDF(*chunks.columns)
    return chunks.unionByName(files).unionByName(mods)


def multi_seed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Walks of two steps from three chunks at once, with the role of what each meets."""
    rels = C.stored_relations(spark, d)
    seeds = rels.where("relation = 'CALLS'").select(F.col("from_id").alias("id")).distinct().orderBy("id").limit(3)
    return TP.traverse(rels, seeds, _heads(spark, d)).groupBy("seed", "path", "relation", "direction").agg(F.min("distance").cast("int").alias("distance"))


def query_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Words and named symbols of every query of the packs."""
    items = table(spark, d, "eval_items").where("query <> ''").select("item_id", "query")
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"
    found = F.array_distinct(F.filter(F.regexp_extract_all("query", F.lit(rf"({name}(?:(?:\.|::){name})*)"), F.lit(1)), lambda c: c.rlike(r"[a-z][A-Z]|[A-Z].*[A-Z]|_|::") & (F.length(c) >= 4)))
    return items.select("item_id", F.array_join(F.array_sort(TP.terms(F.col("query"))), " ").alias("terms"), F.array_join(found, " ").alias("symbols"))


def two_pass(spark: SparkSession, d: str) -> DataFrame:
    """Both passes for a question that names a function: definitions, graph evidence and the second ranking, in lanes."""
    heads, rels = _heads(spark, d), C.stored_relations(spark, d)
    seed = rels.where("relation = 'CALLS'").join(heads.where("owner_kind = 'CODE' and entity_type = 'Chunk'").select(F.col("id").alias("from_id"), "name"), "from_id").where("name rlike '[a-z][A-Z]'").agg(F.min("name").alias("n")).first()["n"]
    if seed is None:
        return spark.createDataFrame([], "lane string, place int, source string, id string, path string")
    query = f"Why does {seed} drop the tracker snapshot when the ledger retries the module?"
    index = C.search_index(spark, d)
    base = S.search(C.candidates(index.heads), None, query, SQ.REFERENCE, top_k=5, found=index.matches(S.asked_words(query), query.lower()))
    baseline = list(dict.fromkeys(r["path"] for r in base.orderBy(F.desc("score"), "id").collect() if r["path"]))
    return TP.retrieve(heads, index.texts, rels, query, baseline)


QUERIES = {f.__name__: f for f in (seed_by_search, impact_paths, impact_minimal, impact_reasons, impact_listed_kinds, related_steps, search_compact, search_full_content, pack_search, pack_recall, primary_recall, result_ranks,
                                   multi_seed_evidence, query_symbols, two_pass)}

_LABELS = "labels as (select id, \"label\" from ents where \"label\" <> '' union select id, path from files)"
_ONE = f"with {X.ALL}, seed as (select {SQ.SEED_SQL} id), kinds as (select * from rels where relation in ('CALLS', 'CALLS_SQL', 'IMPORTS', 'PART_OF'))"
_STOPPED = X.sql_list(TP.STOP)


def _terms(x: str) -> str:
    s = rf"regexp_replace(regexp_replace({x}, '([a-z\d])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return rf"list_distinct(list_filter(string_split_regex(lower({s}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 and not list_contains({_STOPPED}, w)))"


_QW = f"""{X.ALL}, qs as (select item_id::varchar query_id, pack, category, query, expected_hits, must_keep, lower(trim(query)) phrase, {X.sql_tokens('query')} words from eval_items where query <> ''),
    toks as (select *, {X.sql_tokens('"text"')} toks, {X.sql_tokens('path')} pt, {X.sql_tokens(X.sql_basename('path'))} bt, {X.sql_tokens('"label"')} lt, {X.sql_tokens('kind')} kt, lower("text") low,
             (rank() over (partition by entity_type order by deg) - 1 + count(*) over (partition by entity_type order by deg range between unbounded preceding and current row)) / (2.0::double * count(*) over (partition by entity_type)) g,
             {X.sql_recency('updated_at', SQ.REFERENCE)} rec from (select e.*, coalesce(d.degree, 0) deg from ents e left join degree d using (id) where lower(status) <> 'deprecated')),
    hitp as (select query_id, id, count(*) n from (select query_id, unnest(words) w from qs) join (select id, unnest(toks) w from toks) using (w) group by 1, 2),
    lexp as (select h.query_id, h.id, least(1.0::double, n / len(words)::double * 0.85::double + case when contains(low, phrase) then 0.15::double else 0.0::double end) lex from hitp h join qs using (query_id) join toks using (id)),
    bst as (select l.query_id, l.id, lex, t.path, t."label", t.g, t.rec, t.trust_level, t.source_of_truth,
            least(0.2::double, least(0.1::double, len(list_intersect(u, pt)) * 0.035::double) + least(0.08::double, len(list_intersect(u, bt)) * 0.06::double) + least(0.08::double, len(list_intersect(u, lt)) * 0.04::double) + least(0.03::double, len(list_intersect(u, kt)) * 0.02::double)) st,
            case when regexp_matches(t.path, '(^|/)(tests?|__tests__)/') or regexp_matches(t.path, '\\.(test|spec)\\.[^.]+$') then case when lex >= 0.5 then 0.07::double when lex >= 0.4 then 0.04::double else 0.0::double end else 0.0::double end ev
            from lexp l join toks t using (id) join (select query_id, list_filter(words, lambda w: length(w) >= 3 and not list_contains({X.sql_list(sorted(T.STRUCTURE_STOP))}, w)) u from qs) q on q.query_id = l.query_id where lex >= 0.05),
    scored as (select *, lex * 0.4::double + (g * 0.25::double + greatest(0.0::double, least(1.0::double, trust_level / 100.0::double)) * 0.2::double + rec * 0.15::double) * least(1.0::double, greatest(lex, st) * 0.85::double + 0.15::double)
               + st + ev + case when source_of_truth then lex * 0.1::double else 0.0::double end score from bst)"""
_PACK = "with " + _QW + SQ.top_sql(10, "query_id") + """, res as (select query_id, id, path, "label", score, row_number() over (partition by query_id order by score desc, id, path) rank from best)"""
_MATCH = r""", want as (select query_id, {c}, unnest(expected_hits) hit from qs {w}), m as (select w.query_id, {c}, hit, min(r.rank) rank from (select *, regexp_replace(hit, '^(file|chunk):', '') p from want) w
        left join res r on r.query_id = w.query_id and (r.path = p or regexp_replace(r.id, '^(file|chunk):', '') = p or starts_with(regexp_replace(r.id, '^(file|chunk):', ''), p || ':')) group by all)
        select {c}, count(distinct query_id) queries, count(*) expected, count(rank) found, count(*) - count(rank) missing, 0 symbol_matches, count(rank) path_only, round(count(rank) / count(*)::double * 100, 2) recall_pct, min(rank) first_rank from m group by 1"""

SQL = {
    "seed_by_search": SQ.scored_sql() + SQ.top_sql(8) + " select id, round(score, 6) score from best order by score desc, id limit 1",
    "impact_listed_kinds": f"with {X.ALL}, {SQ._walk_sql(2, '''where relation in ('PART_OF', 'DEFINES')''')} select id, hops from found",
    "impact_paths": _ONE + f""", {_LABELS}, n1 as (select k.*, case when from_id = s.id then to_id else from_id end id, case when from_id = s.id then 0 else 1 end dir, ord from (select r.*, o.ord from kinds r left join (select from_id, to_id, relation, min(ord) ord from stored group by all) o using (from_id, to_id, relation)) k, seed s where (from_id = s.id) <> (to_id = s.id)),
        f as (select *, row_number() over (partition by id order by dir, coalesce(ord, 1::bigint << 60)) r from n1), w as (select f.*, s.id sid, coalesce(a."label", s.id) sl, coalesce(b."label", f.id) tl from f cross join seed s left join labels a on a.id = s.id left join labels b on b.id = f.id where r = 1)
        select id, sl || ' -[' || relation || case when note <> '' then '(' || note || ')' else '' end || ']-> ' || tl path_summary, tl || ' is impacted from ' || sl || ' via ' || lower(replace(relation, '_', ' ')) || case when trim(note) <> '' then ' (' || trim(note) || ')' else '' end || ' in 1 hop.' why,
               sid || ' > ' || id nodes, 1 n_edges from w""",
    "related_steps": f"""with {X.ALL}, seed as (select {SQ.SEED_SQL} id), n1 as (select r.*, case when from_id = s.id then to_id else from_id end nid, case when from_id = s.id then 'outgoing' else 'incoming' end dir, o.ord
            from rels r left join (select from_id, to_id, relation, note, min(ord) ord from stored group by all) o using (from_id, to_id, relation, note), seed s where (from_id = s.id) <> (to_id = s.id)),
        f as (select *, row_number() over (partition by nid order by dir = 'incoming', coalesce(ord, 1::bigint << 60)) r from n1)
        select nid id, coalesce(e.entity_type, 'Unknown') "type", coalesce(case when e.entity_type = 'Module' and e."label" = '' then e.path else e."label" end, nid) "label", dir direction, relation from f left join (select id, entity_type, "label", path from ents union select id, 'File', path, path from files) e on e.id = nid where r = 1""",
    "search_compact": SQ.scored_sql(whole=True) + SQ.top_sql(5) + SQ.RULES_SQL + """ select b.id, entity_type, b.kind, "label", path, b.status, b.source_of_truth, b.updated_at, coalesce(rules, '') matched_rules from best b left join pieces p on p.id = b.id left join m on m.file_id = coalesce(p.file_id, b.id)""",
    "search_full_content": SQ.scored_sql(whole=True) + SQ.top_sql(5) + """ select id, entity_type, kind, "label", path, status, source_of_truth, updated_at, round(score, 6) score, round(sem, 6) semantic_score, round(emb, 6) embedding_score, round(lex, 6) lexical_score, round(g, 6) graph_score from best""",
    "result_ranks": SQ.scored_sql(whole=True) + SQ.top_sql(10) + " select id, row_number() over (order by score desc, id, path) rank from best",
    "pack_search": _PACK + " select query_id, id, round(score, 6) score from res",
    "pack_recall": _PACK + _MATCH.format(c="pack", w=""), "primary_recall": _PACK + _MATCH.format(c="category", w="where must_keep"),
    "query_symbols": f"""select item_id, array_to_string(list_sort({_terms('query')}), ' ') terms,
        array_to_string(list_filter(list_distinct(regexp_extract_all(query, '([A-Za-z_$][A-Za-z0-9_$]*(?:(?:\\.|::)[A-Za-z_$][A-Za-z0-9_$]*)*)', 1)), lambda c: regexp_matches(c, '[a-z][A-Z]|[A-Z].*[A-Z]|_|::') and length(c) >= 4), ' ') symbols from eval_items where query <> ''""",
    "multi_seed_evidence": f"""with {X.ALL}, seeds as (select distinct from_id id from stored where relation = 'CALLS' order by 1 limit 3), us as (select from_id, to_id, relation from stored where relation in {TP.PRIORITY}),
        bw as (select from_id a, to_id b, 'outgoing' direction, relation from us union all select to_id, from_id, 'incoming', relation from us),
        s1 as (select s.id seed, b id, direction, relation, 1 distance from seeds s join bw on a = s.id), f1 as (select distinct seed, id from s1 where id <> seed), s2 as (select f1.seed, b id, direction, relation, 2 distance from f1 join bw on a = f1.id),
        hd as (select c.id, coalesce(f.path, '') path from pieces c left join files f on f.id = c.file_id union all select id, path from files union all select id, path from mods),
        al as (select x.*, path from (select * from s1 union all select * from s2) x join hd using (id) where path <> '' and not list_has_any(string_split(path, '/'), {X.sql_list(TP.EXCLUDED)}))
        select seed, path, relation, direction, min(distance) distance from al group by 1, 2, 3, 4""",
}
