"""Bounded walks over relations, and scores of what they reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .lineage import cut

# Relations that an impact walk follows, by profile.
PROFILES = {
    "all": ("CALLS", "CALLS_SQL", "IMPORTS", "USES_CONFIG_KEY", "USES_RESOURCE_KEY", "USES_SETTING_KEY", "USES_CONFIG", "TRANSFORMS_CONFIG", "PART_OF"),
    "config_only": ("USES_CONFIG_KEY", "USES_RESOURCE_KEY", "USES_SETTING_KEY", "USES_CONFIG", "TRANSFORMS_CONFIG", "PART_OF"),
    "config_to_sql": ("USES_CONFIG_KEY", "USES_RESOURCE_KEY", "USES_SETTING_KEY", "USES_CONFIG", "TRANSFORMS_CONFIG", "CALLS_SQL", "PART_OF"),
    "code_only": ("CALLS", "IMPORTS", "PART_OF"),
    "sql_only": ("CALLS_SQL", "PART_OF"),
}
STEP = "struct<relation: string, direction: string, note: string, via: string>"


def walk(relations: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Undirected walk from ``seeds(id)`` up to ``depth`` hops: first discovery of every node.

    Returns ``(seed, id, hops, path, steps)`` with the nodes and relations on the way. Of several ways to
    discover a node in one hop the one through the earliest discovered parent counts, outgoing before
    incoming, then in order of the relations. Each hop is one join of the frontier with the relations and
    one rank per node reached; only the frontier moves, and it is small against the relations.
    """
    edges = relations.select("from_id", "to_id", "relation", "note", "ord")
    both = edges.select(F.col("from_id").alias("_at"), F.col("to_id").alias("_next"), F.lit("outgoing").alias("_dir"), "relation", "note", "ord").unionByName(
        edges.select(F.col("to_id").alias("_at"), F.col("from_id").alias("_next"), F.lit("incoming").alias("_dir"), "relation", "note", "ord"))
    none = F.array().cast(f"array<{STEP}>")
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hops"), F.array("id").alias("path"), none.alias("steps"), F.array().cast("array<string>").alias("_rank")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(both, frontier["id"] == both["_at"]).select(
            "seed", F.col("_next").alias("id"), F.lit(hop).alias("hops"), F.concat("path", F.array("_next")).alias("path"),
            F.concat("steps", F.array(F.struct(F.col("relation"), F.col("_dir").alias("direction"), F.col("note"), F.col("_at").alias("via")).cast(STEP))).alias("steps"),
            F.concat("_rank", F.array(F.concat(F.when(F.col("_dir") == "outgoing", "0").otherwise("1"), F.lpad(F.col("ord").cast("string"), 20, "0"), F.col("_next")))).alias("_rank"),
        )
        fresh = reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        first = W.partitionBy("seed", "id").orderBy("_rank")
        frontier = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    return seen.drop("_rank")


def traversed(relations: DataFrame, visited: DataFrame, depth: int) -> DataFrame:
    """Relations with an end that the walk left from (fewer than ``depth`` hops away), each once."""
    inner = visited.where(F.col("hops") < depth).select("id").distinct()
    touch = relations.join(inner.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(
        relations.join(inner.withColumnRenamed("id", "to_id"), "to_id", "left_semi"))
    return touch.select("from_id", "to_id", "relation", "note").distinct()


def domains(entity_type: Column, kind: Column, path: Column) -> Column:
    """What an entity deals with: sql, config, resource, settings, project; else code for files, chunks, modules."""
    kind, path, typ = F.lower(kind), F.lower(path), F.lower(entity_type)
    resource = (kind == "resource_entry") | path.endswith(".resx")
    settings = (kind == "setting_entry") | path.endswith(".settings")
    config = kind.isin("connection_string", "database_target", "app_setting") | path.endswith(".config")
    sql = kind.isin(*T.SQL_KINDS) | path.endswith(".sql")
    some = sql | config | resource | settings
    return F.array_compact(F.array(
        F.when(sql, F.lit("sql")), F.when(config | resource | settings, F.lit("config")), F.when(resource, F.lit("resource")), F.when(settings, F.lit("settings")),
        F.when(typ == "project", F.lit("project")), F.when(~some & typ.isin("file", "chunk", "module"), F.lit("code")),
    ))


def profile_boost(profile: str, of: Column, relations: Column) -> Column:
    """Boost of a result for the profile of the question, from its domains and the relations on its path."""
    has = lambda d: F.array_contains(of, d)
    via = lambda *r: F.arrays_overlap(relations, F.array(*[F.lit(x) for x in r]))
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    keyed = via("USES_CONFIG_KEY", "USES_RESOURCE_KEY", "USES_SETTING_KEY", "USES_CONFIG")
    if profile == "config_to_sql":
        return plus(has("sql"), 0.18) + plus(has("config"), 0.04) + plus(via("CALLS_SQL"), 0.08) + plus(keyed & via("CALLS_SQL"), 0.08)
    if profile == "config_only":
        return plus(has("config"), 0.08) + plus(~via("CALLS_SQL", "CALLS"), 0.04)
    if profile == "sql_only":
        return plus(has("sql"), 0.14) + plus(via("CALLS_SQL"), 0.08)
    if profile == "code_only":
        return plus(has("code"), 0.08) + plus(via("CALLS", "IMPORTS"), 0.05)
    return plus(has("sql") & via("CALLS_SQL"), 0.04)


# Orders of results; ties end in the id.
SORTS = {
    "impact_score": ("-impact_score", "hops", "-semantic_score"), "shortest_path": ("hops", "-impact_score", "-semantic_score"),
    "semantic_score": ("-semantic_score", "-impact_score", "hops"), "graph_score": ("-graph_score", "-impact_score", "hops"),
    "trust_score": ("-trust_score", "-impact_score", "hops"),
}


def impact(relations: DataFrame, seeds: DataFrame, ents: DataFrame, degree: DataFrame, *, depth: int = 2, profile: str = "all", query: str = "",
           sort_by: str = "impact_score", top_k: int = 8, result_domains: list[str] | None = None, entity_types: list[str] | None = None,
           must_include: list[str] | None = None, must_exclude: list[str] | None = None, kinds: list[str] | None = None, preset: str = "full", catalog: DataFrame | None = None) -> DataFrame:
    """What a change of the seeds reaches, scored by hops, degree, trust, query and profile.

    Degrees are those over all relations, not only the followed ones. Nodes without an entity keep their
    place with type Unknown and trust 0.5. Scores are rounded to 4 places before they are added up. ``kinds``
    are the relations to follow instead of those of the profile; a ``preset`` without scores orders by hops.
    Nodes that no search returns, such as files that a decision record stands for, take type, title and path
    from ``catalog(id, type, label, path)``.
    """
    if preset != "full" and sort_by != "shortest_path":
        # Without scores in the response its comparator reads zeros, so the order falls back to hops and discovery.
        order_by = ("hops",)
    else:
        order_by = SORTS[sort_by]
    followed = relations.where(F.col("relation").isin(*(kinds or PROFILES[profile])))
    found = walk(followed, seeds, depth).where("hops > 0")
    words, phrase = T.expand(T.query_tokens(query)), query.strip().lower()
    semantic = T.lexical_score(F.col("text"), T.tokens(F.col("text")), words, phrase) if query else F.lit(0.0)
    note = F.array_join(F.filter(F.transform("steps", lambda s: F.trim(s["note"])), lambda n: n != ""), "\n")
    note_score = F.when(note != "", F.round(T.lexical_score(note, T.tokens(note), words, phrase), 4)).otherwise(0.0) if query else F.lit(0.0)
    rows = _impact_rows(found, ents, degree, semantic, note_score, catalog)
    rows = rows.withColumn("domains", domains(F.col("entity_type"), F.col("kind"), F.col("path")))
    rows = rows.withColumn("profile_score", F.round(profile_boost(profile, F.col("domains"), F.col("relations")), 4))
    base = F.round(F.lit(0.55) / (F.lit(1.0) + F.col("hops")) + F.col("graph_score") * 0.2 + F.col("trust_score") * 0.15 + F.col("semantic_score") * 0.1, 4)
    rows = rows.withColumn("impact_score", F.round(base + F.col("profile_score") + F.col("note_score") * 0.12, 4))
    texts = lambda v: F.array(*[F.lit(x) for x in v])
    if result_domains:
        rows = rows.where(F.arrays_overlap("domains", texts([d.lower() for d in result_domains])))
    if entity_types:
        rows = rows.where(F.lower("entity_type").isin(*[t.lower() for t in entity_types]))
    lower = F.transform("relations", F.lower)
    if must_include:
        rows = rows.where(F.size(F.array_except(texts([r.lower() for r in must_include]), lower)) == 0)
    if must_exclude:
        rows = rows.where(~F.arrays_overlap(lower, texts([r.lower() for r in must_exclude])))
    order = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order_by]
    return rows.orderBy(*order, "id").limit(top_k)


def _impact_rows(found: DataFrame, ents: DataFrame, degree: DataFrame, semantic: Column, note_score: Column, catalog: DataFrame | None = None) -> DataFrame:
    """Reached nodes with their entity, degree and plain scores."""
    reached = found.withColumnRenamed("path", "nodes").join(ents, "id", "left").join(degree, "id", "left")
    if catalog is None:
        reached = reached.withColumns({"_type": F.lit(None).cast("string"), "_label": F.lit(None).cast("string"), "_path": F.lit(None).cast("string")})
    else:
        reached = reached.join(catalog.select("id", F.col("type").alias("_type"), F.col("label").alias("_label"), F.col("path").alias("_path")), "id", "left")
    trust = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_level") / 100))
    return reached.select(
        "seed", "id", F.coalesce("entity_type", "_type", F.lit("Unknown")).alias("entity_type"), F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("label", "_label", "id").alias("title"), F.coalesce("path", "_path", F.lit("")).alias("path"), "hops", "nodes", "steps",
        F.transform("steps", lambda s: s["relation"]).alias("relations"), F.coalesce(semantic, F.lit(0.0)).alias("semantic_score"),
        F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 4).alias("graph_score"),
        F.when(F.col("trust_level").isNotNull(), trust).otherwise(0.5).alias("trust_score"), note_score.alias("note_score"),
    )


def ancestors(nodes: DataFrame, child: str, parent: str, depth: int = 32) -> DataFrame:
    """``(start, ancestor, distance)``: every node with the nodes above it, up to ``depth`` steps; circles stop there."""
    up = nodes.where(F.col(parent).isNotNull()).select(F.col(child).alias("_c"), F.col(parent).alias("_p"))
    step = up.select(F.col("_c").alias("start"), F.col("_p").alias("ancestor"), F.lit(1).alias("distance"), F.array("_c").alias("_seen"))
    out = step
    for i in range(2, depth + 1):
        step = cut(step.join(up, step["ancestor"] == up["_c"]).where(~F.array_contains("_seen", F.col("_p"))).select(
            "start", F.col("_p").alias("ancestor"), F.lit(i).alias("distance"), F.concat("_seen", F.array("_c")).alias("_seen")))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.drop("_seen")
