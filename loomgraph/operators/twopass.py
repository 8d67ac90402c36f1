"""Two-pass retrieval: definitions of what a query names, graph evidence around them, anchors, and a second ranking within the anchors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import stats as ST
from .lineage import cut

# Words that say nothing, order and roles of relations, names of life-cycle functions, paths, limits.
STOP = """a about all also an and any are as at be been but by can currently does during each example for from had has have how i if in into is it its must not of on only or other our should so some than
    that the their them then there these they this those through to under use used user users using want when where which who will with without""".split()
PRIORITY = ("CALLS", "EXPORTS", "IMPORTS", "DEFINES", "CONTAINS", "CONTAINS_MODULE", "INCLUDES_FILE")
LIFECYCLE = r"(?:^|[._-])(?:create|dispose|init|initialize|invoke|load|open|register|save|setup|start|stop|teardown|unregister)(?:$|[A-Z_.-])"
RUNTIME = r"(?i)\.(?:c|cc|cpp|cs|cxx|go|h|hh|hpp|hxx|java|js|jsx|kt|kts|m|mm|mjs|php|py|rb|rs|swift|ts|tsx|vb)$"
EXCLUDED = (".context", ".git", "__pycache__", "build", "coverage", "dist", "generated", "node_modules", "target", "vendor")
LIMITS = {"definitions": 12, "per_file": 2, "depth": 2, "anchors": 12, "pool": 80, "runtime": 32, "test": 12, "final": 44, "symbol": 4, "word": 3, "overlap": 2}


def is_test(path: Column) -> Column:
    return path.rlike(r"(^|/)(?:test|tests|__tests__)(?:/|$)") | path.rlike(r"\.(?:test|spec)\.[^/]+$")


def is_runtime(path: Column) -> Column:
    return path.rlike(RUNTIME)


def excluded(path: Column, components: tuple[str, ...] = EXCLUDED, prefixes: tuple[str, ...] = ()) -> Column:
    """Whether a path begins with one of the prefixes or has one of the components."""
    out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in components]))
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def split_camel(text: Column) -> Column:
    for p in (r"([a-z\d])([A-Z])", r"([A-Z]+)([A-Z][a-z])"):
        text = F.regexp_replace(text, p, "$1 $2")
    return F.regexp_replace(text, r"[_./:#@-]+", " ")


def terms(text: Column, least: int = 3) -> Column:
    """Distinct words of a text by the second pass's own rules: camel case apart, ``least`` letters, no stop words."""
    words = F.split(F.lower(split_camel(text)), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP)))


def terms_among(text: Column, words: list[str]) -> Column:
    """Which of ``words`` are among the ``terms`` of a text; only runs that hold one are taken apart."""
    if not words:
        return F.array().cast("array<string>")

    def some(run: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.lower(run).contains(w)
        return out

    runs = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), some)
    return F.array_intersect(F.array(*[F.lit(w) for w in words]), terms(F.array_join(F.array_distinct(runs), " ")))


def query_terms(query: str, least: int = 3) -> list[str]:
    """``terms`` of a query, which may hold comments of markup that don't count."""
    text = re.sub(r"<!--[\s\S]*?-->", " ", query)
    for p in (r"([a-z\d])([A-Z])", r"([A-Z]+)([A-Z][a-z])"):
        text = re.sub(p, r"\1 \2", text)
    return list(dict.fromkeys(w for w in re.findall(r"[^\W_]+", text.lower()) if len(w) >= least and w not in STOP))


def named_symbols(query: str, least: int = 4) -> list[str]:
    """Identifiers that a query names: those with inner capitals, underscores, qualifiers, or all in capitals."""
    out = []
    name = r"[A-Za-z_$][A-Za-z0-9_$]*"
    for c in re.findall(rf"{name}(?:(?:\.|::){name})*", re.sub(r"<!--[\s\S]*?-->", " ", query)):
        parts = re.split(r"\.|::", c)
        technical = "::" in c or "_" in c or c == c.upper() or re.search(r"[a-z][A-Z]|[A-Z].*[A-Z]", c) or len(parts) > 1 and any(re.search(r"[A-Z_]", p) for p in parts)
        if technical and len(parts[-1]) >= least and parts[-1].lower() not in STOP and c not in out:
            out.append(c)
    return out


def evidence(heads: DataFrame, texts: DataFrame, words: list[str]) -> DataFrame:
    """``(id, matched, score)``: sum of the weights of the words in a text, 1.5 for each in the path, 2 in name or signature.

    ``heads(id, path, name, signature)`` are the entities that count for the weights; ``texts(id, text)`` may
    give a text in parts, or be a function as for ``search.matches``. Texts without a word are dropped where they
    are read.
    """
    low, some = F.lower("text"), F.lit(False)
    for w in words:
        some = some | low.contains(w)
    each = lambda rows: rows.where(some).select(*[c for c in rows.columns if c != "text"], terms_among(F.col("text"), words).alias("tokens"))
    found = (texts(each) if callable(texts) else each(texts)).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens")).where(F.size("tokens") > 0)
    found = found.join(heads.select("id"), "id", "left_semi")
    weight = F.broadcast(ST.idf(found, heads, words).agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("_w")))
    asked = F.array(*[F.lit(w) for w in words])
    rows = heads.join(found, "id").crossJoin(weight)
    score = F.aggregate(F.array_sort("tokens"), F.lit(0.0), lambda s, t: s + F.col("_w")[t])
    score = score + F.size(F.array_intersect(asked, terms(F.col("path")))) * 1.5 + F.size(F.array_intersect(asked, terms(F.concat_ws(" ", "name", "signature")))) * 2
    return rows.select("id", F.array_sort("tokens").alias("matched"), score.alias("score"))


def definitions(heads: DataFrame, texts: DataFrame, query: str, baseline: list[str]) -> DataFrame:
    """Chunks that a query names exactly, and the two best of each file of the first search: ``(id, path, name, match_class, lane)``.

    ``heads(id, entity_type, owner_kind, kind, language, path, name, signature, exported)``; ``baseline`` are
    the few paths that the first search gave. Exact names come first, then runtime before test paths.
    """
    code = heads.where((F.col("entity_type") == "Chunk") & (F.col("owner_kind") == "CODE") & is_runtime(F.col("path")))
    last = F.element_at(F.split(F.col("name"), r"\.|::"), -1)
    symbols = named_symbols(query, LIMITS["symbol"])
    ends = [re.split(r"\.|::", s)[-1] for s in symbols]
    named = F.array_position(F.array(*[F.lit(e) for e in ends]), last) if ends else F.lit(0)
    whole = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("name")) if symbols else F.lit(0)
    pos = F.least(F.nullif(named, F.lit(0)), F.nullif(whole, F.lit(0)))
    inside = F.col("path").isin(*baseline) if baseline else F.lit(False)
    exact = code.where(~excluded(F.col("path"))).withColumn("_p", pos).where("_p is not null").select("id", "path", "name", F.lit("exact").alias("match_class"), F.lit(0).alias("_c"), "_p", F.when(inside, 0).otherwise(1).alias("_b"), F.when(F.col("exported"), 0).otherwise(1).alias("_e"), F.lit(0.0).alias("_s"))
    owners = code.where(inside & ~F.lower("kind").isin("section", "heading", "object", "preamble") & ~F.lower("language").isin("markdown", "json", "yaml", "yml"))
    ranked = owners.join(evidence(heads, texts, query_terms(query, LIMITS["word"])), "id").where(F.size("matched") >= LIMITS["overlap"]).join(exact.select("id"), "id", "left_anti")
    place = F.array_position(F.array(*[F.lit(b) for b in baseline]), F.col("path")) if baseline else F.lit(0)
    ranked = ranked.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= LIMITS["per_file"])
    ranked = ranked.select("id", "path", "name", F.lit("baseline_owner").alias("match_class"), F.lit(1).alias("_c"), place.alias("_p"), F.lit(0).alias("_b"), F.col("_n").alias("_e"), (-F.col("score")).alias("_s"))
    lane = F.when(is_test(F.col("path")), "test").otherwise("runtime")
    return exact.unionByName(ranked).withColumn("lane", lane).orderBy(F.desc(F.col("lane") == "runtime"), "_c", "_p", "_b", "_e", "path", "id").limit(LIMITS["definitions"]).select("id", "path", "name", "match_class", "lane")


def roles(relation: Column, direction: Column, name: Column) -> Column:
    """What a node is to the definition that leads to it."""
    incoming = direction == "incoming"
    return (F.when((relation == "CALLS") & incoming, F.when(name.rlike(LIFECYCLE), "lifecycle_owner").otherwise("caller")).when(relation == "CALLS", "callee")
            .when(relation == "EXPORTS", "barrel_or_public_export").when((relation == "IMPORTS") & incoming, "importer").when(relation == "IMPORTS", "imported_runtime")
            .when(relation.isin("CONTAINS", "CONTAINS_MODULE"), "module_owner").when(relation == "INCLUDES_FILE", "project_owner").when(relation == "DEFINES", "definition_owner").otherwise("runtime_neighbor"))


def traverse(relations: DataFrame, seeds: DataFrame, heads: DataFrame, depth: int = 2) -> DataFrame:
    """Evidence around every seed: ``(seed, id, path, relation, direction, role, distance)``, one row per seed, path, relation and direction.

    Relations are followed by their priority both ways, each seed on its own. Of several ways to a node in
    one step the smallest parent by discovery counts. Nodes without an entity or path lead on, but are no
    evidence. The frontier moves, not the relations.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("relation"))
    use = relations.where(F.col("relation").isin(*PRIORITY)).select("from_id", "to_id", "relation", rank.alias("_pr"))
    both = use.select(F.col("from_id").alias("_at"), F.col("to_id").alias("id"), F.lit("outgoing").alias("direction"), "relation", "_pr").unionByName(
        use.select(F.col("to_id").alias("_at"), F.col("from_id").alias("id"), F.lit("incoming").alias("direction"), "relation", "_pr"))
    seen = seeds.select(F.col("id").alias("seed"), "id", F.array().cast("array<string>").alias("_o")).distinct()
    frontier, met = seen, None
    for hop in range(1, depth + 1):
        key = F.concat(F.lpad(F.col("_pr").cast("string"), 2, "0"), F.lit(" "), F.col("id"), F.lit(" "), F.col("direction"))
        step = cut(frontier.withColumnRenamed("id", "_from").join(both, F.col("_from") == F.col("_at")).select("seed", "id", "direction", "relation", "_pr", F.lit(hop).alias("distance"), F.concat("_o", F.array(key)).alias("_o")))
        met = step if met is None else met.unionByName(step)
        fresh = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").groupBy("seed", "id").agg(F.min("_o").alias("_o"))
        frontier = fresh
        seen = seen.unionByName(fresh)
    named = met.join(heads.select("id", "path", "name", "entity_type"), "id").where((F.col("path") != "") & ~excluded(F.col("path")))
    first = W.partitionBy("seed", "path", "relation", "direction").orderBy("distance", "_o", "id")
    one = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select("seed", "id", "entity_type", "path", "relation", "direction", roles(F.col("relation"), F.col("direction"), F.col("name")).alias("role"), "distance", F.col("_pr").alias("priority"))


def anchors(defs: DataFrame, found: DataFrame) -> DataFrame:
    """Up to 12 ``(scope, value, kind, cause)``: files and folders of the definitions, then what owns, exports or calls them."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    own = defs.select(F.explode(F.array(
        F.struct(F.lit("file").alias("scope"), F.col("path").alias("value"), F.lit("owner_path").alias("kind"), F.col("id").alias("cause"), F.lit(0).alias("_o")),
        F.struct(F.lit("directory").alias("scope"), folder.alias("value"), F.lit("module_path").alias("kind"), F.col("id").alias("cause"), F.lit(0).alias("_o")))).alias("a")).select("a.*").where("value <> ''")
    graph = found.where(F.col("role").isin("module_owner", "barrel_or_public_export", "caller", "lifecycle_owner")).select(
        F.when(F.col("entity_type").isin("Module", "Project"), "directory").otherwise("file").alias("scope"), F.col("path").alias("value"),
        F.when(F.col("entity_type").isin("Module", "Project"), "graph_module_path").otherwise("graph_file_path").alias("kind"), F.col("id").alias("cause"), F.col("distance").alias("_o"))
    return own.unionByName(graph).groupBy("kind", "value").agg(F.first("scope").alias("scope"), F.min("cause").alias("cause"), F.min("_o").alias("_o")).orderBy("_o", "kind", "value").limit(LIMITS["anchors"]).drop("_o")


def contained(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Rows whose path is an anchor's file or lies in its folder, with the best anchor: files first, then the longest."""
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    # The anchors are at most twelve, so their side is sent to all tasks.
    near = rows.select("*", F.explode(folders).alias("_f")).join(F.broadcast(points), F.col("_f") == F.col("value")).where((F.col("scope") == "directory") | (F.col("_f") == F.col("path")))
    best = W.partitionBy("id").orderBy(F.desc(F.col("scope") == "file"), F.desc(F.length("value")), F.col("kind_a"), "cause")
    return near.withColumnRenamed("kind", "kind_a").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_f")


def relevant(found: DataFrame, matched: DataFrame) -> DataFrame:
    """Graph evidence one step away: callers, callees and exports, and imports with two words of the query; two of each seed and role."""
    rows = found.where("distance = 1").join(matched.select("id", F.size("matched").alias("_m")), "id", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    rows = rows.where(F.col("role").isin("caller", "callee", "lifecycle_owner", "barrel_or_public_export") | F.col("role").isin("importer", "imported_runtime") & (F.col("_m") >= LIMITS["overlap"]))
    order = W.partitionBy("seed", "role").orderBy(F.desc("_m"), "priority", "path", "id")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n <= 2").drop("_n")


def retrieve(heads: DataFrame, texts: DataFrame, relations: DataFrame, query: str, baseline: list[str]) -> DataFrame:
    """``(lane, place, source, id, path)``: what both passes add to the first search, 32 runtime and 12 test paths, 44 in all.

    Every path once; the paths of the first search keep their places and count. Definitions come first, then
    relevant graph evidence, then the best of each path within the anchors that has two words of the query.
    """
    defs = cut(definitions(heads, texts, query, baseline))
    found = cut(traverse(relations, defs.select("id"), heads, LIMITS["depth"]))
    points = cut(anchors(defs, found))
    words = query_terms(query, LIMITS["word"])
    files = heads.where(F.col("entity_type").isin("Chunk", "File") & (F.col("path") != ""))
    scored = cut(evidence(files.select("id", "path", "name", "signature"), texts, words))
    # The anchors' own words: at most twelve short paths.
    anchor_words = query_terms(" ".join(r["value"] for r in points.collect()), LIMITS["word"])
    by_anchor = evidence(files.select("id", "path", "name", "signature"), texts, anchor_words).select("id", F.col("score").alias("_a")) if anchor_words else None
    second = files.where((is_runtime(F.col("path")) | is_test(F.col("path"))) & ~excluded(F.col("path"))).select("id", "path").join(scored.where(F.size("matched") >= LIMITS["overlap"]), "id")
    second = contained(second, points)
    second = second.join(by_anchor, "id", "left") if by_anchor is not None else second.withColumn("_a", F.lit(0.0))
    second = second.withColumn("score", F.col("score") + F.coalesce("_a", F.lit(0.0)) * 1.25 + 3)
    second = second.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy(F.desc("score"), "id"))).where("_n = 1").orderBy(F.desc("score"), "path", "id").limit(LIMITS["pool"])
    graph = relevant(found.where(F.col("entity_type").isin("Chunk", "File") & (is_runtime(F.col("path")) | is_test(F.col("path")))), scored)
    one = lambda rows, n, source, score: rows.select("id", "path", F.lit(n).alias("_p"), F.lit(source).alias("source"), score.alias("_s"))
    every = one(defs, 1, "definition", F.lit(0.0)).unionByName(one(graph, 2, "graph", -F.col("_m").cast("double"))).unionByName(one(second, 3, "second_pass", -F.col("score")))
    every = every.where(~F.col("path").isin(*baseline)) if baseline else every
    first = W.partitionBy("path").orderBy("_p", "_s", "id")
    every = every.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("lane", F.when(is_test(F.col("path")), "test").otherwise("runtime"))
    taken = {"test": 0, "runtime": 0}
    for b in baseline:
        taken["test" if re.search(r"(^|/)(?:test|tests|__tests__)(?:/|$)|\.(?:test|spec)\.[^/]+$", b) else "runtime"] += bool(re.search(RUNTIME.replace("(?i)", ""), b, re.I))
    # At most 12 + 24 + 80 rows are left, so one window over a lane is small.
    placed = every.withColumn("place", F.row_number().over(W.partitionBy("lane").orderBy("_p", "_s", "path", "id")))
    room = F.when(F.col("lane") == "test", LIMITS["test"] - taken["test"]).otherwise(LIMITS["runtime"] - taken["runtime"])
    kept = placed.where(F.col("place") <= room)
    return kept.orderBy("lane", "place").limit(max(0, LIMITS["final"] - len(baseline))).select("lane", "place", "source", "id", "path")
