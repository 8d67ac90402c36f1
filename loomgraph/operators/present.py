"""What a response shows: presets, conditional columns, and the wording of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each preset of a response shows.
PRESETS = {
    "search": {
        "full": {"scores": True, "matched_rules": True, "content": False}, "compact": {"scores": False, "matched_rules": True, "content": False},
        "minimal": {"scores": False, "matched_rules": False, "content": False},
    },
    "impact": {
        "full": {"scores": True, "reasons": True, "verbose_paths": True, "max_path_hops": 2}, "compact": {"scores": False, "reasons": True, "verbose_paths": False, "max_path_hops": 2},
        "minimal": {"scores": False, "reasons": False, "verbose_paths": False, "max_path_hops": 1},
    },
    "related": {"full": {"edges": True, "entities": True}, "compact": {"edges": False, "entities": True}, "minimal": {"edges": False, "entities": False}},
}
#: Columns that a part of a response stands for.
PARTS = {
    "scores": ("score", "semantic_score", "embedding_score", "lexical_score", "impact_score", "profile_score", "note_score", "graph_score", "trust_score"),
    "matched_rules": ("matched_rules",), "content": ("content",), "reasons": ("why", "top_reasons"), "verbose_paths": ("path_entities", "path_edges"), "edges": ("edges",),
    "entities": ("entity_type", "title", "path", "status", "source_of_truth"),
}


def options(what: str, preset: str | None = None, **overrides) -> dict:
    """What a preset shows; overrides that are not None win."""
    return {**PRESETS[what][preset or "full"], **{k: v for k, v in overrides.items() if v is not None}}


def shown(rows: DataFrame, what: str, preset: str | None = None, **overrides) -> DataFrame:
    """The columns of a response under a preset; columns that no part stands for always stay."""
    opts = options(what, preset, **overrides)
    hidden = {c for part, on in opts.items() if part in PARTS and not on for c in PARTS[part]}
    return rows.select(*[c for c in rows.columns if c not in hidden])


def relation_label(step: Column) -> Column:
    """A relation in words, with its note if it has one."""
    name = F.replace(F.lower(step["relation"]), F.lit("_"), F.lit(" "))
    note = F.trim(step["note"])
    return F.when(note != "", F.concat(name, F.lit(" ("), note, F.lit(")"))).otherwise(name)


def _arrow(step: Column) -> Column:
    note = F.when(step["note"] != "", F.concat(F.lit("("), step["note"], F.lit(")"))).otherwise("")
    return F.concat(F.lit("-["), step["relation"], note, F.lit("]->"))


def path_summary(labels: Column, steps: Column, most: int | None = None) -> Column:
    """``a -[REL(note)]-> b ...``; longer paths than ``most`` steps show their head and tail and how much is hidden."""
    n = F.size(steps)
    pair = lambda lo, hi: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i >= lo) & (i < hi)), lambda i: F.concat(_arrow(F.get(steps, i)), F.lit(" "), F.get(labels, i + 1))), " ")
    whole = F.when(n == 0, F.get(labels, F.lit(0))).otherwise(F.concat_ws(" ", F.get(labels, F.lit(0)), pair(F.lit(0), n)))
    if most is None:
        return whole
    head, tail = max(1, -(-most // 2)), max(0, most // 2)
    hidden = F.greatest(F.lit(0), n - head - tail)
    gap = F.concat(F.lit("... "), F.when(hidden == 1, F.lit("1 more hop")).otherwise(F.concat(hidden.cast("string"), F.lit(" more hops"))), F.lit(" ..."))
    ends = [pair(n - tail, n)] if tail else []
    return F.when((F.size(labels) <= 3) | (n <= most), whole).otherwise(F.concat_ws(" ", F.get(labels, F.lit(0)), pair(F.lit(0), F.lit(head)), gap, *ends))


def why(seed: Column, target: Column, steps: Column, hops: Column) -> Column:
    """One sentence on how a result is reached."""
    said = F.array_distinct(F.transform(steps, relation_label))
    text = F.when(F.size(said) == 1, said[0]).otherwise(F.concat(F.array_join(F.slice(said, F.lit(1), F.greatest(F.size(said) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(said, -1)))
    far = F.when(hops == 1, "1 hop").otherwise(F.concat(hops.cast("string"), F.lit(" hops")))
    return F.when(F.size(said) == 0, F.concat(target, F.lit(" is reachable from "), seed, F.lit("."))).otherwise(
        F.concat(target, F.lit(" is impacted from "), seed, F.lit(" via "), text, F.lit(" in "), far, F.lit(".")))


def top_reasons(profile: str) -> Column:
    """Up to four reasons for a result of ``graph.impact``, the plainest first."""
    noted = F.slice(F.filter(F.transform("steps", relation_label), lambda t: t.endswith(")")), 1, 2)
    return F.slice(F.array_compact(F.array(
        F.concat(F.col("hops").cast("string"), F.lit("-hop path")), F.when(F.size("domains") > 0, F.concat(F.lit("domains: "), F.array_join("domains", ", "))),
        F.when(F.col("note_score") > 0, F.when(F.size(noted) > 0, F.concat(F.lit("note match: "), F.array_join(noted, ", "))).otherwise("note match")),
        F.when(F.col("profile_score") > 0, F.lit(f"profile boost: {profile}")), F.when(F.col("semantic_score") > 0.15, F.lit("entity text matched query")))), 1, 4)


def impact_response(rows: DataFrame, labels: DataFrame, profile: str = "all", preset: str | None = None, **overrides) -> DataFrame:
    """Results of ``graph.impact`` with the wording of their paths, under a preset.

    Only the few results are widened: their nodes are exploded, joined to ``labels(id, label)`` and put together
    again. Nodes without a label go by their id. Edges point as the relation does, whichever way it was walked.
    """
    opts = options("impact", preset, **overrides)
    nodes = rows.select(F.col("id").alias("_target"), "seed", F.posexplode("nodes").alias("pos", "id")).join(labels.select("id", "label"), "id", "left")
    named = nodes.groupBy("_target", "seed").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.nullif("label", F.lit("")), "id").alias("l")))), lambda x: x["l"]).alias("_labels"))
    out = rows.join(named, (rows["id"] == named["_target"]) & rows["seed"].eqNullSafe(named["seed"])).drop("_target", named["seed"])
    edge = lambda s, i: F.struct(
        F.when(s["direction"] == "outgoing", s["via"]).otherwise(F.get("nodes", i + 1)).alias("from"), F.when(s["direction"] == "outgoing", F.get("nodes", i + 1)).otherwise(s["via"]).alias("to"), s["relation"].alias("relation"), s["note"].alias("note"))
    out = out.select(
        "*", path_summary(F.col("_labels"), F.col("steps"), opts["max_path_hops"]).alias("path_summary"), why(F.col("_labels")[0], F.element_at("_labels", -1), F.col("steps"), F.col("hops")).alias("why"),
        top_reasons(profile).alias("top_reasons"), F.col("nodes").alias("path_entities"), F.transform("steps", edge).alias("path_edges"))
    return shown(out.drop("_labels", "nodes", "steps"), "impact", preset, **overrides)
