"""Queries on module hierarchies and on orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import below, hierarchies
from ..operators.orphans import orphan_references
from ..sources.tables import table


def module_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "relations").where("upper(relation) = 'CONTAINS_MODULE'").select("from_id", "to_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchies(module_links(spark, sf_dir), "from_id", "to_id", counts=False)
    return nodes.select(F.col("node").alias("module_id"), F.col("root").alias("root_id"), "depth")


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = hierarchies(module_links(spark, sf_dir), "from_id", "to_id")
    return nodes.select(
        F.col("node").alias("module_id"), F.col("root").alias("root_id"), "depth",
        F.array_join("path", " > ").alias("path"), "n_descendants",
        F.array_join("back_edges", " ").alias("closed_by"),
    )


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return below(module_links(spark, sf_dir), "from_id", "to_id").select(
        F.col("node").alias("module_id"), F.col("descendant").alias("below_id"), F.col("distance").cast("int").alias("distance")
    )


def chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present state of each chunk id: its row with the latest ``ingested_at`` (the largest key on ties)."""
    return (
        table(spark, sf_dir, "chunks").where("id is not null").groupBy("id")
        .agg(F.max_by(F.coalesce("status", F.lit("")), F.struct("ingested_at", "chunk_key")).alias("status"),
             F.min("ingested_at").alias("first_seen"))
    )


def reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS and IMPORTS ends as ``(ref, key, period, rel_id, relation, endpoint)``; empty ends are left out."""
    rel = table(spark, sf_dir, "relations").where("upper(relation) in ('CALLS', 'IMPORTS')").select(
        "rel_id", F.upper("relation").alias("relation"), "from_id", "to_id",
        F.coalesce(F.date_format("observed_at", "yyyy-MM"), F.lit("")).alias("period"), "observed_at",
    )
    ends = F.when(F.col("relation") == "CALLS", F.array(
        F.struct(F.lit("from").alias("endpoint"), F.concat(F.lit("c "), "from_id").alias("key")),
        F.struct(F.lit("to").alias("endpoint"), F.concat(F.lit("c "), "to_id").alias("key")),
    )).otherwise(F.array(F.struct(F.lit("to").alias("endpoint"), F.concat(F.lit("f "), "to_id").alias("key"))))
    return (
        rel.select("rel_id", "relation", "period", "observed_at", F.explode(ends).alias("e"))
        .select("rel_id", "relation", "period", "observed_at", "e.endpoint", "e.key")
        .where("length(key) > 2").dropDuplicates(["rel_id", "endpoint"]).withColumn("ref", F.col("rel_id"))
    )


def live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").where("coalesce(status, '') <> 'deleted'")
    return (
        chunk_states(spark, sf_dir).where("status <> 'deleted'").select(F.concat(F.lit("c "), "id").alias("key"))
        .union(files.select(F.concat(F.lit("f "), "file_id").alias("key")))
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(reference_rows(spark, sf_dir), live_keys(spark, sf_dir)).select("rel_id", "endpoint")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per relation, end and month; with those whose target came in after them."""
    refs = reference_rows(spark, sf_dir)
    lone = orphan_references(refs, live_keys(spark, sf_dir))
    per_month = ["relation", "endpoint", "period"]
    totals = refs.groupBy(*per_month).agg(F.count(F.lit(1)).alias("n_refs"))
    orphans = lone.groupBy(*per_month).agg(
        F.count(F.lit(1)).alias("n_orphans"), F.count_distinct("key").alias("n_missing_keys")
    )
    return totals.join(orphans, per_month, "left").select(
        *per_month, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"),
        F.coalesce("n_missing_keys", F.lit(0)).alias("n_missing_keys"),
    )


_LINKS = """
links as (select distinct from_id p, to_id c from relations
          where upper(relation) = 'CONTAINS_MODULE' and from_id <> '' and to_id <> ''),
ids as (select p id from links union select c from links),
tree as (select id, id root, 0 depth, id path from ids where id not in (select c from links)
         union all select l.c, t.root, t.depth + 1, t.path || ' > ' || l.c from tree t join links l on l.p = t.id),
placed as (select ids.id, coalesce(min(root), '') root, coalesce(min(depth), -1) depth, min(path) path
           from ids left join tree using (id) group by ids.id)
"""

# Everything below every node, by the fewest links: circles end because no distance is longer than there are levels.
_BELOW = """down as (select p above, c below, 1 distance from links union select d.above, l.c, d.distance + 1 from down d join links l on l.p = d.below where d.distance < 40)"""

_REFS = """
refs as (select distinct rel_id, upper(relation) relation, 'to' endpoint, to_id key, strftime(observed_at, '%Y-%m') period
         from relations where upper(relation) in ('CALLS', 'IMPORTS') and to_id <> ''
         union all select distinct rel_id, 'CALLS', 'from', from_id, strftime(observed_at, '%Y-%m')
         from relations where upper(relation) = 'CALLS' and from_id <> ''),
live_chunks as (select id from (select id, arg_max(coalesce(status, ''), (ingested_at, chunk_key)) s from chunks group by id) where s <> 'deleted'),
live_files as (select file_id from documents where coalesce(status, '') <> 'deleted'),
lone as (select * from refs where (relation = 'CALLS' and key not in (select id from live_chunks where id is not null))
         or (relation = 'IMPORTS' and key not in (select file_id from live_files where file_id is not null)))
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_hierarchy": p1_hierarchy,
    "p1_descendants": p1_descendants,
    "p7_found": p7_found,
    "p7_report": p7_report,
}

SQL = {
    "p1_found": f"with recursive {_LINKS} select id module_id, root root_id, cast(depth as int) depth from placed",
    "p1_descendants": f"""with recursive {_LINKS}, {_BELOW} select above module_id, below below_id, cast(min(distance) as int) distance from down where above <> below group by 1, 2""",
    "p1_hierarchy": f"""with recursive {_LINKS}, {_BELOW}, pairs as (select distinct above, below from down where above <> below),
        ways as (select id, path, root, depth from tree where id in (select id from placed where depth >= 0)),
        best as (select id, arg_min(path, (depth, string_split(path, ' > '))) path, arg_min(root, (depth, string_split(path, ' > '))) root, min(depth) depth from ways group by id),
        cnt as (select above id, count(*) n from pairs group by 1),
        back as (select c id, string_agg(p, ' ' order by p) b from links l where c not in (select id from best) and (p = c or p > c and exists (select 1 from pairs where above = l.c and below = l.p)) group by 1)
        select i.id module_id, coalesce(best.root, '') root_id, cast(coalesce(best.depth, -1) as int) depth, coalesce(best.path, '') path, coalesce(n, 0) n_descendants, coalesce(b, '') closed_by
        from ids i left join best using (id) left join cnt using (id) left join back using (id)""",
    "p7_found": f"with {_REFS} select rel_id, endpoint from lone",
    "p7_report": f"""with {_REFS},
        t as (select relation, endpoint, period, count(*) n_refs from refs group by all),
        o as (select relation, endpoint, period, count(*) n_orphans, count(distinct key) n_missing_keys from lone group by all)
        select t.relation, t.endpoint, t.period, n_refs, coalesce(n_orphans, 0) n_orphans,
               coalesce(n_missing_keys, 0) n_missing_keys
        from t left join o on t.relation = o.relation and t.endpoint = o.endpoint and t.period = o.period""",
}
