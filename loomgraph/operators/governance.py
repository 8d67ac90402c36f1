"""Logs, policies, reviews, notes and processes: filters, validators by policy, snapshot equality, lint, trees."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import ancestors
from .scans import env_in_prompts, external_calls, policy_hits, secret_hits, too_large, undocumented


def audit(log: DataFrame, limit: int = 100, first: str | None = None, last: str | None = None, **equal: str | None) -> DataFrame:
    """The newest ``limit`` entries of ``log(day, line_no, ...)`` within days, whose columns equal what is given.

    Filters are columns such as tool, event_type, evidence_level, status, session_id; None filters nothing.
    """
    rows = log
    for c, v in equal.items():
        rows = rows if v is None else rows.where(F.col(c) == v)
    rows = rows.where(F.col("day") >= first) if first else rows
    rows = rows.where(F.col("day") <= last) if last else rows
    return rows.orderBy(F.desc("day"), F.desc("line_no")).limit(limit)


#: Validators by the id of a policy: files ``(path, content, size_bytes)`` to hits ``(path, line_no, message)``.
VALIDATORS: dict[str, Callable[..., DataFrame]] = {}
#: Evaluators by the type of a policy, with its configuration.
EVALUATORS: dict[str, Callable[..., DataFrame]] = {}
SEVERITY = {"secrets": "error", "env-in-prompts": "error"}
REVIEW = "code-review"


def validator(policy_id: str) -> Callable:
    """Registers a validator for a policy id; a later one replaces it."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        VALIDATORS[policy_id] = f
        return f

    return add


def evaluator(kind: str) -> Callable:
    """Registers an evaluator for a type of policy."""
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        EVALUATORS[kind] = f
        return f

    return add


def _hits(rows: DataFrame, line: str | None, message: Column) -> DataFrame:
    return rows.select("path", (F.col(line) if line else F.lit(0)).cast("int").alias("line_no"), message.alias("message"))


@validator("secrets")
def _secrets(files: DataFrame, **config) -> DataFrame:
    return _hits(secret_hits(files, "path", "content", **config), "line_no", F.col("secret"))


@validator("env-in-prompts")
def _env(files: DataFrame, **config) -> DataFrame:
    return _hits(env_in_prompts(files, "path", "content", **config), "line_no", F.col("env"))


@validator("external-calls")
def _calls(files: DataFrame, **config) -> DataFrame:
    return _hits(external_calls(files, "path", "content", **config), None, F.col("call"))


@validator("max-file-size")
def _size(files: DataFrame, **config) -> DataFrame:
    return _hits(too_large(files, "path", "size_bytes", **config), None, F.col("size_bytes").cast("string"))


@evaluator("regex")
def _regex(files: DataFrame, pattern: str, **config) -> DataFrame:
    return _hits(policy_hits(files, "path", "content", pattern, **config), "line_no", F.lit(pattern))


@evaluator("code_comments")
def _comments(files: DataFrame, **config) -> DataFrame:
    return _hits(undocumented(files, "path", "content", **config), "line", F.col("name"))


def partition(policies: list[dict]) -> tuple[list[dict], list[dict]]:
    """Policies that can be run, and those that are skipped with their reason; only enforced ones count.

    A policy for reviews by people is left to them; one with a type needs an evaluator of that type, one
    without needs a validator of its id.
    """
    run, skipped = [], []
    for p in policies:
        if not p.get("enforce"):
            continue
        kind = p.get("type")
        reason = ("left to the review itself" if p["id"] == REVIEW else f'no evaluator for type "{kind}"' if kind and kind not in EVALUATORS
                  else "no validator for this policy" if not kind and p["id"] not in VALIDATORS else None)
        if reason:
            skipped.append({"id": p["id"], "type": kind, "reason": reason})
        else:
            run.append({"id": p["id"], "type": kind, "config": p.get("config") or {}, "severity": p.get("severity", "block")})
    return run, skipped


def run_policies(files: DataFrame, policies: list[dict]) -> DataFrame:
    """``(policy_id, passed, severity, n_hits, n_files)`` of every enforced policy that can be run, and the skipped ones with a warning.

    By type first, then by id, else a warning. All hits are counted where they are found; a policy without
    hits passes.
    """
    spark = files.sparkSession
    ready, skipped = partition(policies)
    schema = "policy_id string, severity string, n_hits long, n_files long"
    out = spark.createDataFrame([(s["id"], "warning", None, None) for s in skipped], schema)
    for p in ready:
        f = EVALUATORS[p["type"]] if p["type"] else VALIDATORS[p["id"]]
        hits = f(files, **p["config"])
        bad = SEVERITY.get(p["id"], "warning")
        out = out.unionByName(hits.agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct("path").alias("n_files")).select(
            F.lit(p["id"]).alias("policy_id"), F.when(F.col("n_hits") > 0, bad).otherwise("info").alias("severity"), "n_hits", "n_files"))
    return out.select("policy_id", F.coalesce(F.col("n_hits") == 0, F.lit(False)).alias("passed"), "severity", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def summary(results: DataFrame) -> DataFrame:
    """How many policies passed, failed, and warn."""
    return results.agg(F.count_if("passed").alias("passed"), F.count_if(F.expr("not passed and severity <> 'warning'")).alias("failed"), F.count_if(F.expr("not passed and severity = 'warning'")).alias("warnings"))


def review_matches(reviewed: DataFrame, current: DataFrame) -> DataFrame:
    """One row: whether a reviewed snapshot ``(path, exists, hash)`` is the current one, and how many files differ.

    Both are compared whole by path; a file that only one of them has differs, null hashes are equal.
    """
    a = reviewed.select("path", F.struct("exists", "hash").alias("_a"), F.lit(True).alias("_x"))
    b = current.select("path", F.struct("exists", "hash").alias("_b"), F.lit(True).alias("_y"))
    same = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    n = F.count_if(~same)
    return a.join(b, "path", "full_outer").agg((n == 0).alias("matches"), n.alias("n_differ"))


def changed_since(current: DataFrame, at: Column) -> DataFrame:
    """The same without a snapshot of the review: files ``(path, exists, modified)`` that are gone or newer than the review."""
    n = F.count_if(~F.col("exists") | (F.col("modified") > at))
    return current.agg((n == 0).alias("matches"), n.alias("n_differ"))


# What a note must have, the kinds it may have, when it is stale, and kinds that contradict each other.
NOTE_FIELDS = ("title", "type", "summary")
STALE_DAYS = 90
CONFLICTS = (("decision", "decision"), ("fix", "gotcha"), ("fix", "fix"), ("decision", "gotcha"))


def lint(notes: DataFrame, known: DataFrame, kinds: tuple[str, ...], now: str) -> DataFrame:
    """``(id, check, detail)``: issues of notes ``(id, type, title, summary, body, applies_to, sources, status, freshness, updated_at, supersedes)``.

    Missing fields, unknown kinds, empty bodies, no link to anything, targets and sources that ``known(id)``
    lacks, stale ones, ids of several notes, and replaced notes that are not there.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    unlinked = (F.size(F.coalesce("applies_to", F.array().cast("array<string>"))) <= 0) & (F.size(F.coalesce("sources", F.array().cast("array<string>"))) <= 0)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.try_to_timestamp(F.nullif(F.trim("updated_at"), F.lit(""))))) / 86_400e6
    stale = F.when(F.lower("freshness") == "stale", "marked stale").when(age > STALE_DAYS, F.concat(F.floor(age).cast("string"), F.lit(" days old")))
    checks = F.array_compact(F.array(
        *[F.when(empty(c), F.struct(F.lit("missing field").alias("check"), F.lit(c).alias("detail"))) for c in NOTE_FIELDS],
        F.when(~empty("type") & ~F.col("type").isin(*kinds), F.struct(F.lit("unknown type").alias("check"), F.col("type").alias("detail"))),
        F.when(empty("body"), F.struct(F.lit("empty body").alias("check"), F.lit("").alias("detail"))), F.when(unlinked, F.struct(F.lit("no link").alias("check"), F.lit("").alias("detail"))),
        F.when(stale.isNotNull(), F.struct(F.lit("stale").alias("check"), stale.alias("detail")))))
    own = notes.select("id", F.explode(checks).alias("c")).select("id", "c.*")
    ids = known.select(F.col("id").alias("_k")).distinct()
    targets = notes.select("id", F.explode("applies_to").alias("detail")).join(ids, F.col("detail") == F.col("_k"), "left_anti").select("id", F.lit("unknown target").alias("check"), "detail")
    sources = notes.select("id", F.explode("sources").alias("detail")).join(ids, F.concat(F.lit("file:"), "detail") == F.col("_k"), "left_anti").select("id", F.lit("unknown source").alias("check"), "detail")
    twice = notes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("check"), F.col("n").cast("string").alias("detail"))
    gone = notes.where(~empty("supersedes")).select("id", F.col("supersedes").alias("detail")).join(notes.select(F.col("id").alias("_k")).distinct(), F.col("detail") == F.col("_k"), "left_anti").select("id", F.lit("unknown superseded").alias("check"), "detail")
    return own.unionByName(targets).unionByName(sources).unionByName(twice).unionByName(gone)


def contradictions(notes: DataFrame) -> DataFrame:
    """``(target, type_a, type_b, n_pairs)``: active notes on one target whose kinds contradict each other, counted.

    Pairs of a note and the one it replaces don't count. Pairs are counted from the notes per target and
    kind, never spelt out, so a target of very many notes is one row per kind.
    """
    use = notes.where("status = 'active'").select("id", "type", "supersedes", F.explode(F.array_distinct("applies_to")).alias("target"))
    per = use.groupBy("target", "type").agg(F.count(F.lit(1)).alias("n"))
    out = None
    for a, b in CONFLICTS:
        x = per.where(F.col("type") == a).select("target", F.col("n").alias("x"))
        y = per.where(F.col("type") == b).select("target", F.col("n").alias("y"))
        n = (F.col("x") * (F.col("x") - 1) / 2) if a == b else F.col("x") * F.col("y")
        rows = x.join(y, "target").select("target", F.lit(a).alias("type_a"), F.lit(b).alias("type_b"), n.cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    old = use.select(F.col("id").alias("supersedes"), "target", F.col("type").alias("_t"))
    spared = use.join(old, ["supersedes", "target"]).where("id <> supersedes").select("target", F.least("type", "_t").alias("type_a"), F.greatest("type", "_t").alias("type_b"), F.least("id", "supersedes").alias("i"), F.greatest("id", "supersedes").alias("j")).distinct()
    spared = spared.groupBy("target", "type_a", "type_b").agg(F.count(F.lit(1)).alias("s"))
    return out.join(spared, ["target", "type_a", "type_b"], "left").select("target", "type_a", "type_b", (F.col("n") - F.coalesce("s", F.lit(0))).alias("n_pairs")).where("n_pairs > 0")


def process_trees(processes: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """``(root, processes, rss, cpu)`` of the processes ``(pid, ppid, rss, cpu)`` under every root, itself too; circles stop."""
    up = ancestors(processes.select(F.col("pid"), F.col("ppid")), "pid", "ppid", depth).select(F.col("start").alias("pid"), F.col("ancestor").alias("root"))
    under = up.unionByName(processes.select("pid", F.col("pid").alias("root"))).distinct().join(roots.select("root"), "root", "left_semi")
    return under.join(processes.select("pid", "rss", "cpu"), "pid").groupBy("root").agg(F.count(F.lit(1)).alias("processes"), F.sum("rss").alias("rss"), F.round(F.sum("cpu"), 1).alias("cpu"))


def ungoverned(processes: DataFrame, wanted: Column, governs: Column, depth: int = 32) -> DataFrame:
    """``(pid, chain)``: wanted processes none of whose ancestors governs them, with their ancestors up to ``depth``, nearest first."""
    p = processes.select("pid", "ppid", wanted.alias("_w"), governs.alias("_g"))
    up = ancestors(p, "pid", "ppid", depth).join(p.select(F.col("pid").alias("ancestor"), F.col("_g").alias("_over")), "ancestor").where("ancestor > 1")
    chain = up.groupBy(F.col("start").alias("pid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "ancestor"))), lambda x: x["ancestor"]).alias("chain"), F.bool_or("_over").alias("_over"))
    rows = p.where("_w and not _g").join(chain, "pid", "left").where(~F.coalesce("_over", F.lit(False)))
    return rows.select("pid", F.concat(F.array("pid"), F.coalesce("chain", F.array().cast("array<bigint>"))).alias("chain"))


def sorted_by(rows: DataFrame, column: str, descending: bool, tie: str) -> DataFrame:
    """Rows by a column that a reader picked; missing values are the smallest."""
    c = F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), tie)


def top_per(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group: the cap is the rule's own."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
