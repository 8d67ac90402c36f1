"""From files to chunks and relations: builders, incremental updates, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = """the and for with from that this must when where into used using only true false unless should global active rule rules data file
    files code docs context och det att som med för utan eller inte ska skall måste kan vid alla""".split()
CODE_EXTENSIONS = """.js .jsx .mjs .cjs .ts .tsx .mts .cts .py .go .java .rb .rs .sh .bash .c .cc .cpp .h .hh .hpp .cs .vb .sql .php .swift .kt .bas .cls .frm .ctl""".split()
IMPORT_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json")


def keywords(text: Column) -> Column:
    """Distinct ASCII words of three letters or more that are no stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def detect_kind(path: Column) -> Column:
    """ADR, DOC or CODE by folder and extension."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    ext = F.regexp_extract(low, r"(\.[^./]+)$", 1)
    adr = low.rlike(r"(^|/)(adr|adrs|decisions)(/|$)") | base.rlike(r"^adr[-_ ]?\d+")
    doc = low.startswith("docs/") | ext.isin(".md", ".mdx", ".txt", ".adoc", ".rst") | ~ext.isin(*CODE_EXTENSIONS)
    return F.when(adr, "ADR").when(doc, "DOC").otherwise("CODE")


def trust_of(kind: Column) -> Column:
    return F.when(kind == "ADR", 95).when(kind == "CODE", 80).otherwise(70)


def title_of(text: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1))
    return F.when(found != "", found).otherwise(fallback)


def decision_date(text: Column, fallback: Column) -> Column:
    day = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(
        day(r"""(?im)^\s*date:\s*["']?(\d{4}-\d{2}-\d{2})["']?\s*$"""), day(r"""(?im)^\s*decision[_\s-]*date:\s*["']?(\d{4}-\d{2}-\d{2})["']?\s*$"""), F.substring(fallback, 1, 10))


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def module_rollup(files: DataFrame, chunks: DataFrame, least: int = 2) -> DataFrame:
    """Folders with at least ``least`` files: their number, latest change and the names of up to 20 exported chunks."""
    f = files.withColumn("dir", dirname(F.col("path")))
    exported = chunks.where("exported and not contains(id, ':window:')").join(f.select(F.col("id").alias("file_id"), "dir"), "file_id")
    names = (
        exported.withColumn("_r", F.row_number().over(W.partitionBy("dir").orderBy("id"))).where("_r <= 20")
        .groupBy("dir").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"])), ", ").alias("exports"))
    )
    dirs = f.groupBy("dir").agg(F.count(F.lit(1)).alias("file_count"), F.max("updated_at").alias("updated_at")).where(F.col("file_count") >= least)
    return dirs.join(names, "dir", "left").select(F.concat(F.lit("module:"), "dir").alias("id"), F.col("dir").alias("path"), F.element_at(F.split("dir", "/"), -1).alias("name"),
                                                   "file_count", F.coalesce("exports", F.lit("")).alias("exported_symbols"), "updated_at")


def module_parents(modules: DataFrame) -> DataFrame:
    """CONTAINS_MODULE links between modules whose folders are parent and child."""
    p = modules.select(F.col("id").alias("from_id"), F.col("path").alias("parent"))
    return modules.select(F.col("id").alias("to_id"), dirname(F.col("path")).alias("parent")).where("to_id <> concat('module:', parent)").join(p, "parent").select("from_id", "to_id")


def calls_in_file(chunks: DataFrame) -> DataFrame:
    """CALLS between chunks of one file, by name; every chunk of that name counts, calls of itself too."""
    called = chunks.select("file_id", F.col("id").alias("from_id"), F.explode(F.array_distinct("calls")).alias("name"))
    return called.join(chunks.select("file_id", "name", F.col("id").alias("to_id")), ["file_id", "name"]).select("from_id", "to_id").distinct()


def sql_references(chunks: DataFrame) -> DataFrame:
    """CALLS_SQL: references that meet the full name or the last part of another SQL object's name."""
    last = lambda c: F.element_at(F.split(c, r"\."), -1)
    names = chunks.select(F.col("id").alias("to_id"), F.explode(F.array_distinct(F.array(F.col("name"), last(F.col("name"))))).alias("alias"))
    refs = chunks.select(F.col("id").alias("from_id"), F.explode("calls").alias("ref")).select("from_id", F.explode(F.array_distinct(F.array(F.col("ref"), last(F.col("ref"))))).alias("alias"))
    return refs.join(names, "alias").where("from_id <> to_id").select("from_id", "to_id").distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Target file of every relative import ``(from_id, path, target)``: the first candidate path that exists.

    Candidates are the path as it stands, with each extension, with an index file, and with the source's
    extension for a script's. One join over all candidates, then the earliest per import.
    """
    folder = dirname(F.col("path"))
    raw = F.concat(folder, F.lit("/"), F.col("target"))
    parts = F.aggregate(
        F.split(raw, "/"), F.array().cast("array<string>"),
        lambda s, p: F.when((p == ".") | (p == ""), s).when(p == "..", F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1))).otherwise(F.concat(s, F.array(p))))
    full = F.array_join(parts, "/")
    bare = F.regexp_replace(full, r"\.(js|jsx|mjs|cjs)$", "")
    cands = F.concat(
        F.array(full), F.array(*[F.concat(full, F.lit(e)) for e in IMPORT_EXTENSIONS]), F.array(*[F.concat(full, F.lit(f"/index{e}")) for e in IMPORT_EXTENSIONS]),
        F.when(bare != full, F.array(*[F.concat(bare, F.lit(e)) for e in IMPORT_EXTENSIONS[:4]])).otherwise(F.array().cast("array<string>")))
    tried = imports.where(F.col("target").startswith(".")).select("from_id", "target", F.posexplode(cands).alias("pos", "candidate"))
    hit = tried.join(files.select(F.col("id").alias("to_id"), F.col("path").alias("candidate")), "candidate")
    return hit.groupBy("from_id", "target").agg(F.min_by("to_id", "pos").alias("to_id"))


def keyword_rules(files: DataFrame, rules: DataFrame, limit: int = 20) -> DataFrame:
    """``(rule_id, file_id, how)``: files that mention a rule's id, else share enough keywords with it.

    One shared keyword is enough for code, two for prose. Keywords meet by an equi join, and so do ids that
    have a whole run of letters inside them.
    """
    parts = F.transform(F.split("id", "[._-]+"), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    own = F.slice(F.array_sort(F.array_distinct(F.filter(F.concat(parts, keywords(F.col("body"))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))), 1, limit)
    r = rules.select(F.col("id").alias("rule_id"), own.alias("words"))
    low = F.lower("content")
    # A mention may stand anywhere, within words too: the longest plain run of the id has to be in the text, and
    # the runs of a text that end and begin with it meet it by an equi join before the id itself is looked up.
    run = F.reduce(F.split(F.lower("rule_id"), "[^a-z0-9]+"), F.lit(""), lambda s, x: F.when(F.length(x) > F.length(s), x).otherwise(s))
    keyed = r.select("rule_id", run.alias("run"), F.size(F.split(F.lower("rule_id"), "[^a-z0-9]+")).alias("n_runs"))
    inner = keyed.where("n_runs > 1 and run <> ''")
    texts = files.select("id", low.alias("low"))
    words_in = files.select("id", F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("run"))
    meets = words_in.join(inner, "run").select("id", "rule_id").distinct()
    loose = keyed.where("n_runs <= 1 or run = ''").select("rule_id")
    mention = texts.join(meets, "id").where(F.col("low").contains(F.lower("rule_id"))).select("rule_id", "id")
    # Ids of one run, or of none, may stand within any word, and so may the outer runs of others: the rules are
    # few against the files, so these are joined by looking them up in every text.
    edge = inner.where(F.lower("rule_id").startswith(F.col("run")) | F.lower("rule_id").endswith(F.col("run"))).select("rule_id")
    every = texts.join(loose.unionByName(edge), F.col("low").contains(F.lower("rule_id"))).select("rule_id", "id")
    mention = mention.unionByName(every).distinct()
    words = files.select("id", "kind", F.explode(keywords(F.concat_ws("\n", "path", F.substring("content", 1, 12000)))).alias("word"))
    hits = words.join(r.select("rule_id", F.size("words").alias("n_words"), F.explode("words").alias("word")), "word")
    enough = F.least(F.when(F.first("kind") == "CODE", 1).otherwise(2), F.greatest(F.lit(1), F.first("n_words")))
    matched = hits.groupBy("rule_id", "id").agg((F.count(F.lit(1)) >= enough).alias("ok")).where("ok").select("rule_id", F.col("id").alias("file_id"))
    named = mention.select("rule_id", F.col("id").alias("file_id")).distinct()
    return named.withColumn("how", F.lit("mention")).unionByName(matched.join(named, ["rule_id", "file_id"], "left_anti").withColumn("how", F.lit("keyword")))


def upsert(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """Last writer wins per key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def override(local: DataFrame, org: DataFrame, key: str) -> DataFrame:
    """Rows of ``org`` replace local ones with the same key."""
    return local.join(org.select(key), key, "left_anti").unionByName(org)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, change)``: added, removed, changed or unchanged between two snapshots; null values are equal."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y"))
    return a.join(b, key, "full_outer").select(
        key, F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed").alias("change"))


def drop_files(chunks: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks and relations without those of the files ``gone(id)``.

    Calls go with a lost chunk at either end, imports with the chunk they come from, definitions with their
    file, calls of SQL with their file or their chunk; other relations stay, their ends may come back.
    """
    lost = chunks.join(gone.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id").distinct()
    kind = F.col("relation")
    at = lambda c, ids: relations.where(c).join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    ends = at(kind.isin("CALLS", "CALLS_SQL"), lost).join(lost.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    ends = ends.where(kind == "CALLS").unionByName(ends.where(kind == "CALLS_SQL").join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti"))
    kept = ends.unionByName(at(kind == "IMPORTS", lost)).unionByName(at(kind == "DEFINES", gone)).unionByName(relations.where(~kind.isin("CALLS", "CALLS_SQL", "IMPORTS", "DEFINES")))
    return chunks.join(lost, "id", "left_anti"), kept


def hydrate(files: DataFrame, chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """Prior relations of parsed files that stay: files that are there, chunks of such files, and links between them."""
    f = files.select("id")
    c = chunks.join(f.withColumnRenamed("id", "file_id"), "file_id", "left_semi").select("id")
    out = None
    for kind, a, b in (("DEFINES", f, c), ("CALLS", c, c), ("IMPORTS", c, f), ("CALLS_SQL", f, c)):
        rows = relations.where(F.col("relation") == kind).join(a.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(b.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out


def under(path: Column, folder: str) -> Column:
    """Whether a path is a folder or lies in it."""
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")
