"""Sources and sinks beside Parquet: tolerant JSON lines, trees of text files, logs, small configurations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Folders that a tree scan leaves out, and the largest file it takes.
SKIP_FOLDERS = ".git .idea .vscode node_modules bin obj dist build coverage .next .cache .context".split()
MAX_FILE_BYTES = 1024 * 1024
# Extensions of files that hold text.
TEXT_NAMES = (r"\.(?:md|mdx|txt|adoc|rst|yaml|yml|json|toml|csv|ts|tsx|js|jsx|mjs|cjs|mts|cts|py|go|java|cs|sln|vbproj|csproj|fsproj|vcxproj|props|targets|config|resx|settings|rb|rs|php|swift|kt|vb|sql|sh|bash|zsh|ps1|"
              r"c|cc|cpp|h|hh|hpp|bas|cls|frm|ctl)$")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, required: list[str] | None = None) -> DataFrame:
    """JSON lines under a fixed schema; blank and malformed lines are dropped, and rows without a required text."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for c in required or []:
        rows = rows.where(F.col(c).cast("string") != "")
    return rows


def read_snapshot(spark: SparkSession, path: str, schema: StructType | str, count: int | None = None, sha256: str | None = None) -> DataFrame:
    """A snapshot of JSON lines as its manifest describes it: ValueError where the rows or the bytes are others.

    The bytes are hashed file by file on the executors; only the hashes come to the driver.
    """
    if sha256 is not None and snapshot_hash(spark, path) != sha256:
        raise ValueError(f"{path} has another content")
    rows = read_jsonl(spark, path, schema)
    if count is not None and rows.count() != count:
        raise ValueError(f"{path} has another number of rows")
    return rows


def snapshot_hash(spark: SparkSession, path: str) -> str:
    """One hash over the files of a folder, in order of their names: the hash of their hashes."""
    import hashlib

    parts = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    return hashlib.sha256("".join(r["h"] for r in parts.where(~F.col("name").startswith("_")).orderBy("name").collect()).encode()).hexdigest()


def site_json(spark: SparkSession, root: str, version: str, repo: str | None = None) -> DataFrame:
    """Details of repositories as one JSON document each, under ``root/version/repos/name.json``; a slash in a name is two underscores."""
    name = "*" if repo is None else repo.replace("/", "__")
    return spark.read.option("multiLine", True).json(f"{root.rstrip('/')}/{version}/repos/{name}.json").withColumn("version", F.lit(version))


def upsert_rows(spark: SparkSession, root: str, rows: DataFrame, key: str, batch: str) -> None:
    """Add a batch of rows to a store without a reset: written under the batch's name, so a repeated batch replaces itself."""
    rows.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/batch={batch}")


def read_rows(spark: SparkSession, root: str, key: str) -> DataFrame:
    """The rows of such a store: of each key the one of the last batch by name."""
    rows = spark.read.parquet(f"{root.rstrip('/')}/*")
    rest = [c for c in rows.columns if c not in (key, "_batch", "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(key, "_r.*")


def write_entities(tables: dict[str, DataFrame], root: str) -> None:
    """JSON lines and tab-separated values of every table, each under its name: ``entities.file``, ``relations.calls``."""
    for name, rows in tables.items():
        write_jsonl(rows, f"{root.rstrip('/')}/jsonl/{name}")
        flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes])
        write_tsv(flat, f"{root.rstrip('/')}/tsv/{name}")


def bad_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are no JSON object, with their file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    return lines.where((F.trim("value") != "") & F.get_json_object("value", "$").isNull())


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated values; tabs and line ends within texts become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\t\r\n]+", " ").alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*clean).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    r"""Quoted values; a null text is written as \\N and a text that begins with a backslash gets one more, so
    that empty texts and nulls stay apart."""
    mark = lambda c: F.when(F.col(c).isNull(), "\\N").when(F.col(c).startswith("\\"), F.concat(F.lit("\\"), F.col(c))).otherwise(F.col(c)).alias(c)
    rows.select(*[mark(c) if t == "string" else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """What ``write_csv`` wrote, under its schema."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\x00").csv(path)
    back = lambda c: F.when(F.col(c) == "\\N", F.lit(None)).when(F.col(c).startswith("\\"), F.expr(f"substring(`{c}`, 2)")).otherwise(F.col(c)).alias(c)
    return rows.select(*[back(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size, text, skipped)`` of all files under a folder; skipped tells why a file has no text.

    Folders by name are left out, files above the size limit and those with a zero byte in their first 4,000
    bytes are skipped.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""), "^" + re.escape(root.rstrip("/")) + "/", "")
    # A link to elsewhere shows by a path outside of the folder.
    files = raw.select(rel.alias("path"), F.col("length").alias("size"), "content", "modificationTime").where(~F.col("path").startswith("/") & ~F.col("path").contains("://"))
    top = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    hidden = F.exists(top, lambda x: x.isin(*[s for s in SKIP_FOLDERS if s != "bin"])) | F.exists(F.slice(top, 2, 1000), lambda x: x == "bin")
    binary = F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 4000)), "(..)", "$1 ")) % 3 == 1
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    texty = base.rlike(TEXT_NAMES) | base.startswith("readme")
    why = F.when(~texty, "unsupported").when(F.col("size") > MAX_FILE_BYTES, "too large").when(binary, "binary").otherwise("")
    return files.where(~hidden).select("path", "size", F.when(why == "", F.decode("content", "UTF-8")).alias("text"), why.alias("skipped"), "modificationTime")


def with_prefixes(rows: DataFrame, path: str, prefixes: list[str]) -> DataFrame:
    """Rows whose path is one of the source paths or lies in it, and below it in no folder that a scan leaves out."""
    ok = F.lit(False)
    skipped = F.array(*[F.lit(s) for s in SKIP_FOLDERS])
    for p in prefixes:
        p = p.strip("/")
        p = "" if p == "." else p
        below = F.col(path) if not p else F.when(F.col(path).startswith(p + "/"), F.expr(f"substring(`{path}`, {len(p) + 2})"))
        free = ~F.arrays_overlap(F.slice(F.split(below, "/"), F.lit(1), F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0))), skipped)
        ok = ok | (F.col(path) == p) | F.coalesce(free, F.lit(False))
    return rows.where(ok)


def changed_files(spark: SparkSession, porcelain: str) -> DataFrame:
    """``(path, change)`` of a version-control status in its zero-separated form; a rename deletes and changes."""
    parts, out, i = porcelain.split("\0"), [], 0
    while i < len(parts):
        entry = parts[i]
        i += 1
        if len(entry) < 4:
            continue
        code, path = entry[:2], entry[3:]
        if code[0] in "RC":
            if code[0] == "R" and i < len(parts):
                out.append((parts[i], "deleted"))
            i += 1
            out.append((path, "changed"))
        else:
            out.append((path, "deleted" if "D" in code else "changed"))
    return spark.createDataFrame(out, "path string, change string")


def read_logs(spark: SparkSession, root: str, schema: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Event logs in folders ``date=YYYY-MM-DD``; days outside the range are not read."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").option("basePath", root).json(root)
    day = F.col("date").cast("string")
    rows = rows.where(day >= first) if first else rows
    return rows.where(day <= last) if last else rows


def front_matter(text: Column) -> Column:
    """Flat ``key: value`` lines between the first two ``---`` lines, as a map."""
    block = F.regexp_extract(text, r"^---\r?\n([\s\S]*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike(r"^\s*[\w-]+\s*:"))
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*([\w-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_replace(x, r"^\s*[\w-]+\s*:", "")).alias("value"))
    return F.map_from_entries(F.transform(pairs, entry))


def list_of(value: Column) -> Column:
    """A value of front matter as a list: parted by commas, brackets and quotes don't count; null and empty give none."""
    items = F.transform(F.split(F.regexp_replace(value, r"^\s*\[|\]\s*$", ""), ","), lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", ""))
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x != "")


def source_paths(yaml: str) -> list[str]:
    """Paths under ``source_paths:`` of a small configuration."""
    block = re.search(r"(?m)^source_paths:\s*\n((?:[ \t]+-.*\n?|\s*#.*\n?)*)", yaml + "\n")
    return [x.strip().strip("\"'") for x in re.findall(r"(?m)^[ \t]+-\s*([^#\n]+)", block.group(1))] if block else []


def ranking_weights(yaml: str) -> dict[str, float]:
    """Numbers under ``ranking:``; others keep their defaults."""
    out = {"semantic": 0.4, "graph": 0.25, "trust": 0.2, "recency": 0.15}
    block = re.search(r"(?m)^ranking:\s*\n((?:[ \t]+.*\n?)*)", yaml + "\n")
    for k, v in re.findall(r"(?m)^[ \t]+(\w+):\s*(-?\d+(?:\.\d+)?)", block.group(1)) if block else []:
        if k in out:
            out[k] = float(v)
    return out


def rule_list(yaml: str) -> list[dict]:
    """Rules of a small configuration: ``- id:`` items with their flat keys; only enforced ones are active."""
    out = []
    for item in re.split(r"(?m)^\s*-\s+(?=id:)", yaml)[1:]:
        keys = {k: v.strip().strip("\"'") for k, v in re.findall(r"(?m)^\s*(\w+):\s*([^\n#]*)", item)}
        out.append({"id": keys["id"], "title": keys.get("title") or keys["id"], "body": keys.get("description", ""), "scope": keys.get("scope", "global"),
                    "priority": int(keys.get("priority", 0) or 0), "status": "active" if keys.get("enforce") == "true" else "draft"})
    return out


def coverage_totals(spark: SparkSession, lcov_path: str) -> DataFrame:
    """Lines and branches found and hit of a coverage trace."""
    lines = spark.read.text(lcov_path)
    part = lambda k: F.sum(F.when(F.col("value").startswith(k + ":"), F.substring_index("value", ":", -1).cast("long")))
    return lines.agg(*[F.coalesce(part(k), F.lit(0)).alias(n) for k, n in (("LF", "lines"), ("LH", "lines_hit"), ("BRF", "branches"), ("BRH", "branches_hit"))]).withColumn(
        "line_pct", F.when(F.col("lines") > 0, F.col("lines_hit") / F.col("lines") * 100))


def coverage_summary(spark: SparkSession, path: str) -> DataFrame:
    """Lines and branches covered, from a summary in JSON: its ``total`` with the counts and percentages."""
    total = spark.read.option("multiLine", True).json(path).select("total.*")
    return total.select(F.col("lines.total").alias("lines"), F.col("lines.covered").alias("lines_hit"), F.col("branches.total").alias("branches"), F.col("branches.covered").alias("branches_hit"), F.col("lines.pct").cast("double").alias("line_pct"))


def processes(spark: SparkSession, listing: list[str]) -> DataFrame:
    """``(pid, ppid, user, comm, args)`` of a process listing; lines of another form are dropped."""
    rows = spark.createDataFrame([(x,) for x in listing], "line string")
    pattern = r"^\s*(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s*(.*)$"
    get = lambda i: F.regexp_extract("line", pattern, i)
    return rows.where(F.col("line").rlike(pattern)).select(get(1).cast("long").alias("pid"), get(2).cast("long").alias("ppid"), get(3).alias("user"), get(4).alias("comm"), get(5).alias("args"))
