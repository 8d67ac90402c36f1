"""Relations between files, chunks, records and projects, from what their texts say: pattern extraction and equi joins.

All of it stays in the JVM. Frames: ``files(id, path, kind, content)``, ``chunks(id, file_id, name, language)``.
Every result is ``(from_id, to_id, note)`` without repeats and without links to itself; null texts say nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import dirname

# Where code names SQL, resources and settings, and keys of a configuration.
SQL_STRINGS = (
    r'(?i)\b(?:SqlCommand|OleDbCommand|OdbcCommand)\s*\(\s*"([^"\r\n]{2,200})"', r'(?i)\bCommandText\s*=\s*"([^"\r\n]{2,500})"',
    r'(?i)\bCommandType\s*=\s*(?:CommandType\.)?StoredProcedure[\s\S]{0,240}?"([^"\r\n]{2,200})"', r'(?i)"([^"\r\n]{2,200})"[\s\S]{0,240}?\bCommandType\s*=\s*(?:CommandType\.)?StoredProcedure',
)
SQL_NAMES = tuple(rf"(?i)\b{w}\s+([#@]?[A-Za-z0-9_\[\].]+)" for w in (r"exec(?:ute)?", "from", "join", "update", r"insert\s+into", r"delete\s+from", r"merge\s+into"))
RESOURCE_KEYS = (
    r"\bMy\.Resources\.([A-Za-z_][A-Za-z0-9_]*)", r"\bResources\.([A-Za-z_][A-Za-z0-9_]*)", r"\bMy\.Settings\.([A-Za-z_][A-Za-z0-9_]*)",
    r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)?Settings\.Default\.([A-Za-z_][A-Za-z0-9_]*)", r'\bGetString\(\s*"([^"\r\n]+)"', r'\bGetObject\(\s*"([^"\r\n]+)"',
)
CONFIG_KEYS = (
    r'\bConfigurationManager\.ConnectionStrings\s*\[\s*"([^"\r\n]+)"\s*\]', r'\bConfigurationManager\.ConnectionStrings\s*\(\s*"([^"\r\n]+)"\s*\)',
    r'\bConfigurationManager\.AppSettings\s*\[\s*"([^"\r\n]+)"\s*\]', r'\bConfigurationManager\.AppSettings\s*\(\s*"([^"\r\n]+)"\s*\)',
    r'\bGetConnectionString\(\s*"([^"\r\n]+)"\s*\)', r'\bGetAppSetting\(\s*"([^"\r\n]+)"\s*\)',
)
SQL_SOURCES = (".vb", ".cs", ".config", ".resx", ".settings")
PROJECT_LANGUAGES = {".vbproj": "vbnet", ".csproj": "csharp", ".fsproj": "fsharp", ".vcxproj": "cpp", ".sln": "solution"}
#: Elements of a project that name its files.
PROJECT_ITEMS = ("Compile", "Content", "EmbeddedResource", "None", "Page", "ApplicationDefinition")

LINK = ("from_id", "to_id", "note")


def token(c: Column) -> Column:
    """A key as it is compared: its ASCII letters and digits in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def unescaped(c: Column) -> Column:
    for a, b in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def sql_name(c: Column) -> Column:
    """A name without quotes, brackets and blanks, in lower case, with single dots."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), r'[;"`]', ""), r"\[(.+?)\]", "$1"), r"\s+", "")
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\.+|\.+$", ""), r"\.\.+", "."))


def aliases(name: Column) -> Column:
    """A name and its part after the last dot."""
    return F.array_distinct(F.filter(F.array(name, F.element_at(F.split(name, r"\."), -1)), lambda x: x != ""))


def found(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first groups of the patterns match, each once."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])))


def names_in_sql(text: Column) -> Column:
    """SQL objects that a text refers to: those after its keywords, and the text itself if it is a dotted name."""
    whole = sql_name(text)
    named = F.filter(F.transform(found(text, SQL_NAMES), sql_name), lambda n: (n != "") & ~n.startswith("@") & ~n.startswith("#"))
    return F.array_distinct(F.concat(F.when(whole.rlike(r"^[a-z0-9_.]+$") & whole.contains("."), F.array(whole)).otherwise(F.array().cast("array<string>")), named))


def links(rows: DataFrame) -> DataFrame:
    return rows.where("from_id <> to_id").select(*LINK).distinct()


def keyed_values(files: DataFrame) -> DataFrame:
    """``(id, ext, key, value)``: entries of resource and settings files, and of configurations by name or key."""
    e = ext(F.col("path"))
    pair = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(0))
    data = files.where(e == ".resx").select("id", e.alias("ext"), F.explode(pair(r'(?i)<data\b[^>]*\bname="[^"]+"[^>]*>(?:[\s\S]*?</data>)?')).alias("m"))
    sett = files.where(e == ".settings").select("id", e.alias("ext"), F.explode(pair(r'(?i)<Setting\b[^>]*\bName="[^"]+"[^>]*>(?:[\s\S]*?</Setting>)?')).alias("m"))
    conf = files.where(e == ".config").select("id", e.alias("ext"), F.explode(pair(r"(?i)<add\b[^>]+?/?>")).alias("m"))
    get = lambda p: F.regexp_extract("m", p, 1)
    named = data.unionByName(sett).select("id", "ext", token(unescaped(get(r'(?i)\bname="([^"]+)"'))).alias("key"), F.trim(unescaped(get(r"(?i)<value(?:\s[^>]*)?>([\s\S]*?)</value>"))).alias("value"))
    by = F.when(get(r'(?i)\bname="([^"]+)"') != "", get(r'(?i)\bname="([^"]+)"')).otherwise(get(r'(?i)\bkey="([^"]+)"'))
    return named.unionByName(conf.select("id", "ext", token(unescaped(by)).alias("key"), F.lit("").alias("value"))).where("key <> ''")


def resource_sql(files: DataFrame) -> DataFrame:
    """``(key, ref)``: SQL objects that the value of a resource or setting names."""
    return keyed_values(files).where("value <> ''").select("key", F.explode(names_in_sql(F.col("value"))).alias("ref")).distinct()


def code_keys(files: DataFrame, patterns: tuple[str, ...], exts: tuple[str, ...] = (".vb", ".cs")) -> DataFrame:
    """``(from_id, key)``: keys that code asks for."""
    return files.where(ext(F.col("path")).isin(*exts)).select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.transform(found(F.col("content"), patterns), token))).alias("key")).where("key <> ''")


def embedded_sql(files: DataFrame) -> DataFrame:
    """``(from_id, ref)``: SQL objects that files name, in their texts of commands or through a resource."""
    src = files.where(ext(F.col("path")).isin(*SQL_SOURCES))
    direct = src.select(F.col("id").alias("from_id"), F.explode(found(F.col("content"), SQL_STRINGS)).alias("s")).select("from_id", F.explode(names_in_sql(F.col("s"))).alias("ref"))
    own = keyed_values(files).where("value <> ''").select(F.col("id").alias("from_id"), F.explode(names_in_sql(F.col("value"))).alias("ref"))
    through = code_keys(files, RESOURCE_KEYS, SQL_SOURCES).join(resource_sql(files), "key").select("from_id", "ref")
    return direct.unionByName(own).unionByName(through).distinct()


def chunk_aliases(chunks: DataFrame, language: str) -> DataFrame:
    """``(to_id, file_id, alias)`` of the chunks of a language; windows have none."""
    rows = chunks.where((F.lower("language") == language) & ~F.col("id").contains(":window:"))
    names = aliases(sql_name(F.col("name"))) if language == "sql" else F.array_distinct(F.array(token(F.col("name")), token(F.element_at(F.split("name", r"\."), -1))))
    return rows.select(F.col("id").alias("to_id"), "file_id", F.explode(names).alias("alias")).where("alias <> ''")


def calls_sql(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """CALLS_SQL: from files to the SQL chunks whose full name, or last part, they name."""
    refs = embedded_sql(files).select("from_id", "ref", F.explode(aliases(F.col("ref"))).alias("alias"))
    return links(refs.join(chunk_aliases(chunks, "sql"), "alias").select("from_id", "to_id", F.col("ref").alias("note")))


def uses_keys(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """USES_CONFIG_KEY, USES_RESOURCE_KEY, USES_SETTING_KEY: from code to the entries it asks for; adds ``relation``."""
    out = None
    for relation, patterns, language in (("USES_CONFIG_KEY", CONFIG_KEYS, "config"), ("USES_RESOURCE_KEY", RESOURCE_KEYS, "resource"), ("USES_SETTING_KEY", RESOURCE_KEYS, "settings")):
        hit = code_keys(files, patterns).join(chunk_aliases(chunks, language).withColumnRenamed("alias", "key"), "key").select("from_id", "to_id", F.col("key").alias("note"))
        hit = links(hit).withColumn("relation", F.lit(relation))
        out = hit if out is None else out.unionByName(hit)
    return out


def uses_files(files: DataFrame) -> DataFrame:
    """USES_RESOURCE, USES_SETTING, USES_CONFIG: from code to the files that hold the keys it asks for; adds ``relation``."""
    keys = keyed_values(files).select(F.col("id").alias("to_id"), "ext", "key").distinct()
    named = code_keys(files, RESOURCE_KEYS).join(keys.where("ext in ('.resx', '.settings')"), "key")
    conf = code_keys(files, CONFIG_KEYS).join(keys.where("ext = '.config'"), "key")
    both = named.unionByName(conf).where("from_id <> to_id")
    kind = F.when(F.col("ext") == ".resx", "USES_RESOURCE").when(F.col("ext") == ".settings", "USES_SETTING").otherwise("USES_CONFIG")
    return both.select("from_id", "to_id", F.col("key").alias("note"), kind.alias("relation")).distinct()


def resolved(folder: Column, target: Column) -> Column:
    """A relative path from a folder, without dots; null where it leads out of the tree."""
    parts = F.split(F.when(folder == ".", target).otherwise(F.concat(folder, F.lit("/"), target)), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda s, p: F.when((p == ".") | (p == ""), s).when((p == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(p))))
    path = F.array_join(walked, "/")
    return F.when((path != "") & (path != "..") & ~path.startswith("../"), path)


def config_includes(files: DataFrame) -> DataFrame:
    """Configurations with the files that their sections name by ``configSource`` or ``file``."""
    section = r'(?i)<([A-Za-z_][A-Za-z0-9_.:-]*)\b([^>]*?)\b(configSource|file)="([^"]+)"([^>]*)>'
    conf = files.where(F.lower("path").endswith(".config")).select(F.col("id").alias("from_id"), "path", F.explode(F.regexp_extract_all("content", F.lit(section), F.lit(0))).alias("m"))
    get = lambda i: F.regexp_extract("m", section, i)
    target = F.replace(F.trim(unescaped(get(4))), F.lit("\\"), F.lit("/"))
    rows = conf.select("from_id", target.alias("t"), resolved(dirname(F.col("path")), target).alias("path"), F.concat(F.lower(get(1)), F.lit(":"), F.lower(get(3))).alias("note"))
    rows = rows.where("not startswith(t, '/') and not startswith(t, '~')")
    return links(rows.join(files.select(F.col("id").alias("to_id"), "path"), "path"))


def transforms(files: DataFrame) -> DataFrame:
    """``(from_id, to_id, note)``: X.Env.config files that hold transformations, with the X.config of their folder and the environment."""
    base = F.regexp_extract("path", r"([^/]+)\.config$", 1)
    stem, env = F.regexp_extract(base, r"^(.+)\.([^.]+)$", 1), F.regexp_extract(base, r"^(.+)\.([^.]+)$", 2)
    folder = dirname(F.col("path"))
    rows = files.where(F.lower("path").endswith(".config") & (F.col("content").rlike(r"(?i)\bxdt:(?:transform|locator)\b") | F.col("content").rlike(r"(?i)\bxmlns:xdt=")))
    rows = rows.select(F.col("id").alias("from_id"), stem.alias("stem"), token(env).alias("note"), F.when(folder == ".", F.concat(stem, F.lit(".config"))).otherwise(F.concat(folder, F.lit("/"), stem, F.lit(".config"))).alias("path"))
    return links(rows.where("stem <> ''").join(files.select(F.col("id").alias("to_id"), "path"), "path"))


def transform_keys(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """TRANSFORMS_CONFIG on entries: a transforming file with the entries of its target file that it has keys of."""
    keys = keyed_values(files).where("ext = '.config'").select(F.col("id").alias("from_id"), "key")
    aimed = transforms(files).select("from_id", F.col("to_id").alias("file_id"), F.col("note").alias("env")).join(keys, "from_id")
    hit = aimed.join(chunk_aliases(chunks, "config").withColumnRenamed("alias", "key"), ["file_id", "key"])
    return links(hit.select("from_id", "to_id", F.concat("key", F.lit(":"), "env").alias("note")))


def machine_configs(files: DataFrame) -> DataFrame:
    """Every configuration with the machine.config that shares most of its folders, the smallest id on ties.

    Each machine.config stands under all folders above it, the smallest id of a folder is enough, and a
    configuration takes its deepest folder: equi joins instead of all pairs. The folder '' is above all.
    """
    prefixes = lambda c: F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/")) - 1), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/")))
    above = lambda c: F.when(F.instr(c, "/") > 0, prefixes(c)).otherwise(F.array(F.lit("")))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    machines = files.where(name == "machine.config").select(F.col("id").alias("to_id"), F.explode(above(F.col("path"))).alias("folder")).groupBy("folder").agg(F.min("to_id").alias("to_id"))
    conf = files.where(F.lower("path").endswith(".config") & (name != "machine.config") & F.col("content").rlike(r"(?i)<configuration\b"))
    base = F.regexp_extract("path", r"([^/]+)\.config$", 1)
    changes = base.rlike(r"^.+\.[^.]+$") & (F.col("content").rlike(r"(?i)\bxdt:(?:transform|locator)\b") | F.col("content").rlike(r"(?i)\bxmlns:xdt="))
    near = conf.where(~changes).select(F.col("id").alias("from_id"), F.posexplode(above(F.col("path"))).alias("depth", "folder")).join(machines, "folder")
    return links(near.groupBy("from_id").agg(F.max_by("to_id", "depth").alias("to_id")).withColumn("note", F.lit("inherits:machine")))


def section_handlers(files: DataFrame) -> DataFrame:
    """Configurations with the projects and code files that declare the types of their sections."""
    e, text = ext(F.col("path")), F.col("content")
    section = files.where(F.lower("path").endswith(".config")).select(F.col("id").alias("from_id"), F.explode(F.regexp_extract_all("content", F.lit(r"(?i)<section\b[^>]*?/?>"), F.lit(0))).alias("m"))
    typ = F.split(F.trim(unescaped(F.regexp_extract("m", r'(?i)\btype="([^"]+)"', 1))), r"\s*,\s*")
    short = F.element_at(F.split(F.element_at(F.split(typ[0], r"\."), -1), r"\+"), -1)
    said = section.select("from_id", F.concat(F.lit("section_handler:"), token(unescaped(F.regexp_extract("m", r'(?i)\bname="([^"]+)"', 1)))).alias("note"), token(short).alias("type"), token(F.coalesce(F.get(typ, F.lit(1)), F.lit(""))).alias("assembly"))
    said = said.where("note <> 'section_handler:'")
    tag = lambda t: token(unescaped(F.regexp_extract(text, rf"(?i)<{t}>([\s\S]*?)</{t}>", 1)))
    base = token(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))
    projects = files.where(e.isin(*[x for x in PROJECT_LANGUAGES if x != ".sln"])).select(F.col("id").alias("to_id"), F.explode(F.array_distinct(F.array(tag("AssemblyName"), tag("RootNamespace"), base))).alias("assembly")).where("assembly <> ''")
    declared = r"(?i)\b(?:class|struct|interface|enum|module|structure)\s+([A-Za-z_][A-Za-z0-9_]*)"
    allowed = F.when(e == ".vb", declared.replace("|struct|", "|")).otherwise(declared.replace("|module|structure", ""))
    types = files.where((F.col("kind") == "CODE") & e.isin(".vb", ".cs")).select(F.col("id").alias("to_id"), F.explode(F.array_distinct(F.regexp_extract_all("content", allowed, F.lit(1)))).alias("t")).select("to_id", token(F.col("t")).alias("type")).where("type <> ''")
    return links(said.where("assembly <> ''").join(projects, "assembly").select(*LINK).unionByName(said.where("type <> ''").join(types, "type").select(*LINK)))


def _includes(project: DataFrame, elements: tuple[str, ...]) -> DataFrame:
    """``(id, path, include, target)``: files that elements of a project name, as paths in the tree."""
    p = rf'(?i)<(?:{"|".join(elements)})\b[^>]*\bInclude="([^"]+)"[^>]*/?>'
    rows = project.select("id", "path", F.explode(F.regexp_extract_all("content", F.lit(p), F.lit(1))).alias("include")).withColumn("include", F.trim(unescaped(F.col("include"))))
    return rows.withColumn("target", resolved(dirname(F.col("path")), F.replace("include", F.lit("\\"), F.lit("/"))))


def project_links(files: DataFrame) -> DataFrame:
    """INCLUDES_FILE and REFERENCES_PROJECT of projects and solutions, to files that are there; adds ``relation``."""
    e = ext(F.col("path"))
    defs = files.where(e.isin(*PROJECT_LANGUAGES)).select("path", "content", F.concat(F.lit("project:"), "path").alias("id"), F.col("id").alias("file"))
    there = files.select(F.col("path").alias("target"), F.col("id").alias("file"))
    own = defs.select(F.col("id").alias("from_id"), F.col("file").alias("to_id"), F.lit("").alias("note"), F.lit("INCLUDES_FILE").alias("relation"))
    real = defs.where(~F.lower("path").endswith(".sln"))
    items = _includes(real, PROJECT_ITEMS).join(there, "target").select(F.col("id").alias("from_id"), F.col("file").alias("to_id"), F.lit("").alias("note"), F.lit("INCLUDES_FILE").alias("relation"))
    refs = _includes(real, ("ProjectReference",)).join(there, "target", "left_semi").select(F.col("id").alias("from_id"), F.concat(F.lit("project:"), "target").alias("to_id"), F.col("include").alias("note"), F.lit("REFERENCES_PROJECT").alias("relation"))
    member = r'(?im)^Project\([^)]*\)\s*=\s*"([^"]+)",\s*"([^"]+\.(?:vbproj|csproj|fsproj|vcxproj))",\s*"\{[^"]+\}"\r?$'
    sln = defs.where(F.lower("path").endswith(".sln")).select("id", "path", F.explode(F.regexp_extract_all("content", F.lit(member), F.lit(0))).alias("m"))
    sln = sln.select("id", F.trim(F.regexp_extract("m", member, 1)).alias("name"), resolved(dirname(F.col("path")), F.replace(F.regexp_extract("m", member, 2), F.lit("\\"), F.lit("/"))).alias("target"))
    members = sln.join(there, "target", "left_semi").select(F.col("id").alias("from_id"), F.concat(F.lit("project:"), "target").alias("to_id"), F.concat(F.lit("solution_member:"), "name").alias("note"), F.lit("REFERENCES_PROJECT").alias("relation"))
    return own.unionByName(items).unionByName(refs).unionByName(members).distinct()


def projects(files: DataFrame) -> DataFrame:
    """Projects and solutions as nodes, with what a summary says of them."""
    e, text = ext(F.col("path")), F.col("content")
    rel = project_links(files)
    own = rel.groupBy(F.col("from_id").alias("id")).agg(F.count_if(F.col("relation") == "INCLUDES_FILE").alias("file_count"), F.count_if(F.col("relation") == "REFERENCES_PROJECT").alias("n_refs"))
    tag = lambda t: F.trim(unescaped(F.regexp_extract(text, rf"(?i)<{t}>([\s\S]*?)</{t}>", 1)))
    first = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    language = F.create_map(*[F.lit(x) for kv in PROJECT_LANGUAGES.items() for x in kv])[e]
    solution = e == ".sln"
    declared = F.regexp_count(text, F.lit(r'(?im)^Project\([^)]*\)\s*=\s*"([^"]+)",\s*"([^"]+\.(?:vbproj|csproj|fsproj|vcxproj))",\s*"\{[^"]+\}"\r?$'))
    rows = files.where(e.isin(*PROJECT_LANGUAGES)).select(
        F.concat(F.lit("project:"), "path").alias("id"), "path", F.when(solution, base).otherwise(first(tag("AssemblyName"), tag("RootNamespace"), base)).alias("name"), F.when(solution, "solution").otherwise("project").alias("kind"),
        language.alias("language"), F.when(solution, "").otherwise(F.trim(F.split(first(tag("TargetFramework"), tag("TargetFrameworkVersion"), tag("TargetFrameworks")), ";")[0])).alias("target_framework"),
        "updated_at", F.when(solution, declared).otherwise(0).alias("n_declared"))
    rows = rows.join(own, "id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0))).withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))
    says = lambda test, *parts: F.when(test, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    n = lambda c: F.col(c).cast("string")
    is_sln = F.col("kind") == "solution"
    parts = F.array_compact(F.array(
        says(is_sln, "Solution ", F.col("name")), says(is_sln & (F.col("n_declared") > 0), "Contains ", n("n_declared"), " project references"),
        says(~is_sln, F.upper("language"), " project ", F.col("name")), says(~is_sln & (F.col("target_framework") != ""), "Target framework ", F.col("target_framework")),
        says(~is_sln & (F.col("file_count") > 1), "Includes ", (F.col("file_count") - 1).cast("string"), " indexed project files"), says(~is_sln & (F.col("n_refs") > 0), "References ", n("n_refs"), " projects")))
    return rows.select("id", "path", "name", "kind", "language", "target_framework", F.concat(F.array_join(parts, ". "), F.lit(".")).alias("summary"), F.col("file_count").cast("int").alias("file_count"), "updated_at",
                       F.lit(False).alias("source_of_truth"), F.when(is_sln, 78).otherwise(80).alias("trust_level"), F.lit("active").alias("status"))


def supersedes(records: DataFrame) -> DataFrame:
    """SUPERSEDES between decision records ``(id, path, title, body)``: what a record says it replaces, by id, file name,
    title or number; of several records with one such name the first by path stands."""
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    number = F.regexp_extract(base, r"(\d+)", 1)
    names = F.array_distinct(F.filter(F.concat(F.array(token(F.col("id")), token(base), token(F.col("title"))), F.when(number != "", F.array(F.concat(F.lit("adr"), number), number)).otherwise(F.array().cast("array<string>"))), lambda t: t != ""))
    owned = records.select("id", "path", F.explode(names).alias("name")).groupBy("name").agg(F.min_by("id", F.struct("path", "id")).alias("to_id"))
    said = records.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?iu)(?:supersedes|ersätter)\s*[:\-]?\s*([A-Za-z0-9._/-]+)"), F.lit(1)))).alias("ref"))
    return links(said.withColumn("name", token(F.col("ref"))).join(owned, "name").select("from_id", "to_id", F.concat(F.lit("Supersedes "), "ref").alias("note")))


def module_summaries(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``(id, summary)``: the start of a folder's README, else its counts, the language of its code and five exports.

    ``modules(id, path, exported_symbols)`` have at least a row per folder asked for.
    """
    f = files.withColumn("dir", dirname(F.col("path")))
    names = {".ts": "TypeScript", ".tsx": "TypeScript React", ".mts": "TypeScript ESM", ".cts": "TypeScript CommonJS", ".js": "JavaScript", ".jsx": "JavaScript React", ".mjs": "JavaScript ESM", ".cjs": "JavaScript CommonJS"}
    code = F.col("kind") == "CODE"
    stats = f.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.count_if(code).alias("n_code"), F.min(F.when(code, ext(F.col("path")))).alias("lo"), F.max(F.when(code, ext(F.col("path")))).alias("hi"))
    body = F.regexp_replace(F.regexp_replace(F.col("content"), r"^(?:(?:#[^\n]*|[ \t\r]*)\n)*", ""), r"\r?\n", " ")
    start = F.substring(F.trim(body), 1, 300)
    readme = f.where(F.element_at(F.split("path", "/"), -1) == "README.md").select("dir", start.alias("start")).where("length(start) > 20")
    rows = modules.select("id", F.col("path").alias("dir"), "exported_symbols").join(stats, "dir").join(readme, "dir", "left")
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("lo")]
    parts = F.array_compact(F.array(
        F.concat(F.lit("Module "), F.element_at(F.split("dir", "/"), -1)),
        F.concat(F.lit("Contains "), F.col("n").cast("string"), F.lit(" files ("), F.col("n_code").cast("string"), F.lit(" code, "), (F.col("n") - F.col("n_code")).cast("string"), F.lit(" docs)")),
        F.when((F.col("lo") == F.col("hi")) & kind.isNotNull(), F.concat(kind, F.lit(" source files"))),
        F.when(F.col("exported_symbols") != "", F.concat(F.lit("Key exports: "), F.array_join(F.slice(F.split("exported_symbols", ", "), 1, 5), ", ")))))
    return rows.select("id", F.coalesce("start", F.concat(F.array_join(parts, ". "), F.lit("."))).alias("summary"))

