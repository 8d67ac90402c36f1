"""Queries on relations between files, chunks, decision records and projects, and on nodes made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from . import context as C
from . import sample_files as SF
from . import sqltext as X


def sql_calls(spark: SparkSession, d: str) -> DataFrame:
    """Files with the SQL objects that their texts, resources and settings name, directly or by key."""
    return R.calls_sql(SF.files(spark, d), SF.chunks(spark, d))


def embedded_sql(spark: SparkSession, d: str) -> DataFrame:
    return R.embedded_sql(SF.files(spark, d))


def resource_sql(spark: SparkSession, d: str) -> DataFrame:
    return R.resource_sql(SF.files(spark, d))


def uses_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.uses_keys(SF.files(spark, d), SF.chunks(spark, d))


def uses_files(spark: SparkSession, d: str) -> DataFrame:
    return R.uses_files(SF.files(spark, d))


def config_includes(spark: SparkSession, d: str) -> DataFrame:
    return R.config_includes(SF.files(spark, d))


def config_transforms(spark: SparkSession, d: str) -> DataFrame:
    """X.Env.config files that hold transformations with the X.config of their folder."""
    return R.transforms(SF.files(spark, d))


def transform_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.transform_keys(SF.files(spark, d), SF.chunks(spark, d))


def machine_configs(spark: SparkSession, d: str) -> DataFrame:
    return R.machine_configs(SF.files(spark, d))


def section_handlers(spark: SparkSession, d: str) -> DataFrame:
    return R.section_handlers(SF.files(spark, d))


def project_links(spark: SparkSession, d: str) -> DataFrame:
    return R.project_links(SF.files(spark, d))


def projects(spark: SparkSession, d: str) -> DataFrame:
    return R.projects(SF.files(spark, d))


def supersedes(spark: SparkSession, d: str) -> DataFrame:
    """Decision records with those they say they replace."""
    return R.supersedes(C.adrs(SF.files(spark, d)))


def adr_records(spark: SparkSession, d: str) -> DataFrame:
    return C.adrs(SF.files(spark, d)).select("id", "path", "title", "decision_date", F.md5("body").alias("body_hash"))


def module_summaries(spark: SparkSession, d: str) -> DataFrame:
    return R.module_summaries(SF.files(spark, d), C.modules(spark, d).select("id", "path", "exported_symbols").unionByName(spark.createDataFrame([("module:src", "src", "start, Store")], "id string, path string, exported_symbols string")))


def built_relations(spark: SparkSession, d: str) -> DataFrame:
    """``(from_id, to_id, relation, note)``: all relations that the builders find."""
    f, c = SF.files(spark, d), SF.chunks(spark, d)
    named = lambda df, r: df.withColumn("relation", F.lit(r))
    parts = [named(R.calls_sql(f, c), "CALLS_SQL"), R.uses_keys(f, c), R.uses_files(f), named(R.config_includes(f), "USES_CONFIG"), named(R.machine_configs(f), "USES_CONFIG"), named(R.section_handlers(f), "USES_CONFIG"),
             named(R.transforms(f), "TRANSFORMS_CONFIG"), named(R.transform_keys(f, c), "TRANSFORMS_CONFIG"), R.project_links(f), named(R.supersedes(C.adrs(f)), "SUPERSEDES")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("from_id", "to_id", "relation", "note")


def signals_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Files and chunks with the lines that their relations to SQL and configuration add to their texts."""
    labels = SF.files(spark, d).select("id", F.col("path").alias("label")).unionByName(SF.chunks(spark, d).select("id", F.col("name").alias("label")))
    rels = built_relations(spark, d).withColumn("ord", F.xxhash64("from_id", "to_id", "relation", "note"))
    return C.relation_signals(rels, labels).select("id", F.size(F.split("signals", "\n")).alias("n_lines"), F.array_join(F.array_sort(F.split("signals", "\n")), "\n").alias("lines"))


QUERIES = {f.__name__: f for f in (sql_calls, embedded_sql, resource_sql, uses_keys, uses_files, config_includes, config_transforms, transform_keys, machine_configs, section_handlers, project_links, projects, supersedes,
                                   adr_records, module_summaries, built_relations, signals_in_text)}


def _all(text: str, patterns) -> str:
    q = lambda p: p.replace("'", "''")
    return "list_distinct(flatten([" + ", ".join(f"regexp_extract_all({text}, '{q(p)}', 1)" for p in patterns) + "]))"


def _tok(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def _unesc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _sqlname(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({x}), '[;\"`]', '', 'g'), '\[(.+?)\]', '\1', 'g'), '\s+', '', 'g'), '^\.+|\.+$', '', 'g'), '\.\.+', '.', 'g'))"


def _refs(x: str) -> str:
    names = f"list_filter(list_transform({_all(x, R.SQL_NAMES)}, lambda n: {_sqlname('n')}), lambda n: n <> '' and not starts_with(n, '@') and not starts_with(n, '#'))"
    return f"list_distinct(list_concat(case when regexp_matches({_sqlname(x)}, '^[a-z0-9_.]+$') and contains({_sqlname(x)}, '.') then [{_sqlname(x)}] else [] end, {names}))"


_EXT = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"
_TAIL = "string_split({x}, '.')[-1]"
_BASE = f"with {X.FILES}, {X.CHUNKS}, {SF.SQL_FILES}, {SF.SQL_CHUNKS}, f as (select *, {_EXT} ext, case when instr(path, '/') > 0 then regexp_replace(path, '/[^/]*$', '') else '.' end dir from fs)"
_ENTRIES = rf""", ent as (select id, ext, unnest(regexp_extract_all(content, '(?i)<data\b[^>]*\bname="[^"]+"[^>]*>(?:[\s\S]*?</data>)?')) m from f where ext = '.resx'
        union all select id, ext, unnest(regexp_extract_all(content, '(?i)<Setting\b[^>]*\bName="[^"]+"[^>]*>(?:[\s\S]*?</Setting>)?')) from f where ext = '.settings'
        union all select id, ext, unnest(regexp_extract_all(content, '(?i)<add\b[^>]+?/?>')) from f where ext = '.config'),
    kv as (select id, ext, {_tok(_unesc('''coalesce(nullif(regexp_extract(m, '(?i)\\bname="([^"]+)"', 1), ''), case when ext = '.config' then regexp_extract(m, '(?i)\\bkey="([^"]+)"', 1) else '' end)'''))} k,
           case when ext = '.config' then '' else trim({_unesc("regexp_extract(m, '(?i)<value(?:\\s[^>]*)?>([\\s\\S]*?)</value>', 1)")}) end v from ent where m is not null),
    keyed as (select * from kv where k <> ''), rsql as (select distinct k, unnest({_refs('v')}) ref from keyed where v <> '')"""
_CODEKEYS = f""", rk as (select id from_id, ext, unnest(list_distinct(list_transform({_all('content', R.RESOURCE_KEYS)}, lambda x: {_tok('x')}))) k from f where ext in {R.SQL_SOURCES}),
    ck as (select id from_id, unnest(list_distinct(list_transform({_all('content', R.CONFIG_KEYS)}, lambda x: {_tok('x')}))) k from f where ext in ('.vb', '.cs'))"""
_EMBEDDED = f""", st as (select id from_id, unnest({_all('content', R.SQL_STRINGS)}) s from f where ext in {R.SQL_SOURCES}),
    emb as (select from_id, unnest({_refs('s')}) ref from st union select id, unnest({_refs('v')}) from keyed where v <> '' union select from_id, ref from rk join rsql using (k))"""
_ALIASES = f""", al as (select id to_id, file_id, lower("language") l, unnest(list_distinct(case when lower("language") = 'sql' then [{_sqlname('"name"')}, {_TAIL.format(x=_sqlname('"name"'))}] else [{_tok('"name"')}, {_tok(_TAIL.format(x='"name"'))}] end)) a
        from cs where not contains(id, ':window:'))"""
_INCLUDE = r"""(?i)<([A-Za-z_][A-Za-z0-9_.:-]*)\b([^>]*?)\b(configSource|file)="([^"]+)"([^>]*)>"""
_XDT = r"(regexp_matches(content, '(?i)\bxdt:(?:transform|locator)\b') or regexp_matches(content, '(?i)\bxmlns:xdt='))"
_TRANS = rf""", tr0 as (select id, dir, regexp_extract(path, '([^/]+)\.config$', 1) b from f where ext = '.config' and {_XDT}),
    tr1 as (select id, dir, regexp_extract(b, '^(.+)\.([^.]+)$', 1) s, regexp_extract(b, '^(.+)\.([^.]+)$', 2) e from tr0),
    tr as (select distinct tr1.id from_id, t.id to_id, {_tok('e')} note from tr1 join fs t on t.path = case when dir = '.' then '' else dir || '/' end || s || '.config' where s <> '' and tr1.id <> t.id)"""
# Paths of the samples go up one folder at most.
_UP = r"regexp_replace(regexp_replace({x}, '(^|/)[^/]+/\.\./', '\1'), '(^|/)\./', '\1', 'g')"
_MEMBER = r'(?im)^Project\([^)]*\)\s*=\s*"([^"]+)",\s*"([^"]+\.(?:vbproj|csproj|fsproj|vcxproj))",\s*"\{[^"]+\}"\r?$'
_PROJ = rf""", defs as (select 'project:' || path id, id file, path, dir, ext, content, updated_at from f where ext in ('.vbproj', '.csproj', '.fsproj', '.vcxproj', '.sln')),
    inc as (select id, dir, 'i' t, unnest(regexp_extract_all(content, '(?i)<(?:{"|".join(R.PROJECT_ITEMS)})\b[^>]*\bInclude="([^"]+)"[^>]*/?>', 1)) x from defs where ext <> '.sln'
            union all select id, dir, 'r', unnest(regexp_extract_all(content, '(?i)<(?:ProjectReference)\b[^>]*\bInclude="([^"]+)"[^>]*/?>', 1)) from defs where ext <> '.sln'
            union all select id, dir, 's', unnest(regexp_extract_all(content, '{_MEMBER}')) from defs where ext = '.sln'),
    tgt as (select id, t, case when t = 's' then trim(regexp_extract(x, '{_MEMBER}', 1)) else trim({_unesc('x')}) end n,
            {_UP.format(x="dir || '/' || replace(case when t = 's' then regexp_extract(x, '" + _MEMBER + "', 2) else trim(" + _unesc('x') + ") end, '\\', '/')")} p from inc),
    pl as (select id from_id, file to_id, '' note, 'INCLUDES_FILE' relation from defs union select tgt.id, fs.id, '', 'INCLUDES_FILE' from tgt join fs on fs.path = p where t = 'i'
           union select tgt.id, 'project:' || p, n, 'REFERENCES_PROJECT' from tgt join fs on fs.path = p where t = 'r' union select tgt.id, 'project:' || p, 'solution_member:' || n, 'REFERENCES_PROJECT' from tgt join fs on fs.path = p where t = 's')"""
_RECORDS = X.ADRS.replace("from files where kind = 'ADR'", "from fs where kind = 'ADR'")
_SUPER = f""", nm as (select id, path, regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1') b, title, body from records),
    own as (select id, path, unnest(list_distinct(list_filter([{_tok('id')}, {_tok('b')}, {_tok('title')}, case when regexp_matches(b, '\\d') then 'adr' || regexp_extract(b, '(\\d+)', 1) else '' end, regexp_extract(b, '(\\d+)', 1)], lambda x: x <> ''))) n from nm),
    first_own as (select n, arg_min(id, (path, id)) to_id from own group by n),
    said as (select id from_id, unnest(list_distinct(regexp_extract_all(body, '(?i)(?:supersedes|ersätter)\\s*[:\\-]?\\s*([A-Za-z0-9._/-]+)', 1))) ref from records),
    sup as (select distinct from_id, to_id, 'Supersedes ' || ref note from said join first_own on n = {_tok('ref')} where from_id <> to_id)"""
_CALLS = "calls_sql as (select distinct e.from_id, a.to_id, e.ref note from (select from_id, ref, unnest(list_distinct([ref, string_split(ref, '.')[-1]])) x from emb) e join al a on a.a = e.x and a.l = 'sql' where e.from_id <> a.to_id)"
_KEYS = """ukeys as (select distinct from_id, to_id, k note, 'USES_CONFIG_KEY' relation from ck join al on a = k and l = 'config' where k <> '' union select from_id, to_id, k, case l when 'resource' then 'USES_RESOURCE_KEY' else 'USES_SETTING_KEY' end
        from rk join al on a = k and l in ('resource', 'settings') where k <> '' and ext in ('.vb', '.cs'))"""
_UFILES = """ufiles as (select distinct from_id, keyed.id to_id, k note, case keyed.ext when '.resx' then 'USES_RESOURCE' else 'USES_SETTING' end relation from rk join keyed using (k) where rk.ext in ('.vb', '.cs') and keyed.ext <> '.config' and from_id <> keyed.id
        union select from_id, keyed.id, k, 'USES_CONFIG' from ck join keyed using (k) where keyed.ext = '.config' and from_id <> keyed.id)"""
_INCL = rf"""incl0 as (select id, dir, unnest(regexp_extract_all(content, '{_INCLUDE}')) m from f where ext = '.config'),
    incl1 as (select id, dir, lower(regexp_extract(m, '{_INCLUDE}', 1)) || ':' || lower(regexp_extract(m, '{_INCLUDE}', 3)) note, replace(trim({_unesc("regexp_extract(m, '" + _INCLUDE + "', 4)")}), '\', '/') t from incl0),
    incl as (select distinct i.id from_id, fs.id to_id, note from incl1 i join fs on fs.path = {_UP.format(x="case when dir = '.' then '' else dir || '/' end || t")} where t[1] not in ('/', '~') and i.id <> fs.id)"""
_MACH = rf"""mc as (select id, string_split(path, '/') p from f where lower(string_split(path, '/')[-1]) = 'machine.config'),
    cf as (select id, string_split(path, '/') p from f where ext = '.config' and lower(string_split(path, '/')[-1]) <> 'machine.config' and regexp_matches(content, '(?i)<configuration\b')
           and not (regexp_matches(string_split(path, '/')[-1], '^.+\.[^.]+\.config$') and {_XDT})),
    mj as (select cf.id from_id, mc.id to_id, (select count(*) from (select unnest(generate_series(1, least(len(cf.p), len(mc.p)) - 1)) i) where cf.p[1:i] = mc.p[1:i]) n from cf, mc),
    mach as (select from_id, arg_min(to_id, (-n, to_id)) to_id, 'inherits:machine' note from mj group by 1)"""
_SECT = rf"""se as (select id from_id, unnest(regexp_extract_all(content, '(?i)<section\b[^>]*?/?>')) m from f where ext = '.config'),
    sd as (select from_id, {_tok(_unesc("regexp_extract(m, '(?i)\\bname=\"([^\"]+)\"', 1)"))} n, string_split(trim({_unesc("regexp_extract(m, '(?i)\\btype=\"([^\"]+)\"', 1)")}), ',') t from se),
    sx as (select from_id, 'section_handler:' || n note, {_tok("string_split(string_split(trim(t[1]), '.')[-1], '+')[-1]")} ty, {_tok("coalesce(t[2], '')")} asm from sd where n <> ''),
    pa as (select id to_id, unnest([{_tok("regexp_extract(content, '(?i)<AssemblyName>([\\s\\S]*?)</AssemblyName>', 1)")}, {_tok("regexp_extract(content, '(?i)<RootNamespace>([\\s\\S]*?)</RootNamespace>', 1)")}, {_tok("regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')")}]) asm from f where ext in ('.vbproj', '.csproj', '.fsproj', '.vcxproj')),
    ty as (select id to_id, {_tok('x')} ty from (select id, unnest(regexp_extract_all(content, '(?i)\b(?:class|interface|enum|module|structure)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) x from f where ext = '.vb' and kind = 'CODE'
           union all select id, unnest(regexp_extract_all(content, '(?i)\b(?:class|struct|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) from f where ext = '.cs' and kind = 'CODE')),
    sect as (select distinct from_id, to_id, note from sx join pa using (asm) where asm <> '' union select from_id, to_id, note from sx join ty using (ty) where ty <> '')"""
_TKEYS = "tkeys as (select distinct tr.from_id, al.to_id, k || ':' || note note from tr join keyed on keyed.id = tr.from_id and ext = '.config' join al on al.a = k and al.l = 'config' and al.file_id = tr.to_id)"
_FULL = _BASE + _ENTRIES + _CODEKEYS + _EMBEDDED + _ALIASES + _TRANS + _PROJ + "," + ",".join((_RECORDS, _CALLS, _KEYS, _UFILES, _INCL, _MACH, _SECT, _TKEYS)) + _SUPER
_BUILT = """built as (select from_id, to_id, 'CALLS_SQL' relation, note from calls_sql union all select from_id, to_id, relation, note from ukeys union all select from_id, to_id, relation, note from ufiles union all select from_id, to_id, 'USES_CONFIG', note from incl
    union all select from_id, to_id, 'USES_CONFIG', note from mach union all select from_id, to_id, 'USES_CONFIG', note from sect union all select from_id, to_id, 'TRANSFORMS_CONFIG', note from tr union all select from_id, to_id, 'TRANSFORMS_CONFIG', note from tkeys
    union all select from_id, to_id, relation, note from pl union all select from_id, to_id, 'SUPERSEDES', note from sup)"""
_DIRMODS = """mm as (select id, path dir, exported_symbols from mods union all select 'module:src', 'src', 'start, Store'),
    ms as (select dir, count(*) n, count(*) filter (kind = 'CODE') n_code, min(case when kind = 'CODE' then ext end) lo, max(case when kind = 'CODE' then ext end) hi from f group by dir),
    rd as (select dir, substr(trim(regexp_replace(regexp_replace(content, '^(?:(?:#[^\\n]*|[ \\t\\r]*)\\n)*', ''), '\\r?\\n', ' ', 'g')), 1, 300) s from f where string_split(path, '/')[-1] = 'README.md')"""

SQL = {
    "sql_calls": _FULL + " select * from calls_sql", "embedded_sql": _FULL + " select * from emb", "resource_sql": _FULL + ' select k "key", ref from rsql', "uses_keys": _FULL + " select * from ukeys",
    "uses_files": _FULL + " select * from ufiles", "config_includes": _FULL + " select * from incl", "config_transforms": _FULL + " select * from tr", "transform_keys": _FULL + " select * from tkeys",
    "machine_configs": _FULL + " select * from mach", "section_handlers": _FULL + " select * from sect", "project_links": _FULL + " select * from pl", "supersedes": _FULL + " select * from sup",
    "adr_records": _FULL + " select id, path, title, decision_date, md5(body) body_hash from records",
    "built_relations": _FULL + "," + _BUILT + " select * from built",
    "signals_in_text": _FULL + "," + _BUILT + """, lab as (select id, path n from fs union all select id, "name" from cs),
        s as (select b.*, coalesce(x.n, from_id) src, coalesce(y.n, to_id) tgt from built b left join lab x on x.id = from_id left join lab y on y.id = to_id where relation in ('CALLS_SQL', 'USES_CONFIG_KEY', 'USES_RESOURCE_KEY', 'USES_SETTING_KEY', 'USES_CONFIG', 'TRANSFORMS_CONFIG')),
        l as (select from_id id, concat_ws(' ', lower(relation), nullif(note, ''), tgt) line from s union all select to_id, concat_ws(' ', 'affected_by', lower(relation), nullif(note, ''), src) from s)
        select id, count(*)::int n_lines, string_agg(line, chr(10) order by line) "lines" from l group by id""",
    "module_summaries": _BASE + f", {X.MODULES}, {_DIRMODS}" + r"""
        select mm.id, coalesce(case when length(s) > 20 then s end, concat_ws('. ', 'Module ' || string_split(mm.dir, '/')[-1], 'Contains ' || n || ' files (' || n_code || ' code, ' || (n - n_code) || ' docs)',
            case when lo = hi then map {'.ts': 'TypeScript', '.tsx': 'TypeScript React', '.mts': 'TypeScript ESM', '.cts': 'TypeScript CommonJS', '.js': 'JavaScript', '.jsx': 'JavaScript React', '.mjs': 'JavaScript ESM', '.cjs': 'JavaScript CommonJS'}[lo] || ' source files' end,
            case when exported_symbols <> '' then 'Key exports: ' || array_to_string(string_split(exported_symbols, ', ')[1:5], ', ') end) || '.') summary from mm join ms using (dir) left join rd using (dir)""",
    "projects": _FULL + rf""", cnt as (select from_id id, count(*) filter (relation = 'INCLUDES_FILE') nf, count(*) filter (relation = 'REFERENCES_PROJECT') nr from pl group by 1),
        p as (select id, path, ext, regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '') b, trim({_unesc("regexp_extract(content, '(?i)<AssemblyName>([\\s\\S]*?)</AssemblyName>', 1)")}) an, trim({_unesc("regexp_extract(content, '(?i)<RootNamespace>([\\s\\S]*?)</RootNamespace>', 1)")}) rn,
              string_split(coalesce(nullif(trim(regexp_extract(content, '(?i)<TargetFramework>([\s\S]*?)</TargetFramework>', 1)), ''), nullif(trim(regexp_extract(content, '(?i)<TargetFrameworkVersion>([\s\S]*?)</TargetFrameworkVersion>', 1)), ''), trim(regexp_extract(content, '(?i)<TargetFrameworks>([\s\S]*?)</TargetFrameworks>', 1))), ';')[1] tf,
              len(regexp_extract_all(content, '{_MEMBER}')) nd, updated_at, nf, nr from defs join cnt using (id)),
        q as (select *, case when ext = '.sln' then b else coalesce(nullif(an, ''), nullif(rn, ''), b) end n, map {{'.vbproj': 'vbnet', '.csproj': 'csharp', '.fsproj': 'fsharp', '.vcxproj': 'cpp', '.sln': 'solution'}}[ext] lang from p)
        select id, path, n "name", case when ext = '.sln' then 'solution' else 'project' end kind, lang "language", case when ext = '.sln' then '' else tf end target_framework,
               case when ext = '.sln' then concat_ws('. ', 'Solution ' || n, case when nd > 0 then 'Contains ' || nd || ' project references' end)
                    else concat_ws('. ', upper(lang) || ' project ' || n, case when tf <> '' then 'Target framework ' || tf end, case when nf > 1 then 'Includes ' || (nf - 1) || ' indexed project files' end, case when nr > 0 then 'References ' || nr || ' projects' end) end || '.' summary,
               nf::int file_count, updated_at, false source_of_truth, case when ext = '.sln' then 78 else 80 end trust_level, 'active' status from q""",
}
