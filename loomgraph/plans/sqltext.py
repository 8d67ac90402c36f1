"""SQL text for checking: the entity views and the token rules, as other engines write them."""

from __future__ import annotations

from ..functions import text as T


def sql_tokens(x: str) -> str:
    """Distinct tokens of a text expression."""
    named = x
    for pattern, word in ((r"c#", "csharp"), (r"f#", "fsharp"), (r"vb\.net", "vbnet")):
        named = rf"regexp_replace({named}, '(^|[^\p{{L}}\p{{N}}]){pattern}($|[^\p{{L}}\p{{N}}])', '\1 {word} \2', 'gi')"
    spaced = r"regexp_replace(regexp_replace(p, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '(\p{Lu}+)(\p{Lu}\p{Ll})', '\1 \2', 'g')"
    low = f"lower({spaced})"
    for a, b in T._HALVES:
        low = rf"regexp_replace({low}, '(^| ){a} {b}( |$)', '\1{a}{b}\2', 'g')"
    return (
        f"list_distinct(list_filter(flatten(list_transform(list_filter(string_split_regex({named}, '[^\\p{{L}}\\p{{N}}]+'), lambda p: length(p) >= 2), "
        f"lambda p: list_concat([lower(p)], string_split({low}, ' ')))), lambda t: length(t) >= 2))"
    )


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_lexical(x: str, toks: str, words: list[str], phrase: str) -> str:
    groups = T.token_groups(words)
    matched = " + ".join(f"(case when list_has_any({toks}, {sql_list(g)}) then 1 else 0 end)" for g in groups)
    quoted = phrase.replace("'", "''")
    return (
        f"case when ({matched}) > 0 then least(1.0, ({matched}) / {len(groups)}::double * 0.85::double + "
        f"case when contains(lower({x}), '{quoted}') then 0.15::double else 0.0::double end) else 0.0 end"
    )


FILES = r"""
files as (select file_id id, path, case when upper(coalesce(kind, '')) in ('CODE', 'ADR') then upper(kind) else 'DOC' end kind,
          substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 500) excerpt, coalesce(text, '') content, coalesce(updated_at, '') updated_at,
          coalesce(source_of_truth, false) source_of_truth, coalesce(trust_level, 50) trust_level, coalesce(status, 'active') status
          from documents where file_id <> '' and path <> '')"""
CHUNKS = """
now as (select id, arg_max(chunk_key, (ingested_at, chunk_key)) chunk_key from chunks where id <> '' and file_id <> '' and name <> '' group by id),
pieces as (select distinct c.id, c.file_id, c.name, coalesce(c.kind, 'function') kind, coalesce(c.signature, '') signature, coalesce(c.body, '') body,
           coalesce(c.description, '') description, coalesce(c.start_line, 0) start_line, coalesce(c.end_line, 0) end_line, coalesce(c.lang, 'javascript') "language",
           coalesce(c.exported, false) exported, coalesce(c.updated_at, '') updated_at, coalesce(c.source_of_truth, true) source_of_truth,
           coalesce(c.trust_level, 80) trust_level, coalesce(c.status, 'active') status
           from chunks c join now using (chunk_key) where c.id = now.id)"""
MODULES = """
mods as (select distinct on (id) id, coalesce(path, '') path, coalesce(name, '') name, coalesce(summary, '') summary, coalesce(exported_symbols, '') exported_symbols,
         coalesce(updated_at, '') updated_at, coalesce(source_of_truth, false) source_of_truth, coalesce(trust_level, 75) trust_level, coalesce(status, 'active') status
         from modules where id <> '')"""
ADRS = r"""
adr_rows as (select 'adr:' || lower(regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')) id, path, coalesce(nullif(trim(regexp_extract(content, '(?m)^#[ \t]+(.+?)\s*$', 1)), ''), regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')) title,
        substr(content, 1, 12000) body, coalesce(nullif(regexp_extract(content, '(?im)^\s*date:\s*["'']?(\d{4}-\d{2}-\d{2})["'']?\s*$', 1), ''), nullif(regexp_extract(content, '(?im)^\s*decision[_\s-]*date:\s*["'']?(\d{4}-\d{2}-\d{2})["'']?\s*$', 1), ''), substr(updated_at, 1, 10)) decision_date
        from files where kind = 'ADR'),
records as (select id, max(path) path, arg_max(title, path) title, arg_max(body, path) body, arg_max(decision_date, path) decision_date from adr_rows group by id)"""
RULES = """
ruleset as (select id, coalesce(nullif(title, ''), id) title, coalesce(body, '') body, coalesce(rule_scope, 'global') "scope", coalesce(priority, 0) priority,
            coalesce(updated_at, '') updated_at, coalesce(source_of_truth, true) source_of_truth, coalesce(trust_level, 95) trust_level, coalesce(status, 'active') status
            from rules where id <> '')"""
RELATIONS = """
stored as (select distinct rel_id ord, from_id, to_id, upper(relation) relation, coalesce(note, '') note from relations where from_id <> '' and to_id <> '')"""
PART_OF = """
part_of as (select id from_id, string_split(id, ':window:')[1] to_id, 'PART_OF' relation, 'Overlap window belongs to base chunk' note from pieces where contains(id, ':window:')
            union all select id, file_id, 'PART_OF', 'Chunk belongs to file' from pieces where file_id <> '')"""
ENTITIES = """
ents as (select id, 'File' entity_type, kind, path "label", path, path || chr(10) || excerpt || chr(10) || content "text", status, source_of_truth, trust_level, updated_at, excerpt snippet from files
                where not (kind = 'ADR' and lower(trim(path)) in (select lower(trim(path)) from records))
         union all select id, 'ADR', 'ADR', title, path, path || chr(10) || title || chr(10) || body, 'active', true, 95, decision_date, substr(body, 1, 500) from records
         union all select id, 'Rule', 'RULE', title, '', id || chr(10) || title || chr(10) || body, status, source_of_truth, trust_level, updated_at, substr(body, 1, 500) from ruleset
         union all select c.id, 'Chunk', c.kind, c.name, coalesce(f.path, ''), coalesce(f.path, '') || chr(10) || c.name || chr(10) || c.signature || chr(10) || c.description || chr(10) || c.body, c.status,
                c.source_of_truth, c.trust_level, c.updated_at, case when c.description <> '' then c.description else substr(c.body, 1, 500) end
                from pieces c left join (select * from files where kind = 'CODE') f on f.id = c.file_id
         union all select id, 'Module', 'MODULE', name, path, path || chr(10) || name || chr(10) || summary || chr(10) || exported_symbols, status, source_of_truth, trust_level, updated_at, substr(summary, 1, 500) from mods)"""
DEGREE = """
rels as (select from_id, to_id, relation, note from stored union all select * from part_of),
degree as (select id, count(*) degree from (select from_id id from rels union all select to_id from rels) group by id)"""
ALL = ",".join((FILES, ADRS, CHUNKS, MODULES, RULES, RELATIONS, PART_OF, ENTITIES, DEGREE))


def sql_basename(x: str) -> str:
    base = rf"string_split_regex({x}, '[\\/]')[-1]"
    return rf"case when instr({base}, '.') > 0 then regexp_replace({base}, '^(.+)\.[^.]*$', '\1') else {base} end"


def sql_structural(words: list[str]) -> str:
    """Structural boost over columns path, label, kind for queries without languages and without long phrases."""
    use = [w for w in words if len(w) >= 3 and w not in T.STRUCTURE_STOP]
    hit = lambda toks: f"len(list_intersect({toks}, {sql_list(use)}))"
    return (
        f"least(0.2::double, least(0.1::double, {hit(sql_tokens('path'))} * 0.035::double) + least(0.08::double, {hit(sql_tokens(sql_basename('path')))} * 0.06::double)"
        f" + least(0.08::double, {hit(sql_tokens('\"label\"'))} * 0.04::double) + least(0.03::double, {hit(sql_tokens('kind'))} * 0.02::double))"
    )


def sql_recency(x: str, reference: str) -> str:
    return (
        f"1.0::double / (1.0::double + coalesce(greatest(0.0::double, (epoch_us(timestamp '{reference}') - epoch_us(try_cast(nullif(trim({x}), '') as timestamp))) / 86400e6::double), 3650.0::double) / 30.0::double)"
    )
