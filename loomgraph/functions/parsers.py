"""Parsers: one file in, its chunks out. Registered by extension; run in batches on the executors."""

from __future__ import annotations

import ast
import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import languages as L

Chunk = dict
CHUNK_SCHEMA = (
    "file_id string, path string, name string, kind string, signature string, body string, description string, start_line int, end_line int, language string, "
    "calls array<string>, imports array<string>, exported boolean"
)
# Statements that name another object.
SQL_REFERENCES = tuple(rf"(?i)\b{w}\s+([#@]?[A-Za-z0-9_\[\].]+)" for w in (r"exec(?:ute)?", "from", "join", "update", r"insert\s+into", r"delete\s+from", r"merge\s+into"))
_SQL_OBJECT = re.compile(r"(?i)create\s+(?:or\s+alter\s+)?(procedure|proc|view|function|table|trigger)\s+([^\s(]+)")


def sql_name(name: str) -> str:
    """A name without quotes, brackets and blanks, in lower case, with single dots."""
    name = re.sub(r"\[(.+?)\]", r"\1", re.sub(r'[;"`]', "", name.strip()))
    return re.sub(r"\.\.+", ".", re.sub(r"\s+", "", name).strip(".")).lower()


def sql_aliases(name: str) -> list[str]:
    """The full name and its last part."""
    full = sql_name(name)
    return list(dict.fromkeys(x for x in (full, full.rsplit(".", 1)[-1]) if x))


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def sql_objects(text: str) -> Iterator[Chunk]:
    """Procedures, views, functions, tables and triggers, each up to the next one, with what they refer to."""
    found = list(_SQL_OBJECT.finditer(text))
    for i, m in enumerate(found):
        end = found[i + 1].start() if i + 1 < len(found) else len(text)
        body = text[m.start() : end].rstrip()
        name = sql_name(m.group(2))
        if not name:
            continue
        refs = {sql_name(r) for p in SQL_REFERENCES for r in re.findall(p, body)} - {name, ""}
        kind = {"proc": "procedure"}.get(m.group(1).lower(), m.group(1).lower())
        yield {"name": name, "kind": kind, "signature": f"{kind} {name}", "body": body, "start_line": _line(text, m.start()),
               "end_line": _line(text, max(m.start(), m.start() + len(body) - 1)), "language": "sql", "calls": sorted(refs)}


def markdown_sections(text: str) -> Iterator[Chunk]:
    """Sections under headings of the first three levels; headings in fences don't count, nor do empty sections."""
    lines = re.split(r"\r?\n", text)
    marks, fenced = [], False
    for i, line in enumerate(lines):
        if re.match(r"```|~~~", line.strip()):
            fenced = not fenced
        elif not fenced:
            m = re.match(r"(#{1,3})\s+(.+?)\s*#*\s*$", line)
            if m:
                marks.append((i, m.group(2).strip(), line.strip()))
            elif not marks:
                marks.append((i, "preamble", None))
    for (i, name, heading), end in zip(marks, [m[0] for m in marks[1:]] + [len(lines)], strict=True):
        body = "\n".join(lines[i:end]).rstrip()
        if body.strip() and any(x.strip() for x in lines[i + (heading is not None) : end]):
            yield {"name": name, "kind": "section", "signature": heading or name, "body": body, "start_line": i + 1, "end_line": max(i + 1, end), "language": "markdown"}


def _attributes(raw: str) -> dict[str, str]:
    return {k: html.unescape(v) for k, v in re.findall(r'\b([A-Za-z_:][A-Za-z0-9_:\-]*)="([^"]*)"', raw)}


def config_key(key: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", key.lower()).strip("_")


def config_entries(text: str) -> Iterator[Chunk]:
    """Connection strings, the databases they name, and application settings of a configuration."""
    for m in re.finditer(r"(?i)<add\b([^>]+?)/?>", text):
        a = _attributes(m.group(1))
        name, value = a.get("name"), a.get("connectionString")
        kind, key = ("connection_string", name) if name and value else ("app_setting", a.get("key"))
        if not key or not config_key(key):
            continue
        provider = (a.get("providerName") or "").strip()
        said = (value or "").strip() if kind == "connection_string" else a.get("value", "")
        said = f"{said}; provider={provider}" if kind == "connection_string" and provider and provider not in said else said
        at = {"body": m.group(), "start_line": _line(text, m.start()), "end_line": _line(text, m.end() - 1), "language": "config"}
        target = f"database_target.{config_key(key)}"
        yield {"name": f"{kind}.{config_key(key)}", "kind": kind, "signature": f"{kind} {key}", "description": said, "calls": [target] if kind == "connection_string" else [], **at}
        if kind == "connection_string":
            parts = dict((p.split("=", 1)[0].strip().lower(), p.split("=", 1)[1].strip()) for p in value.split(";") if "=" in p)
            first = lambda *ks: next((parts[k] for k in ks if parts.get(k)), "")
            got = [("database", first("database", "initial catalog")), ("server", first("server", "data source", "addr", "address", "network address")), ("provider", parts.get("provider") or provider)]
            yield {"name": target, "kind": "database_target", "signature": f"database_target {key}", "description": "; ".join(f"{k}={v}" for k, v in got if v) or value, **at}


def resource_entries(text: str) -> Iterator[Chunk]:
    """Entries of resource and settings files."""
    for tag, kind in (("data", "resource_entry"), ("Setting", "setting_entry")):
        for m in re.finditer(rf"<{tag}\b([^>]*)>([\s\S]*?)</{tag}>", text):
            a = _attributes(m.group(1))
            key = a.get("name") or a.get("Name")
            value = re.search(r"<[vV]alue[^>]*>([\s\S]*?)</[vV]alue>", m.group(2))
            if key:
                yield {"name": f"{kind}.{config_key(key)}", "kind": kind, "signature": f"{kind} {key}", "body": m.group(), "description": html.unescape(value.group(1)).strip() if value else "",
                       "start_line": _line(text, m.start()), "end_line": _line(text, m.end() - 1), "language": "resource"}


def python_chunks(text: str) -> Iterator[Chunk]:
    """Functions and classes of a module with what they call and import; nothing for files that do not parse.

    Calls are gathered in one walk: a call belongs to every function and class around it.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = text.splitlines()
    imports: set[str] = set()
    blocks: list[tuple[ast.AST, set[str]]] = []
    todo: list[tuple[ast.AST, tuple[int, ...]]] = [(tree, ())]
    while todo:
        n, around = todo.pop()
        if isinstance(n, ast.Import):
            imports |= {a.name for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            imports.add(n.module)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            around = (*around, len(blocks))
            blocks.append((n, set()))
        elif isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)):
            for i in around:
                blocks[i][1].add(n.func.id if isinstance(n.func, ast.Name) else n.func.attr)
        todo += [(c, around) for c in ast.iter_child_nodes(n)]
    for n, calls in sorted(blocks, key=lambda b: b[0].lineno):
        yield {"name": n.name, "kind": "class" if isinstance(n, ast.ClassDef) else "function", "signature": lines[n.lineno - 1].strip().rstrip(":"), "body": "\n".join(lines[n.lineno - 1 : n.end_lineno]),
               "description": (ast.get_docstring(n) or "").split("\n")[0], "start_line": n.lineno, "end_line": n.end_lineno, "language": "python", "calls": sorted(calls), "imports": sorted(imports), "exported": not n.name.startswith("_")}


def solution_projects(text: str) -> Iterator[Chunk]:
    """Projects that a solution lists."""
    for m in re.finditer(r'Project\("\{[^}]*\}"\)\s*=\s*"([^"]+)",\s*"([^"]+)"', text):
        yield {"name": m.group(1), "kind": "project", "signature": m.group(2).replace("\\", "/"), "body": m.group(), "start_line": _line(text, m.start()), "end_line": _line(text, m.start()), "language": "dotnet"}


def project_items(text: str) -> Iterator[Chunk]:
    """Files and projects that a project names."""
    for m in re.finditer(r'(?i)<(Compile|Content|EmbeddedResource|None|Page|ApplicationDefinition|ProjectReference)\b[^>]*\bInclude="([^"]+)"[^>]*>', text):
        at = _line(text, m.start())
        yield {"name": html.unescape(m.group(2)).replace("\\", "/"), "kind": "project_reference" if m.group(1).lower() == "projectreference" else "project_item", "signature": f"{m.group(1)} {m.group(2)}", "body": m.group(),
               "start_line": at, "end_line": at, "language": "dotnet"}


#: Parser by extension. Add to it to support more languages.
REGISTRY: dict[str, Callable[[str], Iterator[Chunk]]] = {
    ".sql": sql_objects, ".md": markdown_sections, ".mdx": markdown_sections, ".config": config_entries, ".resx": resource_entries,
    ".settings": resource_entries, ".py": python_chunks, ".sln": solution_projects, **{e: L.parser_for(e) for e in L.BY_EXTENSION}, **dict.fromkeys((".csproj", ".vbproj", ".fsproj", ".vcxproj"), project_items),
}


def parse_files(files: DataFrame, registry: dict[str, Callable[[str], Iterator[Chunk]]] | None = None) -> DataFrame:
    """Chunks of ``files(id, path, content)`` by the parser of their extension; others, null and empty texts have none."""
    known = registry or REGISTRY
    empty = {"signature": "", "body": "", "description": "", "start_line": 1, "end_line": 1, "language": "", "calls": [], "imports": [], "exported": False}

    def run(frames):
        for f in frames:
            rows = []
            for i, p, t in zip(f["id"], f["path"], f["content"], strict=True):
                ext = re.search(r"\.[^./]+$", (p or "").lower())
                parser = known.get(ext.group()) if ext else None
                if parser and isinstance(t, str) and t:
                    rows += [{**empty, **c, "file_id": i, "path": p} for c in parser(t)]
            yield pd.DataFrame(rows, columns=["file_id", "path", "name", "kind", "signature", "body", "description", "start_line", "end_line", "language", "calls", "imports", "exported"])

    return files.select("id", "path", "content").mapInPandas(run, CHUNK_SCHEMA)
