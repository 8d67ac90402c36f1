"""Chunks of source files in languages without a grammar library: what opens a block, how it ends, what it calls and imports.

One reader for all languages; a language is a row of patterns. Texts and comments are blanked out first, with
all line ends kept, so that braces and names inside them count for nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

Chunk = dict
NOT_CALLS = frozenset("""if for while switch catch return function sizeof typeof new else elif match do and or not in await yield throw super constructor using lock foreach unless until case when def fn func
    sub class struct""".split())
NOT_NAMES = frozenset("if for while switch catch return else do foreach using lock until unless elif match".split())


@dataclass(frozen=True)
class Language:
    """``blocks`` are ``(kind, pattern)`` with the group ``name``; ``ends`` tells how they end: by braces, by indent-free
    ``end`` words, or by a closing line with the word in the group ``word``. ``blank`` are comments and texts."""

    name: str
    blocks: tuple[tuple[str, str], ...]
    ends: str = "braces"
    line_comment: str = "//"
    blank: str = r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    imports: tuple[str, ...] = ()
    exported: str = ""
    compiled: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        self.compiled.update(blocks=[(k, re.compile(p, re.M | (re.I if self.ends == "closing" else 0))) for k, p in self.blocks], blank=re.compile(self.blank), imports=[re.compile(p, re.M | (re.I if self.ends == "closing" else 0)) for p in self.imports],
                             exported=re.compile(self.exported) if self.exported else None)


_BODY = r"[^;{}]*?"
SCRIPT = Language(
    "javascript", (
        ("class", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{;]*\{"), ("interface", r"^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)[^{;]*\{"),
        ("enum", r"^[ \t]*(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)\s*\{"), ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^>{}]*>)?\([^{}]*?\)[^{};=]*\{"),
        ("function", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)(?:\s*:[^=;{}]+)?\s*=\s*(?:async\s+)?(?:function\b[^{};]*|(?:<[^>{}]*>)?\([^{}]*?\)[^{};=]*=>\s*|[\w$]+\s*=>\s*)\{"),
        ("method", r"^[ \t]+(?:public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+|async\s+|get\s+|set\s+|\*\s*)*(?P<name>[#\w$]+)\s*(?:<[^>{}]*>)?\([^{}()]*(?:\([^{}()]*\)[^{}()]*)*\)(?:\s*:[^{};=]+)?\s*\{"),
    ), imports=(r"""^\s*(?:import|export)\b[^;'"\n]*?\bfrom\s+["']([^"'\n]+)["']""", r"""^\s*import\s+["']([^"'\n]+)["']""", r"""\brequire\(\s*["']([^"'\n]+)["']\s*\)""", r"""\bimport\(\s*["']([^"'\n]+)["']\s*\)"""), exported=r"^\s*export\b")
GO = Language("go", (("function", r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\([^{}]*\{"), ("type", r"^type\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{")),
              imports=(r'^\s*import\s+(?:\w+\s+)?"([^"]+)"', r'^\s+(?:[\w.]+\s+)?"([^"\n]+)"\s*$'), exported=r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)[A-Z]", blank=r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'")
RUST = Language("rust", (
    ("function", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?P<name>\w+)[^{};]*\{"), ("struct", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)[^{};]*\{"),
    ("enum", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)[^{};]*\{"), ("trait", r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)[^{};]*\{"), ("impl", r"^[ \t]*impl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)[^{};]*\{"),
), imports=(r"^\s*(?:pub\s+)?use\s+([\w:]+)", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), exported=r"^\s*pub\b", blank=r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'")
JAVA = Language("java", (
    ("class", r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(?P<name>\w+)[^{};]*\{"), ("interface", r"^[ \t]*(?:(?:public|private|protected|static)\s+)*interface\s+(?P<name>\w+)[^{};]*\{"),
    ("enum", r"^[ \t]*(?:(?:public|private|protected|static)\s+)*enum\s+(?P<name>\w+)[^{};]*\{"),
    ("method", r"^[ \t]*(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?(?!(?:return|new|else|throw)\b)[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^{};]*?\)[^{};()]*\{"),
), imports=(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",), exported=r"^\s*(?:@\w+\s+)*public\b")
CSHARP = Language("csharp", (
    ("class", r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|file)\s+)*(?:class|struct|record)\s+(?P<name>\w+)[^{};]*\{"),
    ("interface", r"^[ \t]*(?:(?:public|private|protected|internal|partial)\s+)*interface\s+(?P<name>\w+)[^{};]*\{"), ("enum", r"^[ \t]*(?:(?:public|private|protected|internal)\s+)*enum\s+(?P<name>\w+)[^{};]*\{"),
    ("method", r"^[ \t]*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|virtual|override|sealed|abstract|async|new|partial|extern|unsafe)\s+)+(?:[\w<>\[\],.?]+\s+)?(?P<name>\w+)\s*(?:<[^>]*>)?\([^{};]*?\)[^{};]*\{"),
), imports=(r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",), exported=r"^\s*(?:\[[^\]]*\]\s*)*public\b", blank=r"//[^\n]*|/\*[\s\S]*?\*/|@\"(?:\"\"|[^\"])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'")
C = Language("cpp", (
    ("class", r"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+(?:\w+\s+)?(?P<name>\w+)[^{};()]*\{"), ("struct", r"^[ \t]*(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)[^{};()]*\{"), ("enum", r"^[ \t]*enum\s+(?:class\s+)?(?P<name>\w+)[^{};()]*\{"),
    ("function", r"^(?!\s*(?:else|return|if|for|while|switch|do)\b)[ \t]*(?:template\s*<[^>]*>\s*)?(?:[\w:<>,~\[\]]+[ \t*&]+)+(?P<name>[\w:~]+)\s*\([^{};]*?\)[^{};()]*\{"),
), imports=(r"^\s*#\s*include\s*[<\"]([^>\"\n]+)[>\"]",), exported=r"^(?!\s*static\b)")
RUBY = Language("ruby", (("class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)"), ("module", r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)"), ("method", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=]+)")), ends="end", line_comment="#",
                blank=r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", imports=(r"^\s*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)",))
SHELL = Language("bash", (("function", r"^[ \t]*function\s+(?P<name>[\w-]+)\s*(?:\(\s*\))?\s*\{"), ("function", r"^[ \t]*(?P<name>[\w-]+)\s*\(\s*\)\s*\{")), line_comment="#", blank=r"(?:(?<=\s)|^)#[^\n]*|\"(?:\\.|[^\"\\])*\"|'[^']*'",
                 imports=(r"^\s*(?:source|\.)\s+([^\s;]+)",))
BASIC = Language("vbnet", (
    ("class", r"^[ \t]*(?:(?:Public|Private|Friend|Protected|Partial|MustInherit|NotInheritable)\s+)*(?P<word>Class)\s+(?P<name>\w+)"), ("module", r"^[ \t]*(?:(?:Public|Friend)\s+)*(?P<word>Module)\s+(?P<name>\w+)"),
    ("structure", r"^[ \t]*(?:(?:Public|Private|Friend)\s+)*(?P<word>Structure|Enum|Interface|Type)\s+(?P<name>\w+)"),
    ("method", r"^[ \t]*(?:(?:Public|Private|Friend|Protected|Shared|Overrides|Overridable|Overloads|MustOverride|Static|Async|Shadows|Default|ReadOnly)\s+)*(?P<word>Sub|Function|Property)\s+(?:Get\s+|Let\s+|Set\s+)?(?P<name>\w+)"),
), ends="closing", line_comment="'", blank=r"'[^\n]*|\"(?:\"\"|[^\"\n])*\"", imports=(r"^\s*Imports\s+([\w.]+)",), exported=r"(?i)^\s*public\b")

BY_EXTENSION: dict[str, Language] = {
    **dict.fromkeys((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"), SCRIPT), ".go": GO, ".rs": RUST, ".java": JAVA, ".cs": CSHARP, **dict.fromkeys((".c", ".cc", ".cpp", ".h", ".hh", ".hpp"), C),
    ".rb": RUBY, ".sh": SHELL, ".bash": SHELL, **dict.fromkeys((".vb", ".bas", ".cls", ".frm", ".ctl"), BASIC),
}


def blanked(text: str, pattern: re.Pattern) -> str:
    """The text with comments and texts turned to blanks, all places and line ends as they were."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _braces(code: str) -> dict[int, int]:
    """Where every opening brace is closed, found in one pass; braces without an end are left out."""
    open_at, pairs = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            open_at.append(m.start())
        elif open_at:
            pairs[open_at.pop()] = m.end()
    return pairs


_WORDS = re.compile(r"(?m)^[ \t]*(?:class|module|def|if|unless|while|until|case|begin|for)\b|=\s*(?:if|unless|case|begin)\b|\bdo\b(?=\s*(?:\||$))|\bend\b")


def _closing_end(code: str, at: int) -> int:
    """The ``end`` of a Ruby block: openers at the start of a statement, and ``do``, count; modifiers don't."""
    depth = 0
    for m in _WORDS.finditer(code, at):
        depth += -1 if m.group().strip() == "end" else 1
        if depth == 0:
            return m.end()
    return len(code)


def _closing_word(code: str, at: int, word: str) -> int:
    m = re.compile(rf"(?im)^[ \t]*End\s+{word}\b").search(code, at)
    return m.end() if m else len(code)


def _comment_above(lines: list[str], first: int, mark: str) -> str:
    """The comment right above a line, without its signs, in one line."""
    out, i = [], first - 1
    while i >= 0:
        t = lines[i].strip()
        if t.startswith((mark, "/*", "*", "///")) or t.endswith("*/"):
            out.append(t)
        elif t.startswith(("#[", "@")):
            pass
        else:
            break
        i -= 1
    return " ".join(x for x in (re.sub(r"^(?:/\*+|\*+/?|//+!?|#+|'+)\s?|\s*\*/$", "", t).strip() for t in reversed(out)) if x)


def code_chunks(text: str, language: Language) -> Iterator[Chunk]:
    """Blocks of a file with what they call and import; a name at one place once, the first kind that fits.

    Names of methods hold their class: ``Store.save``. Unclosed blocks reach to the end of the text. Nothing
    is given for a block in a comment or a text.
    """
    made = language.compiled
    code = blanked(text, made["blank"])
    pairs = _braces(code) if language.ends == "braces" else {}
    ends_of_lines = [m.start() for m in re.finditer("\n", text)]
    found: dict[int, tuple] = {}
    for kind, pattern in made["blocks"]:
        for m in pattern.finditer(code):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            name = m.group("name")
            if start in found or name in NOT_NAMES:
                continue
            if language.ends == "braces":
                end = pairs.get(m.end() - 1, len(code))
            elif language.ends == "end":
                end = _closing_end(code, code.rfind("\n", 0, start) + 1)
            else:
                end = _closing_word(code, m.end(), m.group("word"))
            found[start] = (kind, name, m.end(), end)
    imports = sorted({x for p in made["imports"] for x in p.findall(text)})
    lines = text.split("\n")
    owners: list[tuple[str, int]] = []
    for start, (kind, name, head, end) in sorted(found.items()):
        owners = [(n, e) for n, e in owners if e > start]
        within = [n for n, e in owners if e >= end]
        if kind in ("class", "struct", "impl", "interface", "trait", "module") and kind != "function":
            owners.append((name, end))
        first = bisect_left(ends_of_lines, start)
        body = text[start:end]
        inside = code[head:end]
        calls = {c for c in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", inside) if c not in NOT_CALLS and c.lower() not in NOT_CALLS}
        if language is SHELL:
            calls |= {w for w in re.findall(r"(?m)^[ \t]*([\w-]+)", inside)}
        full = f"{within[-1]}.{name}" if within and kind in ("method", "function") else name
        out = made["exported"]
        yield {"name": full, "kind": "method" if within and kind == "function" else kind, "signature": re.sub(r"\s+", " ", text[start:head].rstrip("{ \t\n")).strip(), "body": body, "description": _comment_above(lines, first, language.line_comment),
               "start_line": first + 1, "end_line": first + 1 + body.count("\n"), "language": language.name, "calls": sorted(calls), "imports": imports, "exported": bool(out and out.search(text[text.rfind("\n", 0, start) + 1:head]))}


def script_chunks(text: str) -> Iterator[Chunk]:
    """JavaScript and TypeScript: as ``code_chunks``, with names that are exported in a list or by assignment."""
    named = {n for block in re.findall(r"\bexport\s*\{([^}]*)\}", text) for n in re.findall(r"([\w$]+)(?:\s+as\s+[\w$]+)?", block)}
    named |= set(re.findall(r"\b(?:module\.)?exports\.([\w$]+)\s*=", text)) | set(re.findall(r"\bexport\s+default\s+([\w$]+)\s*;", text))
    named |= {n for block in re.findall(r"\bmodule\.exports\s*=\s*\{([^}]*)\}", text) for n in re.findall(r"[\w$]+", block)}
    for c in code_chunks(text, SCRIPT):
        yield {**c, "exported": c["exported"] or c["name"] in named}


def parser_for(extension: str):
    """The parser of an extension, or None."""
    language = BY_EXTENSION.get(extension)
    if language is None:
        return None
    return script_chunks if language is SCRIPT else lambda text: code_chunks(text, language)
