"""Scans of texts against patterns: injections, secrets, policies, redaction, long functions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Signs of an injected instruction, their category and weight.
INJECTIONS = (
    ("ignore_previous_instructions", "instruction_override", 0.5, r"(?i)ignore\s+(all\s+)?previous\s+instructions"),
    ("disregard_previous", "instruction_override", 0.5, r"(?i)disregard\s+(all\s+)?(above|previous|prior|earlier)"),
    ("forget_previous", "instruction_override", 0.5, r"(?i)forget\s+(all\s+)?(above|previous|prior|earlier)\s+(instructions|context|rules)"),
    ("new_instructions", "instruction_override", 0.4, r"(?i)new\s+instructions?\s*:"),
    ("you_are_now", "instruction_override", 0.4, r"(?i)you\s+are\s+now\s+"),
    ("from_now_on", "instruction_override", 0.4, r"(?i)from\s+now\s+on\s*,?\s+(you|ignore|do\s+not)"),
    ("override_system", "instruction_override", 0.5, r"(?i)override\s+(all\s+)?(system|safety|previous)\s+(prompt|instructions|rules)"),
    ("act_as_unrestricted", "role_play", 0.5, r"(?i)act\s+as\s+(an?\s+)?(unrestricted|unfiltered|evil|malicious|jailbroken)"),
    ("pretend_you_are", "role_play", 0.4, r"(?i)pretend\s+you\s+are\s+(an?\s+)?(different|new|unrestricted)"),
    ("special_mode", "role_play", 0.5, r"(?i)enter\s+(DAN|developer|god|sudo|admin)\s+mode"),
    ("jailbreak_keyword", "role_play", 0.4, r"(?i)jailbreak"),
    ("xml_tag_escape", "delimiter_escape", 0.5, r"(?i)</?(system|assistant|user|tool_result|human|function_call|antml:)[\s>]"),
    ("inst_tag_escape", "delimiter_escape", 0.5, r"(?i)\[INST\]|\[/INST\]|\[SYS\]|\[/SYS\]"),
    ("code_block_escape", "delimiter_escape", 0.3, r"(?i)```\s*(system|prompt|instructions)"),
    ("authority_marker", "instruction_marker", 0.3, r"(?im)^\s*(IMPORTANT|SYSTEM|ADMIN|OVERRIDE|INSTRUCTION)\s*:"),
    ("do_not_follow", "instruction_marker", 0.5, r"(?i)\bdo\s+not\s+follow\s+(any\s+)?(previous|prior|above)\s+(rules|instructions|guidelines)"),
    ("encoded_eval", "encoded_payload", 0.4, r"""(?:eval|atob|Buffer\.from)\s*\(\s*["'`][A-Za-z0-9+/=]{20,}["'`]\s*\)"""),
    ("html_entity_encode", "encoded_payload", 0.2, r"(?i)&#x[0-9a-f]{2,4};"),
)
# Shapes of secrets, and whether a placeholder may stand in them.
SECRETS = (
    ("AWS access key", r"\bAKIA[0-9A-Z]{16}\b", False), ("GitHub PAT", r"\bghp_[A-Za-z0-9]{36}\b", False), ("GitHub OAuth", r"\bgho_[A-Za-z0-9]{36}\b", False),
    ("GitHub refresh", r"\bghr_[A-Za-z0-9]{36}\b", False), ("GitHub app", r"\bghs_[A-Za-z0-9]{36}\b", False), ("Slack token", r"\bxox[abpsr]-[A-Za-z0-9-]{10,}\b", False),
    ("Google API key", r"\bAIza[0-9A-Za-z\-_]{35}\b", False), ("Stripe key", r"\b(?:sk|rk)_live_[0-9a-zA-Z]{24,}\b", False),
    ("Bearer token", r"\bBearer\s+[A-Za-z0-9\-._~+/]{20,}={0,2}\b", False), ("Private key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", False),
    ("Hardcoded password", r"""(?i)\b(?:password|passwd|pwd)\s*[=:]\s*["'][^"'\s<>{}]{4,}["']""", True),
    ("Hardcoded API key", r"""(?i)\b(?:api[-_]?key|apikey|secret|auth[-_]?token)\s*[=:]\s*["'][^"'\s<>{}]{8,}["']""", True),
    ("Connection string password", r"""(?i)\b(?:password|pwd)\s*=\s*[^;'"<>\s]{4,}(?:;|$)""", True),
)
PLACEHOLDERS = """changeme change-me changethis todo password passwd pwd password123 secret example your-password-here yourpasswordhere
    your-api-key yourapikey xxx xxxx xxxxxx redacted hidden""".split()
# Signs of outward calls, files that hold texts, and folders that a scan for secrets leaves out.
EXTERNAL_CALLS = ("fetch(", "axios.", "http.get", "http.post", "https.get", "https.request")
TEXT_FILES = r"(?i)\.(?:json|ya?ml|toml|ini|env|config|xml|properties|tf|tfvars|sh|ps1|py|js|mjs|cjs|ts|tsx|jsx|cs|vb|java|go|rs|rb|php|sql|md|txt)$|(?:^|/)\.env(?:\.|$)|(?:^|/)appsettings"
ALLOWED_PATHS = ("tests/", "test/", "__tests__/", "fixtures/", "mocks/", "docs/")
# Reading of the environment, and signs of a prompt around it.
ENV_ACCESS = r"""\bprocess\.env\.[A-Z][A-Z0-9_]*|\bprocess\.env\[\s*['"][A-Z][A-Z0-9_]*['"]\s*\]|\bos\.environ\[\s*['"][A-Z][A-Z0-9_]*['"]\s*\]|\bos\.getenv\(\s*['"][A-Z][A-Z0-9_]*['"]"""
PROMPT_SIGNS = r"""(?i)\b(?:prompt|system[_ -]?message|instructions?|role\s*[:=]\s*["'](?:system|user|assistant)["']|you\s+are\s+(?:a|an|the)\b|respond\s+with|answer\s+as|act\s+as)\b"""
PROMPT_NAMES = r"(?i)\b(?:prompt|system[_ -]?prompt|instructions?|messages?|content|completion[_ -]?input)\s*[:=]"

#: Texts of which one from each group has to stand in the lower-case text for a sign of that name to be there.
#: They follow from the patterns, and spare most texts the patterns.
_NEEDED = {
    "ignore_previous_instructions": (("ignore",), ("previous",), ("instructions",)), "disregard_previous": (("disregard",),), "forget_previous": (("forget",),),
    "new_instructions": (("instruction",), ("new",)), "you_are_now": (("now",), ("you",), ("are",)), "from_now_on": (("from",), ("now",), ("you", "ignore", "do")),
    "override_system": (("override",), ("prompt", "instructions", "rules")), "act_as_unrestricted": (("unrestricted", "unfiltered", "evil", "malicious", "jailbroken"),),
    "pretend_you_are": (("pretend",),), "special_mode": (("enter",), ("mode",)), "jailbreak_keyword": (("jailbreak",),), "xml_tag_escape": (("<",), ("system", "assistant", "user", "tool_result", "human", "function_call", "antml:")),
    "inst_tag_escape": (("inst]", "sys]"),), "code_block_escape": (("```",), ("system", "prompt", "instructions")), "authority_marker": (("important", "system", "admin", "override", "instruction"), (":",)),
    "do_not_follow": (("follow",), ("rules", "instructions", "guidelines")), "encoded_eval": (("eval", "atob", "buffer.from"),), "html_entity_encode": (("&#x",),),
}


def _signs(text: Column, low: Column) -> list[tuple[str, str, float, Column]]:
    """Every sign with the number of its matches; a pattern is tried only where its needed texts are there."""
    out = []
    for name, cat, weight, p in INJECTIONS:
        there = F.lit(True)
        for group in _NEEDED[name]:
            some = F.lit(False)
            for word in group:
                some = some | low.contains(word)
            there = there & some
        out.append((name, cat, weight, F.when(there, F.regexp_count(text, F.lit(p))).otherwise(0)))
    return out


def injection_total(text: Column) -> Column:
    """Sum of the weights of all matches; 0 for null. The lower-case form is bound, so that it is made once."""
    total = lambda low: sum((n * w for _, _, w, n in _signs(text, low)), F.lit(0.0))
    return F.coalesce(F.element_at(F.transform(F.array(F.lower(text)), total), 1), F.lit(0.0))


def injection_score(text: Column) -> Column:
    """Sum of the weights of all matches, at most 1; 0 for null."""
    return F.least(F.lit(1.0), injection_total(text))


def injection_matches(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``pattern``, ``category`` and ``n`` for every sign that occurs: one row each."""
    found = F.element_at(F.transform(F.array(F.lower(text)), lambda low: F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.lit(cat).alias("category"), n.alias("n")) for name, cat, _, n in _signs(F.col(text), low)
    ])), 1)
    return rows.withColumn("_m", F.explode(F.filter(found, lambda m: m["n"] > 0))).select(*rows.columns, "_m.*")


def neutralise(text: Column) -> Column:
    """The text with tags that play system boundaries made harmless."""
    out = F.regexp_replace(text, r"(?i)<(/?)(system|assistant|user|tool_result|human|function_call|antml:)", "&lt;$1$2")
    return F.regexp_replace(out, r"(?i)\[(/?)(INST|SYS)\]", "[$1_[$1$2]_]")


def lines_of(rows: DataFrame, text: str) -> DataFrame:
    """One row per line with ``line_no`` from 1 and ``line``; all other columns but the text stay."""
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("_i", "line")).withColumn("line_no", F.col("_i") + 1).drop("_i")


def secret_hits(rows: DataFrame, path: str, text: str, allowed: tuple[str, ...] = ALLOWED_PATHS, max_bytes: int = 2_000_000) -> DataFrame:
    """Lines that hold secrets: ``(path, line_no, secret)``; placeholders don't count.

    Texts above ``max_bytes`` are left out, as is the policy's rule. The others are first tried as a whole
    against all shapes in one pass, line ends counting as ends, so only those with a hit are cut in lines.
    """
    ok = F.col(path).rlike(TEXT_FILES) & (F.octet_length(text) <= max_bytes) & (F.instr(F.substring(text, 1, 512), "\x00") == 0)
    for a in allowed:
        ok = ok & ~F.col(path).contains(a)
    some = rows.where(ok).where(F.col(text).rlike("(?m)" + "|".join(f"(?:{p})" for _, p, _ in SECRETS)))
    shapes = []
    for name, p, aware in SECRETS:
        value = F.regexp_extract("line", f"({p})" if not p.startswith("(?") else p.replace(")", ")(", 1) + ")", 1)
        bare = F.lower(F.regexp_replace(F.trim(F.regexp_replace(value, r"^[^=:]*[=:]\s*", "")), r"""^["'`<{]+|["'`>};]+$""", ""))
        shapes.append(F.struct(F.lit(name).alias("secret"), ((value != "") & (~bare.isin(*PLACEHOLDERS) if aware else F.lit(True))).alias("hit")))
    found = lines_of(some.select(path, text), text).withColumn("_s", F.explode(F.filter(F.array(*shapes), lambda s: s["hit"])))
    return found.select(path, "line_no", F.col("_s.secret").alias("secret"))


def policy_hits(rows: DataFrame, path: str, text: str, pattern: str, per_file: int = 20, file_pattern: str | None = None) -> DataFrame:
    """Lines that match a policy's pattern, the first ``per_file`` of each file: that limit is the policy's own."""
    rows = rows.where(F.col(path).rlike(file_pattern)) if file_pattern else rows
    found = lines_of(rows.where(F.col(text).rlike("(?m)" + pattern)).select(path, text), text).where(F.col("line").rlike(pattern))
    return found.withColumn("_n", F.row_number().over(W.partitionBy(path).orderBy("line_no"))).where(F.col("_n") <= per_file).drop("_n")


def policy_detail(hits: DataFrame, path: str, shown: int = 30) -> DataFrame:
    """One row: how many hits in how many files, and the first ``shown`` of them by file and line, as a report shows them."""
    first = hits.orderBy(path, "line_no").limit(shown).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(path, "line_no"))), lambda h: F.concat(h[path], F.lit(":"), h["line_no"].cast("string"))), "\n").alias("detail"))
    return hits.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(path).alias("n_files")).crossJoin(F.broadcast(first))


def context_lines(rows: DataFrame, key: str, text: str, pattern: str, around: int = 3) -> DataFrame:
    """Lines that match, with the lines around them joined: a window over the lines of each text."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(-around, around)
    lines = lines_of(rows.where(F.col(text).rlike("(?m)" + pattern)).select(key, text), text)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(w), "\n")).where(F.col("line").rlike(pattern)).select(key, "line_no", "line", "context")


def env_in_prompts(rows: DataFrame, path: str, text: str, allowed: tuple[str, ...] = tuple(p for p in ALLOWED_PATHS if p != "mocks/")) -> DataFrame:
    """Lines that read the environment where the lines around look like a prompt: ``(path, line_no, env)``."""
    ok = F.col(path).rlike(r"(?i)\.(?:ts|tsx|js|mjs|cjs|jsx|py)$")
    for a in allowed:
        ok = ok & ~F.col(path).contains(a)
    near = context_lines(rows.where(ok), path, text, ENV_ACCESS)
    near = near.where(F.col("context").rlike(PROMPT_SIGNS) | F.col("context").rlike(PROMPT_NAMES))
    return near.select(path, "line_no", F.regexp_extract("line", f"({ENV_ACCESS})", 1).alias("env"))


def too_large(rows: DataFrame, path: str, size: str, max_bytes: int = 500_000) -> DataFrame:
    """``(path, size)`` of files above a size; a null size is none."""
    return rows.where(F.col(size) > max_bytes).select(path, size)


def external_calls(rows: DataFrame, path: str, text: str, patterns: tuple[str, ...] = EXTERNAL_CALLS) -> DataFrame:
    """``(path, call)`` for every pattern of an outward call that a text holds."""
    there = F.array_compact(F.array(*[F.when(F.col(text).contains(p), F.lit(p)) for p in patterns]))
    return rows.select(path, F.explode(there).alias("call"))


# Names of keys whose content never leaves, and how much of an object is described.
SENSITIVE = re.compile(r"(?i)(?:query|prompt|content|code|diff|patch|body|text|embedding|embeddings|graph|raw_query|raw_prompt|raw_code|raw_content)")
ENTRIES = 12


def _outline(value: object, depth: int = 0):
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if isinstance(value, str):
        return {"type": "string", "length": len(value), "redacted": True}
    if isinstance(value, list):
        some = {"redacted": True} if depth >= 2 else {"sample": [_outline(v, depth + 1) for v in value[:ENTRIES]]}
        return {"type": "array", "count": len(value), **some}
    first = list(value.items())[:ENTRIES]
    if depth >= 2:
        return {"type": "object", "keys": [k for k, _ in first], "key_count": len(value), "redacted": True}
    return {k: _withheld(v) if SENSITIVE.fullmatch(k) else _outline(v, depth + 1) for k, v in first}


def _withheld(value: object) -> dict:
    if isinstance(value, str):
        return _outline(value)
    if isinstance(value, list):
        return {"type": "array", "count": len(value), "redacted": True}
    if isinstance(value, dict):
        return {"type": "object", "key_count": len(value), "redacted": True}
    kind = "boolean" if isinstance(value, bool) else "object" if value is None else "number"
    return {"type": kind, "redacted": True}


@F.pandas_udf(StringType())
def outline(texts: pd.Series) -> pd.Series:
    """JSON with its strings replaced by their lengths, to two levels and twelve entries each; what stands under a
    sensitive key is withheld whole; null if it is no JSON."""
    def one(t):
        try:
            return json.dumps(_outline(json.loads(t)), sort_keys=True, separators=(",", ":")) if isinstance(t, str) else None
        except ValueError:
            return None

    return texts.map(one)


# How functions begin, by extension; whether their end is told by indentation.
_SCRIPT = (
    r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\s*\(",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::\s*[\w<>,\s[\]|&]+)?\s*=\s*(?:async\s*)?(?:<[^>]*>)?\s*\([^)]*\)\s*(?::\s*[\w<>,\s[\]|&]+\s*)?=>",
    r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:readonly\s+)?(?:async\s+)?(?:\*\s*)?(\w+)\s*(?:<[^>]*>)?\s*\([^)]*\)\s*(?::\s*[\w<>,\s[\]|&]+\s*)?\{",
)
FUNCTIONS = {
    **dict.fromkeys((".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), _SCRIPT),
    ".py": (r"^\s*(?:async\s+)?def\s+(\w+)\s*\(",),
    ".go": (r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",),
    ".rs": (r"^\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(\w+)",),
    ".cs": (r"^\s*(?:(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|new|partial)\s+)+(?:[\w<>\[\],?\s]+?\s+)?(\w+)\s*\([^)]*\)\s*(?:\{|where|:|=>|$)",),
    ".java": (r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native)\s+)+(?:[\w<>\[\],?\s]+?\s+)?(\w+)\s*\([^)]*\)\s*(?:\{|throws|$)",),
}
_BEGIN = {e: [re.compile(p) for p in ps] for e, ps in FUNCTIONS.items()}


def _indented_end(lines: list[str], at: int) -> int:
    indent = len(lines[at]) - len(lines[at].lstrip())
    inner = (i for i in range(at + 1, len(lines)) if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= indent)
    return next(inner, len(lines))


def _braced_end(lines: list[str], at: int) -> int:
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for sign in re.findall(r"[{}]", lines[i]):
            depth += 1 if sign == "{" else -1
            opened |= sign == "{"
            if opened and depth == 0:
                return i + 1
    return len(lines)


def long_functions(text: str | None, path: str | None, min_lines: int = 20) -> list[tuple[str, int, int]]:
    """Functions of at least ``min_lines`` lines without a comment above or a docstring: (name, first line, length).

    The language goes by the extension; other files have none. Braces in texts and comments count like
    others. Only the nearest line above that is not blank can be the comment.
    """
    ext = re.search(r"\.[^./]+$", (path or "").lower())
    begins = _BEGIN.get(ext.group()) if ext else None
    if not text or not begins:
        return []
    python = ext.group() == ".py"
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        m = next((m for m in (b.match(line) for b in begins) if m), None)
        if not m:
            continue
        length = (_indented_end if python else _braced_end)(lines, i) - i
        if length < min_lines:
            continue
        above = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
        noted = above.startswith("#") if python else above.startswith(("//", "/*")) or above.endswith("*/")
        quoted = python and i + 1 < len(lines) and lines[i + 1].strip()[:1] in ('"', "'")
        if not noted and not quoted:
            out.append((m.group(1), i + 1, length))
    return out


def undocumented(rows: DataFrame, path: str, text: str, min_lines: int = 20) -> DataFrame:
    """``(path, name, line, length)`` of long functions without a comment, file by file."""
    def run(frames):
        for f in frames:
            got = [(p, *x) for p, t in zip(f[path], f[text], strict=True) for x in long_functions(t, p, min_lines)]
            yield pd.DataFrame(got, columns=[path, "name", "line", "length"])

    return rows.select(path, text).mapInPandas(run, f"{path} string, name string, line int, length int")
