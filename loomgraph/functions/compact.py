"""Texts for embedding: descriptions of chunks, files cut to head, signal lines and tail, and cuts to a token budget."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes of a compacted text and signs of a line that says what a file does.
THRESHOLD, TARGET, SIGNAL_CHARS, SIGNAL_LINE, HEAD_LEAST, TAIL_LEAST, HEAD_SHARE = 32_768, 16_000, 4_096, 512, 4_096, 2_048, 0.62
SIGNALS = (
    r"^(import|export)\b", r"^(abstract\s+|async\s+|public\s+|private\s+|protected\s+|static\s+|readonly\s+|override\s+)*(class|interface|type|enum|function)\b", r"^(const|let|var)\s+[$A-Z_a-z][$\w]*\s*=",
    r"^(describe|it|test)\s*\(", r"^(@[A-Z_a-z][$\w]*|#[#\s])", r"^```[A-Za-z0-9_-]+", r"(?i)\b(route|router|endpoint|controller|handler|middleware|permission|auth|token|secret|security|todo|fixme)\b",
)
_SIGNAL = [re.compile(p) for p in SIGNALS]
MARK = "compact-v1"
COMPACT = "id string, text string, compacted boolean, original_chars long, text_chars long, omitted_chars long"


def description(kind: Column, exported: Column, signature: Column, said: Column, body: Column) -> Column:
    """Kind, whether exported, signature, the start of what is said of a chunk, and of the comment its body begins with."""
    tidy = lambda c: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, 200)
    comment = F.regexp_extract(body, r"^((?:\s*(?:/\*[\s\S]*?\*/|//[^\n]*)[\s\n]*)+)", 1)
    clean = tidy(F.regexp_replace(comment, r"/\*\*|\*/|\*|//", ""))
    parts = F.array_compact(F.array(kind, F.when(exported, F.lit("exported")), signature, F.when(F.length(F.trim(said)) > 10, tidy(said)), F.when(F.length(clean) > 10, clean)))
    return F.concat(F.array_join(parts, ". "), F.lit("."))


def is_signal(line: str) -> bool:
    line = line.strip()
    return bool(line) and any(p.search(line) for p in _SIGNAL)


def signal_lines(text: str, budget: int = SIGNAL_CHARS) -> str:
    """The lines that tell most, each once, in order, while they fit; long ones are cut with a note."""
    kept, used = {}, 0
    for line in re.split(r"\r?\n", text):
        if not is_signal(line):
            continue
        line = line.rstrip()
        if len(line) > SIGNAL_LINE:
            line = f"{line[:SIGNAL_LINE]} [{MARK} signal_line_truncated_chars={len(line) - SIGNAL_LINE}]"
        if line not in kept and used + len(line) + 1 <= budget:
            kept[line] = True
            used += len(line) + 1
    return "\n".join(kept)


def compact_file(path: str, excerpt: str, content: str) -> tuple[str, bool, int, int, int]:
    """``(text, compacted, original, kept, omitted)``; texts up to the threshold, and those that would not get shorter, stay whole."""
    whole = f"{path}\n{excerpt}\n{content}"
    if len(whole) > THRESHOLD:
        signal = signal_lines(content)
        room = max(HEAD_LEAST + TAIL_LEAST, TARGET - len(path) - len(excerpt) - len(signal) - len(f"[{MARK} omitted_chars=") - 64)
        n_head = max(HEAD_LEAST, int(room * HEAD_SHARE))
        n_tail = max(TAIL_LEAST, room - n_head)
        head, tail = content[:n_head], content[-n_tail:]
        parts = [path, excerpt, head, f"[{MARK} omitted_chars={max(0, len(content) - len(head) - len(tail))}]", f"[{MARK} signal_lines]\n{signal}" if signal else "", tail]
        text = "\n".join(p for p in parts if p)
        if len(text) < len(whole):
            return text, True, len(whole), len(text), len(whole) - len(text)
    return whole, False, len(whole), len(whole), 0


def compacted(files: DataFrame) -> DataFrame:
    """``COMPACT`` of ``files(id, path, excerpt, content)``; nulls count as empty."""
    def run(frames):
        for f in frames:
            rows = [(i, *compact_file(p or "", e or "", c or "")) for i, p, e, c in zip(f["id"], f["path"], f["excerpt"], f["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "text", "compacted", "original_chars", "text_chars", "omitted_chars"])

    return files.select("id", "path", "excerpt", "content").mapInPandas(run, COMPACT)


def estimate(text: str) -> int:
    """Tokens taken as a quarter of the characters."""
    return max(1, -(-len(text) // 4))


def cut_to_tokens(text: str, most: int, count: Callable[[str], int] = estimate) -> str:
    """The longest start of a text that a counter gives at most ``most`` tokens, by bisection, without blanks at its end."""
    if most < 1 or count(text) <= most:
        return text
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if count(text[:mid]) <= most else (low, mid - 1)
    return text[:low].rstrip()


def truncated(rows: DataFrame, key: str, text: str, most: int, count: Callable[[str], int] = estimate) -> DataFrame:
    """``(key, text, cut)`` within a token budget; a null text stays null."""
    kind = dict(rows.dtypes)[key]

    def run(frames):
        for f in frames:
            new = [cut_to_tokens(t, most, count) if isinstance(t, str) else None for t in f[text]]
            yield pd.DataFrame({key: f[key], text: new, "cut": [isinstance(t, str) and n != t for t, n in zip(f[text], new, strict=True)]})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, {text} string, cut boolean")
