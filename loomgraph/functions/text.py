"""Tokens and lexical scores: column builders for texts, plain Python for the one query string."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Aliases that widen a query.
EXPANSIONS: dict[str, list[str]] = {
    "dashboard": ["status"], "embed": ["embedding", "embeddings"], "embedding": ["embed", "embeddings"],
    "embeddings": ["embed", "embedding"], "git": ["githooks"], "hook": ["hooks", "githooks"],
    "hooks": ["hook", "githooks"], "import": ["imports"], "imports": ["import"], "javascript": ["js"],
    "parser": ["parsers"], "parsers": ["parser"], "status": ["dashboard"], "semantisk": ["semantic"],
    "sökning": ["search"], "sokning": ["search"], "regel": ["rule"], "regler": ["rules"],
    "relaterad": ["related"], "meddelande": ["message"], "avvikelse": ["deviation"],
}
# Words that say nothing about structure.
STRUCTURE_STOP = frozenset("""about after and are before between does from happen happens has how into the their then through
    when where while with what which who why""".split())
# Identifiers that stay one token, and tokens of one language.
COMPOUNDS = ("csharp", "fsharp", "graphql", "javascript", "typescript", "vbnet")
LANGUAGES = (
    ("javascript", "typescript", "js", "ts"), ("csharp", "cs"), ("vbnet", "vb"), ("fsharp", "fs"), ("java",), ("cpp",),
    ("python", "py"), ("rust", "rs"), ("ruby", "rb"), ("go",), ("php",), ("swift",), ("kotlin", "kt"), ("sql",),
)
_ALIASES = {"csharp": "c#", "fsharp": "f#", "vbnet": "vb.net"}
#: How the compounds fall apart at capital letters: their two halves.
_HALVES = (("c", "sharp"), ("f", "sharp"), ("graph", "ql"), ("java", "script"), ("type", "script"), ("vb", "net"))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, for corpora that hold letters in other than their usual form."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) and not t.isascii() else t)


def _unstable() -> str:
    """A pattern class of the letters that compatibility composition may change, by the rule itself, as ranges."""
    hit = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFKC", chr(c)))]
    spans, start = [], hit[0]
    for a, b in zip(hit, [*hit[1:], -1], strict=True):
        if b != a + 1:
            spans.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return "[" + "".join(spans) + "]"


UNSTABLE = _unstable()
#: Letters outside those of one byte that composition never changes: listed one by one, they cost one look-up.
_FOREIGN = "[^" + "".join(f"\\x{c:02x}" for c in range(256) if unicodedata.is_normalized("NFKC", chr(c))) + "]"


def unstable(text: Column) -> Column:
    """Whether compatibility composition may change a text."""
    return text.rlike(_FOREIGN) & text.rlike(UNSTABLE)


def composed(text: Column) -> Column:
    """The text in compatibility composition. Only texts that hold a letter it may change go through Python."""
    return F.coalesce(nfkc(F.when(unstable(text), text)), text)


def _named(text: Column) -> Column:
    """The text with names of languages that hold signs turned to words."""
    # The letters come first and the look back last, so that most places cost one comparison.
    for pattern, word in (("[cC]#", "csharp"), ("[fF]#", "fsharp"), (r"[vV][bB]\.[nN][eE][tT]", "vbnet")):
        text = F.regexp_replace(text, rf"{pattern}(?<![\p{{L}}\p{{N}}]{pattern})(?![\p{{L}}\p{{N}}])", f" {word} ")
    return text


def tokens(text: Column) -> Column:
    """Distinct tokens of a text: runs of letters and digits of two or more, and their camel-case parts.

    Stays in the JVM; apply ``nfkc`` before it where the corpus needs that. A null text gives null.
    """
    named = _named(text)
    halves = "|".join(f"({a})\x01({b})(?<![\\p{{L}}\\p{{N}}]{a}\x01{b})" for a, b in _HALVES)
    whole = "".join(f"${i + 1}" for i in range(2 * len(_HALVES)))

    def cut(c: Column) -> Column:
        return F.split(c, r"[^\p{L}\p{N}]+")

    def both(n: Column) -> Column:
        # Whole texts are marked at capital letters and cut twice; work on each word would cost many times as much.
        marked = F.regexp_replace(F.regexp_replace(n, r"([\p{Ll}\p{N}])(\p{Lu})", "$1\x01$2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1\x01$2")
        joined = F.regexp_replace(F.lower(marked), rf"(?:{halves})(?![\p{{L}}\p{{N}}])", whole)
        return F.array_union(cut(F.lower(n)), cut(joined))

    # The lambda binds the named text, so that it is worked out once.
    return F.filter(F.element_at(F.transform(F.array(named), both), 1), lambda t: F.length(t) >= 2)


def needles(words: list[str]) -> list[str]:
    """Texts of which one must stand in a lower-case text for any of the words to be among its tokens."""
    return [*words, *(a for w, a in _ALIASES.items() if w in words)]


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text may hold one of the words: a plain search in its lower-case form."""
    low, out = F.lower(text), F.lit(False)
    for n in needles(words):
        out = out | low.contains(n)
    return out


def tokens_among(text: Column, words: list[str]) -> Column:
    """The tokens of a text that are among ``words``: ``tokens`` is applied only to the runs that hold one of them.

    A token never reaches over the end of a run of letters and digits, so no other run can give it.
    """
    if not words:
        return F.array().cast("array<string>")
    cut = r"[^0-9A-Za-z\x80-\x{10FFFF}]+"
    if any(w in words for w in _ALIASES):
        # The signs in these names end a run, so they become words first, as in ``tokens``.
        text = _named(text)

    def some(run: Column) -> Column:
        low, out = F.lower(run), F.lit(False)
        for w in words:
            out = out | low.contains(w)
        return out

    return F.array_intersect(tokens(F.array_join(F.array_distinct(F.filter(F.split(text, cut), some)), "\n")), _texts(words))


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query in order, by the rules of ``tokens``."""
    text = unicodedata.normalize("NFKC", query)
    for pattern, word in ((r"c#", "csharp"), (r"f#", "fsharp"), (r"vb\.net", "vbnet")):
        text = re.sub(rf"(^|[\W_]){pattern}(?=$|[\W_])", rf"\1 {word} ", text, flags=re.I)
    out: list[str] = []
    for part in re.split(r"[\W_]+", text):
        if len(part) < 2:
            continue
        spaced = re.sub(r"([^\W\d_A-ZÅÄÖÜ]|\d)([A-ZÅÄÖÜ])", r"\1 \2", part)
        spaced = re.sub(r"([A-ZÅÄÖÜ]+)([A-ZÅÄÖÜ][a-zåäöü])", r"\1 \2", spaced).lower()
        for a, b in _HALVES:
            spaced = re.sub(f"(^| ){a} {b}(?= |$)", rf"\1{a}{b}", spaced)
        out += [t for t in (part.lower(), *spaced.split(" ")) if len(t) >= 2]
    return list(dict.fromkeys(out))


def expand(words: list[str]) -> list[str]:
    """The words and their aliases, each once."""
    return list(dict.fromkeys([*words, *(a for w in words for a in EXPANSIONS.get(w, []))]))


def token_groups(words: list[str]) -> list[list[str]]:
    """Alias groups: words of the query that lead to each other by aliases count as one."""
    given, used, groups = set(words), set(), []
    for word in words:
        if word in used:
            continue
        group, todo = [], [word]
        reached = set()
        while todo:
            w = todo.pop(0)
            if w in reached:
                continue
            reached.add(w)
            near = [*EXPANSIONS.get(w, [])]
            for source, aliases in EXPANSIONS.items():
                if w in aliases:
                    near += [source, *aliases]
            group += [w, *near]
            todo += [n for n in near if n in given and n not in used]
        group = list(dict.fromkeys(group))
        used |= given.intersection(group)
        groups.append(group)
    return groups


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def lexical_score(text: Column, text_tokens: Column, words: list[str], phrase: str) -> Column:
    """0.85 times the share of matched alias groups, plus 0.15 if the text holds the whole phrase; at most 1."""
    groups = token_groups(words)
    if not groups:
        return F.lit(0.0)
    matched = sum((F.when(F.arrays_overlap(text_tokens, _texts(g)), 1).otherwise(0) for g in groups), F.lit(0))
    bonus = F.when(F.lower(text).contains(phrase), 0.15).otherwise(0.0) if phrase else F.lit(0.0)
    return F.when(matched > 0, F.least(F.lit(1.0), matched / F.lit(float(len(groups))) * 0.85 + bonus)).otherwise(0.0)


def lexical_share(text_tokens: Column, whole: Column, words: list[str]) -> Column:
    """``lexical_score`` from tokens and whether the text holds the whole phrase."""
    groups = token_groups(words)
    if not groups:
        return F.lit(0.0)
    # One constant and a count over it, so that a long query doesn't make a long expression.
    asked = F.from_json(F.lit(json.dumps(groups, ensure_ascii=False)), "array<array<string>>")
    matched = F.size(F.filter(asked, lambda g: F.arrays_overlap(g, text_tokens)))
    bonus = F.when(whole, 0.15).otherwise(0.0)
    return F.when(matched > 0, F.least(F.lit(1.0), matched / F.lit(float(len(groups))) * 0.85 + bonus)).otherwise(0.0)


def overlap(words: list[str], target: Column) -> Column:
    """How many of the distinct words are in a set of tokens."""
    return F.size(F.array_intersect(_texts(words), target)) if words else F.lit(0)


def basename(path: Column) -> Column:
    """Last part of a path without its extension; a name that is all extension stays."""
    base = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def structural_boost(path: Column, label: Column, kind: Column, words: list[str], phrase: str, names: tuple | None = None) -> Column:
    """Boost for query words in path, file name, label and kind; at most 0.2, less for parsers of other languages.

    ``names`` are the tokens of path, file name, label and kind, where they are known already.
    """
    use = structure_words(words)
    if not use:
        return F.lit(0.0)
    asked = [w for g in LANGUAGES if set(g) & set(words) for w in g]
    wanted = sorted({*use, *LANGUAGE_WORDS, "parsers"}) if asked else use
    among = lambda c: tokens_among(c, wanted)
    names = names or (among(path), among(basename(path)), among(label), among(kind))
    compact = re.sub(r"[\W_]+", "", phrase)
    return structure(names, path, label, _texts(use), F.lit(compact), _texts(asked))


LANGUAGE_WORDS = [w for g in LANGUAGES for w in g]


def structure_words(words: list[str]) -> list[str]:
    return [w for w in words if len(w) >= 3 and w not in STRUCTURE_STOP]


def structure(names: tuple, path: Column, label: Column, use: Column, compact: Column, asked: Column) -> Column:
    """The structural boost with the parts of the query as columns: its words, its phrase without signs, and the
    words of the languages it names."""
    in_path, in_base, in_label, in_kind = names
    hits = lambda toks: F.size(F.array_intersect(use, toks))
    boost = (
        F.least(F.lit(0.1), hits(in_path) * 0.035) + F.least(F.lit(0.08), hits(in_base) * 0.06)
        + F.least(F.lit(0.08), hits(in_label) * 0.04) + F.least(F.lit(0.03), hits(in_kind) * 0.02)
    )
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    boost += F.when((F.length(compact) >= 8) & (squeeze(path).contains(compact) | squeeze(label).contains(compact)), 0.04).otherwise(0.0)
    there = F.array_union(in_path, in_label)
    other = F.arrays_overlap(there, _texts(LANGUAGE_WORDS)) & ~F.arrays_overlap(there, asked)
    boost -= F.when((F.size(asked) > 0) & other & F.array_contains(in_path, "parsers"), 0.08).otherwise(0.0)
    return F.when(F.size(use) > 0, F.least(F.lit(0.2), boost)).otherwise(0.0)


# Words by which a query asks for kinds of data access.
_INTENTS = {
    "sql": """sql database db provider providername sqlclient sqlserver oracle postgres postgresql pgsql mysql sqlite stored procedure proc
        query queries view table trigger report reporting data dataflow""",
    "config": "config configuration connection connectionstring connectionstrings appsettings setting settings",
    "resource": "resource resources resx", "settings": "setting settings appsettings",
    "transform": "release debug prod production staging stage dev development test qa uat transform xdt override",
    "machine": "machine machineconfig", "impact": "impact affect affected affects change changes changing override overrides",
    "target": "database server catalog provider providername sqlclient sqlserver oracle postgres postgresql pgsql mysql sqlite",
}
ENVIRONMENTS = "release debug prod production staging stage dev development test qa uat".split()
SQL_KINDS = ("procedure", "view", "function", "table", "trigger")


def intents(words: list[str], phrase: str) -> dict[str, bool]:
    """What a query asks for, worked out once on the driver."""
    out = {k: bool(set(v.split()) & set(words)) for k, v in _INTENTS.items()}
    out["sql"] |= "stored procedure" in phrase
    out["config"] |= "connection string" in phrase
    out["transform"] |= "web.release.config" in phrase or "web.debug.config" in phrase
    return out


def data_access_boost(entity_type: Column, kind: Column, path: Column, words: list[str], phrase: str) -> Column:
    """Boost for chunks and files that hold data access, where the query asks for it."""
    return data_access(entity_type, kind, path, {k: F.lit(v) for k, v in intents(words, phrase).items()})


def data_access(entity_type: Column, kind: Column, path: Column, want: dict[str, Column]) -> Column:
    """The same with what the query asks for as columns."""
    kind, path = F.lower(kind), F.lower(path)
    # Boosts by kind of chunk, the first that fits, and by file, all that fit.
    chunk = [
        (kind == "connection_string", want["config"] | want["sql"], 0.16),
        (kind == "database_target", want["config"] | want["sql"] | want["target"], 0.18),
        (kind == "app_setting", want["config"] | want["settings"], 0.12),
        (kind == "resource_entry", want["resource"] | want["sql"], 0.1),
        (kind == "setting_entry", want["settings"] | want["config"] | want["sql"], 0.1),
        (kind.isin(*SQL_KINDS), want["sql"], 0.12),
    ]
    of_chunk = F.lit(0.0)
    for test, asked, boost in reversed(chunk):
        of_chunk = F.when(test & asked, boost).otherwise(of_chunk)
    of_chunk = of_chunk + F.when(want["impact"] & kind.isin("connection_string", "database_target", "app_setting", *SQL_KINDS), 0.08).otherwise(0.0)
    config = path.endswith(".config")
    staged = path.rlike(r"\.(?:" + "|".join(ENVIRONMENTS) + r")\.config")
    files = [
        (path.endswith(".sql"), want["sql"], 0.04), (config, want["config"], 0.06), (config & staged, want["transform"], 0.12),
        (path.endswith("machine.config"), want["machine"], 0.12), (config, want["impact"] & (want["config"] | want["transform"] | want["sql"]), 0.08),
        (path.endswith(".resx"), want["resource"] | want["sql"], 0.05), (path.endswith(".settings"), want["settings"] | want["config"], 0.05),
    ]
    of_file = sum((F.when(test & asked, boost).otherwise(0.0) for test, asked, boost in files), F.lit(0.0))
    return F.when(entity_type == "Chunk", of_chunk).when(entity_type == "File", of_file).otherwise(0.0)


def iso_time(date: Column) -> Column:
    """An ISO date or time as a timestamp, null where it is none."""
    return F.try_to_timestamp(F.when(F.trim(date) != "", date))


def recency(date: Column, reference: str) -> Column:
    """1 / (1 + days / 30) before the reference time; dates in the future count as now, none as ten years ago."""
    seconds = F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(iso_time(date))
    days = F.coalesce(F.greatest(F.lit(0.0), seconds / F.lit(86_400e6)), F.lit(3650.0))
    return F.lit(1.0) / (F.lit(1.0) + days / F.lit(30.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for empty, unequally long or zero vectors."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (length > 0), product / length).otherwise(0.0)
