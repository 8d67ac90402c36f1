"""Personal information in free text: typed spans, and terms that reveal persons by co-occurrence.

Mail addresses, phone numbers, identity numbers and street addresses have a written form and are found by
it. Names have none but capital letters. Which capitalised words reveal a person is learnt from the whole
corpus: the information that a word gives about a protected span nearby (pointwise mutual information).
Pairs of words above the disclosure threshold are names; all spans are replaced by their types.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

# Forms of the structured types.
_AT = r"(?:@|\s?[\[(]\s?at\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(
    rf"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*+(?:{_AT}(?:{_LABEL}{_DOT})+|[ ]at[ ](?:{_LABEL}[ ]dot[ ])+)[A-Za-z]{{2,24}}(?![\w@])", re.I
)
_AT_RE = re.compile(rf"{_AT}|[ ]at[ ]", re.I)
#: Mailboxes of machines or offices, not persons.
MACHINES = frozenset("""
git svn hg noreply no-reply donotreply do-not-reply root admin administrator postmaster hostmaster webmaster
mailer-daemon daemon bot ci build builds jenkins deploy deployer release releases svc service system cron
alerts alert notifications notify nobody www ftp info support help helpdesk contact office security abuse
""".split())
PHONE = re.compile(r"""(?<![\w.+/-])(?:
    (?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){1,2}(?:[ .\-/]?\d{2,8}){1,4}
  | \(\d{3}\)[ ]?\d{3}[-. ]\d{4}
  | \d{3}([-.])\d{3}\1\d{4}
  | 0[1-9]\d{1,3}[ /-]\d{2,8}(?:[ -]\d{2,4}){0,3}
)(?![\w]|[-./]\d)""", re.X)
DATE = re.compile(r"(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?!\d)")
SOCIAL = re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])")
PERSONAL = re.compile(r"(?<![\w-])(?:\d{2})?(\d{2}(?:0[1-9]|1[0-2])(?:[06][1-9]|[1278]\d|[39][01]))[-+]?(\d{4})(?![\w-])")
#: The same in one run of digits, with or without the century.
UNPARTED = re.compile(r"(?<![\w+-])(?<!\d[./])(1[89]|20)?(\d{2}(?:0[1-9]|1[0-2])(?:[06][1-9]|[1278]\d|[39][01]))(\d{4})(?![\w-]|[./]\d)")
#: Ten digits in a row, without which no such number is there.
TEN = re.compile(r"\d{10}")
INSURANCE = re.compile(r"(?<!\w)[A-CEGHJ-PQR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)")
_CAP = r"[A-ZÅÄÖÜÉ][\w'’-]+"
STREET = re.compile(rf"""(?<![\w-])(?:
    \d{{1,5}}[A-Za-z]?[ ](?:{_CAP}[ ]){{1,3}}(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Way|Place|Square|Terrace|Boulevard|Blvd|Crescent|Close|Row|Parkway|Highway)(?![\w-])
  | (?:Am|An[ ]der|Auf[ ]der|Auf[ ]dem|Im|In[ ]der|Zum|Zur|Unter[ ]den)[ ]{_CAP}[ ]\d{{1,4}}(?:[ ]?[a-zA-Z](?!\w))?(?![\w-])
  | [A-ZÅÄÖÜ][\wåäöüß-]*(?:straße|strasse|str\.|weg|allee|gasse|platz|ufer|damm|ring|steig|chaussee|vägen|gatan|gränd|stigen|torget|backen|allén)[ ]\d{{1,4}}(?:[a-zA-Z](?!\w)|[ ][A-H](?=[.,;:)\s]*(?:\n|$)|[.,;:)]))?(?![\w-])
)""", re.X)
#: Every span but a mail address and an unparted number has one of these within; the patterns above are tried around them only.
ANCHOR = re.compile(r"\d(?:[-. /)(]{1,2}\d|[A-D]\b| [A-ZÅÄÖÜ])|[a-zß.] \d{1,4}(?!\d)")
MAIL_ANCHOR = re.compile(r"@|[\[(] ?at ?[\])]| at (?=\S+ dot )", re.I)
MAIL_WORD = re.compile(r"[ \[(]at[ \])]", re.I)
#: Characters before and after an anchor that a span may reach.
REACH = 90
#: Capitalised words and initials, one after another; "Family, Given" may hold a comma.
_NAME = r"[A-ZÅÄÖÜÉØÆ](?:[a-zåäöüéøæß'’]+|[A-ZÅÄÖÜÉØÆ]+)(?:[-'’][A-ZÅÄÖÜÉØÆ](?:[a-zåäöüéøæß]+|[A-ZÅÄÖÜÉØÆ]+))?"
WORD = re.compile(rf"(?<![\w`@.\\/$-]){_NAME}(?![\w`(\\/$]|-\w|\.\w)")
JOIN = re.compile(r"(?:[ \t]+|,[ \t]+|[ \t]+[A-ZÅÄÖÜ]\.[ \t]+)\Z")
#: Characters around a word within which a protected span counts as nearby.
NEAR = 60
#: Disclosure threshold: the information that a word gives about a protected span nearby, as a part of what
#: there is to know (the bits from the rate at any place to certainty).
DISCLOSES = 0.68
#: What the other word of a pair must have, and up to how many occurrences a word is too rare to tell.
OTHER, RARE = 0.23, 2
#: What stands before the first word of a sentence or line.
OPENING = re.compile(r"(?:^|[.!?]\s|\n)[\s>*#/'\-]*\Z")


def _control(digits: str) -> bool:
    """Whether the last of ten digits is right (doubled alternate digits sum to a multiple of ten)."""
    total = 0
    for i, ch in enumerate(digits):
        n = int(ch) * (2 - i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def _born(century: str | None, digits: str) -> bool:
    """Whether six digits are a date; the days of coordination numbers are 60 higher."""
    day = int(digits[4:6])
    try:
        date(int(f"{century or 20}{digits[:2]}"), int(digits[2:4]), day - 60 if day > 60 else day)
    except ValueError:
        return False
    return True


def _windows(anchor: re.Pattern, text: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for m in anchor.finditer(text):
        lo, hi = max(0, m.start() - REACH), m.end() + REACH
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def structured(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, type)`` with a written form of their own; of overlapping ones the first found."""
    out: list[tuple[int, int, str]] = []
    for lo, hi in _windows(MAIL_ANCHOR, text) if "@" in text or MAIL_WORD.search(text) else ():
        for m in EMAIL.finditer(text, lo, hi):
            local = _AT_RE.split(m.group(), maxsplit=1)[0].lower()
            # git@host:path names a repository
            remote = re.match(r":[\w~./-]+/", text[m.end() : m.end() + 60]) is not None
            if local not in MACHINES and not remote:
                out.append((m.start(), m.end(), "EMAIL"))
    for m in UNPARTED.finditer(text) if TEN.search(text) else ():
        if _control(m.group(2) + m.group(3)) and _born(m.group(1), m.group(2)):
            out.append((m.start(), m.end(), "ID_NUMBER"))
    windows = _windows(ANCHOR, text)
    for pattern, kind in ((SOCIAL, "ID_NUMBER"), (PERSONAL, "ID_NUMBER"), (INSURANCE, "ID_NUMBER"), (STREET, "ADDRESS"), (PHONE, "PHONE")):
        for lo, hi in windows:
            for m in pattern.finditer(text, lo, hi):
                if pattern is PERSONAL and not (_control(m.group(1) + m.group(2)) and re.search(r"[-+]", m.group())):
                    continue
                if pattern is PHONE and (not 8 <= sum(c.isdigit() for c in m.group()) <= 15 or DATE.match(m.group())):
                    continue
                out.append((m.start(), m.end(), kind))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Capitalised words in runs, each word as a span."""
    out: list[list[tuple[int, int]]] = []
    last = -10
    for m in WORD.finditer(text):
        if m.start() - last <= 6 and JOIN.match(text, last, m.start()):
            out[-1].append(m.span())
        else:
            out.append([m.span()])
        last = m.end()
    return out


def _masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text without the words of its structured spans, at the same length."""
    if not found:
        return text
    parts, at = [], 0
    for s, e, _ in found:
        parts += [text[at:s], "\0" * (e - s)]
        at = e
    return "".join(parts) + text[at:]


def _near(span: tuple[int, int], found: list[tuple[int, int, str]]) -> bool:
    return any(s - NEAR <= span[1] and span[0] <= e + NEAR for s, e, _ in found)


def observe(texts: list[str | None]) -> tuple[dict[str, list[int]], int, int]:
    """Per word: occurrences, those near a protected span, those that open a sentence or a longer run.
    And the number of all places, and of those near a protected span."""
    seen: dict[str, list[int]] = {}
    places = near = 0
    for text in texts:
        if not text:
            continue
        found = structured(text)
        places += len(text)
        near += sum(min(len(text), e + NEAR) - max(0, s - NEAR) for s, e, _ in found)
        for run in runs(_masked(text, found)):
            at = run[0][0]
            opening = OPENING.search(text, max(0, at - 12), at) is not None
            for i, span in enumerate(run):
                row = seen.setdefault(text[span[0] : span[1]].lower(), [0, 0, 0])
                row[0] += 1
                row[1] += bool(found) and _near(span, found)
                row[2] += i == 0 and (opening or len(run) > 2) or i == 1 and opening and len(run) == 2
    return seen, places, near


def revealing(n: int, k: int, opens: int, rate: float) -> float | None:
    """Disclosure of a word seen ``n`` times, ``k`` of them near a protected span, smoothed by one; None if it
    can't be part of a name. A word that mostly opens sentences or runs is a cue before names
    ("Customer ..."), not a part of them; a rare word doesn't speak against a name."""
    part = math.log2((k + rate) / (n + 1) / rate) / -math.log2(rate)
    part = max(part, OTHER) if n <= RARE else part
    return part if part >= OTHER and opens * 2 <= n else None


def name_spans(text: str, known: dict[str, float], found: list[tuple[int, int, str]], threshold: float = DISCLOSES) -> list[tuple[int, int]]:
    """Names: pairs of neighbouring words, initial or comma between them, that reveal a person.

    One of the two must be above the threshold and the other not speak against it. Of overlapping pairs
    the more revealing wins; given and family name side by side go before the pair around a comma.
    """
    out: list[tuple[int, int]] = []
    for run in runs(_masked(text, found)):
        if len(run) < 2:
            continue
        pairs = []
        for a, b in zip(run[:-1], run[1:], strict=True):
            x, y = (known.get(text[s:e].lower(), -9.0) for s, e in (a, b))
            if max(x, y) >= threshold and min(x, y) >= OTHER:
                comma = "," in text[a[1] : b[0]]
                pairs.append((min(x, threshold) + min(y, threshold) - (0.1 if comma else 0), a[0], b[1]))
        taken: list[tuple[int, int]] = []
        for _, s, e in sorted(pairs, key=lambda p: (-p[0], -p[1])):
            if all(e <= t[0] or s >= t[1] for t in taken):
                taken.append((s, e))
        out += taken
    return sorted(out)


def looked_up(text: str) -> set[str]:
    """The words of a text that ``name_spans`` looks up."""
    return {text[s:e].lower() for run in runs(_masked(text, structured(text))) if len(run) > 1 for s, e in run}


def find(text: str, known: dict[str, float]) -> list[tuple[int, int, str]]:
    found = structured(text)
    return sorted(found + [(s, e, "NAME") for s, e in name_spans(text, known, found)])


def revealing_terms(docs: DataFrame) -> DataFrame:
    """``(term, discloses)`` of all words that don't speak against being part of a name, over all texts."""

    def run(batches):
        for batch in batches:
            seen, places, near = observe(batch.column("text").to_pylist())
            rows = [(t, *v) for t, v in seen.items()] + [("", places, near, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.int64(), pa.int64(), pa.int64()], strict=True)],
                names=["term", "n", "k", "opens"],
            )

    counted = cut(
        docs.where("length(text) > 0").select("text").mapInArrow(run, "term string, n long, k long, opens long")
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum("opens").alias("opens"))
    )
    total = counted.where("term = ''").first()
    rate = min(0.5, max(1e-9, total["k"] / total["n"])) if total and total["n"] else 0.5
    part = F.log2((F.col("k") + rate) / (F.col("n") + 1) / rate) / -math.log2(rate)
    part = F.when(F.col("n") <= RARE, F.greatest(part, F.lit(OTHER))).otherwise(part)
    return (
        counted.where((F.col("term") != "") & (F.col("opens") * 2 <= F.col("n")))
        .select("term", part.alias("discloses")).where(F.col("discloses") >= OTHER)
    )


SPANS = "doc_id long, redacted string, spans array<struct<pii_type: string, found_text: string, start: int>>"


def sanitise(docs: DataFrame, max_broadcast_terms: int = 500_000) -> DataFrame:
    """``(doc_id, redacted, spans)`` for the documents ``(doc_id, text)`` with personal information.

    The rest of a text stays as it is. The revealing terms go to all tasks while there are at most
    ``max_broadcast_terms``, counted first; above that every document gets those of its own words by a
    join. Null and empty texts have no rows; equal documents each have theirs.
    """

    def words_of(batches):
        for batch in batches:
            rows = [(doc, t) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in looked_up(text)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string()], strict=True)], names=["doc_id", "term"])

    spark = docs.sparkSession
    texts = docs.where("length(text) > 0").select("doc_id", "text")
    terms = cut(revealing_terms(texts))
    small = terms.count() <= max_broadcast_terms
    sent = spark.sparkContext.broadcast({r["term"]: r["discloses"] for r in terms.toLocalIterator()}) if small else None
    if not small:
        words = texts.mapInArrow(words_of, "doc_id long, term string")
        own = words.join(terms, "term").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "discloses"))).alias("known"))
        texts = texts.join(own, "doc_id", "left")

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            given = batch.column("known").to_pylist() if sent is None else None
            for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                found = find(text, sent.value if sent is not None else dict(given[i] or []))
                if not found:
                    continue
                parts, at = [], 0
                for s, e, kind in found:
                    parts += [text[at:s], f"[{kind}]"]
                    at = e
                rows.append((doc, "".join(parts) + text[at:], [{"pii_type": k, "found_text": text[s:e], "start": s} for s, e, k in found]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            spans = pa.list_(pa.struct([("pii_type", pa.string()), ("found_text", pa.string()), ("start", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), spans], strict=True)], names=["doc_id", "redacted", "spans"])

    return texts.mapInArrow(run, SPANS)
