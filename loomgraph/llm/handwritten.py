"""Telling hand-written source from generated, minified, vendored files and data saved as code.

Many such files say so, in a notice at their head or by the folder or ending they are kept under. These
notices label a bounded sample; the features are measured without them, so a random forest learns what
such files look like and finds those that say nothing. Files of literal rows never carry a notice; a
strict count of literal rows labels those. Vendored files are ordinary code: their notice counts, but
they are no examples for the forest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

#: Labelled rows that the forest is fitted on, at most. All rows are classified.
SAMPLE_ROWS = 20_000
#: Probability from which a file counts as not hand-written.
THRESHOLD = 0.385
#: The same for the first forest, whose examples of hand-written files still hold machine-made ones without a notice.
FIRST_THRESHOLD = 0.1

# Notices at the start of a comment line, by kind.
_NOTICES = {
    "generated": r"""<auto-?generated|@generated\b|auto-?generated(?:\s+file|\s+by|\s+from|[.:!]|\s*$)|code\s+generated\b|generated\s+(?:by|from|with|using)\b
        |(?:this\s+(?:file|code|class)\s+(?:was|is)\s+(?:automatically\s+|auto-?)?(?:generated|created|produced)\b)|machine\s+(?:output|generated)\b|do\s+not\s+(?:edit|modify)\b""",
    "vendored": r"""vendored\s+from\b|third[- ]party\s+code\b|copied\s+(?:from|verbatim)\b|!?\s*[\w.@/-]+\s+v?\d+\.\d+[\w.]*\s*(?:\|.*)?\(c\)|[\w.@/-]+\s+-\s+release\s+\d
        |copyright\s+the\s+.*authors\b.*upstream|upstream\s+commit\b|imported\s+from\s+upstream\b""",
    "minified": r"!\s*[\w.-]+\s+build\s+\d+",
}
NOTICES = {k: re.compile(rf"(?:{v})", re.I | re.X) for k, v in _NOTICES.items()}
#: A comment line with what it says, and the lines that open or close a block comment.
COMMENT = re.compile(r"\s*(?://+|#+(?!!)|--+|'+|/\*+|\*+/?|<!--)[\s=*#-]*(.*?)\s*(?:\*/|-->)?\s*$")
#: The reference to a source map, in the last line of what a tool wrote.
MAPPED = re.compile(r"^[ \t]*(?://|/\*)[ \t]*[#@][ \t]*sourceMappingURL=[^\n]*\s*\Z", re.M)
#: Folders and endings by which such files are kept apart.
PATHS = {
    "vendored": re.compile(r"(?:^|/)(?:vendor|vendored|third[_-]?party|node_modules|bower_components|external|externals|deps|site-packages|wwwroot/lib)/", re.I),
    "generated": re.compile(r"(?:^|/)(?:generated|__generated__|autogen|gen|obj)/|\.(?:generated|g|gen|designer|pb)\.\w+$|_(?:generated|gen|pb2)\.\w+$", re.I),
    "minified": re.compile(r"\.(?:min|bundle)\.\w+$", re.I),
}
TOKEN = re.compile(r"[A-Za-z_$@][\w$]*|\d[\w.]*|[^\s\w]")
SHAPE_NAME, SHAPE_NUMBER, SHAPE_STRING = re.compile(r"[A-Za-z_$@][\w$]*"), re.compile(r"\d+"), re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`")
LITERAL_LINE = re.compile(r"(?:[\s,()\[\]{}+-]*+(?:\"[^\"\n]*+\"|'[^'\n]*+'|0x[\da-fA-F]++|\d[\d.]*+|null|true|false|NULL))++[\s,()\[\]{};]*$|insert\s+into\s+\S+\s+(?:\([^()]*\)\s*)?values\s*\([^()]*\)\s*[;,]?$", re.I)

FEATURES = (
    "compression", "entropy", "name_length", "short_names", "numbered_names", "comment_density", "line_length", "longest_line",
    "shapes", "top_shape", "digits", "blanks", "size",
)
SIZE = len(FEATURES) - 1


def head_notice(text: str) -> tuple[str, int]:
    """Kind of the notice in the comment block at the head of ``text``, else '', and where that block ends."""
    at, kind, inside = 0, "", ""
    for line in text.splitlines(keepends=True):
        start = line.lstrip()
        said = COMMENT.match(line[:400])
        if line.strip() and not said and not inside:
            break
        if not inside:
            inside = "*/" if start.startswith("/*") else "-->" if start.startswith("<!--") else ""
        if line.strip() and not kind:
            words = said.group(1) if said else line.strip()
            kind = next((k for k, p in NOTICES.items() if p.match(words)), "")
        if inside and inside in line:
            inside = ""
        at += len(line)
    return kind, at


def tail_notice(text: str) -> tuple[str, int]:
    """'minified' for a text that ends with the reference to its source map, else '', and where the rest ends."""
    m = MAPPED.search(text, max(0, text.rfind("sourceMappingURL=") - 200)) if "sourceMappingURL=" in text else None
    return ("minified", m.start()) if m else ("", len(text))


def literal_share(lines: list[str]) -> float:
    """Share of the characters outside comments that stand in rows of literals; 0 with fewer than four rows."""
    rows = [x.strip() for x in lines if LITERAL_LINE.match(x.strip())]
    code = rows + [x.strip() for x in lines if x.strip() and not LITERAL_LINE.match(x.strip()) and not COMMENT.match(x[:400])]
    return sum(map(len, rows)) / sum(map(len, code)) if len(rows) >= 4 else 0.0


def features(text: str) -> list[float]:
    """The features of a file whose head notice has been cut off, in the order of FEATURES."""
    raw = text.encode("utf-8", "replace")
    tokens = TOKEN.findall(text)
    seen = Counter(tokens)
    total = max(1, len(tokens))
    entropy = -sum(c / total * math.log2(c / total) for c in seen.values())
    names = [(t, c) for t, c in seen.items() if t[0].isalpha() or t[0] in "_$@"]
    n_names = max(1, sum(c for _, c in names))
    lines = [x for x in text.splitlines() if x.strip()]
    n_lines = max(1, len(lines))
    comments = sum(COMMENT.match(x[:400]) is not None for x in lines)
    plain = SHAPE_NUMBER.sub("9", SHAPE_NAME.sub("i", SHAPE_STRING.sub("s", text)))
    shapes = Counter(x.strip() for x in plain.splitlines() if x.strip())
    return [
        len(zlib.compress(raw, 1)) / max(1, len(raw)), entropy / max(1.0, math.log2(total + 1)),
        sum(len(t) * c for t, c in names) / n_names, sum(c for t, c in names if len(t) <= 3) / n_names,
        sum(c for t, c in names if t[-1].isdigit()) / n_names, comments / n_lines,
        min(1000.0, sum(map(len, lines)) / n_lines), min(10_000.0, float(max(map(len, lines), default=0))),
        len(shapes) / n_lines, max(shapes.values(), default=0) / n_lines,
        sum(map(str.isdigit, text)) / max(1, len(text)), sum(map(str.isspace, text)) / max(1, len(text)),
        math.log2(1 + len(text)),
    ]


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, notice, features)``: the kind of notice or 'data', else '', and the measures."""

    def run(batches):
        for batch in batches:
            kinds, values = [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                kind, at = head_notice(text)
                tail, end = tail_notice(text)
                body = text[at:end]
                kind = kind or tail or next((k for k, p in PATHS.items() if p.search(path or "")), "")
                if not kind and literal_share(body.splitlines()) >= 0.85:
                    kind = "data"
                kinds.append(kind)
                values.append(features(body))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kinds, pa.string()), pa.array(values, pa.list_(pa.float64()))], names=["doc_id", "notice", "features"]
            )

    return docs.select("doc_id", "path", "text").mapInArrow(run, "doc_id long, notice string, features array<double>")


def _forest(sample: DataFrame, seed: int):
    rows = sample.select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=40, maxDepth=8, maxBins=64, minInstancesPerNode=3, seed=seed, subsamplingRate=0.8
    ).fit(rows)


def _scored(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows.withColumn("x", array_to_vector("features")))
    return out.withColumn("p", F.element_at(vector_to_array("probability"), 2)).drop("x", "rawPrediction", "probability", "prediction")


def classify(docs: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """``(doc_id, notice, probability, by_hand)`` for every file ``(doc_id, path, text)``.

    The forest is fitted twice: files without a notice that the first one takes for machine-made are left
    out of the second one's examples of hand-written files. A file with a notice is not hand-written
    whatever the forest says. Null and empty texts have no features to speak of and count as written by
    hand unless their path says otherwise. Without any notice, or with nothing else, there is nothing to learn:
    then only the notices count.
    """
    rows = cut(describe(docs.where("doc_id is not null")))
    n = rows.count()
    grain = 1 << 30
    part = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(grain)) < int(sample_rows / n * grain))
    sample = part.where("notice <> 'vendored'").withColumn("label", (F.col("notice") != "").cast("int")).where(f"features[{SIZE}] > 5")
    sample = cut(sample.repartition(max(1, min(8, sample_rows // 2500))))
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return rows.select("doc_id", "notice", F.col("notice").eqNullSafe("").cast("double").alias("probability"), (F.col("notice") == "").alias("by_hand"))
    first = _forest(sample, seed)
    clean = _scored(first, sample).where(f"label = 1 or p < {FIRST_THRESHOLD}")
    clean = cut(clean.drop("p"))
    model = _forest(clean, seed + 1) if clean.where("label = 0").limit(1).count() else first
    return _scored(model, rows).select(
        "doc_id", "notice", F.col("p").alias("probability"),
        ((F.col("notice") == "") & ((F.col("p") < threshold) | (F.col("features")[SIZE] <= 5) & (F.col("p") < 0.9))).alias("by_hand"),
    )
