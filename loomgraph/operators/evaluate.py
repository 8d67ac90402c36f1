"""Many queries at once against the texts of a corpus, and what they find of what was expected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .index import ScannedIndex
from .search import MIN_LEXICAL, Weights, diverse, test_evidence

#: Queries and rows that are worked on at once: a few dense blocks of 1,024 x 256 numbers.
QUERY_BLOCK, ROW_BLOCK = 256, 1024
SCORED = "query_id string, id string, path string, label string, entity_type string, lexical_score double, score double"


@dataclass(frozen=True)
class Block:
    """Some queries with the words they need, as plain lists that go to the tasks."""

    words: list[str]
    ids: list[str]
    phrases: list[str]
    #: By query, the places of words: alias groups, inner words of the phrase, words for the structure, words of the languages it names.
    groups: list[list[list[int]]]
    inner: list[list[int]]
    use: list[list[int]]
    asked: list[list[int]]
    compact: list[str]
    intent: list[int]


def prepare(queries: list[tuple[str, str]]) -> tuple[list[Block], list[dict[str, bool]]]:
    """The queries in blocks, and the different kinds of data access that they ask for. Queries are a given, short list."""
    blocks, intents = [], []
    for start in range(0, len(queries), QUERY_BLOCK):
        at: dict[str, int] = {w: i for i, w in enumerate([*T.LANGUAGE_WORDS, "parsers"])}
        place = lambda ws, at=at: [at.setdefault(w, len(at)) for w in ws]
        cols: list[list] = [[] for _ in range(8)]
        for qid, query in queries[start : start + QUERY_BLOCK]:
            phrase = query.strip().lower()
            mine = T.expand(T.query_tokens(query))
            want = T.intents(mine, phrase)
            if want not in intents:
                intents.append(want)
            # A text that holds the phrase has all its words as tokens, but for the first and last, which may go on there.
            inner = T.query_tokens(" ".join(re.split(r"\s+", phrase)[1:-1]))
            row = (qid, phrase, [place(g) for g in T.token_groups(mine)], place(inner), place(T.structure_words(mine)),
                   place([w for g in T.LANGUAGES if set(g) & set(mine) for w in g]), re.sub(r"[\W_]+", "", phrase), intents.index(want))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        blocks.append(Block(list(at), *cols))
    return blocks, intents


class _Dense:
    """The queries of a block as matrices of words by queries."""

    def __init__(self, b: Block) -> None:
        self.b, n, self.at = b, len(b.ids), pa.array(b.words)
        # Equal alias groups count in one column; most are one word.
        known: dict[tuple[int, ...], int] = {}
        cols = [[known.setdefault(tuple(g), len(known)) for g in gs] for gs in b.groups]
        self.members = [list(g) for g in known]
        self.single = np.array([g[0] for g in self.members], dtype=np.int64)
        self.several = [(k, g) for k, g in enumerate(self.members) if len(g) > 1]
        self.by_group, self.n_groups = self._matrix(cols, len(known)), np.array([max(1, len(c)) for c in cols], dtype=np.float64)
        self.inner, self.n_inner = self._matrix(b.inner, len(b.words)), np.array([len(set(i)) for i in b.inner], dtype=np.float32)
        self.use, self.has_use = self._matrix(b.use, len(b.words)), np.array([bool(u) for u in b.use])
        self.asked, self.has_asked = self._matrix(b.asked, len(b.words)), np.array([bool(a) for a in b.asked])
        self.intent = np.array(b.intent, dtype=np.int64)
        self.n = n

    @staticmethod
    def _matrix(places: list[list[int]], height: int) -> np.ndarray:
        m = np.zeros((height, len(places)), dtype=np.float32)
        for q, at in enumerate(places):
            m[at, q] = 1
        return m

    def of(self, lists: pa.Array) -> np.ndarray:
        """Rows by words: which of the block's words each list holds."""
        m = np.zeros((len(lists), len(self.b.words)), dtype=np.float32)
        rows, words = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.index_in(lists.flatten(), value_set=self.at)
        ok = words.is_valid().to_numpy(zero_copy_only=False)
        m[rows[ok], words.drop_null().to_numpy(zero_copy_only=False)] = 1
        return m

    def groups(self, m: np.ndarray) -> np.ndarray:
        out = m[:, self.single] if len(self.single) else np.zeros((len(m), 0), dtype=np.float32)
        for k, g in self.several:
            out[:, k] = m[:, g].max(axis=1)
        return out @ self.by_group


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROW_BLOCK):
            yield batch.slice(i, ROW_BLOCK)


def found_many(rows: DataFrame, blocks: list[Block]) -> DataFrame:
    """``(id, ..., words, whole)`` of ``(id, ..., text)``: words of the queries in each text, and the queries whose phrase it holds."""
    keys = [c for c in rows.columns if c != "text"]
    cut = rows.select(*keys, T.composed(F.col("text")).alias("text")).where("text is not null").select(*keys, F.lower("text").alias("low"), T.tokens(F.col("text")).alias("tokens"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense(b) for b in blocks]
        every = pa.array(sorted({w for b in blocks for w in b.words}))
        for batch in _blocks(batches):
            toks, low = batch.column("tokens"), batch.column("low").to_pylist()
            flat = toks.flatten()
            ok = pc.is_in(flat, value_set=every)
            parents = pc.list_parent_indices(toks).filter(ok).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=len(toks)))]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), flat.filter(ok))
            whole: list[list[str]] = [[] for _ in low]
            for d in dense:
                m = d.of(words)
                may = (m @ d.inner == d.n_inner) & (d.groups(m) > 0 if len(d.members) else False)
                for r, q in zip(*np.nonzero(may), strict=True):
                    if d.b.phrases[q] in low[r]:
                        whole[r].append(d.b.ids[q])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], words, pa.array(whole, pa.list_(pa.string()))], [*keys, "words", "whole"])

    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return cut.mapInArrow(work, f"{schema}, words array<string>, whole array<string>")


def _score(d: _Dense, batch: pa.RecordBatch, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Lexical scores and scores, rows by queries, by the same steps as ``search.scored``; -1 for a query that the text has no word of."""
    col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[:, None]
    n = d.groups(d.of(batch.column("words"))).astype(np.float64)
    bonus = np.zeros_like(n)
    at = {q: i for i, q in enumerate(d.b.ids)}
    for r, qs in enumerate(batch.column("whole").to_pylist()):
        for q in qs:
            if q in at:
                bonus[r, at[q]] = 0.15
    lex = np.where(n > 0, np.minimum(1.0, n / d.n_groups * 0.85 + bonus), -1.0)
    in_path, in_base, in_label, in_kind = (d.of(batch.column(c)) for c in ("path_tokens", "base_tokens", "label_tokens", "kind_tokens"))
    hits = lambda m: (m @ d.use).astype(np.float64)
    s = np.minimum(0.1, hits(in_path) * 0.035) + np.minimum(0.08, hits(in_base) * 0.06) + np.minimum(0.08, hits(in_label) * 0.04) + np.minimum(0.03, hits(in_kind) * 0.02)
    squeezed = list(zip(batch.column("path_squeezed").to_pylist(), batch.column("label_squeezed").to_pylist(), strict=True))
    longest = np.array([max(len(p or ""), len(t or "")) for p, t in squeezed])
    for q, compact in enumerate(d.b.compact):
        if len(compact) >= 8:
            for r in np.nonzero(longest >= len(compact))[0]:
                if any(compact in (x or "") for x in squeezed[r]):
                    s[r, q] += 0.04
    there = np.maximum(in_path, in_label)
    n_language = len(T.LANGUAGE_WORDS)
    other = (there[:, :n_language].max(axis=1) > 0)[:, None] & ~(there @ d.asked > 0)
    s -= np.where(d.has_asked & other & (in_path[:, n_language : n_language + 1] > 0), 0.08, 0.0)
    s = np.where(d.has_use, np.minimum(0.2, s), 0.0)
    scale = np.minimum(1.0, np.maximum(np.maximum(0.0, lex), s) * 0.85 + 0.15)
    evidence = np.where(col("is_test"), np.where(lex >= 0.5, 0.07, np.where(lex >= 0.4, 0.04, 0.0)), 0.0)
    access = np.array(batch.column("access").to_pylist(), dtype=np.float64).reshape(len(n), -1)[:, d.intent]
    score = (lex * weights.semantic + col("graph_score") * weights.graph * scale + col("trust") * weights.trust * scale + col("recency") * weights.recency * scale
             + s + evidence + access + np.where(col("source_of_truth"), lex * 0.1, 0.0))
    return lex, score


def scored_many(index: ScannedIndex, cands: DataFrame, queries: list[tuple[str, str]], reference: str, weights: Weights = Weights(), top: int | None = None) -> DataFrame:
    """``search.scored`` for many queries: ``(query_id, id, path, label, entity_type, lexical_score, score)``.

    Texts are read once and give the words of all queries; pairs of a query and an entity exist only within
    blocks of rows in a task. With ``top`` a task keeps the best so many of each query, by score, id and path,
    so the best ``top`` of all are among what it gives, and what is moved does not grow with the pairs.
    Queries of the same words are scored once.
    """
    spark = cands.sparkSession
    first: dict[str, str] = {}
    same = [(first.setdefault(q, qid), qid) for qid, q in queries]
    blocks, intents = prepare([(qid, q) for q, qid in first.items()])
    if not blocks:
        return spark.createDataFrame([], SCORED)
    unite = lambda c: F.flatten(F.collect_list(c)).alias(c)
    hits = index.texts(lambda rows: found_many(rows, blocks)).where(F.size("words") > 0).groupBy("id").agg(unite("words"), unite("whole"))
    counts = cands.groupBy("entity_type", "degree").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(W.partitionBy("entity_type").orderBy("degree"))
    ranks = counts.select("entity_type", "degree", ((upto - F.col("_c") + upto) / (2 * F.sum("_c").over(W.partitionBy("entity_type")))).alias("graph_score"))
    path, label, kind = F.col("path"), F.col("label"), F.col("kind")
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    rows = cands.select("id", "entity_type", "kind", "label", "path", "degree", "trust_level", "updated_at", "source_of_truth").join(hits, "id").join(ranks, ["entity_type", "degree"]).select(
        "id", "path", "label", "entity_type", "words", "whole", "graph_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust_level") / 100)).alias("trust"),
        T.recency(F.col("updated_at"), reference).alias("recency"), F.coalesce("source_of_truth", F.lit(False)).alias("source_of_truth"), test_evidence(path).alias("is_test"),
        T.tokens(path).alias("path_tokens"), T.tokens(T.basename(path)).alias("base_tokens"), T.tokens(label).alias("label_tokens"), T.tokens(kind).alias("kind_tokens"),
        squeeze(path).alias("path_squeezed"), squeeze(label).alias("label_squeezed"),
        F.array(*[T.data_access(F.col("entity_type"), kind, path, {k: F.lit(v) for k, v in want.items()}) for want in intents]).alias("access"))
    schema = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("path", pa.string()), ("label", pa.string()), ("entity_type", pa.string()), ("lexical_score", pa.float64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = [_Dense(b) for b in blocks]
        best: dict[str, list[tuple]] = {}
        for batch in _blocks(batches):
            names = [batch.column(c).to_pylist() for c in ("id", "path", "label", "entity_type")]
            for d in dense:
                lex, score = _score(d, batch, weights)
                for q in range(d.n):
                    use = np.nonzero(lex[:, q] >= MIN_LEXICAL)[0]
                    qid, mine = d.b.ids[q], score[use, q]
                    if top is not None:
                        kept = best.setdefault(qid, [])
                        # What is below the worst of a full list can't come in; equal scores may.
                        least = -kept[-1][0] if len(kept) == top else -np.inf
                        if len(mine) > top:
                            least = max(least, np.partition(mine, -top)[-top])
                        use, mine = use[mine >= least], mine[mine >= least]
                        if len(use):
                            kept += [(-x, names[0][r].encode(), (names[1][r] or "").encode(), names[2][r], names[3][r], lex[r, q], names[1][r]) for r, x in zip(use.tolist(), mine.tolist(), strict=True)]
                            best[qid] = sorted(kept, key=lambda k: k[:3])[:top]
                    elif len(use):
                        yield pa.RecordBatch.from_arrays([pa.array([qid] * len(use), pa.string()), *[pa.array([n[r] for r in use], pa.string()) for n in names], pa.array(lex[use, q]), pa.array(mine)], schema=schema)
        for qid, kept in best.items():
            if kept:
                x, i, _, lab, kind_of, lx, p = zip(*kept, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([qid] * len(kept), pa.string()), pa.array([b.decode() for b in i]), pa.array(p, pa.string()), pa.array(lab, pa.string()), pa.array(kind_of, pa.string()), pa.array([float(v) for v in lx]), pa.array([-v for v in x])], schema=schema)

    out = rows.mapInArrow(work, SCORED)
    if all(a == b for a, b in same):
        return out
    twins = spark.createDataFrame(same, "query_id string, _twin string")
    return out.join(F.broadcast(twins), "query_id").drop("query_id").withColumnRenamed("_twin", "query_id").select(*out.columns)


def search_many(index: ScannedIndex, cands: DataFrame, queries: list[tuple[str, str]], reference: str, top_k: int = 10) -> DataFrame:
    """The best ``top_k`` of every query with their ``rank``."""
    best = diverse(scored_many(index, cands, queries, reference, top=3 * top_k), top_k, ["query_id"])
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id", "path")))


def match_hits(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``(query_id, hit, rank, level)``: the first result that is an expected hit ``path``, ``path:symbol`` or ``path::symbol``.

    Prefixes ``file:`` and ``chunk:`` don't count. A result counts if its path or id is the path, or its id begins with the path and a colon; ``level`` is
    symbol if its id or title holds the symbol too, else path, and missing without a result.
    """
    plain = lambda c: F.regexp_replace(c, r"^(?:file:|chunk:)", "")
    parts = r"^(.+?\.[A-Za-z0-9]+)::?(.+)$"
    bare = plain(F.trim("hit"))
    path = F.when(bare.rlike(parts), F.regexp_extract(bare, parts, 1)).otherwise(bare)
    want = expected.select("query_id", "hit", path.alias("_path"), F.nullif(F.regexp_extract(bare, parts, 2), F.lit("")).alias("_symbol"))
    r = results.select("query_id", plain(F.col("id")).alias("id"), "path", F.col("label").alias("title"), "rank")
    same = (want["query_id"] == r["query_id"]) & ((r["path"] == want["_path"]) | (r["id"] == want["_path"]) | r["id"].startswith(F.concat(want["_path"], F.lit(":"))))
    named = F.lower(r["id"]).contains(F.lower("_symbol")) | F.lower(r["title"]).contains(F.lower("_symbol"))
    hit = want.join(r, same, "left").select(want["query_id"], "hit", "rank", F.when(r["rank"].isNull(), "missing").when(named, "symbol").otherwise("path").alias("level"))
    return hit.groupBy("query_id", "hit").agg(F.min("rank").alias("rank"), F.min_by("level", F.coalesce("rank", F.lit(1 << 30))).alias("level"))


def summary(matched: DataFrame, by: list[str]) -> DataFrame:
    """Totals of expected hits: found, missing, by symbol and by path only, recall in percent with 2 places, first rank."""
    n = F.count(F.lit(1))
    found = F.count("rank")
    return matched.groupBy(*by).agg(
        F.count_distinct("query_id").alias("queries"), n.alias("expected"), found.alias("found"), (n - found).alias("missing"), F.count_if(F.col("level") == "symbol").alias("symbol_matches"),
        F.count_if(F.col("level") == "path").alias("path_only"), F.round(found / n * 100, 2).alias("recall_pct"), F.min("rank").alias("first_rank"))
