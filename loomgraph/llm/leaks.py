"""Evaluation passages that appear in training texts: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, slices

#: A shared span of MIN_WORDS words holds a window of WINDOW runs of GRAM words, and so a common fingerprint.
MIN_WORDS, GRAM = 12, 5


def _smallest(values: np.ndarray, inside: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest value of each window of ``window`` consecutive runs that lie in one text."""
    if len(values) < window:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values) - window + 1)
    least = values[: len(best)].copy()
    whole = inside[: len(best)].copy()
    for j in range(1, window):
        v = values[j : j + len(best)]
        take = v <= least  # the rightmost of equal values
        best[take] = np.arange(j, j + len(best))[take]
        least = np.minimum(least, v)
        whole &= inside[j : j + len(best)]
    # A window may not cross from one text to the next: its first and last run must have one owner.
    return np.unique(best[whole])


def fingerprints(words: Words, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """``(places, hashes)`` of the winnowed runs: every span of ``min_words`` words within a text holds one."""
    values, inside = words.runs(gram)
    places = _smallest(values, inside, min_words - gram + 1)
    return places, values[places]


def shared_spans(a: np.ndarray, b: np.ndarray, hits: list[tuple[int, int]], min_words: int) -> tuple[int, int, int] | None:
    """The longest run of equal words through any hit: ``(start in a, start in b, length)``, if long enough."""
    best = None
    seen: set[tuple[int, int]] = set()
    for i, j in hits:
        if (i, j) in seen:
            continue
        back = 0
        while i - back > 0 and j - back > 0 and a[i - back - 1] == b[j - back - 1]:
            back += 1
        n = back
        while i - back + n < len(a) and j - back + n < len(b) and a[i - back + n] == b[j - back + n]:
            seen.add((i - back + n, j - back + n))
            n += 1
        if n >= min_words and (best is None or n > best[2]):
            best = (i - back, j - back, n)
    return best


class Passages:
    """The test passages as word hashes with an index from fingerprint to (item, place)."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int, gram: int):
        rows = [(i, p) for i, p in rows if i is not None and p]
        words = Words([p for _, p in rows], True)
        self.ids = [i for i, _ in rows]
        self.hashes = [words.hashes[words.first[k] : words.first[k + 1]] for k in range(len(rows))]
        places, values = fingerprints(words, min_words, gram)
        owner = np.searchsorted(words.first, places, side="right") - 1
        self.index: dict[int, list[tuple[int, int]]] = {}
        for p, v, o in zip(places.tolist(), values.tolist(), owner.tolist(), strict=True):
            self.index.setdefault(v, []).append((o, p - int(words.first[o])))
        self.known = np.array(sorted(self.index), dtype=np.uint64)


LEAK_SCHEMA = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM,
               max_broadcast_chars: int = 32_000_000) -> DataFrame:
    """Documents ``(doc_id, text)`` that share ``min_words`` words in a row with an item ``(item_id, passage)``.

    One row per document and item with the longest shared span and where it starts, in words. Words are
    runs of letters and digits, lower-cased. The items are sent to all tasks while their passages have at
    most ``max_broadcast_chars`` characters together, which is counted first; a larger test set is worked
    off in parts of that size. Null and empty texts and passages match nothing; equal passages each match.
    """
    sizes = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0)).alias("n")).first()["n"]
    parts = int(sizes // max_broadcast_chars) + 1
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else items
        found = _scan(docs, own, min_words, gram)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(docs: DataFrame, items: DataFrame, min_words: int, gram: int) -> DataFrame:
    rows = [(r["item_id"], r["passage"]) for r in items.select("item_id", "passage").distinct().collect()]
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches):
        tests = Passages(sent.value, min_words, gram)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out: list[tuple] = []
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi], True)
                places, values = fingerprints(words, min_words, gram)
                if not len(tests.known) or not len(places):
                    continue
                at = np.minimum(np.searchsorted(tests.known, values), len(tests.known) - 1)
                hit = tests.known[at] == values
                hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                owner = np.searchsorted(words.first, places[hit], side="right") - 1
                for p, v, d in zip(places[hit].tolist(), values[hit].tolist(), owner.tolist(), strict=True):
                    for item, q in tests.index[v]:
                        hits.setdefault((d, item), []).append((p - int(words.first[d]), q))
                for (d, item), pairs in hits.items():
                    own = words.hashes[words.first[d] : words.first[d + 1]]
                    if best := shared_spans(own, tests.hashes[item], pairs, min_words):
                        out.append((ids[lo + d], tests.ids[item], best[2], best[0], best[1]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()], strict=True)],
                names=["doc_id", "item_id", "n_words", "doc_word", "item_word"],
            )

    return docs.where("length(text) > 0").select("doc_id", "text").mapInArrow(scan, LEAK_SCHEMA)
