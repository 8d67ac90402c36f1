"""Near-duplicate texts: word-run sketches, a binary trie self-join over their bits, and an exact check.

Every text becomes its set of word runs. Sets that are equal form one class, and one member stands for it.
The classes get BITS one-bit min-hashes and BANDS keys of ROWS min-hashes each. Within the classes that
share a band key a trie of the bits is joined with itself: pairs of nodes descend together, add up the
bits in which they differ, and stop as soon as these exceed the error budget. The pairs that are left
are compared exactly, run by run.

Two sets of similarity s agree in a bit with probability (1 + s) / 2 and share a given band with
probability s^ROWS; at 0.6 the bands lose 0.04 % of the pairs and the budget of the trie about 0.01 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.lineage import cut
from .words import MUL, Words, mix, slices

BITS, BANDS, ROWS = 128, 32, 3
#: Differing bits that a pair may have: the mean at the threshold and 3.7 standard deviations more.
SPREAD = 3.7
SEEDS = mix(np.arange(1, BITS + 1, dtype=np.uint64) * MUL)
#: Largest trie leaf whose members are compared one by one.
LEAF = 16

SKETCH = "key long, n int, set_hi long, set_lo long, bits binary, bands array<long>"


def budget(threshold: float) -> int:
    p = (1 - threshold) / 2
    return min(BITS, int(np.ceil(BITS * p + SPREAD * np.sqrt(BITS * p * (1 - p)))))


def run_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``k`` words of each text, in order, and where each text's begin."""
    words = Words(texts, False)
    values, inside = words.runs(k)
    owner = (np.searchsorted(words.first, np.arange(len(values)), side="right") - 1)[inside]
    values = values[inside]
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def sketches(texts: list[str | None], k: int) -> tuple[np.ndarray, ...]:
    """Of the texts with at least one run: places, sizes, two hashes of the set, bits, and band keys."""
    values, first = run_sets(texts, k)
    sizes = np.diff(first)
    kept = np.flatnonzero(sizes)
    if not len(kept):
        none = np.zeros(0, dtype=np.uint64)
        return kept, sizes[kept], none, none, np.zeros((0, BITS // 8), dtype=np.uint8), np.zeros((0, BANDS), dtype=np.uint64)
    starts = first[:-1][kept]
    hi = mix(np.add.reduceat(mix(values ^ MUL), starts))
    lo = mix(np.add.reduceat(mix(values + MUL), starts))
    bits = np.zeros((len(kept), BITS), dtype=np.uint8)
    bands = np.zeros((len(kept), BANDS), dtype=np.uint64)
    for i in range(BITS):
        low = np.minimum.reduceat((values ^ SEEDS[i]) * (SEEDS[i] | np.uint64(1)), starts)
        bits[:, i] = (mix(low) >> np.uint64(40)) & np.uint64(1)
        if i < BANDS * ROWS:
            bands[:, i // ROWS] = mix(bands[:, i // ROWS] * MUL + low)
    bands ^= SEEDS[:BANDS]  # a key belongs to one band
    return kept, sizes[kept], hi, lo, np.packbits(bits, axis=1), bands


def _sketch_batches(k: int):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                kept, sizes, hi, lo, bits, bands = sketches(texts[a:b], k)
                flat = pa.array(bands.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([
                    keys.slice(a, b - a).take(pa.array(kept)), pa.array(sizes, pa.int32()),
                    pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                    pa.array([x.tobytes() for x in bits], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * BANDS + 1, BANDS), pa.int32()), flat),
                ], names=["key", "n", "set_hi", "set_lo", "bits", "bands"])
    return run


def trie_self_join(bits: np.ndarray, allowed: int) -> list[tuple[int, int]]:
    """Pairs of rows of ``bits`` (packed) that differ in at most ``allowed`` bits, smaller row first.

    The rows, in order of their bits, are a binary trie: a node is a range of rows and a depth. A pair of
    nodes carries the bits in which their paths differ so far and is dropped when these exceed the budget.
    """
    n = len(bits)
    if n < 2:
        return []
    order = np.lexsort(bits.T[::-1])
    packed = np.ascontiguousarray(bits[order])
    wide = packed.view(np.uint64)
    out: list[tuple[int, int]] = []

    def leaf(a: tuple[int, int], b: tuple[int, int]) -> None:
        diff = np.bitwise_count(wide[a[0] : a[1], None, :] ^ wide[None, b[0] : b[1], :]).sum(axis=2)
        x, y = np.nonzero(diff <= allowed)
        for i, j in zip((x + a[0]).tolist(), (y + b[0]).tolist(), strict=True):
            if a != b or i < j:
                i, j = int(order[i]), int(order[j])
                out.append((i, j) if i < j else (j, i))

    if n <= LEAF:
        leaf((0, n), (0, n))
        return out
    plain = np.unpackbits(packed, axis=1)

    def split(node: tuple[int, int], depth: int) -> list[tuple[int, tuple[int, int]]]:
        lo, hi = node
        mid = lo + int(np.searchsorted(plain[lo:hi, depth], 1))
        return [(bit, part) for bit, part in ((0, (lo, mid)), (1, (mid, hi))) if part[0] < part[1]]

    todo = [((0, n), (0, n), 0, 0)]
    while todo:
        a, b, depth, differ = todo.pop()
        if depth == BITS or (a[1] - a[0] <= LEAF and b[1] - b[0] <= LEAF):
            leaf(a, b)
            continue
        left = split(a, depth)
        right = left if a == b else split(b, depth)
        for s, x in left:
            for t, y in right:
                if (a != b or x <= y) and differ + (s != t) <= allowed:
                    todo.append((x, y, depth + 1, differ + (s != t)))
    return out


def _join_batches(allowed: int, ratio: float):
    """Streams rows sorted by band key; joins the rows of one key, drops keys with one row."""

    def run(batches):
        for t in key_groups(batches, "band"):
            band, salt = t.column("band").to_numpy(), t.column("block").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (salt[1:] != salt[:-1]), [True])))
            starts, counts = edge[:-1], np.diff(edge)
            many = np.flatnonzero(counts > 1)
            if not len(many):
                continue
            rows = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[many], counts[many], strict=True)])
            sub = t.take(pa.array(rows))
            keys, sizes, side = sub.column("rep").to_numpy(), sub.column("n").to_numpy(), sub.column("side").to_numpy()
            bits = np.frombuffer(b"".join(sub.column("bits").to_pylist()), dtype=np.uint8).reshape(len(rows), BITS // 8)
            a, b, at = [], [], 0
            for c in counts[many].tolist():
                for i, j in trie_self_join(bits[at : at + c], allowed):
                    i, j = i + at, j + at
                    # 3: within a block; else only pairs between the two blocks
                    if (side[i] == 3 or side[i] != side[j]) and keys[i] != keys[j]:
                        if min(sizes[i], sizes[j]) >= ratio * max(sizes[i], sizes[j]):
                            a.append(keys[i])
                            b.append(keys[j])
                at += c
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


#: Rows of one key that a task compares at once; keys with more are split in blocks of about this size.
BLOCK_ROWS = 16_384
#: Copies of one set that are paired at once.
PAIR_ROWS = 2_048
#: Split keys that may be sent to all tasks: 16 bytes each.
MAX_SENT = 1_000_000


def split_hot(rows: DataFrame, key: str, spread: str, most: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``block`` and ``side``. Keys of more than ``most`` rows are split in blocks of about that size, and
    every two blocks meet in a task of their own, so a task holds at most about twice ``most`` rows however
    large a key is. Rows of side 3 are to be compared with each other, rows of side 1 with those of side 2.

    Keys are counted exactly, combined before the shuffle; at most one in ``most`` rows names a split key, and
    these are sent to all tasks while they are few, else joined.
    """
    hot = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_b")))
    n = hot.count()
    if not n:
        return rows.withColumn("block", F.lit(0)).withColumn("side", F.lit(3))
    # A block is numbered by its two parts: the smaller, then the larger.
    own = F.pmod(F.xxhash64(spread), F.col("_b")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_b") - 1),
        lambda o: F.struct(
            (F.least(o, own).cast("long") * F.col("_b") + F.greatest(o, own)).alias("block"),
            F.when(o == own, 3).when(own < o, 1).otherwise(2).alias("side"),
        ),
    )
    alone = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(3).alias("side")))
    marked = rows.join(F.broadcast(hot) if n <= MAX_SENT else hot, key, "left")
    return marked.withColumn("p", F.explode(F.when(F.col("_b").isNotNull(), pairs).otherwise(alone))).select(*rows.columns, "p.block", "p.side")


def key_groups(batches, key: str):
    """Tables of whole groups from batches that are sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column(key)[batch.num_rows - 1] == held[0].column(key)[0]:
            continue  # one key so far
        whole = pa.Table.from_batches(held).combine_chunks()
        values = whole.column(key).to_numpy()
        cut_at = int(np.flatnonzero(values != values[-1])[-1]) + 1
        yield whole.slice(0, cut_at)
        held = whole.slice(cut_at).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def sketch_classes(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(members(key, rep), classes(rep, n, bits, bands))``; texts without a run of ``k`` words have no class."""
    rows = cut(docs.where("key is not null and length(text) > 0").select("key", "text").mapInArrow(_sketch_batches(k), SKETCH))
    one_set = ["set_hi", "set_lo", "n"]
    classes = rows.groupBy(*one_set).agg(
        F.min("key").alias("rep"), F.first("bits").alias("bits"), F.first("bands").alias("bands")
    )
    classes = cut(classes)
    members = rows.select("key", *one_set).distinct().join(classes.select(*one_set, "rep"), one_set).select("key", "rep")
    return members, classes.select("rep", "n", "bits", "bands")


def similar_classes(docs: DataFrame, classes: DataFrame, k: int, threshold: float, most: int = BLOCK_ROWS,
                    max_broadcast_keys: int = 1_000_000) -> DataFrame:
    """Pairs ``(a, b, shared, n_a, n_b)`` of class representatives whose similarity is at least ``threshold``."""
    rows = split_hot(classes.select("rep", "n", "bits", F.explode("bands").alias("band")), "band", "rep", most)
    found = (
        rows.repartition("band", "block").sortWithinPartitions("band", "block")
        .mapInArrow(_join_batches(budget(threshold), threshold), "a long, b long")
    )
    pairs = cut(found.distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    n_ends = ends.count()
    # The texts of the pairs only; the keys go to all tasks while they are few.
    texts = docs.where("key is not null").join(F.broadcast(ends) if n_ends <= max_broadcast_keys else ends, "key", "left_semi")

    def sets(batches):
        for batch in batches:
            keys, bodies = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in slices(bodies):
                values, first = run_sets(bodies[lo:hi], k)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), pa.array([values[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())],
                    names=["key", "runs"],
                )

    have = cut(texts.select("key", "text").mapInArrow(sets, "key long, runs binary").dropDuplicates(["key"]))

    def compare(batches):
        for batch in batches:
            a, b = batch.column("ra").to_pylist(), batch.column("rb").to_pylist()
            both, na, nb = [], [], []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both.append(int((y[at] == x).sum()) if len(y) else 0)
                na.append(len(x))
                nb.append(len(y))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(both, pa.int32()), pa.array(na, pa.int32()), pa.array(nb, pa.int32())],
                names=["a", "b", "shared", "n_a", "n_b"],
            )

    full = (
        pairs.join(have.select(F.col("key").alias("a"), F.col("runs").alias("ra")), "a")
        .join(have.select(F.col("key").alias("b"), F.col("runs").alias("rb")), "b")
        .select("a", "b", "ra", "rb")
    )
    # Exact in integers: shared / (n_a + n_b - shared) >= threshold, with the threshold in millionths.
    millionths = round(threshold * 1_000_000)
    return full.mapInArrow(compare, "a long, b long, shared int, n_a int, n_b int").where(
        F.col("shared").cast("long") * 1_000_000 >= (F.col("n_a").cast("long") + F.col("n_b") - F.col("shared")) * millionths
    )


def similar_pairs(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """All pairs ``(a, b)`` of keys of ``docs(key, text)``, smaller first, at least ``threshold`` similar.

    Equal keys count once. Null and empty texts, and texts of fewer than ``k`` words, are in no pair.
    Copies are expanded: a class of m equal sets gives m (m - 1) / 2 pairs, which is what this form of the
    result asks for; ``groups`` and ``links`` stay linear.
    """
    members, classes = sketch_classes(docs, k)
    members = cut(members)
    links = similar_classes(docs, classes, k, threshold).select("a", "b")
    left = members.select(F.col("rep").alias("a"), F.col("key").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("key").alias("y"))
    between = links.join(left, "a").join(right, "b")
    # A class of very many copies is split in blocks that meet pairwise, each pair of blocks in its own place.
    parts = split_hot(members, "rep", "key", PAIR_ROWS)
    one = parts.select("rep", "block", F.col("side").alias("s"), F.col("key").alias("x"))
    two = parts.select("rep", "block", F.col("side").alias("t"), F.col("key").alias("y"))
    within = one.join(two, ["rep", "block"]).where("(s = 3 and t = 3 and x < y) or (s = 1 and t = 2)")
    return between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(within.select(F.least("x", "y"), F.greatest("x", "y")))


def links_and_members(docs: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The linear form: ``(a, b)`` of class representatives that are similar, and ``(key, rep)`` of every text with a run.

    Together they hold every pair: those of one class, and those of two classes that are linked.
    """
    members, classes = sketch_classes(docs, k)
    return similar_classes(docs, classes, k, threshold).select("a", "b"), members


def groups(docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """One row per key in a group of two or more: ``(key, group, class, n_links)``.

    The group is the smallest key that chains of similar texts lead to, the class the smallest key with the
    same set of runs, ``n_links`` the number of other classes that are similar to its own.
    """
    members, classes = sketch_classes(docs, k)
    members = cut(members)
    links = cut(similar_classes(docs, classes, k, threshold).select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    comps = connected_components(links, "a", "b").withColumnRenamed("node", "rep")
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("m"))
    return (
        members.join(sizes, "rep").join(comps, "rep", "left").join(degree, "rep", "left")
        .where("m > 1 or component is not null")
        .select("key", F.coalesce("component", "rep").alias("group"), F.col("rep").alias("class"),
                F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
