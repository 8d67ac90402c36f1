"""The most similar vectors of every vector, by balanced posting lists.

A bounded sample is split by repeated k-means until every part is small; the means of the parts are the
centroids. Each vector goes to the lists of its nearest centroids, boundary vectors to several, as far as
these are not much farther than the nearest one. Within a list the vectors are compared by matrix
products. The vectors travel as 16-bit integers; cosines are off by about 4e-6.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .neardups import BLOCK_ROWS, key_groups, split_hot
from .words import MUL, mix

#: Vectors in a list, apart from replicas.
LIST_SIZE = 256
#: Lists in all. Bounds the centroids that every task gets to 33 MB at 128 numbers each. From 16.8 million vectors
#: on lists get longer instead; those above ``BLOCK_ROWS`` are compared in blocks, so tasks stay bounded.
MAX_LISTS = 65_536
#: Lists that one vector goes to, and how much farther than the nearest centroid theirs may be.
REPLICAS, RATIO = 6, 1.25
#: Sampled vectors for the coarse parts, which are fitted in the driver, and for each list, which are fitted on the executors.
COARSE_ROWS, SAMPLE_PER_LIST = 8_192, 32
#: Links of a centroid, and centroids that a search keeps in view. So few centroids as are in view at once are all looked at.
GRAPH_LINKS, BEAM = 24, 32


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Assignment of the unit rows of ``x`` to ``k`` spherical means."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return (x @ c.T).argmax(axis=1)


def train_centroids(sample: np.ndarray, lists: int, seed: int = 7, fanout: int = 32) -> np.ndarray:
    """Unit centroids of a sample of unit vectors: parts are split again until they hold their share of it.

    Dense directions thereby get more lists. Parts of equal vectors can't be split and stay whole.
    """
    rng = np.random.default_rng(seed)
    share = max(1.0, len(sample) / max(1, lists))
    todo, done = [np.arange(len(sample))], []
    while todo:
        part = todo.pop()
        k = min(fanout, round(len(part) / share))
        if k < 2:
            done.append(part)
            continue
        own = _means(sample[part], k, rng)
        pieces = [part[own == i] for i in range(k)]
        pieces = [p for p in pieces if len(p)]
        if len(pieces) == 1:
            done.append(part)
        else:
            todo.extend(pieces)
    c = np.stack([sample[p].mean(axis=0) for p in done]) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
    norm = np.linalg.norm(c, axis=1, keepdims=True)
    return (c / np.maximum(norm, 1e-12)).astype(np.float32)


class CentroidGraph:
    """Nearest-centroid search for batches of queries, by walking a graph in memory.

    Every centroid is linked to its nearest ones. A search starts at the best of a few evenly drawn entry
    nodes and follows the links of the best nodes in view until the best ``k`` have all been followed.
    """

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        links = min(GRAPH_LINKS, n - 1)
        self.links = np.empty((n, links), dtype=np.int32)
        for a in range(0, n if links else 0, 1024):
            s = centroids[a : a + 1024] @ centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -9
            self.links[a : a + 1024] = np.argpartition(-s, links - 1, axis=1)[:, :links]
        self.entries = np.unique(np.linspace(0, n - 1, max(BEAM, int(4 * np.sqrt(n)))).astype(np.int64))

    def nearest(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of about the ``k`` nearest centroids of each row, nearest first."""
        k = min(k, len(self.c))
        beam = min(BEAM, len(self.entries))
        s = x @ self.c[self.entries].T
        top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
        ids, got = self.entries[top], np.take_along_axis(s, top, axis=1)
        seen = np.zeros(ids.shape, dtype=bool)
        live = np.arange(len(x)) if self.links.shape[1] and len(self.entries) < len(self.c) else np.zeros(0, dtype=np.int64)
        while len(live):
            i, g, f = ids[live], got[live], seen[live]
            # The two best nodes not followed yet, as long as they are among the best k.
            order = np.argsort(np.where(f, 9, -g), axis=1, kind="stable")[:, :2]
            grown = self.links[np.take_along_axis(i, order, axis=1)].reshape(len(live), -1)
            np.put_along_axis(f, order, True, axis=1)
            new = np.matmul(self.c[grown], x[live][:, :, None])[:, :, 0]
            i, g = np.concatenate((i, grown), axis=1), np.concatenate((g, new), axis=1)
            f = np.concatenate((f, np.zeros(grown.shape, dtype=bool)), axis=1)
            # Copies of one node stand together, followed ones first; later ones drop out.
            order = np.lexsort((~f, i), axis=1)
            i, g, f = (np.take_along_axis(v, order, axis=1) for v in (i, g, f))
            g[:, 1:][i[:, 1:] == i[:, :-1]] = -9
            keep = np.argsort(-g, axis=1, kind="stable")[:, :beam]
            i, g, f = (np.take_along_axis(v, keep, axis=1) for v in (i, g, f))
            ids[live], got[live], seen[live] = i, g, f
            live = live[~f[:, :k].all(axis=1)]
        return ids[:, :k], got[:, :k]


def usable_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and these as unit rows in double. Usable: full length, finite, not all zero."""
    sizes = np.array([-1 if v is None else v for v in column.value_lengths().to_pylist()], dtype=np.int64)
    full = np.flatnonzero(sizes == dims)
    if not len(full):
        return full, np.zeros((0, dims))
    flat = column.take(pa.array(full)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(full), dims)  # null numbers become NaN
    good = np.isfinite(x).all(axis=1)
    good[good] = (x[good] != 0).any(axis=1)
    x = x[good]
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return full[good], x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def _units(q: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(q), dtype=np.int16).reshape(len(q), dims).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(sent, dims: int, replicas: int, ratio: float):
    def run(batches):
        graph = CentroidGraph(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                at, x = usable_matrix(part.column("vector"), dims)
                q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 32767).astype(np.int16) if len(x) else x.astype(np.int16)
                lists: list[list[int]] = []
                if len(x):
                    ids, cos = graph.nearest(x.astype(np.float32), replicas)
                    far = np.sqrt(np.maximum(0, 2 - 2 * cos))
                    keep = far <= ratio * far[:, :1] + 1e-6
                    lists = [i[k].tolist() for i, k in zip(ids, keep, strict=True)]
                h = np.zeros(len(q), dtype=np.uint64)
                for j, col in enumerate(q.T.astype(np.int64).view(np.uint64) if len(q) else []):
                    h = mix(h * MUL + col + np.uint64(j))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([
                    part.column("key").take(take), part.column("model").take(take), pa.array(h.view(np.int64)),
                    pa.array([r.tobytes() for r in q], pa.binary()), pa.array(lists, pa.list_(pa.int32())),
                ], names=["key", "model", "same", "q", "lists"])
    return run


def _compare(dims: int, k: int, least: float, step: int = 1024):
    def run(batches):
        for t in key_groups(batches, "spot"):
            spot, block = t.column("spot").to_numpy(), t.column("block").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], (spot[1:] != spot[:-1]) | (block[1:] != block[:-1]), [True])))
            keys, side = t.column("key").to_numpy(), t.column("side").to_numpy()
            a, b, c = [], [], []
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x, own, s = _units(t.column("q").slice(lo, hi - lo).to_pylist(), dims), keys[lo:hi], side[lo:hi]
                for i in range(0, len(x), step):
                    cos = x[i : i + step] @ x.T
                    cos[np.arange(len(cos)), np.arange(i, i + len(cos))] = -2
                    if s[0] != 3:
                        cos[s[i : i + step, None] == s[None, :]] = -2
                    r, w = np.nonzero(cos >= least)
                    v = cos[r, w]
                    order = np.lexsort((own[w], -v, r))
                    r, w, v = r[order], w[order], v[order]
                    first = np.searchsorted(r, r)
                    keep = np.arange(len(r)) - first < k
                    a.append(own[i + r[keep]])
                    b.append(own[w[keep]])
                    c.append(v[keep].astype(np.float64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (a, b, c)], names=["key", "other", "cosine"])
    return run


def _draw(rows: DataFrame, n: int, size: int) -> DataFrame:
    """About ``size`` of ``n`` rows by a hash of their keys: the same rows however they lie."""
    grain = 1 << 30
    return rows if n <= size else rows.where(F.pmod(F.xxhash64("key"), F.lit(grain)) < int(size / n * grain))


def fit_lists(rows: DataFrame, n: int, lists: int, dims: int) -> np.ndarray:
    """Centroids of ``lists`` lists from bounded samples.

    A sample of at most about COARSE_ROWS comes to the driver (4 MB) and is parted by k-means. A larger one,
    SAMPLE_PER_LIST vectors for each list, stays on the executors: every part of it is split there into its
    share of the lists, and only the centroids come back, at most 33 MB.
    """
    first = _draw(rows, n, COARSE_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    first = first.combine_chunks() if isinstance(first, pa.ChunkedArray) else first
    _, x = usable_matrix(first, dims)
    x = x.astype(np.float32)
    if n <= COARSE_ROWS or lists <= 16:
        return train_centroids(x, lists)
    coarse = train_centroids(x, max(2, min(256, int(np.sqrt(lists)))))
    share = max(1.0, min(n, SAMPLE_PER_LIST * lists) / lists)

    def part(batches):
        for batch in batches:
            _, v = usable_matrix(batch.column("vector"), dims)
            own = (v.astype(np.float32) @ coarse.T).argmax(axis=1) if len(v) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([r.tobytes() for r in v.astype(np.float32)], pa.binary())], names=["part", "v"])

    def fit(pdf):
        v = np.frombuffer(b"".join(pdf["v"]), dtype=np.float32).reshape(len(pdf), dims)
        order = np.lexsort(v.T[:4])  # the fit must not hang on the order in which rows arrive
        c = train_centroids(v[order], max(1, round(len(v) / share)))
        return pd.DataFrame({"c": [r.tobytes() for r in c]})

    sample = _draw(rows, n, SAMPLE_PER_LIST * lists).mapInArrow(part, "part int, v binary")
    got = sample.groupBy("part").applyInPandas(fit, "c binary").orderBy("c").collect()
    return np.frombuffer(b"".join(r["c"] for r in got), dtype=np.float32).reshape(len(got), dims) if got else coarse


def nearest(vectors: DataFrame, k: int = 5, least: float = 0.8, dims: int = 128, replicas: int = REPLICAS,
            ratio: float = RATIO, list_size: int = LIST_SIZE, most: int = BLOCK_ROWS) -> DataFrame:
    """``(key, other, cosine, rank)``: up to ``k`` others of the same model with a cosine of at least ``least``.

    ``vectors`` has ``key`` (long), ``model`` and ``vector``; equal keys are one vector. Vectors that are
    null, of another length, not finite or all zero are left out and are nobody's neighbour; a null model
    is a model of its own. Equal cosines rank by key. Of more than k + 1 copies of one vector only the
    first k + 1 are compared; the others have the first k as their nearest ones, which is what comparing
    them would give. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select("key", F.coalesce("model", F.lit("\0")).alias("model"), F.col("vector").cast("array<float>").alias("vector")).where(
        f"key is not null and size(vector) = {dims}"
    )
    n = rows.count()
    lists = int(min(MAX_LISTS, max(1, n // list_size)))
    sent = spark.sparkContext.broadcast(fit_lists(rows, n, lists, dims))
    coded = cut(
        rows.mapInArrow(_assign(sent, dims, replicas, ratio), "key long, model string, same long, q binary, lists array<int>")
        .dropDuplicates(["key"])
    )
    many = coded.groupBy("model", "same").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > k + 1).select("model", "same")
    extra = None
    posted = coded
    if not many.isEmpty():
        copies = coded.select("key", "model", "same").join(many, ["model", "same"])
        salt = F.pmod(F.xxhash64("key"), F.lit(64))
        first = copies.withColumn("r", F.row_number().over(Window.partitionBy("model", "same", salt).orderBy("key"))).where(F.col("r") <= k + 1)
        first = cut(
            first.withColumn("r", F.row_number().over(Window.partitionBy("model", "same").orderBy("key"))).where(F.col("r") <= k + 1)
        )
        surplus = cut(copies.join(first.select("key"), "key", "left_anti"))
        posted = coded.join(surplus.select("key"), "key", "left_anti")
        heads = first.where(F.col("r") <= k).groupBy("model", "same").agg(F.collect_list("key").alias("others"))
        extra = surplus.join(heads, ["model", "same"]).select("key", F.explode("others").alias("other"), F.lit(1.0).alias("cosine"))
    spots = posted.select("key", "q", "model", F.explode("lists").alias("list")).select("key", "q", F.xxhash64("model", "list").alias("spot"))
    spots = split_hot(spots, "spot", "key", most)
    found = spots.repartition("spot", "block").sortWithinPartitions("spot", "block").mapInArrow(
        _compare(dims, k, least), "key long, other long, cosine double"
    )
    found = found if extra is None else found.unionByName(extra)
    best = found.groupBy("key", "other").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("key").orderBy(F.desc("cosine"), "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
