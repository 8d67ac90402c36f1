"""Parent-child links to full hierarchies: paths, depths, roots, descendants and circles.

Connected components split the links into independent pieces; each piece is co-located and walked by
an iterative depth-first search with node colours. Pieces too large for one task take a
level-by-level walk of the whole piece on the cluster instead, with the same results.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .lineage import cut

NODE_SCHEMA = (
    "node string, root string, depth int, path array<string>, n_descendants long, back_edges array<string>"
)
BELOW_SCHEMA = "node string, descendant string, distance int"
#: Pairs that a task hands over at once.
BATCH = 100_000


def _reach(start: str, children: dict[str, list[str]]) -> dict[str, int]:
    """The nodes below ``start`` and how many links away each is; a circle doesn't lead back to ``start``."""
    seen = {start: 0}
    todo = deque([start])
    while todo:
        node = todo.popleft()
        for c in children.get(node, ()):
            if c not in seen:
                seen[c] = seen[node] + 1
                todo.append(c)
    del seen[start]
    return seen


def walk_component(links: list[tuple[str, str]]) -> list[tuple]:
    """Depth-first walk of one component's (parent, child) links.

    White nodes are unseen, grey ones lie on the current path, black ones are done; a link to a grey node
    is a back edge and closes a circle. A node in a circle, or below one, has no root: ``''`` and depth -1
    with an empty path. A node with several parents takes its shortest path, the smallest by text among
    equals. ``back_edges`` of a node are its parents, not smaller by text, that it leads back to, so every
    circle has at least one and they don't depend on where the walk starts. Returns rows of ``NODE_SCHEMA``.
    """
    children: dict[str, list[str]] = {}
    parents: dict[str, set[str]] = {}
    for p, c in set(links):
        children.setdefault(p, []).append(c)
        children.setdefault(c, [])
        parents.setdefault(c, set()).add(p)
        parents.setdefault(p, set())
    for kids in children.values():
        kids.sort()
    roots = sorted(n for n, ps in parents.items() if not ps)
    colour: dict[str, int] = {}
    back: set[str] = set()
    finished: list[str] = []
    for start in roots + sorted(children):
        if start in colour:
            continue
        colour[start] = 1
        stack = [(start, iter(children[start]))]
        while stack:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                colour[node] = 2
                finished.append(node)
                stack.pop()
            elif nxt not in colour:
                colour[nxt] = 1
                stack.append((nxt, iter(children[nxt])))
            elif colour[nxt] == 1:
                back.add(nxt)
    # Reverse finishing order: parents before children, apart from back edges.
    circular: set[str] = set()
    todo = list(back)
    while todo:
        node = todo.pop()
        if node not in circular:
            circular.add(node)
            todo.extend(children[node])
    path: dict[str, tuple[str, ...]] = {}
    for node in reversed(finished):
        if node in circular:
            continue
        ways = [path[p] for p in parents[node]]
        path[node] = (*min(ways, key=lambda w: (len(w), w)), node) if ways else (node,)
    below: dict[str, int] = {}
    closing: dict[str, list[str]] = {}
    shared = any(len(ps) > 1 for ps in parents.values()) or circular
    if not shared:
        for node in finished:
            below[node] = sum(below[c] + 1 for c in children[node])
    else:
        for node in children:
            reach = _reach(node, children)
            below[node] = len(reach)
            if node in circular:
                closing[node] = sorted(p for p in parents[node] if p == node or p > node and p in reach)
    return [
        (n, path[n][0], len(path[n]) - 1, list(path[n]), below[n], []) if n in path
        else (n, "", -1, [], below[n], closing[n])
        for n in sorted(children)
    ]


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = walk_component(list(zip(pdf["parent"], pdf["child"], strict=True)))
    return pd.DataFrame(rows, columns=["node", "root", "depth", "path", "n_descendants", "back_edges"])


def _walk_levels(links: DataFrame, counts: bool = True) -> DataFrame:
    """The walk for pieces beyond one task: one join per level; a node is placed when all its parents are."""
    links = cut(links)
    need = links.groupBy(F.col("child").alias("node")).agg(F.count(F.lit(1)).alias("need"))
    nodes = links.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    placed = cut(nodes.join(need, "node", "left_anti").select("node", F.array("node").alias("path")))
    while True:
        ready = (
            links.join(placed.withColumnRenamed("node", "parent"), "parent")
            .groupBy(F.col("child").alias("node"))
            .agg(F.count(F.lit(1)).alias("have"), F.min(F.struct(F.size("path").alias("k"), F.col("path"))).alias("best"))
            .join(need, "node").where("have = need")
            .join(placed.select("node"), "node", "left_anti")
            .select("node", F.concat("best.path", F.array("node")).alias("path"))
        )
        step = cut(ready)
        if step.isEmpty():
            break
        placed = cut(placed.union(step))
    out = nodes.join(placed, "node", "left").select(
        "node",
        F.when(F.col("path").isNull(), "").otherwise(F.element_at("path", 1)).alias("root"),
        F.when(F.col("path").isNull(), -1).otherwise(F.size("path") - 1).cast("int").alias("depth"),
        F.coalesce("path", F.array().cast("array<string>")).alias("path"),
    )
    if not counts:
        return out
    pairs = _below_levels(links)
    count = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    unplaced = links.join(placed.select(F.col("node").alias("child")), "child", "left_anti").where("parent >= child")
    closing = (
        unplaced.where("parent > child")
        .join(pairs.select(F.col("node").alias("child"), F.col("descendant").alias("parent")), ["parent", "child"], "left_semi")
        .select("parent", "child").union(unplaced.where("parent = child").select("parent", "child"))
        .groupBy(F.col("child").alias("node")).agg(F.sort_array(F.collect_list("parent")).alias("back"))
    )
    return out.join(count, "node", "left").join(closing, "node", "left").select(
        "node", "root", "depth", "path",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"),
        F.coalesce("back", F.array().cast("array<string>")).alias("back_edges"),
    )


def _pieces(edges: DataFrame, parent: str, child: str, max_links: int, small_group: int) -> tuple[DataFrame, DataFrame | None]:
    """The links of components for one task, with their group ``_g``, and those of larger ones if there are any."""
    links = cut(
        edges.select(F.col(parent).alias("parent"), F.col(child).alias("child"))
        .where("parent <> '' and child <> ''").distinct()
    )
    comps = connected_components(links, "parent", "child")
    tagged = cut(links.join(comps.withColumnRenamed("node", "parent"), "parent"))
    sizes = tagged.groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    big = sizes.where(F.col("links") > max_links).select("component")
    total = tagged.count()
    groups = max(1, total // small_group + 1)
    small = tagged.join(sizes.where(F.col("links") <= max_links).select("component"), "component")
    small = small.withColumn("_g", F.pmod(F.xxhash64("component"), F.lit(groups)))
    return small, None if big.isEmpty() else tagged.join(big, "component", "left_semi").select("parent", "child")


def _below_levels(links: DataFrame) -> DataFrame:
    """``BELOW_SCHEMA`` for pieces beyond one task: one join per level; a pair is kept where it is first met."""
    links = cut(links)
    step = cut(links.where("parent <> child").select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")))
    met = step
    while not step.isEmpty():
        step = cut(
            step.join(links.withColumnRenamed("parent", "descendant"), "descendant")
            .select("node", F.col("child").alias("descendant"), (F.col("distance") + 1).alias("distance"))
            .where("node <> descendant").distinct().join(met.select("node", "descendant"), ["node", "descendant"], "left_anti")
        )
        met = met.union(step)
    return met


def hierarchies(edges: DataFrame, parent: str, child: str, max_links: int = 1_000_000,
                small_group: int = 20_000, counts: bool = True) -> DataFrame:
    """Path, depth, root, number of descendants and closing back edges of every node of the links.

    Null or empty ends and repeated links are dropped; other columns of ``edges`` don't matter. Components
    of up to ``max_links`` links are each walked in one task; small ones share groups of about
    ``small_group`` links, so there are not more Python calls than needed. Larger ones are walked level
    by level over the cluster, with the same results. Without ``counts`` there are no ``n_descendants`` and
    ``back_edges``, which take all pairs there. No links give no rows.
    """
    small, large = _pieces(edges, parent, child, max_links, small_group)
    out = small.groupBy("_g").applyInPandas(lambda pdf: _walk(pdf), NODE_SCHEMA)
    if not counts:
        out = out.drop("n_descendants", "back_edges")
    if large is not None:
        out = out.unionByName(_walk_levels(large, counts))
    return out


def below(edges: DataFrame, parent: str, child: str, max_links: int = 1_000_000, small_group: int = 20_000) -> DataFrame:
    """``(node, descendant, distance)``: every node with every other node below it, once, by the fewest links.

    This follows all links, so it also has the nodes in circles and below them, and those with several
    parents under all their ancestors. Pieces are split as in ``hierarchies``.
    """
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        children: dict[str, list[str]] = {}
        for pdf in batches:
            for p, c in zip(pdf["parent"], pdf["child"], strict=True):
                children.setdefault(p, []).append(c)
        rows: list[tuple[str, str, int]] = []
        for node in children:
            for d, n in _reach(node, children).items():
                rows.append((node, d, n))
                if len(rows) == BATCH:
                    yield pd.DataFrame(rows, columns=["node", "descendant", "distance"])
                    rows = []
        yield pd.DataFrame(rows, columns=["node", "descendant", "distance"])

    small, large = _pieces(edges, parent, child, max_links, small_group)
    out = small.groupBy("_g").applyInPandas(walk, BELOW_SCHEMA)
    return out if large is None else out.unionByName(_below_levels(large))


def descendants(nodes: DataFrame) -> DataFrame:
    """``(node, descendant, distance)``: the nodes on the path of every node; ``below`` follows all links."""
    return (
        nodes.select(F.col("node").alias("descendant"), F.posexplode("path").alias("pos", "node"), "depth")
        .where("pos < depth").select("node", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
