"""Exact top-k inner-product search with cover trees on both sides.

Candidates are dealt into shards and queries into blocks by hash; every (shard, block) pair is one group.  Inside
a group both sides are put in cover trees that are descended together: a pair of nodes is dropped when the bound from
their centres and covering radii is below the worst k-th score of the query node's group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Children of at most this many points are held together in leaves by place.
TINY = 4


class CoverNode:
    """Points within ``radius`` of ``center``; children lie within half of it, around points that far apart.

    Children of a few points each become leaves by place.  ``floor`` is used on the query side: the worst k-th score of the node's queries.
    """

    __slots__ = ("center", "norm", "radius", "points", "children", "parent", "floor", "centers", "norms", "radii")

    def __init__(self, x: np.ndarray, points: np.ndarray, center: np.ndarray, parent: CoverNode | None):
        self.center, self.points, self.parent = center, points, parent
        self.norm = float(np.sqrt((center**2).sum()))
        self.radius = float(distances(x[points], center).max())
        self.children: list[CoverNode] = []
        self.floor = -np.inf

    def close(self) -> None:
        """Arrays of the children's balls, for bounds of all of them at once."""
        self.centers = np.stack([c.center for c in self.children])
        self.norms = np.array([c.norm for c in self.children])
        self.radii = np.array([c.radius for c in self.children])


def distances(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - center) ** 2).sum(axis=1))


def by_place(x: np.ndarray, points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Points in parts of at most ``leaf``, cut in half along the line to the farthest point."""
    todo, parts = [points], []
    while todo:
        p = todo.pop()
        if len(p) <= leaf:
            parts.append(p)
            continue
        far = x[p[distances(x[p], x[p[0]]).argmax()]]
        order = p[np.argsort(x[p] @ (far - x[p[0]]), kind="stable")]
        todo += [order[: len(p) // 2], order[len(p) // 2 :]]
    return parts


def cover_tree(x: np.ndarray, leaf: int) -> CoverNode:
    root = CoverNode(x, np.arange(len(x)), x[0], None)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.points) <= leaf or node.radius == 0:
            continue
        rest, few = node.points, []
        center = node.center
        while len(rest):
            inside = distances(x[rest], center) <= node.radius / 2
            part, rest = rest[inside], rest[~inside]
            if len(part) > TINY:
                node.children.append(CoverNode(x, part, center, node))
            else:
                few.append(part)
            center = x[rest[0]] if len(rest) else center
        todo += node.children
        if few:
            node.children += [CoverNode(x, p, x[p].mean(axis=0), node) for p in by_place(x, np.concatenate(few), leaf) if len(p)]
        node.close()
    return root


class Best:
    """The k best (score, id) of each query; equal scores go to the smaller id."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in own]
        self.floor = np.full(len(own), -np.inf)

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: list[np.ndarray]) -> None:
        least = self.floor[queries]
        if scores.shape[1] > self.k + 1:
            # each column has a candidate, and a query is itself at most one of them
            least = np.maximum(least, np.partition(scores, -(self.k + 1), axis=1)[:, -(self.k + 1)])
        for i, j in zip(*np.nonzero(scores >= least[:, None])):
            q, s = queries[i], int(scores[i, j])
            if s < self.floor[q]:
                continue
            row = self.rows[q]
            row += [(-s, int(v)) for v in ids[j] if v != self.own[q]]
            row.sort()
            del row[self.k :]
            if len(row) == self.k:
                self.floor[q] = -row[-1][0]


def highest(q: CoverNode, center, norm, radius):
    """The most that a query of ``q`` can score with a point of a ball, or of several balls."""
    slack = 1e-9 * (q.norm + q.radius) * (norm + radius) + 1e-6
    return center @ q.center + q.norm * radius + norm * q.radius + radius * q.radius + slack


def search_group(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, leaf: int = 48, seen: dict | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates of each query within one group.

    Pairs of a query node and a candidate node wait on one heap by their highest possible score.  A pair goes when
    that is under the query node's floor; two leaves are scored, and floors rise to the root; otherwise the wider node
    of the two is opened.  ``seen`` takes the numbers of pairs met, dropped and scored.
    """
    order = np.argsort(ids, kind="stable")
    where: dict[bytes, int] = {}
    same: list[list[int]] = []
    first = []
    for i in order.tolist():
        at = where.setdefault(x[i].tobytes(), len(same))
        if at == len(same):
            same.append([])
            first.append(i)
        # of equal vectors only the k smallest ids other than the query itself can be among its best
        if len(same[at]) <= k and (not same[at] or same[at][-1] != ids[i]):
            same[at].append(int(ids[i]))
    ux = x[first]
    members = [np.array(s) for s in same]
    asked, held = cover_tree(q, leaf), cover_tree(ux, leaf)
    best = Best(query_ids, k)
    met = dropped = scored = 0
    heap: list[tuple[float, int, CoverNode, CoverNode]] = [(-np.inf, 0, asked, held)]
    tick = 0
    while heap:
        top, _, a, b = heapq.heappop(heap)
        met += 1
        if -top < a.floor:
            dropped += 1
            continue
        if not a.children and not b.children:
            scored += 1
            best.add(a.points, q[a.points] @ ux[b.points].T, [members[p] for p in b.points])
            a.floor = best.floor[a.points].min()
            up = a.parent
            while up is not None:
                low = min(c.floor for c in up.children)
                if low <= up.floor:
                    break
                up.floor, up = low, up.parent
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            bounds = highest(a, b.centers, b.norms, b.radii)
            pairs = [(bounds[j], a, b.children[j]) for j in np.nonzero(bounds >= a.floor)[0]]
            dropped += len(b.children) - len(pairs)
        else:
            bounds = highest(b, a.centers, a.norms, a.radii)
            pairs = [(u, c, b) for u, c in zip(bounds, a.children) if u >= c.floor]
            dropped += len(a.children) - len(pairs)
        for u, c, d in pairs:
            tick += 1
            heapq.heappush(heap, (-float(u), tick, c, d))
    if seen is not None:
        seen.update(met=met, dropped=dropped, scored=scored)
    return [(int(best.own[i]), v, -s) for i, row in enumerate(best.rows) for s, v in row]


def usable(vector: str = "embedding") -> Column:
    """Vectors that are neither null nor empty and hold only finite numbers."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = 4096, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best other rows by integer inner product.

    Components are floor(256 * x) of the component as double.  Rows with a null id, or a vector that is null,
    empty or holds null or non-finite components, take no part; vectors of different lengths are not compared; an
    id that repeats counts once.  Ties go to the smaller id.  Fewer than ``k`` candidates give fewer rows.
    Shards and blocks have a fixed mean size, so a task's memory does not grow with the input.
    """
    good = vectors.where(usable(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"), is_query.alias("is_query")
    )
    sizes = good.select(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_query").cast("long")), F.lit(0)).alias("q")).head()
    shards, blocks = -(-sizes["n"] // shard_rows) or 1, -(-sizes["q"] // block_rows) or 1
    cands = good.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    asked = good.where("is_query").select(F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    # new names for the second use of the same columns, so that the two sides of the cogroup stay apart
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            right = right.drop_duplicates("id")
            rows = search_group(left["id"].to_numpy(), np.stack(left["v"].to_list()), right["id"].to_numpy(), np.stack(right["v"].to_list()), k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    key = ["dim", "shard", "block"]
    found = cands.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
