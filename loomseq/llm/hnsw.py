"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards; each shard gets its own graph and every vector of the label queries
every shard of it.  Beams are widened until an audit against brute force passes; found pairs are verified by
cosine in double precision; links are united into components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import connected_components, cut
from loomseq.llm.topk import usable


class Hnsw:
    """A graph over the unit rows of ``x``: sparse upper layers to approach, a dense lowest layer to gather."""

    def __init__(self, x: np.ndarray, links: int = 16, beam: int = 48, seed: int = 3, batch: int = 256):
        self.x, self.links, self.beam, self.batch = np.ascontiguousarray(x, dtype=np.float32), links, beam, batch
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(len(x)) + 1e-12) / np.log(links)).astype(int), 8)
        order = rng.permutation(len(x))
        self.layers: list[np.ndarray] = []
        for depth in range(int(level.max(initial=0)), -1, -1):
            self.layers.append(np.full((len(x), 2 * links), -1, dtype=np.int32))
            self._build(order[level[order] >= depth])
        self.entry = order[level[order] == level.max(initial=0)][:1]

    def _build(self, nodes: np.ndarray) -> None:
        graph, size = self.layers[-1], self.batch
        done = nodes[: min(size, len(nodes))]
        self._connect(graph, done, done, np.where(np.eye(len(done), dtype=bool), -2, self.x[done] @ self.x[done].T))
        at = len(done)
        while at < len(nodes):
            new = nodes[at : at + size]
            start = self._approach(self.x[new], nodes[:1], len(self.layers) - 1)
            ids, sims = self._walk(graph, self.x[new], start, self.beam)[:2]
            own = np.where(np.eye(len(new), dtype=bool), -2, self.x[new] @ self.x[new].T)
            take = min(self.links, len(new))
            near = np.argpartition(-own, take - 1, axis=1)[:, :take]
            ids = np.concatenate([ids, new[near]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, near, 1)], axis=1)
            self._connect(graph, new, ids, sims)
            at += len(new)

    def _connect(self, graph: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Link each node to its nearest candidates and to a few spread ones, both ways, within the degree bound."""
        for i, node in enumerate(nodes.tolist()):
            cand = ids if ids.ndim == 1 else ids[i]
            order = np.argsort(-sims[i], kind="stable")
            order = order[(sims[i][order] > -1.5) & (cand[order] >= 0)][: 3 * self.links]
            chosen = self._spread(node, cand[order])
            graph[node, : len(chosen)] = chosen
            for c in chosen.tolist():
                row = graph[c]
                free = np.nonzero(row < 0)[0]
                if node in row:
                    continue
                if len(free):
                    row[free[0]] = node
                else:
                    all_ = np.append(row, node)
                    all_ = all_[np.argsort(-(self.x[all_] @ self.x[c]), kind="stable")]
                    kept = self._spread(c, all_)
                    row[:] = -1
                    row[: len(kept)] = kept

    def _spread(self, node: int, cand: np.ndarray) -> np.ndarray:
        """Of candidates by falling similarity, those nearer to the node than to any chosen before; then the nearest others."""
        if len(cand) <= self.links:
            return cand
        sim, between = self.x[cand] @ self.x[node], self.x[cand] @ self.x[cand].T
        chosen: list[int] = []
        for i in range(len(cand)):
            if len(chosen) >= self.links:
                break
            if not chosen or between[i, chosen].max() < sim[i]:
                chosen.append(i)
        rest = [i for i in range(len(cand)) if i not in chosen][: self.links - len(chosen)]
        return cand[chosen + rest]

    def _approach(self, q: np.ndarray, fallback: np.ndarray, upto: int) -> np.ndarray:
        """An entry point per query: greedy walks through the layers above ``upto``."""
        at = np.repeat(fallback if upto == 0 else self.top(), len(q))[:, None]
        for graph in self.layers[:upto]:
            at = self._walk(graph, q, at, 1)[0]
        return np.concatenate([at, np.repeat(fallback, len(q))[:, None]], axis=1) if upto else at

    def top(self) -> np.ndarray:
        linked = np.nonzero((self.layers[0] >= 0).any(axis=1))[0]
        return linked[:1] if len(linked) else np.zeros(1, dtype=int)

    def _walk(self, graph: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int, expand: int = 4):
        """Beam search of all queries in step: (ids, sims, seen) with the ``beam`` nearest met, best first."""
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.x)), dtype=bool)
        width = max(beam, start.shape[1])
        ids = np.full((n, width), -1, dtype=np.int64)
        sims = np.full((n, width), -2.0, dtype=np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("bmd,bd->bm", self.x[start], q)
        for c in range(1, start.shape[1]):
            twin = (start[:, :c] == start[:, c : c + 1]).any(axis=1)
            sims[twin, c], ids[twin, c] = -2.0, -1
        seen[rows, start] = True
        opened = ids < 0
        live = np.arange(n)
        while len(live):
            s = np.where(opened[live], -3.0, sims[live])
            take = min(expand, width)
            pick = np.argpartition(-s, take - 1, axis=1)[:, :take] if width > take else np.broadcast_to(np.arange(width), s.shape)
            fresh = np.take_along_axis(s, pick, 1) > -1.9
            going = fresh.any(axis=1)
            live, pick, fresh = live[going], pick[going], fresh[going]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            nb = np.where(fresh[:, :, None], graph[ids[live[:, None], pick]], -1).reshape(len(live), -1)
            nb.sort(axis=1)
            bad = (nb < 0) | seen[live[:, None], nb]
            bad[:, 1:] |= nb[:, 1:] == nb[:, :-1]
            ns = np.where(bad, -2.0, np.einsum("bmd,bd->bm", self.x[nb], q[live]))
            seen[live[:, None], np.where(bad, ids[live, :1], nb)] = True
            ids_, sims_ = np.concatenate([ids[live], np.where(bad, -1, nb)], 1), np.concatenate([sims[live], ns], 1)
            open_ = np.concatenate([opened[live], bad], 1)
            best = np.argpartition(-sims_, width - 1, axis=1)[:, :width]
            ids[live], sims[live] = np.take_along_axis(ids_, best, 1), np.take_along_axis(sims_, best, 1)
            opened[live] = np.take_along_axis(open_, best, 1) | (ids[live] < 0)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), seen

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Boolean (queries x rows): rows found with a similarity of about ``least`` or more; every hit is followed on."""
        graph = self.layers[-1]
        start = self._approach(q, self.top() if len(self.layers) == 1 else self.entry, len(self.layers) - 1)
        ids, sims, seen = self._walk(graph, q, start, beam)
        slack = least - 1e-3
        hit = np.zeros(seen.shape, dtype=bool)
        b, c = np.nonzero((sims >= slack) & (ids >= 0))
        pairs = np.stack([b, ids[b, c]])
        hit[pairs[0], pairs[1]] = True
        while pairs.shape[1]:
            nb = graph[pairs[1]]
            b = np.repeat(pairs[0], nb.shape[1])
            code = np.unique((b * len(self.x) + nb.ravel())[nb.ravel() >= 0])
            b, c = np.divmod(code, len(self.x))
            new = ~hit[b, c]
            b, c = b[new], c[new]
            good = np.concatenate([np.einsum("ij,ij->i", self.x[c[i : i + 65536]], q[b[i : i + 65536]]) >= slack for i in range(0, len(b), 65536)]) if len(b) else np.zeros(0, bool)
            pairs = np.stack([b[good], c[good]])
            hit[pairs[0], pairs[1]] = True
        return hit


def link_group(shard_ids: np.ndarray, shard: np.ndarray, ids: np.ndarray, q: np.ndarray, least: float, audit: int = 32, goal: float = 0.99) -> list[tuple[int, int, int]]:
    """(id, links found here, local root) for the queries of one block against one shard.

    Only exact cosines of at least ``least`` count.  A block whose audited recall is below ``goal`` is searched
    again with a beam twice as wide, up to the whole shard.
    """
    unit = shard / np.sqrt((shard**2).sum(axis=1))[:, None]
    uq = q / np.sqrt((q**2).sum(axis=1))[:, None]
    graph = Hnsw(unit)
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    links: dict[int, int] = {}
    beam, step = 48, 256
    for at in range(0, len(uq), step):
        part, own = uq[at : at + step], ids[at : at + step]
        check = np.linspace(0, len(part) - 1, min(audit, len(part))).astype(int)
        truth = part[check] @ unit.T >= least
        while True:
            hit = graph.within(part.astype(np.float32), least, beam) if beam < len(unit) else np.ones((len(part), len(unit)), dtype=bool)
            if beam >= len(unit) or (hit[check] & truth).sum() >= goal * truth.sum():
                break
            beam *= 2
        for i in np.nonzero(hit.any(axis=1))[0].tolist():
            near = np.nonzero(hit[i])[0]
            near = near[unit[near] @ uq[at + i] >= least]
            others = shard_ids[near][shard_ids[near] != own[i]].tolist()
            if others:
                me = int(own[i])
                links[me] = links.get(me, 0) + len(others)
                a = find(me)
                for o in others:
                    b = find(o)
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        root[b] = a
    return [(v, links.get(v, 0), find(v)) for v in list(root)]


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard_rows: int = 4096, block_rows: int = 16_384) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector of ``vectors`` (vec_id, embedding, label).

    Vectors are compared only where labels are equal and not null.  A vector that is null, empty, zero or holds
    null or non-finite components links with nothing and is kept; lengths that differ are not compared.  Rows are told apart
    by a number of their own, so rows of one id are vectors like any others: each has its row and its links, equal ones link
    with each other.  A null id links with nothing and is returned with no component.  A label's vectors are spread over shards of a
    bounded size, so one label with a third of all rows is no single task.
    """
    # the numbers are written with the rows, so a task that runs again finds the same
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.monotonically_increasing_id().alias("row")), "vectors")
    good = rows.where(usable() & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        F.col("row").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")
    ).where(F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    sizes = good.groupBy("label", "dim").agg(F.count("*").alias("n"))
    split = sizes.select("label", "dim", F.ceil(F.col("n") / shard_rows).alias("shards"), F.ceil(F.col("n") / block_rows).alias("blocks"))
    dealt = good.join(split, ["label", "dim"])
    members = dealt.select("label", "dim", F.pmod(F.xxhash64("id"), "shards").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "v")
    asked = dealt.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "id"), "blocks").alias("block"), "id", "v")

    # new names for the second use of the same columns, so that the two sides of the cogroup stay apart
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            rows = link_group(left["id"].to_numpy(), np.stack(left["v"].to_list()), right["id"].to_numpy(), np.stack(right["v"].to_list()), least)
        return pd.DataFrame(rows, columns=["row", "n", "root"])

    key = ["label", "dim", "shard", "block"]
    found = cut(members.groupBy(key).cogroup(asked.groupBy(key)).applyInPandas(run, "row long, n long, root long"), "links")
    counts = found.groupBy("row").agg(F.sum("n").alias("n_links"))
    parts = connected_components(found, "row", "root").withColumnRenamed("node", "row")
    every = rows.select("row", "vec_id")
    lowest = parts.join(every, "row").groupBy("component").agg(F.min("vec_id").alias("low"))
    parts = parts.join(lowest, "component").select("row", F.col("low").alias("component"))
    out = every.join(counts, "row", "left").join(parts, "row", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
