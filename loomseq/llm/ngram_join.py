"""Similarity join on word n-grams by universe-partition pigeonhole.

A document is its set of distinct word n-grams (hashed to 64 bits).  Sizes are cut into bands so narrow that
documents that can link lie in one band or in neighbours.  For a band the universe of n-grams is hashed into
segments; two sets that link differ in at most H n-grams, so with thresholds that sum to more than H - (number of
segments), some segment differs by no more than its threshold.  A threshold of 0 indexes the segment's subset, 1
indexes it and its one-deletion neighbourhood, -1 leaves it out; a cost model on observed collisions allocates
them.  Documents that share an index entry form candidate groups, in which links are verified exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomseq.llm.common import connected_components, cut, map_pandas, release

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M3
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct n-gram hashes of whole texts; words are runs of bytes other than ASCII white space, A-Z lowered."""

    def __init__(self, n: int, cache_words: int = 150_000):
        self.n, self.cache_words = n, cache_words
        self.words: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        if len(known) >= self.cache_words:
            known.clear()
        n = min(self.n, len(codes))
        h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = mix(h * _M1 + codes[k : len(codes) - n + 1 + k])
        return np.unique(h)


class Bands:
    """Size bands, their worst difference H and number of segments for a Jaccard threshold of ``num``/``den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def _grow(self, upto: int) -> None:
        while self.starts[-1] <= upto:
            # the next band begins beyond the largest set that can link with this band's smallest
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * self.den // self.num + 1))

    def upto(self, size: int) -> list[int]:
        """The smallest sizes of the bands up to that of ``size``."""
        return self.starts[: self.band(size) + 1]

    def band(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def worst(self, band: int) -> int:
        """The most n-grams by which two linked sets of at most this band's largest size can differ."""
        while band + 1 >= len(self.starts):
            self._grow(self.starts[-1])
        top = self.starts[band + 1] - 1
        return 2 * top * (self.den - self.num) // (self.den + self.num)


def allocate(worst: int, segments: int, plain: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Thresholds (-1, 0 or 1) per segment with sum of (threshold + 1) > ``worst`` at the least estimated cost.

    ``plain`` and ``spread`` are the costs of thresholds 0 and 1; whichever step buys a unit most cheaply goes first.
    """
    t = np.full(segments, -1)
    need = worst + 1
    steps = [(plain[s], s, 0) for s in range(segments)] + [(max(plain[s], spread[s] - plain[s]), s, 1) for s in range(segments)]
    for _, s, to in sorted(steps):
        if need <= 0:
            break
        if t[s] == to - 1:
            t[s] = to
            need -= 1
    return t


class Index:
    """Index entries of a set under its own band's scheme and the next one's."""

    def __init__(self, bands: Bands, plans: dict[int, np.ndarray] | None = None):
        self.bands, self.plans = bands, plans or {}

    def segments(self, band: int) -> int:
        return self.bands.worst(band) + 1

    def parts(self, grams: np.ndarray, band: int):
        """(segment of each gram in segment order, mixed grams in that order, starts, segments met, sums)."""
        m = np.uint64(self.segments(band))
        seg = mix(grams ^ np.uint64(band + 1)) % m
        order = np.argsort(seg, kind="stable")
        seg, val = seg[order], mix(grams[order] + _M1)
        starts = np.nonzero(np.concatenate(([True], seg[1:] != seg[:-1])))[0]
        return seg, val, starts, seg[starts], np.add.reduceat(val, starts)

    def entries(self, grams: np.ndarray) -> np.ndarray:
        own = self.bands.band(len(grams))
        out = []
        for band in (own, own + 1):
            m = self.segments(band)
            seg, val, starts, met, sums = self.parts(grams, band)
            plan = self.plans.get(band)
            full = np.zeros(m, dtype=np.uint64)  # a segment that the set does not meet is the empty subset
            full[met.astype(np.int64)] = sums
            ids = np.arange(m, dtype=np.uint64)
            salt = np.uint64((band + 1) * int(_M1) & 0xFFFFFFFFFFFFFFFF)
            if plan is None:
                out.append(mix(full + mix(ids * _M3 + salt)))
                continue
            used = np.nonzero(plan >= 0)[0]
            out.append(mix(full[used] + mix(ids[used] * _M3 + salt)))
            soft = plan[seg.astype(np.int64)] == 1
            s = seg[soft]
            out.append(mix(full[s.astype(np.int64)] - val[soft] + mix(s * _M3 + salt)))
        return np.unique(np.concatenate(out))


def plan_bands(sample: DataFrame, sets: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], index: Index, most_segments: int = 64) -> dict[int, np.ndarray]:
    """Thresholds per band from collision counts on a sample; ``sets`` makes frames with ``grams`` of its rows.

    Only the cost of the search depends on this, never its result, so a sample is enough.  Bands of many segments
    keep threshold 0 throughout: their segments are alike and the pigeonhole needs each of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # in one worker with what makes the sets: a second one per task would stay in the executor's memory
        for b in sets(batches):
            rows = []
            for g in filter(len, b["grams"]):
                g = np.asarray(g, dtype=np.int64).view(np.uint64)
                own = index.bands.band(len(g))
                for band in (own, own + 1):
                    if 1 < index.segments(band) <= most_segments:
                        _, _, starts, met, sums = index.parts(g, band)
                        sizes = np.diff(np.append(starts, len(g)))
                        rows += [(band, int(s), int(v.view(np.int64)), int(n)) for s, v, n in zip(met, sums, sizes)]
            yield pd.DataFrame(rows, columns=["band", "seg", "val", "n"]).astype("int64")

    seen = map_pandas(sample, run, "band int, seg int, val long, n long").groupBy("band", "seg", "val").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    cost = seen.groupBy("band", "seg").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("hit"), F.avg("n").alias("n"), F.sum("c").alias("rows"))
    plans: dict[int, np.ndarray] = {}
    for band, g in cost.toPandas().groupby("band"):
        m = index.segments(int(band))
        plain, spread = np.ones(m), np.full(m, 10.0)
        plain[g["seg"]] = 1 + g["hit"] / g["rows"]
        spread[g["seg"]] = plain[g["seg"]] * (2 + g["n"])
        plans[int(band)] = allocate(index.bands.worst(int(band)), m, plain, spread)
    return plans


def linked(a: int, b: int, both: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


def link_sets(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, num: int, den: int) -> dict[int, int]:
    """Local union-find over one group: position -> root, after every link between rows that do not share a side.

    ``left`` tells rows of the first block from the second; within one block all pairs count (``left`` all true).
    Grams are ordered by rarity in the group; a pair that links shares one among the rarest of both, so only those
    are met.  Pairs already in one component need no check, which keeps groups of mutual copies linear.
    """
    n = len(sets)
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    _, codes, use = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(use), dtype=np.int64)
    rank[np.argsort(use, kind="stable")] = np.arange(len(use))
    codes = rank[codes]
    ends = np.cumsum([len(s) for s in sets])
    rows = [np.sort(codes[e - len(s) : e]) for s, e in zip(sets, ends)]
    split = not left.all()
    seen: dict[int, list[int]] = {}
    for i in np.argsort([len(s) for s in sets], kind="stable").tolist():
        r = rows[i]
        size = len(r)
        prefix = r[: size - -(-size * num // den) + 1].tolist()
        met: dict[int, None] = {}
        for c in prefix:
            for j in seen.get(c, ()):
                met[j] = None
        mine: set[int] | None = None
        for j in met:
            other = rows[j]
            if den * len(other) < num * size or (split and left[i] == left[j]) or find(i) == find(j):
                continue
            if mine is None:
                mine = set(r.tolist())
            if linked(size, len(other), sum(map(mine.__contains__, other.tolist())), num, den):
                root[find(i)] = find(j)
        for c in prefix:
            seen.setdefault(c, []).append(i)
    return {i: find(i) for i in range(n)}


#: Numbers of blocks of one size band, of which there are fewer.
_BLOCKS = 1 << 20


def deal_blocks(members: DataFrame, bands: Bands, block_rows: int) -> DataFrame:
    """(node, grp, at, x, y): the blocks ``x`` and ``y`` that meet in one task, one of them (``at``) the row's own.

    ``members`` holds (node, grp, n_shingles).  A group of up to ``block_rows`` rows is one block.  A larger one is cut by size
    band, and a band by hash into blocks of about that many rows; a block meets those of its own band and of the two
    beside it, as sets that link are no further apart.  So a row goes to the blocks of sizes like its own, not to all.
    """
    top = members.agg(F.max("n_shingles")).head()[0] or 1
    starts = F.lit([s for s in bands.upto(top)])
    band = (F.size(F.filter(starts, lambda s: s <= F.col("n_shingles"))) - 1).cast("long")
    large = members.groupBy("grp").agg((F.count("*") > block_rows).alias("large"))
    placed = members.join(large, "grp").select("node", "grp", F.when(F.col("large"), band).otherwise(F.lit(0).cast("long")).alias("band")).distinct()
    counts = placed.groupBy("grp", "band").agg(F.ceil(F.count("*") / block_rows).cast("long").alias("k"))
    beside = lambda step, name: counts.select("grp", (F.col("band") - step).alias("band"), F.col("k").alias(name))
    counts = counts.join(beside(1, "_next"), ["grp", "band"], "left").join(beside(-1, "_last"), ["grp", "band"], "left")
    blocks = lambda k, step: F.when(F.col(k) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), lambda o: (F.col("band") + step) * _BLOCKS + o)).otherwise(F.array().cast("array<long>"))
    at = F.col("band") * _BLOCKS + F.pmod(F.xxhash64("node"), F.col("k"))
    met = F.concat(blocks("k", 0), blocks("_next", 1), blocks("_last", -1))
    dealt = placed.join(counts, ["grp", "band"]).select("node", "grp", at.alias("at"), F.explode(met).alias("o"))
    return dealt.select("node", "grp", "at", F.least("at", "o").alias("x"), F.greatest("at", "o").alias("y"))


def may_link(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(s1, s2, n_shingles, node) of the different sets of ``sets`` that can link with another one.

    ``sets`` holds (doc_id, n_shingles, s1, s2, grams), ``grams`` being any part of each set that a hash of the n-gram decides.
    Of a set that links, at most n - ceil(n * num / den) n-grams are missing in the other one; a set with more n-grams that
    no other set has links with nothing.  Counting them in a part of the n-grams leaves sets in, but never one out.
    """
    lone = sets.select("s1", F.explode("grams").alias("gram")).groupBy("gram").agg(F.min("s1").alias("s1"), F.max("s1").alias("other"))
    lone = lone.where("s1 = other").groupBy("s1").agg(F.count("*").alias("lone"))
    nodes = sets.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("node"))
    missing = F.col("n_shingles") - F.expr(f"(n_shingles * {num} + {den - 1}) div {den}")
    return nodes.join(lone, "s1", "left").where(F.coalesce("lone", F.lit(0)) <= missing).select("s1", "s2", "n_shingles", "node")


def link_documents(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, block_rows: int = 1_000, sample: float = 1 / 16, thin: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Documents link where den * intersection >= num * union of their sets of distinct ``n``-word shingles (fewer
    words: the whole sequence is one shingle).  A text without words and a null text have the empty set and link
    with nothing.  ``component_id`` is the smallest doc_id reachable by links; a row with a null doc_id links with nothing and has no component.
    Rows of one id are one node, whatever their texts: each keeps its own ``n_shingles``, and all share the component.
    Sets are compared by 64-bit hashes of their shingles.
    Sets that are equal are joined before anything else and count as one below.  With ``thin``, sets with too many shingles
    of their own go next (``may_link``) and only the others are indexed, which pays where shingles are long: the result
    is the same.  A candidate group larger than ``block_rows`` is verified block against block of like sizes in separate tasks.
    """
    bands = Bands(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a part of the shingles, of which a set of shingles of its own has twice as many as may be missing
    part = np.uint64(max(1, den // (2 * (den - num)) if num < den else den))

    def sketch(batches: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for b in batches:
            for at in range(0, len(b), 1_000):  # few documents at a time, so that a worker stays small
                rows = []
                for d, t in zip(b["doc_id"][at : at + 1_000], b["text"][at : at + 1_000]):
                    g = shingler.of(t)
                    if not len(g):
                        rows.append((d, 0, 0, 0, []))
                        continue
                    s = int(np.bitwise_xor.reduce(mix(g + _M2)).view(np.int64)), int(mix(g + _M3).sum().view(np.int64))
                    rows.append((d, len(g), *s, of(g).view(np.int64)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "grams"])

    shape = "doc_id long, n_shingles long, s1 long, s2 long, grams array<long>"

    def planned(rows: DataFrame) -> Index:
        some = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(round(1 / sample))) == 0)
        return Index(bands, plan_bands(some, lambda b: sketch(b, lambda g: g), Index(bands)))

    index = None if thin else planned(docs)
    sets = cut(map_pandas(docs, lambda b: sketch(b, index.entries if index else lambda g: g[g % part == 0]), shape), "sets", 1_000 if thin else None)

    # equal sets are one node from here on: its smallest id; in the index they go by their hash, so no id is joined on
    whole = sets.where("n_shingles > 0 and doc_id is not null")
    nodes = whole.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("node"))
    of = cut(sets.select("doc_id", "n_shingles", "s1", "s2").join(nodes, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", "s1", "node"), "nodes")

    # repeated texts of one id go before the texts are shipped, by the partitioning that the join needs anyway
    texts = docs.select(F.col("doc_id").alias("node"), "text", F.xxhash64("text").alias("_t")).repartition("node").dropDuplicates(["node", "_t"])
    indexed, made = whole, [sets]
    if thin:
        left = cut(may_link(whole, num, den), "left")
        release(docs.sparkSession, sets)
        texts = cut(texts.hint("merge").join(left.select("node").distinct(), "node"), "texts")
        again = texts.select(F.col("node").alias("doc_id"), "text")
        index = planned(again)
        entries = cut(map_pandas(again, lambda b: sketch(b, index.entries), shape), "entries", 1_000)
        indexed, made = entries.join(left, ["s1", "s2", "n_shingles"], "left_semi"), [left, entries]

    # entries that two different sets share tie both to the smallest, which gives the candidate groups; the join is
    # a merge join at every size, whose hot keys AQE splits
    own = indexed.select("s1", F.explode("grams").alias("entry"))
    shared = own.groupBy("entry").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low <> high").select("entry", "low")
    ties = own.hint("merge").join(shared, "entry").where("s1 <> low").select("s1", "low").distinct()
    found = connected_components(ties, "s1", "low").select(F.col("node").alias("s1"), F.col("component").alias("grp"))
    groups = cut(of.where("doc_id = node").select("s1", "node", "n_shingles").join(found, "s1").select("node", "grp", "n_shingles"), "groups")
    release(docs.sparkSession, *made)

    work = deal_blocks(groups, bands, block_rows).join(texts.hint("merge"), "node")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        shingler = Shingler(n)
        ids = pdf["node"].to_numpy()
        first = (pdf["at"] == pdf["x"]).to_numpy()
        root = link_sets(ids, [shingler.of(t) for t in pdf["text"]], first, num, den)
        low: dict[int, int] = {}
        for i, r in root.items():
            low[r] = min(low.get(r, ids[i]), ids[i])
        pairs = [(int(ids[i]), int(low[r])) for i, r in root.items() if ids[i] != low[r]]
        return pd.DataFrame(pairs, columns=["node", "low"]).astype("int64")

    links = cut(work.groupBy("grp", "x", "y").applyInPandas(verify, "node long, low long"), "pairs")
    parts = connected_components(links, "node", "low")
    release(docs.sparkSession, groups, links, texts)
    out = of.join(parts, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
