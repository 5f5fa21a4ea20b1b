"""Best-fit packing of token pieces into fixed-length sequences.

The lengths' histogram (at most ``capacity`` rows, whatever the input) is solved on the driver as a configuration
linear program by multiplicative weights: prices on lengths, an unbounded-knapsack dynamic program that finds the
dearest configuration, and a multiplicative cut of the prices of what it covers.  The fractional solution is
rounded down, the remainder is solved again, and the last few pieces go best-fit.  Spark then ranks the pieces
within their length in two levels and each piece reads its place from the plan.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.bpe import byte_alphabet
from loomseq.llm.common import map_pandas

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def encoder(path: str):
    """A function text -> ids (numpy uint32) of the byte-level tokenizer file at ``path``.

    Where the file's ids follow its merge order, they are ranks and the faster rank encoder gives the same ids;
    any other file goes through the tokenizers library.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = spec["normalizer"] is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
    if plain and [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges))) and len(vocab) == 256 + len(merges):
        import public_tokenizers
        import tiktoken

        byte = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        allowed = frozenset(special)
        return lambda text: enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: ids by the tokenizer file at ``path`` plus a closing id 0; null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                ids = np.append(encode(t or ""), np.uint32(0)).astype("<u4")
                rows += [(d, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut_points(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_pandas(docs.select("doc_id", "text"), run, PIECES)


def dearest(prices: np.ndarray, lengths: np.ndarray, capacity: int, many: int) -> list[dict[int, int]]:
    """The dearest configurations, by an unbounded knapsack over the lengths (ascending).

    One table of the dynamic program gives, for every length, the dearest configuration that holds it; the
    ``many`` best of those are returned.
    """
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        v = best[c - lengths[: upto[c]]] + prices[: upto[c]]
        k = int(v.argmax())
        best[c], take[c] = v[k], k
    holding = prices + best[capacity - lengths]
    out = {}
    for first in np.argsort(-holding, kind="stable")[:many]:
        config = {int(first): 1}
        c = capacity - int(lengths[first])
        while c >= lengths[0]:
            k = int(take[c])
            config[k] = config.get(k, 0) + 1
            c -= int(lengths[k])
        out[tuple(sorted(config.items()))] = config
    return list(out.values())


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, steps: int, eps: float, close: float = 1.001) -> tuple[dict[tuple, float], float]:
    """Multiplicative weights for the covering program: (configuration -> amount, scaled to the demanded volume; lower bound).

    Prices divided by the value of the dearest configuration are a solution of the dual, so what the demand is worth
    at them is a lower bound on the sequences; the best one of all steps is kept, and the search ends ``close`` to it.
    """
    prices = lengths / capacity
    amount: dict[tuple, float] = {}
    volume = float((lengths * demand).sum())
    made = total = bound = 0.0
    for _ in range(steps):
        configs = dearest(prices, lengths, capacity, max(1, len(lengths) // 16))
        bound = max(bound, float((prices * demand).sum()) / max(sum(m * prices[k] for k, m in c.items()) for c in configs))
        cover = np.zeros(len(lengths))
        for config in configs:
            step = min(demand[k] / m for k, m in config.items()) / 4
            key = tuple(sorted(config.items()))
            amount[key] = amount.get(key, 0) + step
            total += step
            for k, m in config.items():
                cover[k] += step * m
                made += step * m * lengths[k]
        prices *= np.exp(-eps * np.minimum(cover / demand, 8))
        prices /= prices.max()
        if total * volume / made <= close * bound and len(amount) >= len(lengths):
            break
    return {c: a * volume / made for c, a in amount.items()}, bound


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Best-fit decreasing of single pieces; for the bounded remainder after rounding."""
    space: list[tuple[int, int]] = []
    bins: list[dict[int, int]] = []
    for k in range(len(lengths) - 1, -1, -1):
        n = int(lengths[k])
        for _ in range(int(demand[k])):
            i = bisect.bisect_left(space, (n, -1))
            if i < len(space):
                room, b = space.pop(i)
            else:
                room, b = capacity, len(bins)
                bins.append({})
            bins[b][k] = bins[b].get(k, 0) + 1
            if room - n:
                bisect.insort(space, (room - n, b))
    return bins


def plan_bins(hist: dict[int, int], capacity: int = CAPACITY, steps: int = 100, eps: float = 0.5) -> list[tuple[dict[int, int], int]]:
    """[(configuration: length -> pieces, sequences made so)] that covers the histogram exactly: the better of two roundings."""
    return min((rounded(hist, capacity, steps, eps, up) for up in (True, False)), key=lambda plan: sum(n for _, n in plan))


def rounded(hist: dict[int, int], capacity: int, steps: int, eps: float, up: bool) -> list[tuple[dict[int, int], int]]:
    """A plan from the program's solution, rounded down and, with ``up``, up again where that fills a sequence well.

    The program is solved and rounded, whatever the histogram's size: amounts are cut to whole numbers, then
    full configurations are added, those of the longest pieces first, as long as their pieces are there.  What rounding leaves, at most a few
    pieces per configuration met, is solved again while that places a fifth of it, and then goes best-fit.
    """
    plan: list[tuple[dict[int, int], int]] = []
    left = {n: c for n, c in hist.items() if c > 0}
    if left.get(capacity):
        plan.append(({capacity: 1}, left.pop(capacity)))
    while left:
        lengths = np.array(sorted(left))
        demand = np.array([left[n] for n in lengths], dtype=np.int64)
        before = int(demand.sum())
        amounts, _ = fractional(lengths, demand.astype(float), capacity, steps, eps)

        def take(config: tuple, most: float) -> None:
            count = min(int(most), min(int(demand[k]) // m for k, m in config))
            if count > 0:
                plan.append(({int(lengths[k]): m for k, m in config}, count))
                for k, m in config:
                    demand[k] -= m * count

        for config, x in sorted(amounts.items(), key=lambda c: -c[1]):
            take(config, x)
        # remainders: configurations of the longest pieces come first, as those are the hardest to place, the fullest before others
        size = lambda c: sum(m * int(lengths[k]) for k, m in c)
        for config in sorted(amounts if up else (), key=lambda c: (-c[-1][0], -size(c), -(amounts[c] % 1))):
            if size(config) >= 0.98 * capacity:
                take(config, 1)
        left = {int(n): int(c) for n, c in zip(lengths, demand) if c}
        if sum(left.values()) > 0.8 * before:
            break
    if left:
        lengths = np.array(sorted(left))
        demand = np.array([left[n] for n in lengths])
        plan += [({int(lengths[k]): m for k, m in b.items()}, 1) for b in best_fit(lengths, demand, capacity)]
    return plan


def place_table(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length, runs of ranks: where they start, pieces per sequence, first sequence, offset of the first."""
    rows, used, seq = [], {}, 0
    for config, count in plan:
        offset = 0
        for n, m in sorted(config.items(), reverse=True):
            first = used.get(n, 0)
            rows.append((n, first, m, seq, offset))
            used[n] = first + m * count
            offset += n * m
        seq += count
    out = pd.DataFrame(rows, columns=["length", "first", "per", "seq", "offset"]).sort_values(["length", "first"])
    return out.astype("int64").reset_index(drop=True)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) plus ``sequence_id`` and ``offset``.

    Every piece is placed exactly once and a sequence is filled without gaps.  Ties between pieces of one length
    go by (doc_id, piece).  The rank of a piece is counted within (length, bucket) and moved by the counts of
    earlier buckets, so one length with most of the rows is no single task.  No rows give no rows.
    """
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = place_table(plan_bins(hist, capacity))
    buckets = max(1, -(-sum(hist.values()) // bucket_rows))
    b = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = b.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    moved = counts.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    ranked = b.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(moved, ["length", "_b"]).withColumn("_rank", F.col("_r") + F.col("_before")).drop("_b", "_r", "_before")
    wide = 1 << 44

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = places["length"].to_numpy() * wide + places["first"].to_numpy()
        first, per, seq, off = (places[c].to_numpy() for c in ("first", "per", "seq", "offset"))
        for x in batches:
            n, rank = x["length"].to_numpy(), x.pop("_rank").to_numpy()
            at = np.searchsorted(keys, n * wide + rank, side="right") - 1
            k = rank - first[at]
            x["sequence_id"] = seq[at] + k // per[at]
            x["offset"] = off[at] + (k % per[at]) * n
            yield x[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return map_pandas(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank"), run, f"{PIECES}, sequence_id long, offset long")
