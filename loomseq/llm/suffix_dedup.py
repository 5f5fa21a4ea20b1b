"""Removal of repeated 100-byte strings with sorted suffixes.

Repeats are found without shipping texts: every 100-byte string contains an anchor, a locally smallest hash of 32
bytes that depends on the string alone, so equal strings share it.  Anchors that occur once end there.  The
stretches of text around the others are made distinct with their first place, dealt by anchor, and their suffixes
sorted: multikey quicksort to a shallow depth of 32 bytes, then blind tries order what is still tied to full depth.
Equal suffixes form a class whose first place stays; every other place is removed.  Strings of an anchor that very
many documents have are not gathered: they meet one by one, by a 128-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomseq.llm.common import cut, map_pandas
from loomseq.llm.ngram_join import mix

SPAN, GRAM, SHALLOW = 100, 32, 32
_BYTE = np.random.default_rng(11).integers(0, 2**63, 256, dtype=np.int64).view(np.uint64)
_STEP = tuple(np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position, by doubling."""
    h, k = _BYTE[data], 1
    for step in _STEP:
        h = h[:-k] * step + h[k:]
        h ^= h >> np.uint64(29)
        k *= 2
    return mix(h)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width``."""
    k = 1
    while 2 * k <= width:
        a = pick(a[:-k], a[k:])
        k *= 2
    return pick(a[: len(a) - (width - k)], a[width - k :]) if width > k else a


class Anchors:
    """Anchor positions of a text and, for each 100-byte string, the anchor it belongs to."""

    def __init__(self, data: np.ndarray):
        self.h = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        if len(data) < SPAN:
            return
        width = SPAN - GRAM + 1
        self.h = gram_hashes(data)
        self.least = sliding(self.h, width, np.minimum)
        # a position is an anchor if some window has its hash as minimum: the largest minimum around it equals it
        pad = np.zeros(width - 1, np.uint64)
        most = sliding(np.concatenate([pad, self.least, pad]), width, np.maximum)
        self.at = np.nonzero(most == self.h)[0]

    def runs(self, wanted: np.ndarray) -> list[tuple[int, int, int]]:
        """(anchor, first start, number of starts) of the strings whose anchor has a wanted hash."""
        if not len(self.at):
            return []
        width = SPAN - GRAM + 1
        starts = np.arange(len(self.least))
        left = np.searchsorted(self.at, starts + width - 1, side="right") - 1
        open_ = starts
        while len(open_):  # the last anchor of the window that has the window's minimum
            off = self.h[self.at[left[open_]]] != self.least[open_]
            open_ = open_[off]
            left[open_] -= 1
        good = np.isin(self.h[self.at[left]], wanted)
        edge = np.nonzero(np.concatenate(([True], left[1:] != left[:-1])))[0]
        size = np.diff(np.append(edge, len(left)))
        return [(int(self.at[left[e]]), int(e), int(n)) for e, n in zip(edge, size) if good[e]]


class BlindTrie:
    """Strings of one length in order; branches hold only a position, and a string is compared once when it comes in."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # a leaf is an index, a branch [position, {byte: child}]
        self.same: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            self.same[i] = [i]
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.strings[node]
        if other == s:
            self.same[node].append(i)
            return
        both = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        at = len(s) - (both.bit_length() + 7) // 8
        self.same[i] = [i]
        parent, key, node = None, None, self.root
        while isinstance(node, list) and node[0] < at:
            parent, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node, list) and node[0] == at:
            node[1][s[at]] = i
            return
        branch = [at, {other[at]: node, s[at]: i}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def classes(self) -> Iterator[list[int]]:
        """Indexes of equal strings, classes in lexicographic order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            elif node is not None:
                yield self.same[node]


def multikey_quicksort(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): rows in the order of their words, and whether a row differs from the one before it.

    ``keys[d]`` holds the rows' words at depth d.  All segments that are still unsorted are partitioned together, each
    about its own pivot's word into less, equal and greater; the equal part goes on at the next depth.
    """
    n = len(keys[0])
    words = np.stack(keys)
    order = np.arange(n)
    first = np.zeros(n, dtype=bool)
    first[:1] = True
    # of every open segment: where it begins in ``order``, its size and depth
    begin, size, depth = (np.array([x]) for x in (0, n, 0))
    rounds = 0
    while True:
        wide = (size > 1) & (depth < len(keys))
        begin, size, depth = begin[wide], size[wide], depth[wide]
        if not len(begin):
            return order, first
        seg = np.repeat(np.arange(len(begin)), size)
        at = np.arange(len(seg)) + np.repeat(begin - (np.cumsum(size) - size), size)
        rows = order[at]
        # the middle row of a segment, moved about from round to round, gives the pivot
        pivot = words[depth, order[begin + (size * (2 + rounds % 3)) // 6]]
        own, mid = words[depth[seg], rows], pivot[seg]
        part = 3 * seg + 1 + (own > mid).astype(np.int64) - (own < mid)
        order[at] = rows[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=3 * len(begin)).reshape(-1, 3)
        starts = begin[:, None] + np.cumsum(count, axis=1) - count
        first[starts[count > 0]] = True
        begin, size = starts.ravel(), count.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        rounds += 1


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(order, class) of the suffixes at ``starts`` by their first ``depth`` bytes; equal suffixes share a class number.

    The caller guarantees ``depth`` bytes behind every start.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = padded[:-7]
    for k in range(1, 8):
        word = (word << np.uint64(8)) | padded[k : len(padded) - 7 + k]
    order, fresh = multikey_quicksort([word[starts + 8 * k] for k in range(SHALLOW // 8)])
    begin = np.nonzero(fresh)[0]
    size = np.diff(np.append(begin, len(order)))
    raw = data.tobytes()
    for g, n in zip(begin[size > 1].tolist(), size[size > 1].tolist()):
        members = order[g : g + n].copy()
        trie = BlindTrie([raw[s + SHALLOW : s + depth] for s in starts[members].tolist()])
        at = g
        for same in trie.classes():
            fresh[at] = True
            order[at : at + len(same)] = members[same]
            fresh[at + 1 : at + len(same)] = False
            at += len(same)
    number = np.empty(len(starts), dtype=np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order, number


def repeats_of_group(docs: np.ndarray, ties: np.ndarray, places: np.ndarray, counts: np.ndarray, stretches: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(doc_id, tie, begin, end) of bytes covered by strings of these stretches that also start earlier in another of them."""
    at: dict[bytes, int] = {}
    kind = np.array([at.setdefault(s, len(at)) for s in stretches])
    order = np.lexsort((places, ties, docs, kind))
    new = np.concatenate(([True], kind[order][1:] != kind[order][:-1]))
    lead = order[new]
    # all but the first of equal stretches go whole, unless they are the first one's own row once more
    of = lead[np.cumsum(new) - 1]
    whole = (docs[order] != docs[of]) | (ties[order] != ties[of]) | (places[order] != places[of])
    out = [(int(docs[k]), int(ties[k]), int(places[k]), int(places[k] + counts[k] - 1 + SPAN)) for k in order[whole]]
    docs, ties, places, counts, stretches = docs[lead], ties[lead], places[lead], counts[lead], [stretches[k] for k in lead]
    lengths = np.array([len(s) for s in stretches])
    base = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(stretches)), counts)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    _, number = sort_suffixes(np.frombuffer(b"".join(stretches), np.uint8), base[owner] + inner)
    doc, tie, start = docs[owner], ties[owner], places[owner] + inner
    first = np.lexsort((start, tie, doc, number))
    lead = np.concatenate(([True], number[first][1:] != number[first][:-1]))
    again = np.ones(len(owner), dtype=bool)
    again[first[lead]] = False
    hit = np.nonzero(again)[0]
    if not len(hit):
        return out
    edge = np.nonzero(np.concatenate(([True], (owner[hit][1:] != owner[hit][:-1]) | (hit[1:] != hit[:-1] + 1))))[0]
    last = np.append(edge[1:] - 1, len(hit) - 1)
    return out + [(int(doc[hit[e]]), int(tie[hit[e]]), int(start[hit[e]]), int(start[hit[f]]) + SPAN) for e, f in zip(edge, last)]


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeated_ranges(texts: DataFrame, every: DataFrame, group_bytes: int = 2_000_000, hot_documents: int = 10_000, most_hot: int = 1_000_000) -> DataFrame:
    """(doc_id, tie, begin, end): byte ranges to remove, for ``texts`` (doc_id, tie, text), all of them not null.

    ``every`` holds at least those rows, as they are; its exchange by (doc_id, tie) is what the caller's joins use too.
    Stretches are grouped by anchor into groups that stem from about ``group_bytes`` of text each.  An anchor with at
    least ``hot_documents`` rows, and at least one row in ``most_hot`` of all, is hot: there are no more than
    ``most_hot`` of those.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hs, ds, ts, ns = [], [], [], []
            for d, i, t in zip(b["doc_id"], b["tie"], b["text"]):
                a = Anchors(np.frombuffer(utf8(t), np.uint8))
                h, n = np.unique(a.h[a.at], return_counts=True)
                hs.append(h.view(np.int64))
                ds.append(np.full(len(h), d))
                ts.append(np.full(len(h), i))
                ns.append(n)
            h, d, t, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hs, ds, ts, ns))
            _, at, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # seen in three documents of one batch: surely repeated, so its rows need no counting and scatter freely,
            # and one marker row with their number tells the other batches; a hot anchor so sends few rows to any one task
            known = times[inverse] >= 3
            key = np.where(known, mix(h.view(np.uint64) ^ mix(d.astype(np.int64).view(np.uint64))).view(np.int64), h)
            marked = times >= 3
            mark = h[at[marked]]
            yield pd.DataFrame({
                "key": np.concatenate([key, mark]), "doc_id": np.concatenate([d, np.zeros(len(mark), np.int64)]), "tie": np.concatenate([t, np.zeros(len(mark), np.int64)]),
                "h": np.concatenate([h, mark]), "n": np.concatenate([np.where(known, 0, np.minimum(n, 2)), times[marked]]), "mark": np.concatenate([np.zeros(len(h), bool), np.ones(len(mark), bool)]),
            })

    rows = map_pandas(texts, sketch, "key long, doc_id long, tie int, h long, n int, mark boolean")
    # a row known to be repeated carries n = 0 and its own key; other rows meet at key = h
    lean = rows.select("key", "doc_id", "tie", F.when(F.col("n") == 0, F.col("h")).alias("h"), "n", "mark")
    total = F.sum("n").over(Window.partitionBy("key"))
    shared = cut(lean.withColumn("total", total).where("h is not null or total >= 2").drop("n"), "anchors")
    found_rows = shared.where("not mark").count()
    hot = shared.where("h is null").groupBy(F.col("key").alias("h")).agg(F.max("total").alias("c")).where(F.col("c") >= max(hot_documents, found_rows / most_hot)).select("h")
    hot_anchors = np.sort(np.array([r["h"] for r in hot.toLocalIterator()], dtype=np.int64).view(np.uint64))
    wanted = shared.where("not mark").groupBy("doc_id", "tie").agg(F.collect_list(F.coalesce("h", "key")).alias("wanted"))
    work = every.hint("merge").join(wanted, ["doc_id", "tie"])
    groups = (every.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // group_bytes + 1

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["g", "doc_id", "tie", "start", "n", "s"]
        for b in batches:
            out, met = [], {}
            for d, i, t, w in sorted(zip(b["doc_id"], b["tie"], b["text"], b["wanted"]), key=lambda r: r[:2]):
                raw = utf8(t)
                a = Anchors(np.frombuffer(raw, np.uint8))
                for p, start, n in a.runs(np.asarray(w, dtype=np.int64).view(np.uint64)):
                    s = raw[start : start + n - 1 + SPAN]
                    h = a.h[p]
                    place = (d, i, start)
                    if met.setdefault((int(h), s), place) != place:  # not even the first of its batch: goes whole, and its text need not travel
                        out.append((hash(place) % groups, *place, n, None))
                    elif len(hot_anchors) and hot_anchors[min(np.searchsorted(hot_anchors, h), len(hot_anchors) - 1)] == h:
                        out.append((-1, *place, n, s))
                    else:
                        out.append((int(h) % groups, *place, n, s))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=cols)
                    out, met = [], {}
            yield pd.DataFrame(out, columns=cols)

    def sort_group(pdf: pd.DataFrame) -> pd.DataFrame:
        told = pdf["s"].notna()
        gone = pdf[~told]
        rows = [(d, i, a, a + n - 1 + SPAN) for d, i, a, n in zip(gone["doc_id"], gone["tie"], gone["start"], gone["n"])]
        pdf = pdf[told]
        if len(pdf):
            rows += repeats_of_group(*(pdf[c].to_numpy() for c in ("doc_id", "tie", "start", "n")), pdf["s"].tolist())
        return pd.DataFrame(rows, columns=["doc_id", "tie", "begin", "end"]).astype("int64")

    def string_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, i, start, n, s in zip(b["doc_id"], b["tie"], b["start"], b["n"], b["s"]):
                g = gram_hashes(np.frombuffer(s, np.uint8))
                parts = [g[o : o + n] for o in (0, GRAM, 2 * GRAM, SPAN - GRAM)]
                k = [mix(mix(mix(mix(parts[0] + salt) ^ parts[1]) * _STEP[0] ^ parts[2]) * _STEP[1] ^ parts[3]).view(np.int64) for salt in _STEP[2:4]]
                yield pd.DataFrame({"k1": k[0], "k2": k[1], "doc_id": d, "tie": i, "begin": start + np.arange(n)})

    shape = "doc_id long, tie int, begin long, end long"
    stretches = map_pandas(work, stretch, "g long, doc_id long, tie int, start long, n long, s binary")
    if not len(hot_anchors):
        return stretches.groupBy("g").applyInPandas(sort_group, shape)
    stretches = cut(stretches, "stretches")
    found = stretches.where("g >= 0").groupBy("g").applyInPandas(sort_group, shape)
    strings = cut(map_pandas(stretches.where("g < 0").drop("g"), string_hashes, "k1 long, k2 long, doc_id long, tie int, begin long"), "strings")
    place = F.struct("doc_id", "tie", "begin")
    first = strings.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", "first")
    again = strings.hint("merge").join(first, ["k1", "k2"]).where(place != F.col("first")).select("doc_id", "tie", "begin", (F.col("begin") + SPAN).alias("end"))
    return found.unionByName(again)


def kept_bytes(raw: bytes, ranges: list) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs) of a text."""
    spans: list[list[int]] = []
    for a, b in sorted((r["begin"], r["end"]) for r in ranges):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), sum(b - a for a, b in spans), len(spans)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs`` (doc_id, text).

    ``tie`` is the text's 32-bit hash (``hash``), which tells rows of one id apart; ``kept`` is binary.

    A byte goes if a 100-byte string that covers it also starts earlier (smaller doc_id, or the same document and
    an earlier start); strings are judged on the input and never cross documents.  Null and short texts lose nothing,
    nor do rows with a null id.  Rows equal in id and text are one document, and each gets its result; rows of one id
    with different texts are different documents, of which the one whose text has the smaller 32-bit hash is earlier.
    """
    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("tie"), "text")
    docs = tied.where("doc_id is not null and text is not null")
    # exact copies of a whole text go at once; only the first of each takes part in the search
    digest = [F.xxhash64(F.lit(k), "text") for k in (1, 2)]
    twins = docs.select("doc_id", "tie", digest[0].alias("h1"), digest[1].alias("h2"), F.octet_length("text").alias("b")).where(F.col("b") >= SPAN)
    twice = twins.groupBy("h1", "h2", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = cut(twins.join(twice, ["h1", "h2", "b"]).where("doc_id <> first").select("doc_id", "tie", F.lit(0).cast("long").alias("begin"), F.col("b").cast("long").alias("end")), "copies")
    # three merge joins by (doc_id, tie) on the same rows, so that the texts are exchanged once
    texts = docs.hint("merge").join(copies.select("doc_id", "tie"), ["doc_id", "tie"], "left_anti")
    ranges = repeated_ranges(texts, docs).unionByName(copies).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, i, t, r in zip(b["doc_id"], b["tie"], b["text"], b["ranges"]):
                raw = utf8(t)
                kept, n, spans = kept_bytes(raw, r) if r is not None else (raw, 0, 0)
                rows.append((d, i, len(raw), n, spans, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["doc_id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    every = docs.hint("merge").join(ranges, ["doc_id", "tie"], "left").select("doc_id", "tie", "text", "ranges")
    rest = tied.where("doc_id is null or text is null").select("doc_id", "tie", "text", F.lit(None).cast("array<struct<begin:bigint,end:bigint>>").alias("ranges"))
    return map_pandas(every.unionByName(rest), run, "doc_id long, tie int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``, as ``remove_repeats`` gives them."""
    return remove_repeats(docs.select("doc_id", "text")).drop("tie", "kept")
