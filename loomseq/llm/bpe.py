"""BPE encoding and decoding with a contiguous rank array per word.

Each distinct word is merged once per worker: part boundaries and the ranks of adjacent pairs are held side by
side, the smallest rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed.  Long
words take the same merges in the same order from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomseq.llm.common import map_pandas

_NONE = 1 << 60
#: Words of more bytes are merged with a heap: the scan is for short words.
LONG_WORD = 96
_WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Below these characters nothing composes and lower case is the same in every Unicode version.
_BEYOND = re.compile("[^\u0000-\u02ff]")
_CONTROLS = re.compile("[\x1c-\x1f]")

# Letters and numbers that Unicode gained after the tokenizer library's tables; there they are symbols.
_NEWER = re.compile(
    "[՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟝꟢꟱꭬-꭭"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-end BPE vocabulary (lower case, white space dropped) read from a tokenizer file."""

    def __init__(self, path: str, cache_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
        self.alphabet = byte_alphabet()
        self.cache_words = cache_words
        #: the file's own normaliser: its Unicode tables decide on composed and lower-case forms
        self.normalised = Tokenizer.from_file(path).normalizer.normalize_str
        self.white = regex.compile(f"[{_WHITE}]+")
        self.ids: dict[str, tuple[int, ...]] = {}
        self.packed: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one word by the contiguous rank array."""
        sym = [self.alphabet[b] for b in word.encode("utf-8", "surrogatepass")]
        sym[-1] += self.end
        parts = [self.vocab[s] for s in sym]
        if len(parts) > LONG_WORD:
            return self.merge_long(parts)
        rank_of = self.ranks.get
        ranks = [rank_of(p, _NONE) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            parts[i] = self.merged[best]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank_of((parts[i], parts[i + 1]), _NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """As ``merge``, for long words: a heap of (rank, place) over linked parts, so that no merge scans them all.

        Stale entries are those whose place is gone or whose pair has another rank by now.
        """
        n, rank_of = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = bytearray(n)
        heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := rank_of(p)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or rank_of((parts[i], parts[j])) != rank:
                continue
            parts[i] = self.merged[rank]
            gone[j] = 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank_of((parts[i], parts[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank_of((parts[before[i]], parts[i]))) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [p for p, g in zip(parts, gone) if not g]

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.ids.get(word)
        if ids is None:
            if len(self.ids) >= self.cache_words:
                self.ids.clear()
            ids = self.ids[word] = tuple(self.merge(word))
        return ids

    def _learn(self, chunk: str) -> None:
        """Remember a stretch without white space; no word crosses white space."""
        if chunk.isascii() or not _NEWER.search(chunk):
            words = self.words.findall(chunk)
        else:
            words = [chunk[w.start() : w.end()] for w in self.words.finditer(_NEWER.sub("\ue000", chunk))]
        ids = [i for w in words for i in self._word(w)]
        self.packed[chunk] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        ids = []
        for k, piece in enumerate(self.special_split.split(text)):
            if k % 2:
                ids.append(struct.pack("<I", self.special[piece]))
                continue
            low = self.normalised(piece) if _BEYOND.search(piece) else piece.lower()
            # str.split also cuts at four control characters that are not white space here
            chunks = list(filter(None, self.white.split(low))) if _CONTROLS.search(low) else low.split()
            for c in set(chunks).difference(self.packed):
                self._learn(c)
            ids.extend(map(self.packed.__getitem__, chunks))
        if len(self.packed) >= self.cache_words:
            self.packed.clear()
        return b"".join(ids)

    def decode(self, packed: bytes) -> str:
        """Without a decoder in the file, tokens are joined by blanks, special ones included."""
        return " ".join(map(self.name.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row; null text counts as empty, repeated rows are encoded each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(path)
        for b in batches:
            got = [bpe.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "ids": [np.frombuffer(a, "<u4").tolist() for a in got], "decoded": [bpe.decode(a) for a in got]})

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_pandas(src, run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def encode_digest(docs: DataFrame, path: str) -> DataFrame:
    """Token count and checksums of ids and of the decoded text for every document (doc_id, text).

    Null text counts as empty; rows that repeat are encoded each; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(path)
        for b in batches:
            got = [bpe.encode(t or "") for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_tokens": [len(a) // 4 for a in got],
                "ids_sha256": [hashlib.sha256(a).hexdigest() for a in got],
                "decoded_sha256": [hashlib.sha256(bpe.decode(a).encode("utf-8", "surrogatepass")).hexdigest() for a in got],
            })

    return map_pandas(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
