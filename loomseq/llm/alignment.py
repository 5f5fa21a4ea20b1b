"""Cross-tokenizer alignment: which tokens of one vocabulary end where tokens of another one end, over a corpus.

A text's tokens under A (byte-level BPE) and B (pieces with byte fallback) are laid out over the same bytes; where both
end, a group ends.  Groups of one token each hold the same bytes on both sides, so an A id alone names them: a table
A id -> B id of the same bytes is made beforehand and such groups are counted in vectors of the vocabulary's length.  Only the
links of other groups are shuffled as pairs, folded within a block of documents.  Each block then gets the
corpus-wide counts of its own pairs back, so that no table of all pairs is shipped to every task.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loomseq.llm.bpe import byte_alphabet
from loomseq.llm.common import cut, drop_cut, keyed

#: A block of documents ends after so many tokens (or after one document with more).
BLOCK_TOKENS = 2_000_000
NONE = -1


class Aligner:
    """Both tokenizers, their tokens' bytes and the table from A ids to B ids of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        special = {t["content"] for t in spec["added_tokens"]}
        bytes_a = {i: t.encode() if t in special else bytes(map(byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.n_a, self.n_b = max(bytes_a) + 1, len(self.bytes_b)
        self.bytes_a = [bytes_a.get(i, b"") for i in range(self.n_a)]
        self.len_a, self.len_b = (np.array([len(t) for t in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        own = {}
        for i, t in enumerate(self.bytes_b):
            own.setdefault(t, i)  # of several B ids with the same bytes the smallest; groups with another one are irregular
        self.same = np.array([own.get(t, NONE) for t in self.bytes_a], dtype=np.int64)
        self.encode_a = self._encoder_a(path_a, spec, special)
        self.text = [f"{i}{end}" for n, mid, last in ((self.n_a, ",", "|"), (self.n_b, ",", ";")) for end in (mid, last) for i in range(n)]

    def _encoder_a(self, path: str, spec: dict, special: set):
        """Ids of a text with strings of special tokens as plain text; by ranks where the file's ids are ranks."""
        vocab, merges = spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        before = spec["pre_tokenizer"]
        if spec["normalizer"] is None and before["type"] == "ByteLevel" and not before["add_prefix_space"] and [vocab[a + b] for a, b in merges] == list(range(256, 256 + len(merges))):
            import public_tokenizers
            import tiktoken

            ranks = {t: i for i, t in enumerate(self.bytes_a[: 256 + len(merges)])}
            return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        tok.no_padding()
        tok.no_truncation()
        return lambda text: tok.encode(text, add_special_tokens=False).ids

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of space + text under A and of the text under B; none of either where the bytes they join to are others."""
        pieces = iter(self.b.encode([t for t in texts if t], num_threads=1))
        for t in texts:
            if t:
                ids, own, want = self.encode_a(f" {t}"), next(pieces), f" {t}".encode()
                if b"".join(map(self.bytes_b.__getitem__, own)) == want and b"".join(map(self.bytes_a.__getitem__, ids)) == want:
                    yield np.array(ids, dtype=np.int64), np.array(own, dtype=np.int64)
                    continue
            yield np.empty(0, np.int64), np.empty(0, np.int64)

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the place of its last A token and of its last B token."""
        _, i, j = np.intersect1d(self.len_a[a].cumsum(), self.len_b[b].cumsum(), assume_unique=True, return_indices=True)
        return i, j

    def written(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: every token's text with what follows it, in the order of groups, A before B."""
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[i], last_b[j] = True, True
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        before = np.concatenate([[0], j + 1])[group_a]
        out = np.empty(len(a) + len(b), dtype=np.int64)
        out[np.arange(len(a)) + before] = a + np.where(last_a, self.n_a, 0)
        out[np.arange(len(b)) + (i + 1)[group_b]] = 2 * self.n_a + b + np.where(last_b, self.n_b, 0)
        return "".join(map(self.text.__getitem__, out.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One per worker process and pair of files."""
    return Aligner(path_a, path_b)


def _counts(x: np.ndarray) -> tuple[bytes, bytes]:
    """Different values and how often each occurs, as little-endian 64-bit numbers."""
    v, n = np.unique(x, return_counts=True)
    return v.astype("<i8").tobytes(), n.astype("<i8").tobytes()


def _ints(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", "<i8")


ROW = "block_row boolean, block long, n_a long, n_b long, n_groups long, groups_sha256 string, same binary, same_n binary, odd binary, odd_n binary"


def laid_out(docs: DataFrame, key: str, path_a: str, path_b: str, block_tokens: int) -> DataFrame:
    """One row per document, and one per block (``block_row``) with the block's links in sum.

    ``same``: A ids of one-to-one groups of equal bytes; ``odd``: other links as A id * size of B + B id; each with counts.
    """
    schema = keyed("id", docs.schema[key].dataType, ROW)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, task = aligner(path_a, path_b), TaskContext.get().partitionId()
        block, held, same, odd = 0, 0, [], []

        def close() -> pa.RecordBatch:
            s, o = _counts(np.concatenate(same or [[]]).astype(np.int64)), _counts(np.concatenate(odd or [[]]).astype(np.int64))
            row = (None, True, (task << 32) + block, 0, 0, 0, "", *s, *o)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            ids, rows, places = batch.column("id"), [], []

            def flush() -> pa.RecordBatch:
                cols = [ids.take(pa.array(places, pa.int64())), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))]
                return pa.RecordBatch.from_arrays(cols, schema=arrow)

            for s in range(0, batch.num_rows, 64):
                for k, (a, b) in enumerate(al.tokens(batch.column("text").slice(s, 64).to_pylist())):
                    i, j = al.groups(a, b)
                    la, lb = a[i], b[j]
                    one = (np.diff(i, prepend=-1) == 1) & (np.diff(j, prepend=-1) == 1) & (al.same[la] == lb)
                    own, others = la[one], la[~one] * al.n_b + lb[~one]
                    sha = hashlib.sha256(al.written(a, b, i, j).encode()).hexdigest() if len(i) else ""
                    rows.append((False, (task << 32) + block, len(a), len(b), len(i), sha, *_counts(own), *_counts(others)))
                    places.append(s + k)
                    same.append(own)
                    odd.append(others)
                    held += len(a) + len(b)
                    if held >= block_tokens:
                        yield flush()
                        yield close()
                        rows, places, same, odd, held, block = [], [], [], [], 0, block + 1
            if rows:
                yield flush()
        if same:
            yield close()

    return docs.select(F.col(f"`{key}`").alias("id"), F.col("`text`").alias("text")).mapInArrow(run, schema)


def align(
    docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", block_tokens: int = BLOCK_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): what each document's alignment is, and the corpus-wide table of linked id pairs.

    documents: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.  Tokens that end together are linked; as no
    token is empty, a group holds exactly one link, that of its last tokens.  A pair's count is the number of
    links that hold it; a link is best if no other A id is linked more often with its B id.
    pairs: id_a, id_b, count, best.

    Null and empty texts, and texts one tokenizer changes (so that its tokens do not join to space + text), have no tokens:
    zeros and an empty digest.  Null and repeated ids are rows like any other.  An empty table gives two empty results.
    Other columns are not read.
    """
    rows = cut(laid_out(docs, key, path_a, path_b, block_tokens), "aligned")
    blocks = rows.where("block_row")
    al = aligner(path_a, path_b)
    n_b, size, same_b = al.n_b, al.n_a, al.same

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for v, n in zip(b.column("same").to_pylist(), b.column("same_n").to_pylist()):
                total[_ints(v)] += _ints(n)
        met = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(met * n_b + same_b[met]), pa.array(total[met])], names=["code", "n"])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, v, n in zip(*(b.column(c).to_pylist() for c in ("block", "odd", "odd_n"))):
                codes = _ints(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block, dtype=np.int64)), pa.array(codes), pa.array(_ints(n))], names=["block", "code", "n"])

    regular = blocks.select("same", "same_n").mapInArrow(vectors, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"), F.lit(True).alias("one"))
    met = cut(blocks.select("block", "odd", "odd_n").mapInArrow(exploded, "block long, code long, n long"), "alignedpairs")
    counts = regular.unionByName(met.groupBy("code").agg(F.sum("n").alias("n")).withColumn("one", F.lit(False)))
    counts = counts.groupBy("code").agg(F.sum("n").alias("n"), F.max("one").alias("one")).withColumn("b", F.col("code") % n_b)
    counts = cut(counts, "aligncounts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    pairs = cut(counts.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"), "one"), "alignbest")
    drop_cut(counts)
    # at most one row per A id
    vector = pairs.where("one").select("code", "n", "best").toPandas()
    of_a, best_a = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    of_a[vector["code"].to_numpy() // n_b], best_a[vector["code"].to_numpy() // n_b] = vector["n"].to_numpy(), vector["best"].to_numpy()
    told = met.select("block", "code").join(pairs.select("code", "n", "best"), "code")
    shape = keyed(key, rows.schema["id"].dataType, "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    arrow = to_arrow_schema(shape)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        code, n, best = (right.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        code, n, best = code[order], n[order], best[order]
        best_links, sums = [], []
        for same, same_n, odd, odd_n in zip(*(left.column(c).to_pylist() for c in ("same", "same_n", "odd", "odd_n"))):
            a, k, o, m = _ints(same), _ints(same_n), _ints(odd), _ints(odd_n)
            at = np.searchsorted(code, o)
            best_links.append(int(k[best_a[a]].sum() + m[best[at]].sum()))
            sums.append(int((of_a[a] * k).sum() + (n[at] * m).sum()))
        cols = [left.column("id"), *(left.column(c) for c in ("n_a", "n_b", "n_groups", "n_groups")), pa.array(best_links, pa.int64()), pa.array(sums, pa.int64()), left.column("groups_sha256")]
        return pa.Table.from_arrays(cols, schema=arrow)

    out = rows.where("not block_row").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(summed, shape)
    table = pairs.select(F.floor(F.col("code") / n_b).cast("int").alias("id_a"), (F.col("code") % n_b).cast("int").alias("id_b"), F.col("n").alias("count"), "best")
    return out, table


def align_digest(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    return align(docs, path_a, path_b)[0]
