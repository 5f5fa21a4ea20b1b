"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector; an n-gram is the product (binding) of its letters' vectors, each rotated
by its place; a text is the sum (bundle) of its n-grams; a language's prototype is the bundle of its training
texts.  A document takes the language whose prototype has the greatest cosine with its own vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from loomseq.llm.common import map_pandas

DIM = 1024
MAX_LANGUAGES = 1_000
UNKNOWN = "und"
_PLACE = 1 << 21


class GramSpace:
    """Letter trigrams of a text and their vectors; letter vectors come from a seed and the code point alone."""

    def __init__(self, dim: int = DIM, seed: int = 7, cache_grams: int = 16_000):
        self.dim, self.seed, self.cache_grams = dim, seed, cache_grams
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((0, dim), dtype=np.float32)
        self.fold = np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            v = np.random.default_rng((self.seed, code)).integers(0, 2, self.dim).astype(np.float32) * 2 - 1
            self.letters[code] = v
        return v

    def gram(self, code: int) -> np.ndarray:
        a, rest = divmod(code, _PLACE * _PLACE)
        b, c = divmod(rest, _PLACE)
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams and counts; every stretch of non-letters counts as one boundary letter.  No letter, no grams."""
        codes = self.fold[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
        if not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        return np.unique((codes[:-2] * _PLACE + codes[1:-1]) * _PLACE + codes[2:], return_counts=True)

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct grams; the commonest stay cached up to ``cache_grams`` rows."""
        out = np.empty((len(grams), self.dim), dtype=np.float32)
        known, at = [], []
        for i, g in enumerate(grams.tolist()):
            row = self.rows.get(g)
            if row is None:
                v = self.gram(g)
                out[i] = v
                if len(self.rows) < self.cache_grams:
                    row = self.rows[g] = len(self.rows)
                    if row >= len(self.vectors):
                        grown = np.zeros((min(self.cache_grams, 2 * row + 256), self.dim), dtype=np.float32)
                        grown[:row] = self.vectors
                        self.vectors = grown
                    self.vectors[row] = v
            else:
                known.append(i)
                at.append(row)
        if at:
            out[known] = self.vectors[at]
        return out

    def bundle(self, texts: list[str]) -> np.ndarray:
        """One vector per text (zero where there is no letter): counts of the group's grams times their vectors."""
        found = [self.grams(t) for t in texts]
        codes = np.concatenate([f[0] for f in found])
        if not len(codes):
            return np.zeros((len(texts), self.dim), dtype=np.float32)
        grams, at = np.unique(codes, return_inverse=True)
        counts = np.zeros((len(texts), len(grams)), dtype=np.float32)
        counts[np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]), at] = np.concatenate([f[1] for f in found])
        return counts @ self.rows_of(grams)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: remainder 1 of crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def learn(train: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototype of each language, as a vector of length 1, from every row with a text and a language.

    Each task bundles what it reads and returns one vector per language, in pieces that Spark sums; the driver
    receives languages x dim numbers (at most ``MAX_LANGUAGES`` languages).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = GramSpace(dim)
        sums: dict[str, dict[int, int]] = {}
        for b in batches:
            for t, name in zip(b["text"], b["lang"]):
                own = sums.setdefault(name, {})
                for g, c in zip(*(x.tolist() for x in space.grams(t))):
                    own[g] = own.get(g, 0) + c
                if len(own) > 200_000:
                    yield pieces(space, name, own)
                    own.clear()
        for name, own in sums.items():
            if own:
                yield pieces(space, name, own)

    def pieces(space: GramSpace, name: str, own: dict[int, int]) -> pd.DataFrame:
        total = np.zeros(dim)
        for g, c in own.items():
            total += c * space.gram(g)
        return pd.DataFrame({"lang": name, "k": np.arange(dim), "v": total})

    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    summed = map_pandas(rows, run, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in summed.limit(MAX_LANGUAGES * dim + 1).toLocalIterator():
        if r["lang"] not in out and len(out) >= MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        out.setdefault(r["lang"], np.zeros(dim))[r["k"]] = r["v"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict_rows(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dim: int = DIM, group: int = 64) -> DataFrame:
    """Every row of ``docs`` (with the column ``text``) and all its columns, plus ``lang_pred`` and ``lang_score`` (which replace any of those names).

    The score is the cosine with the winning prototype, at least 0; ties go to the first language by name.  A
    null text, one without a letter, or a model without languages gives ``und`` and 0.
    """
    names = sorted(prototypes)
    stack = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else np.zeros((1, dim), np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = GramSpace(dim)
        for b in batches:
            lang, score = [], []
            texts = [t or "" for t in b[text]]
            for at in range(0, len(texts), group):
                v = space.bundle(texts[at : at + group])
                norm = np.linalg.norm(v, axis=1)
                near = v @ stack.T / np.maximum(norm, 1e-9)[:, None]
                for n, row in zip(norm, near):
                    k = int(row.argmax()) if n > 0 and names else -1
                    lang.append(names[k] if k >= 0 else UNKNOWN)
                    score.append(min(1.0, max(0.0, float(row[k]))) if k >= 0 else 0.0)
            yield b.assign(lang_pred=lang, lang_score=score)

    own = docs.drop("lang_pred", "lang_score")
    shape = StructType([*own.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    return map_pandas(own, run, shape)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows that are not held out, predict every row.

    A row with a null id is not learned from, and not held out; rows that repeat are learned from and predicted each.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = predict_rows(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
