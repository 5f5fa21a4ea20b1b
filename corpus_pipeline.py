"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Rows with a null ``doc_id`` cannot be told apart by the deduplicating stages and pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import langid, line_dedup, ngram_join, packing, suffix_dedup
from loomseq.llm.common import cut, drop_cut, map_pandas

#: A document goes if no language is found in it, or if it is this far from every prototype.
LEAST_COSINE = 0.05
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without letters, or unlike every learned language, go."""
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    # numbered names keep the user's columns apart from the prediction's
    cols = docs.columns
    found = langid.predict_rows(docs.toDF(*[f"c{i}" for i in range(len(cols))]), model, f"c{cols.index('text')}")
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_COSINE))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeats of earlier lines go; a document left with no line goes too."""
    rows = line_dedup.dedup_rows(docs)
    kept = rows.where(~((F.trim("text") == "") & (F.col("lines_removed") > 0)))
    return kept.select(*line_dedup.with_text(rows, docs.columns, F.col("lines_removed") > 0))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the smallest id stays."""
    groups = ngram_join.link_documents(docs, n=SHINGLE_WORDS, num=SIMILARITY_PERCENT, den=100, thin=True)
    rest = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(rest, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of strings of 100 that start earlier go; cut characters and emptied documents go too."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["doc_id"], "tie": b["tie"], "kept": [k.decode("utf-8", "ignore") for k in b["kept"]]})

    cols = docs.columns
    lost = suffix_dedup.remove_repeats(docs.select("doc_id", "text")).where("n_removed > 0").select("doc_id", "tie", "kept")
    kept = map_pandas(lost.dropDuplicates(["doc_id", "tie"]), decode, "id long, tie int, kept string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.hash("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    out = rows.hint("merge").join(kept, ["id", "tie"], "left").where("kept is null or trim(kept) <> ''")
    out = out.select("row", F.coalesce("kept", "row.text").alias("text"), F.col("kept").isNotNull().alias("cut"))
    return out.select(*line_dedup.with_text(out, cols, F.col("cut")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the kept documents' pieces into sequences of 2048 tokens."""
    pieces = cut(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return packing.pack_pieces(pieces)


STAGES = [
    ("language_id", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Language profiles, MinHash, anchors and the packing program have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_cut(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
