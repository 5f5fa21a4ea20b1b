"""The registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import alignment, bpe, hnsw, langid, line_dedup, mixing, ngram_join, packing, sharding, suffix_dedup, topk, toxicity, whitening
from loomseq.llm.common import cut, table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_pieces(cut(packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.lines_digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats_digest(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_documents(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_digest(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return alignment.align_digest(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in (op1_embedding_dedup, op2_toxicity, op3_langid, op4_bpe, op5_packing, op6_line_dedup, op7_suffix_dedup, op8_sharding, op9_ngram_join, op10_topk, op11_mixing, op12_whitening, op13_alignment, pipeline)}


def oracle_sql():
    return {
        "op1_embedding_dedup": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings
                WHERE embedding IS NOT NULL AND label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
                  AND len([x for x in embedding if x <> 0]) > 0),
            links AS (
                SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
            reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
            SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, min(r.r) AS component_id, min(r.r) = e.vec_id AS kept
            FROM embeddings e JOIN reach r ON r.id = e.vec_id GROUP BY e.vec_id""",
        "op10_topk": """
            WITH v AS (
                SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len(embedding) > 0)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score,
                       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS rank
                FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
            WHERE rank <= 5""",
    }
