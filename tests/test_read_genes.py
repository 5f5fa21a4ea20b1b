"""Genes of a read are gathered once, without a join of the hits with themselves."""

from loomseq.operators import fusion as fu

HITS = "sample string, read_id string, gene string"


def test_pair_support_makes_no_join_and_counts_reads_once(spark):
    rows = [("S", f"r{i}", g) for i in range(4) for g in ("a", "b", "b", "c")] + [("S", "x", "a"), ("S", None, "a"), ("S", None, "b"), ("S", "y", None), ("S", "y", "a")]
    got = fu.pair_support(spark.createDataFrame(rows, HITS))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.gene_1, r.gene_2, r.support) for r in got.collect()) == [("a", "b", 4), ("a", "c", 4), ("b", "c", 4)]


def test_tags_of_reads_with_several_genes_come_from_the_hits(spark):
    rows = [("S", "r", "b"), ("S", "r", "a"), ("S", "q", "a"), ("T", "q", "b"), ("S", "n", None), ("S", "n", "a")]
    assert [tuple(r) for r in fu.read_tags(spark.createDataFrame(rows, HITS), genes=2).collect()] == [("S", "r", "a,b")]
    edges = fu.pair_edges(spark.createDataFrame(rows, HITS))
    assert [(r.src, r.dst, r.n) for r in edges.collect()] == [("a", "b", 1)]
