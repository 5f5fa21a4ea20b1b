"""Joins that give a row once per label, however many regions of the label it meets, against a nested loop."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomseq.operators import coverage, intervals as iv

LEFT = "id long, chrom string, start_pos long, end_pos long"
RIGHT = "chrom string, start_pos long, end_pos long, gene string"


def crowd(rnd, n):
    """Copies, crowds, long and empty regions."""
    rows = [(rnd.choice(["chr1", "chr2"]), s, s + rnd.choice([0, 5, 40, 300, 9_000]), rnd.choice(["a", "b", "c"])) for s in (rnd.randrange(20_000) for _ in range(n))]
    return rows + rows[: n // 2] + [("chr1", 0, 250_000_000, "long"), ("chr1", 100, 100, "a")] + [("chr2", 50, 90, None)]


@pytest.mark.parametrize("least, width", [(0, 100), (20, 1_000), (98, 20_000)])
def test_hits_and_counts_equal_nested_loop(spark, least, width):
    rnd = random.Random(least)
    right = crowd(rnd, 80)
    left = [(i, c, s, e) for i, (c, s, e, _) in enumerate(crowd(rnd, 60))]
    pairs = Counter((x[0], y[3]) for x in left for y in right if x[1] == y[0] and min(x[3], y[2]) - max(x[2], y[1]) > least)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    key = lambda r: (r[0], r[1] or "")
    assert sorted(((r.id, r.r_gene) for r in iv.label_hits(a, b, ["gene"], least).collect()), key=key) == sorted(pairs, key=key)
    assert {(r.id, r.r_gene): r.n for r in iv.label_counts(a, b, ["gene"], least, width).collect()} == pairs
    assert sorted(r.id for r in iv.touching(a, b, least).collect()) == sorted({i for i, _ in pairs})


def test_a_crowd_of_regions_is_met_once_per_gene(spark):
    crowded = spark.range(5_000).select(F.lit("chr1").alias("chrom"), (F.col("id") % 40 * 100).alias("start_pos"), (F.col("id") % 40 * 100 + 8_000).alias("end_pos"), F.concat(F.lit("G"), F.col("id") % 2).alias("gene"))
    read = spark.createDataFrame([(1, "chr1", 5_000, 5_300)], LEFT)
    assert iv.stretches(crowded, ["gene"], 99).count() == 2
    assert sorted((r.r_gene, r.n) for r in iv.label_counts(read, crowded, ["gene"]).collect()) == [("G0", 2_500), ("G1", 2_500)]


def test_reads_of_one_place_meet_a_target_as_one_row(spark):
    reads = spark.createDataFrame([("r", "chr1", 0, 100, False)] * 3 + [(None, "chr1", 0, 100, False), ("q", "chr1", 50, 60, True)], "read_id string, chrom string, start_pos long, end_pos long, is_supplementary boolean")
    t = spark.createDataFrame([("chr1", 40, 140, "x"), ("chr2", 0, 9, "y")], RIGHT)
    assert sorted((r.gene, r.bases) for r in coverage.target_coverage(reads, t).collect()) == [("x", 250), ("y", 0)]
    assert sorted((r.gene, r.reads) for r in coverage.reads_per_target(reads, t).collect()) == [("x", 3), ("y", 0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_meet_a_small_set_of_regions_where_they_lie(spark):
    reads = spark.range(1_000).select("id", F.lit("chr1").alias("chrom"), (F.col("id") * 10).alias("start_pos"), (F.col("id") * 10 + 300).alias("end_pos"))
    genes = spark.createDataFrame([("chr1", 100, 5_000, "a"), ("chr1", 400, 6_000, "a"), ("chr1", 0, 50, "b")], RIGHT)
    counts, hits = iv.label_counts(reads, genes, ["gene"]), iv.label_hits(reads, genes, ["gene"])
    assert "Window" not in plan(counts)
    assert "Exchange hashpartitioning" not in plan(hits) and "Window" not in plan(hits)
    assert counts.agg(F.sum("n")).head()[0] == sum(min(i * 10 + 300, e) - max(i * 10, s) > 99 for i in range(1_000) for s, e in ((100, 5_000), (400, 6_000)))


def test_counts_without_broadcast_equal_those_with_it(spark, monkeypatch):
    rnd = random.Random(7)
    a, b = spark.createDataFrame([(i, c, s, e) for i, (c, s, e, _) in enumerate(crowd(rnd, 60))], LEFT), spark.createDataFrame(crowd(rnd, 80), RIGHT)
    few = sorted(map(str, iv.label_counts(a, b, ["gene"], 20).collect()))
    monkeypatch.setattr(iv, "STEP_ROWS", 10)
    assert sorted(map(str, iv.label_counts(a, b, ["gene"], 20).collect())) == few
