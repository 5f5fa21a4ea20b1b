"""Boundaries, nulls and properties on small hand-made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomseq.functions import text as tx
from loomseq.operators import cnv, coverage, density, fusion, intervals, methylation, reads, scores, variants
from loomseq.sources import tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_overlap_needs_more_than_99(spark):
    a = spark.createDataFrame([("chr1", 0, 1000, "x")], "chrom string, start_pos long, end_pos long, id string")
    b = spark.createDataFrame([("chr1", 901, 2000, "99"), ("chr1", 900, 2000, "100"), ("chr2", 0, 1000, "other")], "chrom string, start_pos long, end_pos long, name string")
    assert rows(intervals.overlap_join(a, b), "id", "r_name") == [("x", "100")]


@pytest.mark.parametrize("width", [10, 100, 5000])
def test_overlap_join_equals_nested_loop(spark, width):
    rng = np.random.default_rng(width)
    make = lambda n: [(f"chr{rng.integers(1, 3)}", int(s), int(s + rng.integers(0, 120)), i) for i, s in enumerate(rng.integers(0, 900, n))]
    left, right = make(60), make(60)
    shape = "chrom string, start_pos long, end_pos long, id int"
    got = rows(intervals.overlap_join(spark.createDataFrame(left, shape), spark.createDataFrame(right, shape), 5, width), "id", "r_id")
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] == b[0] and min(a[2], b[2]) - max(a[1], b[1]) > 5)
    assert got == want


def test_merge_touching_nested_and_order_free(spark):
    r = [("chr1", "+", 0, 10, "a"), ("chr1", "+", 10, 20, "b"), ("chr1", "+", 2, 4, "c"), ("chr1", "+", 21, 30, "d"), ("chr1", "-", 5, 6, "e")]
    shape = "chrom string, strand string, start_pos long, end_pos long, name string"
    want = [("chr1", 0, 20, 3), ("chr1", 5, 6, 1), ("chr1", 21, 30, 1)]
    for order in (r, r[::-1]):
        once = intervals.merge_regions(spark.createDataFrame(order, shape).repartition(3), ["chrom", "strand"], width=7)
        assert rows(once, "chrom", "start_pos", "end_pos", "n") == want
    assert rows(intervals.merge_regions(spark.createDataFrame([], shape), ["chrom", "strand"]), "n") == []


def test_quality_gate_drops_all_of_a_failing_read(spark):
    a = spark.createDataFrame([("s", "r1", False, 11.9), ("s", "r1", True, 30.0), ("s", "r2", False, 12.0), ("s", "r3", False, None), ("s", "r4", True, 5.0)], "sample string, read_id string, is_supplementary boolean, qs double")
    assert rows(reads.quality_gate(a), "read_id") == [("r2",), ("r3",), ("r4",)]


def test_sa_tag_with_and_without_cigar(spark):
    a = spark.createDataFrame([("s", "r", "chr1,100,+,300M,60,0;chr2,5,-,*,60,0;chrM,1,+,900M,60,0;chr3,7,+,10S290M5D,50,1;"), ("s", "q", None)], "sample string, read_id string, sa string")
    assert rows(reads.supplementary_from_tag(a), "chrom", "start_pos", "end_pos") == [("chr1", 100, 400), ("chr3", 7, 307)]


def test_pileup_ties_and_threshold(spark):
    c = [("s", "r1", "chr1", 5, "+", "m", 177), ("s", "r2", "chr1", 5, "+", "m", 178), ("s", "r3", "chr1", 5, "+", "m", 0), ("s", "r4", "chr1", 9, "+", "m", 120)]
    df = spark.createDataFrame(c, "sample string, read_id string, chrom string, pos long, strand string, mod_code string, prob int")
    assert rows(methylation.pileup_combined(df), "pos", "n_mod", "n_canonical", "n_fail", "percent") == [(5, 1, 1, 1, 33.33)]


def test_probe_vote_of_even_split_is_no_call(spark):
    probes = spark.createDataFrame([("p", "1", 100), ("q", "1", 500)], "probe_id string, chrom string, start_pos long")
    calls = spark.createDataFrame([("1", 75, 0.9), ("1", 126, 0.1), ("1", 127, 0.9), ("1", 74, 0.9), ("1", 500, 0.8), ("1", 501, 0.5)], "chrom string, pos long, score double")
    assert rows(methylation.probe_votes(probes, calls), "probe_id", "calls", "vote") == [("p", 2, 0), ("q", 2, 1)]


def test_runs_strict_threshold_and_sign_flip(spark):
    b = [("s", "chr1", i, v) for i, v in enumerate([0.5, 0.6, 0.7, -0.6, -0.5, 0.9])]
    df = spark.createDataFrame(b, "sample string, chrom string, bin long, value double")
    assert rows(cnv.runs(df, width=10), "start_pos", "end_pos", "kind") == [(10, 30, "gain"), (30, 40, "loss"), (50, 60, "gain")]


def test_change_points_cost_is_least(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 8), rng.normal(8, 1, 6)])

    def cost(cuts):
        at = [0, *cuts]
        return sum(((v[a:b] - v[a:b].mean()) ** 2).sum() + 10 for a, b in zip(at, at[1:])) - 10

    def every(start):
        yield [len(v)]
        for e in range(start + 2, len(v) - 1):
            for rest in every(e):
                yield [e, *rest]

    assert abs(cost(cnv.segment_ends(v)) - min(map(cost, every(0)))) < 1e-9
    df = spark.createDataFrame([("s", "chr1", i, 1.0) for i in range(3)], "sample string, chrom string, bin long, value double")
    assert cnv.change_points(df).count() == 0


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))]
    root = {n: n for e in edges for n in e}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = sorted((n, find(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    assert rows(fusion.components(spark.createDataFrame(edges, "src long, dst long")), "node", "component") == want
    assert fusion.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_density_clusters_of_two_stacks(spark):
    p = [("s", f"r{i}", "chr1", 1000 + i, 1000 + i, "chr2", 9000, 9000) for i in range(4)] + [("s", "far", "chr1", 90_000, 90_000, "chr2", 9000, 9000)]
    df = spark.createDataFrame(p, "sample string, read_id string, chrom_1 string, start_pos_1 long, end_pos_1 long, chrom_2 string, start_pos_2 long, end_pos_2 long")
    assert rows(density.density_clusters(df), "start_1", "end_1", "support") == [(1000, 1003, 4)]


def test_newly_supported_crosses_once(spark):
    seen = spark.createDataFrame([("g", "r1"), ("g", "r2"), ("h", "r1"), ("h", "r2"), ("h", "r3")], "gene string, read_id string")
    batch = spark.createDataFrame([("g", "r2"), ("g", "r3"), ("h", "r4"), ("k", "r1")], "gene string, read_id string")
    assert rows(fusion.newly_supported(seen, batch, ["gene"]), "gene", "support") == [("g", 3)]


def test_bed_widths_comments_and_bad_rows(spark):
    v = [("chr1\t5\t9",), ("# c",), ("",), ("chr1\t1\t2\tg\t.\t?",), ("chr1\tx\t2",), ("track name",)]
    df = tables.parse_bed(spark.createDataFrame(v, "value string"))
    assert rows(df, "chrom", "start_pos", "name", "score", "strand") == [("chr1", 1, "g", "0", "."), ("chr1", 5, ".", "0", ".")]


def test_info_values_with_equals_and_conflicting(spark):
    df = spark.createDataFrame([("CLNSIG=Conflicting_classifications_of_pathogenicity;X=a=b;FLAG",), ("NOCLNSIG=Pathogenic",)], "info string")
    got = df.select(variants.pathogenic(F.col("info")), variants.pathogenic(F.col("info"), strict=True), variants.info_map(F.col("info"))["X"]).collect()
    assert [tuple(r) for r in got] == [(True, False, "a=b"), (False, False, None)]


def test_labels_at_their_bounds(spark):
    df = spark.createDataFrame([(30.0,), (20.0,), (10.0,), (9.9,)], "v double")
    assert [r[0] for r in df.select(coverage.depth_quality(F.col("v"))).collect()] == ["Excellent", "Good", "Moderate", "Insufficient"]
    assert spark.range(1).select(tx.disease_name(F.lit("tumour_OF_brain"))).head()[0] == "Tumour of Brain"


def test_softmax_of_large_values(spark):
    z = F.array(F.lit(1000.0), F.lit(1000.0))
    assert spark.range(1).select(scores.softmax(z, F.lit(None).cast("double"))).head()[0] == [0.5, 0.5]


def test_evidence_ladder_at_its_bounds(spark):
    cols = "chrom string, pos long, A long, C long, G long, T long, coverage long, major string"
    table, wants = [], []
    cases = [
        ("A", "G", (10, 0), "no_support", "low_frequency"), ("A", "G", (0, 2), "low_support", "homozygous"), ("A", "G", (97, 3), "low_frequency", "low_frequency"),
        ("A", "G", (90, 10), "medium_frequency", "low_frequency"), ("A", "G", (80, 20), "medium_frequency", "low_frequency"), ("A", "G", (79, 21), "medium_frequency", "heterozygous"),
        ("A", "G", (70, 30), "high_frequency", "heterozygous"), ("A", "G", (20, 80), "high_frequency", "heterozygous"), ("A", "G", (19, 81), "high_frequency", "homozygous"),
        ("A", "G", (0, 0), "no_support", "unknown"), ("AT", "A", (5, 5), "indel_requires_review", "indel_requires_review"),
        ("A", "AT", (6, 4), "insertion_requires_review", "indel_requires_review"), ("C", "CT", (6, 4), "reference_mismatch", "indel_requires_review"),
    ]
    for i, (ref, alt, (a, g), level, zyg) in enumerate(cases):
        table.append(("chr1", i, a, 0, g, 0, a + g, "A" if a + g else None))
        wants.append((i, level, zyg))
    v = spark.createDataFrame([("chr1", i, c[0], c[1]) for i, c in enumerate(cases)], "chrom string, pos long, ref string, alt string")
    out = variants.evidence(v, spark.createDataFrame(table, cols)).orderBy("pos").collect()
    assert [(r.pos, r.level, r.zygosity) for r in out] == wants
    assert [(r.ref_support, r.alt_support) for r in out[10:]] == [(0, 0), (6, 0), (0, 0)]


def test_sex_and_confidence_ladders(spark):
    cases = [(0.1, -0.1, "Female"), (0.1, -0.09, "Male"), (0.05, -0.2, "Male"), (0.2, -0.05, "Male (query X/Y copy number changes)"), (0.05, -0.3, "Unknown (Query XY copy number changes)"), (0.0, 0.5, "Unknown")]
    table = [(f"s{i}", c, 0, v) for i, (x, y, _) in enumerate(cases) for c, v in (("chrX", x), ("chrY", y))]
    got = {r.sample: r.sex for r in cnv.estimate_sex(spark.createDataFrame(table, "sample string, chrom string, bin int, value double")).collect()}
    assert got == {f"s{i}": c[2] for i, c in enumerate(cases)}
    df = spark.createDataFrame([("sturgeon", 95.0), ("sturgeon", 94.9), ("nanodx", 25.0), ("random_forest", 64.9), ("other", 20.0), ("other", 19.9)], "c string, p double")
    assert [r[0].split()[0] for r in df.select(scores.confidence_label(F.col("p"), F.col("c"))).collect()] == ["High", "Medium", "Medium", "Low", "Low", "Very"]


def test_copies_of_a_region_count_their_positions_once(spark):
    pile = spark.createDataFrame([("chr1", 5, 2), ("chr1", 9, 4)], "chrom string, pos long, coverage long")
    # two strands of one place are one region for its quality
    r = spark.createDataFrame([("chr1", 0, 600, "x", "+"), ("chr1", 0, 600, "x", "-"), ("chr1", 700, 800, "y", "+")], "chrom string, start_pos long, end_pos long, name string, strand string")
    assert rows(variants.region_quality(pile, r), "name", "positions", "total", "mean") == [("x", 2, 6, 3.0), ("y", 0, 0, 0.0)]
