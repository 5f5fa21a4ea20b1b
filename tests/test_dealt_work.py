"""Work that is dealt out by places: greedy clusters in one sorted walk per task, site pairs by place."""

import random

from loomseq.operators import fusion, methylation

PAIRS = "sample string, read_id string, gene_1 string, gene_2 string, chrom_1 string, chrom_2 string, pos_1 long, pos_2 long, mapq long"


def plain(rows, distance, least):
    """The loop over all rows of a gene pair, with the list of all its seeds."""
    out = []
    for key in sorted({r[2:6] for r in rows}):
        seeds = []
        for s, i, *_, a, b, _q in sorted((r for r in rows if r[2:6] == key), key=lambda r: (r[6], r[7], r[0], r[1])):
            hit = next((x for x in seeds if abs(x[0] - a) <= distance and abs(x[1] - b) <= distance), None)
            if hit is None:
                hit = (a, b, set())
                seeds.append(hit)
            hit[2].add((s, i))
        out += [(*key, a, b, len(n)) for a, b, n in seeds if len(n) >= least]
    return sorted(out)


def test_greedy_clusters_equal_the_plain_loop_over_many_small_groups(spark, capsys):
    rnd = random.Random(4)
    rows = [("s", f"r{i}", f"A{rnd.randrange(30)}", "B", "chr1", rnd.choice(["chr2", "chr3"]), rnd.randrange(3_000), rnd.randrange(500), 60) for i in range(3_000)]
    got = fusion.greedy_clusters(spark.createDataFrame(rows, PAIRS).repartition(7), 100, 2)
    got.explain()
    # no call of Python per group
    assert "FlatMapGroups" not in capsys.readouterr().out
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 100, 2)


def test_site_pairs_of_one_place_and_of_several(spark):
    bed = [("s", "chr1", 4, "+", 10, 50.0), ("s", "chr1", 5, "-", 30, 10.0), ("s", "chr1", 9, "+", 4, 100.0), ("t", "chr1", 5, "-", 8, 25.0)]
    pairs = [("a", "chr1", 5, 6), ("b", "chr1", 5, 6), ("b", "chr1", 10, 11), ("c", "chr2", 5, 6)]
    out = methylation.site_pairs(
        spark.createDataFrame(bed, "sample string, chrom string, pos long, strand string, valid_cov long, percent_modified double"), spark.createDataFrame(pairs, "pair_id string, chrom string, p1 long, p2 long"))
    # pairs of one place meet its sums, not its calls
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 2
    got = sorted(tuple(r) for r in out.select("sample", "pair_id", "forward_cov", "reverse_cov", "total_cov", "total_mod", "meth_pct").collect())
    assert got == [("s", "a", 10, 30, 40, 8, 20.0), ("s", "b", 14, 30, 44, 12, 27.27), ("t", "a", 0, 8, 8, 2, 25.0), ("t", "b", 0, 8, 8, 2, 25.0)]
