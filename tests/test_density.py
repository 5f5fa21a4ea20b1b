"""Density clusters against a plain scan, and places too dense for comparing pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomseq.operators import density as de


def scan(points, eps, least):
    """DBSCAN by the book over (x, y, weight) in the order of (x, y): point -> smallest core point of its cluster."""
    points = sorted(points)
    near = [[j for j, q in enumerate(points) if abs(p[0] - q[0]) + abs(p[1] - q[1]) <= 2 * eps] for p in points]
    core = [sum(points[j][2] for j in n) >= least for n in near]
    label = {}
    for i in range(len(points)):
        if not core[i] or i in label:
            continue
        todo, name = [i], points[i][:2]
        while todo:
            j = todo.pop()
            if j in label:
                continue
            label[j] = name
            if core[j]:
                todo += near[j]
    return {points[j][:2]: name for j, name in label.items()}


@pytest.mark.parametrize("seed, eps, least, wide, n", [(1, 20, 3, 900, 700), (2, 20.5, 4, 500, 500), (3, 7, 3, 90, 250), (4, 30, 12, 700, 700), (5, 1, 3, 40, 400)])
def test_spot_clusters_equal_scan(spark, seed, eps, least, wide, n):
    rnd = random.Random(seed)
    spots = {(rnd.randrange(wide), rnd.randrange(wide) // (1 + rnd.randrange(3))): rnd.choice([1, 1, 1, 2]) for _ in range(n)}
    # two full cells that only their corners bring close, above, beside and across
    rows = [("a", x, y, w) for (x, y), w in spots.items()] + [("b", x, y, 1) for x in range(3) for y in range(3)]
    got = de.spot_clusters(spark.createDataFrame(rows, "k string, x long, y long, w long"), ["k"], eps, least).collect()
    want = scan([(x, y, w) for (x, y), w in spots.items()], eps, least)
    assert {(r.x, r.y): tuple(r.cluster) for r in got if r.k == "a"} == want and len(set(want.values())) > 1
    assert {tuple(r.cluster) for r in got if r.k == "b"} <= {(0, 0)}


def test_full_cells_side_by_side(spark):
    rnd = random.Random(9)
    for eps, least in ((10, 3), (6, 2)):
        rows = {}
        for k in range(30):  # groups of two stacks at distances around the reach
            dx, dy = rnd.randrange(-2 * eps - 2, 2 * eps + 3), rnd.randrange(0, 2 * eps + 3)
            for i in range(least):
                rows[k, 500 + i % 2, 500 + i // 2] = 1
                rows[k, 500 + dx + i % 2, 500 + dy + i // 2] = 1
        df = spark.createDataFrame([(f"k{k}", x, y, w) for (k, x, y), w in rows.items()], "k string, x long, y long, w long")
        got = {(r.k, r.x, r.y): tuple(r.cluster) for r in de.spot_clusters(df, ["k"], eps, least).collect()}
        want = {}
        for k in range(30):
            want |= {(f"k{k}", *p): c for p, c in scan([(x, y, w) for (n, x, y), w in rows.items() if n == k], eps, least).items()}
        assert got == want


def test_dense_place_takes_bounded_time(spark):
    rows = spark.range(100_000).select(
        F.lit("S").alias("sample"), F.concat(F.lit("r"), "id").alias("read_id"), F.lit("chr1").alias("chrom_1"), (F.col("id") % 400 + 1_000_000).alias("start_pos_1"), F.lit(1_000_900).alias("end_pos_1"),
        F.lit("chr2").alias("chrom_2"), (F.floor(F.col("id") / 400) + 2_000_000).alias("start_pos_2"), F.lit(2_000_900).alias("end_pos_2"), F.lit(60).alias("mapq_1"), F.lit(50).alias("mapq_2"), F.lit("+").alias("strand_1"), F.lit("-").alias("strand_2"),
    )
    began = time.time()
    out = de.density_clusters(rows).collect()
    assert time.time() - began < 90
    assert [(r.support, r.start_1, r.end_1, r.start_2, r.end_2, r.mapq_1, r.mapq_2) for r in out] == [(100_000, 1_000_000, 1_000_900, 2_000_000, 2_000_900, 60.0, 50.0)]


def test_cells_joined_by_outermost_points_are_not_swept(spark, monkeypatch):
    swept = []
    sweep = de._close_cells
    monkeypatch.setattr(de, "_close_cells", lambda *a: swept.append(a) or sweep(*a))
    dense = spark.range(1_600).select(F.lit("a").alias("k"), (F.col("id") % 40).alias("x"), F.floor(F.col("id") / 40).alias("y"), F.lit(1).cast("long").alias("w"))
    assert {tuple(r.cluster) for r in de.spot_clusters(dense, ["k"], 4, 3).collect()} == {(0, 0)}
    assert not swept


def test_event_table_by_hand(spark):
    shape = "sample string, read_id string, chrom string, start_pos long, end_pos long, strand string, mapq int, is_supplementary boolean"
    rows = []
    for k in range(4):
        rows += [("S", f"r{k}", "chr1", 1000 + k, 2000 + k, "+", 20, False), ("S", f"r{k}", "chr2", 9000 + k, 9500, "-", 50 + k, True)]
    rows += [("S", "r1", "chr3", 1, 300, "+", 49, True), ("S", "q", "chr1", 1000, 2000, "+", 60, False), ("T", "r1", "chr1", 1000, 2000, "+", 60, False)]
    for k in range(3):  # a side that starts at 0 makes no event
        rows += [("S", f"z{k}", "chr5", 0, 800, "+", 60, False), ("S", f"z{k}", "chr6", 5000, 5801 + k, "+", 60, True)]
    df = spark.createDataFrame(rows, shape)
    got = sorted(map(tuple, de.event_table(de.event_pairs(df)).select("chrom", "start_pos", "end_pos", "event_type", "read_count", "avg_mapping_quality", "avg_mapping_span").collect()))
    assert got == [
        ("chr1", 1000, 2003, "breakpoint_pair_primary", 4, 20.0, 1000.0), ("chr2", 9000, 9500, "breakpoint_pair_supplementary", 4, 51.5, 498.0),
        ("chr6", 5000, 5803, "breakpoint_pair_supplementary", 3, 60.0, 802.0),
    ]
    assert de.event_table(de.event_pairs(df.limit(0))).count() == 0
